"""The evidence graph: claim checks, entity and fact resolution, counts and projections.

Resolution runs in rounds over whole tables instead of one mention after the other: exact names and aliases first, then
scored candidates (the nearest by vector and those that share a blocking key), and what is left becomes new. New ids come
from type and normal name, so equal mentions coincide in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablewright.functions.names import blocking_keys_of, entity_score, fact_score, normal_name
from sablewright.functions.schema import PREDICATES, STANCES, USABLE, entity_type, fact_signature, hashed_id, predicate, relation_of_predicate
from sablewright.functions.scores import confidence
from sablewright.functions.text import evidence_form, tokens
from sablewright.operators.nearest import nearest
from sablewright.shared import settled

# Thresholds of the stored resolutions.
MERGE, NEW, FACT_MERGE, FACT_NEW = 0.88, 0.55, 0.90, 0.60


def claims_of(raw: DataFrame) -> DataFrame:
    """Raw candidates as claims: names, types and predicate in the closed vocabularies, confidence within 0 and 1."""
    return raw.select(
        "paper_id",
        "chunk_index",
        F.trim(F.coalesce("subject", F.lit(""))).alias("subject"),
        entity_type(F.col("subject_type")).alias("subject_type"),
        predicate(F.col("predicate")).alias("predicate"),
        F.trim(F.coalesce("object", F.lit(""))).alias("object"),
        entity_type(F.col("object_type")).alias("object_type"),
        F.when(F.lower("stance").isin(*STANCES), F.lower("stance")).otherwise("support").alias("stance"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        confidence(F.col("confidence")).alias("confidence"),
    )


def checked(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims with ``valid`` and a reason: known chunk, names of two letters, evidence that stands in the chunk, schema."""
    joined = claims.join(chunks.select("paper_id", "chunk_index", F.col("content").alias("__content")), ["paper_id", "chunk_index"], "left")
    reason = (
        F.when(F.col("__content").isNull(), "unknown_chunk")
        .when((F.length("subject") < 2) | (F.length("object") < 2), "short_name")
        .when(F.length("evidence") < 12, "short_evidence")
        .when(F.col("subject_type").isNull() | F.col("object_type").isNull() | ~F.col("predicate").isin(*PREDICATES), "outside_schema")
        .when(~F.contains(evidence_form(F.col("__content")), evidence_form(F.col("evidence"))), "evidence_not_in_chunk")
    )
    return joined.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("__content")


def evidence_hits(items: DataFrame, chunks: DataFrame, key: list[str], item_text: str = "evidence", chunk_text: str = "content") -> DataFrame:
    """Items joined to the chunk they name, with whether their normal text stands in it."""
    return items.join(chunks, key).withColumn("found", F.contains(evidence_form(F.col(chunk_text)), evidence_form(F.col(item_text))))


#: Characters of a mention's contexts that count.
CONTEXT = 1000


def mentions(claims: DataFrame, ascii_only: bool = False) -> DataFrame:
    """One row for each type and normal name: a name as written, and its mentions' different contexts joined to 1000 characters.

    A context and the space after it take two characters at least, so that half as many contexts are all that can count.
    """
    both = claims.select(F.col("subject_type").alias("type"), F.col("subject").alias("name"), "evidence").unionByName(claims.select(F.col("object_type").alias("type"), F.col("object").alias("name"), "evidence"))
    named = both.withColumn("normal", normal_name(F.col("name"), ascii_only)).where("normal <> '' and type is not null")
    names = named.groupBy("type", "normal").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    first = Window.partitionBy("type", "normal").orderBy("evidence")
    contexts = named.where("evidence <> ''").select("type", "normal", "evidence").distinct().withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= CONTEXT // 2)
    joined = contexts.groupBy("type", "normal").agg(F.substring(F.array_join(F.array_sort(F.collect_list("evidence")), " "), 1, CONTEXT).alias("context"))
    return names.join(joined, ["type", "normal"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def resolution_text(name: Column, kind: Column, context: Column, domain: Column | None = None, relation: Column | None = None) -> Column:
    """The text whose vector stands for a mention: its parts that are not empty, joined by bars."""
    parts = [name, kind, domain, F.substring(context, 1, 500), relation]
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts if p is not None))


#: Ids of a kind that travel together, and of a blocking key from which on they are dealt to several tasks, about.
BLOCK_IDS = 2_000
#: Cells of two blocks of ids that a task gets where keys are too frequent for ``BLOCK_IDS``.
TASK_CELLS = 8


def blocks_of_keys(counts: DataFrame, tasks: int, block: int = BLOCK_IDS) -> DataFrame:
    """(__k, __n_blocks, __m_blocks): in how many blocks the ids of a key's left and right side are dealt, from counts of keys and the least and greatest first key of their ids.

    One size of blocks for all keys, ``block`` or as many ids as make ``TASK_CELLS`` cells for each task. Keys of one side only, and those whose ids all share the same lesser key, are left out.
    """
    size = counts.groupBy("__k").agg(F.sum("__n").alias("__n"), F.sum("__m").alias("__m"), F.min("__from").alias("__from"), F.max("__to").alias("__to"))
    size = size.where("__n > 0 and __m > 0 and (__from <> __to or __from = __k)")
    most = F.greatest(F.lit(float(block)), F.sqrt(F.sum(F.col("__n").cast("double") * F.col("__m")) / F.lit(TASK_CELLS * tasks))).alias("__most")
    return size.crossJoin(F.broadcast(size.agg(most))).select("__k", *(F.ceil(F.col(c) / F.col("__most")).cast("int").alias(f"{c}_blocks") for c in ("__n", "__m")))


def blocked(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: str = "blocking_keys", type_col: str = "type", carry: tuple[str, ...] = (), block: int = BLOCK_IDS, made: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs (left_id, right_id) of one type that share a blocking key, each once, with the ``carry`` columns of both as structs ``left`` and ``right``.

    Ids with the same keys and carried columns are one kind and travel as an array, at most about ``block`` of them; kinds meet, and ids become
    pairs only within the task where they do. What is said of a pair's carried columns is said once for two kinds: ``made`` gets both structs
    and gives a column ``made`` that takes their place in the result.
    The join is on the key and, where very many ids have it, on a pair of their blocks too, so that a frequent key is dealt to
    many tasks. An id is sent once for each block of the other side, so blocks grow with the pairs that there are: they make some cells for each task, not
    ever more of one size, and what is shuffled does not grow with the square of a key's ids. A pair is made at the first key that it shares, so that pairs are
    never shuffled to be told apart; a key all of whose ids share the same lesser key makes none and is left out.
    Null ids, types and keys pair with nothing. Rows that repeat an id count as one, with the keys of all of them and the least carried columns.
    """
    # keys are few bytes and pairs many rows: as many tasks as the session has partitions, not as few as the keys' bytes would fill
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(df: DataFrame, id_col: str) -> DataFrame:
        row = df.select(F.col(id_col).alias("__id"), F.col(type_col).alias("__type"), (F.struct(*carry) if carry else F.lit(0)).alias("__c"), F.explode(keys).alias("__key"))
        kind = F.col("__type").cast("string")
        row = row.dropna(subset=["__id", "__type", "__key"]).withColumn("__k", F.concat(F.length(kind), F.lit(":"), kind, "__key"))
        one = row.groupBy("__id").agg(F.array_sort(F.collect_set("__k")).alias("__all"), F.min("__c").alias("__c"))
        parts = one.groupBy("__all", "__c").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("__parts"))
        part = F.pmod(F.xxhash64("__id"), "__parts").alias("__part")
        some = one.join(parts, ["__all", "__c"]).groupBy("__all", "__c", part).agg(F.collect_list("__id").alias("__ids"))
        return some.select("__c", "__all", "__ids", F.xxhash64("__all", "__c", "__part").alias("__h"), F.posexplode("__all").alias("__at", "__k"))

    a, b = keyed(left, left_id), keyed(right, right_id)
    ids, first, none = F.sum(F.size("__ids")), F.col("__all")[0], F.lit(0).cast("long")
    ends = [F.min(first).alias("__from"), F.max(first).alias("__to")]
    size = blocks_of_keys(a.groupBy("__k").agg(ids.alias("__n"), none.alias("__m"), *ends).unionByName(b.groupBy("__k").agg(none.alias("__n"), ids.alias("__m"), *ends)), tasks, block)

    def dealt(df: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        out = df.join(size, "__k").withColumn(own, F.pmod("__h", own_blocks).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)))

    # of two that share a lesser key, both have it before this one
    before = F.slice("__all", F.lit(1), F.col("__at"))
    x = dealt(a, "__x", "__n_blocks", "__y", "__m_blocks").select("__k", "__x", "__y", F.col("__ids").alias("__left_ids"), F.col("__c").alias("left"), before.alias("__before"))
    y = dealt(b, "__y", "__m_blocks", "__x", "__n_blocks").select("__k", "__x", "__y", F.col("__ids").alias("__right_ids"), F.col("__c").alias("right"), before.alias("__r"))
    x, y = (t.repartition(tasks, "__k", "__x", "__y") for t in (x, y))
    kinds = x.join(y, ["__k", "__x", "__y"]).where(~F.arrays_overlap("__before", "__r"))
    said = ["made"] if made else ["left", "right"] if carry else []
    if made:
        kinds = kinds.withColumn("made", made(F.col("left"), F.col("right")))
    # a lambda keeps this step out of the loops that follow, so that what is made is not made again for every pair of ids
    kinds = kinds.select(F.transform("__left_ids", lambda i: i).alias("__left_ids"), "__right_ids", *said)
    # a compiled loop holds all rows that it makes of one row: a lambda between the two loops lets them hold the pairs of one id, not of two kinds
    one = kinds.withColumn("left_id", F.explode("__left_ids")).withColumn("left_id", F.transform(F.array("left_id"), lambda i: i)[0]).select("left_id", "__right_ids", *said)
    return one.withColumn("right_id", F.explode("__right_ids")).select("left_id", "right_id", *said)


def candidates(mention: DataFrame, entities: DataFrame, most: int = 8) -> DataFrame:
    """(mention_id, entity_id, similarity): for each mention the ``most`` nearest entities and the ``most`` newest that share a
    blocking key, of its type, each once.

    The similarity is the cosine of the nearest, 0 for entities that only share a key. Without ``embedding`` columns only
    the latter are candidates.
    """
    m = mention.withColumn("blocking_keys", blocking_keys_of(F.col("normal"))).withColumn("mention_id", F.concat_ws(":", "type", "normal"))
    # the newest of all that share a key are among the newest of each key, so that a frequent key makes no more rows
    of_key = Window.partitionBy("type", "key").orderBy(F.desc("updated_at"), "entity_id")
    keyed = entities.select("entity_id", "type", "updated_at", F.explode("blocking_keys").alias("key")).withColumn("__n", F.row_number().over(of_key)).where(F.col("__n") <= most)
    pairs = m.select(F.col("mention_id").alias("left_id"), "type", F.explode("blocking_keys").alias("key")).join(keyed, ["type", "key"])
    pairs = pairs.select("left_id", F.col("entity_id").alias("right_id"), "updated_at").distinct()
    w = Window.partitionBy("left_id").orderBy(F.desc("updated_at"), "right_id")
    found = pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("left_id", "right_id", F.lit(0.0).alias("similarity"))
    if "embedding" in mention.columns and "embedding" in entities.columns:
        found = nearest(m, entities, "mention_id", "entity_id", "type", most).unionByName(found)
        found = found.groupBy("left_id", "right_id").agg(F.max_by("similarity", F.abs("similarity")).alias("similarity"))
    return found.select(F.col("left_id").alias("mention_id"), F.col("right_id").alias("entity_id"), "similarity")


def route(score: Column, merge: float = MERGE, new: float = NEW) -> Column:
    """What a best score (null: no candidate) leads to; what is ambiguous waits for a decision and is new without one."""
    return F.when(score >= merge, "rule_merge").when(F.coalesce(score, F.lit(0.0)) < new, "new").otherwise("ambiguous_unresolved")


def scored_candidates(rest: DataFrame, entities: DataFrame, most: int = 8) -> DataFrame:
    """(mention_id, entity_id, score, rank): each mention's candidates by score, the best ``most``."""
    e = entities.select("entity_id", F.col("type").alias("e_type"), "canonical_normalized", "aliases", F.col("context").alias("e_context"))
    m = rest.withColumn("mention_id", F.concat_ws(":", "type", "normal"))
    pairs = m.drop("embedding").join(candidates(rest, entities, most), "mention_id").join(e, "entity_id")
    none = F.array().cast("array<string>")
    score = entity_score(F.col("type") == F.col("e_type"), F.col("normal"), F.col("canonical_normalized"), F.coalesce("aliases", none), tokens(normal_name(F.col("context"))), tokens(normal_name(F.col("e_context"))), F.col("similarity"))
    w = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    return pairs.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("mention_id", "entity_id", "score", "rank")


def resolved_entities(mention: DataFrame, entities: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Each mention's entity and route: exact, rule_merge, ambiguous_unresolved, new, or what a decision says.

    Exact names and aliases leave first (equi-joins); the rest is scored against its candidates and merged at .88 or more.
    Below .55, and without a candidate, it is new; between, it waits for a decision. ``decisions`` (mention_id, decision,
    entity_id) are those of a model or person; a merge into an entity that is no candidate, and a missing one, leave
    the mention new and marked ambiguous. Both tables may have ``embedding`` columns.
    """
    m = mention.withColumn("mention_id", F.concat_ws(":", "type", "normal"))
    spelled = entities.select("entity_id", "type", F.explode(F.array_union(F.array("canonical_normalized"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("normal"))
    # written once: what is exact and what is left are read several times from here on
    spelled = settled(m.join(spelled.groupBy("type", "normal").agg(F.min("entity_id").alias("entity_id")), ["type", "normal"], "left"))
    exact = spelled.where("entity_id is not null").select("mention_id", "type", "normal", "name", "entity_id", F.lit("exact").alias("route"), F.lit(1.0).alias("score"))
    rest = spelled.where("entity_id is null").drop("entity_id")
    ranked = scored_candidates(rest.select(*mention.columns), entities)
    best = ranked.where("rank = 1").select("mention_id", F.col("entity_id").alias("best"), "score")
    new_id = hashed_id("E", F.col("type"), F.col("normal"))
    j = rest.join(best, "mention_id", "left").withColumn("route", route(F.col("score")))
    if decisions is not None:
        allowed = decisions.join(ranked.select("mention_id", "entity_id"), ["mention_id", "entity_id"], "left_semi").where("decision = 'merge'").select("mention_id", "decision", "entity_id")
        made = allowed.unionByName(decisions.where("decision = 'new'").select("mention_id", "decision", F.lit(None).cast("string").alias("entity_id"))).dropDuplicates(["mention_id"])
        j = j.join(made.select("mention_id", "decision", F.col("entity_id").alias("decided")), "mention_id", "left")
        waits = F.col("route") == "ambiguous_unresolved"
        j = j.withColumn("best", F.when(waits & (F.col("decision") == "merge"), F.col("decided")).otherwise(F.col("best")))
        j = j.withColumn("route", F.when(waits & (F.col("decision") == "merge"), "decided_merge").when(waits & (F.col("decision") == "new"), "new").otherwise(F.col("route")))
    merged = F.col("route").isin("rule_merge", "decided_merge")
    routed = j.select("mention_id", "type", "normal", "name", F.when(merged, F.col("best")).otherwise(new_id).alias("entity_id"), "route", F.coalesce("score", F.lit(0.0)).alias("score"))
    return exact.unionByName(routed)


def grown_entities(entities: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Entities with the aliases that merges add (unless another entity of the type has them), and new entities."""
    taken = entities.select("entity_id", "type", F.explode(F.array_union(F.array("canonical_normalized"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("normal"))
    fresh = resolved.where("route in ('rule_merge', 'decided_merge')").select("entity_id", "type", "normal").join(taken.select("type", "normal").distinct(), ["type", "normal"], "left_anti")
    added = fresh.groupBy("entity_id").agg(F.array_sort(F.collect_set("normal")).alias("__more"))
    old = entities.join(added, "entity_id", "left").withColumn("aliases", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("__more", F.array().cast("array<string>")))).drop("__more")
    made = resolved.where("route in ('new', 'ambiguous_unresolved')").groupBy("entity_id").agg(F.min("type").alias("type"), F.min("name").alias("canonical_name"), F.min("normal").alias("canonical_normalized"), F.min("route").alias("resolution_status"))
    made = made.join(entities.select("entity_id"), "entity_id", "left_anti").withColumn("aliases", F.array("canonical_normalized")).withColumn("blocking_keys", blocking_keys_of(F.col("canonical_normalized"))).withColumn("updated_at", now)
    return old.unionByName(made, allowMissingColumns=True)


def _near_facts(rest: DataFrame, known: DataFrame, most: int) -> DataFrame | None:
    """(signature, fact_id, similarity) of the nearest known facts of the predicate; None without vectors on both sides."""
    if "embedding" not in rest.columns or "embedding" not in known.columns:
        return None
    return nearest(rest, known, "signature", "fact_id", "predicate", most).select(F.col("left_id").alias("signature"), F.col("right_id").alias("fact_id"), "similarity")


def _shared_facts(rest: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``rest`` with ``candidates``: the newest known facts that share the subject or object, at most ``most``, null without any.

    The newest of all that share either are among the newest of the subject and of the object. Both lists are short, so a
    fact meets two arrays instead of rows for each of their entries; they hold all that scores need, but not the part that is
    shared: ``other`` is the object where ``of_subject``, else the subject.
    """
    newest_first = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**63 - 1))
    k = known.select("fact_id", F.col("subject_id").alias("ks"), F.col("predicate").alias("kp"), F.col("object_id").alias("ko"), newest_first.alias("age"))

    def newest(by: str, other: str, name: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy("age", "fact_id")
        top = k.where(F.col(by).isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
        entry = F.struct("age", "fact_id", "kp", F.col(other).alias("other"), F.lit(by == "ks").alias("of_subject"))
        return top.groupBy(F.col(by).alias(f"__{by}")).agg(F.sort_array(F.collect_set(entry)).alias(name))

    met = rest.join(newest("ks", "ko", "__a"), F.col("subject_id") == F.col("__ks"), "left").join(newest("ko", "ks", "__b"), F.col("object_id") == F.col("__ko"), "left")

    def twice(c: Column) -> Column:
        """Whether an entry of the object's list, which shares the subject too, stands in the subject's list."""
        return c["other"].eqNullSafe(F.col("subject_id")) & F.array_contains("__a", F.struct(c["age"].alias("age"), c["fact_id"].alias("fact_id"), c["kp"].alias("kp"), F.col("object_id").alias("other"), F.lit(True).alias("of_subject")))

    # few facts have such entries; a look at the subjects alone spares the others the comparison of structs
    more = F.when(F.array_contains(F.col("__b")["other"], F.col("subject_id")), F.filter("__b", lambda c: ~twice(c))).otherwise(F.col("__b"))
    both = F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("__a")).otherwise(F.slice(F.sort_array(F.concat("__a", more)), 1, most))
    return met.withColumn("candidates", both).drop("__a", "__b", "__ks", "__ko")


def fact_candidates(rest: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """(signature, fact_id, similarity): for each fact the nearest known ones of its predicate; only where it has none, the
    newest that share its subject or object.

    A join on either is the union of two equi-joins. Without ``embedding`` columns there are only the latter.
    """
    near = _near_facts(rest, known, most)
    left = rest if near is None else rest.join(near.select("signature"), "signature", "left_anti")
    shared = _shared_facts(left, known, most).select("signature", F.explode("candidates").alias("c")).select("signature", "c.fact_id", F.lit(0.0).alias("similarity"))
    return shared if near is None else near.unionByName(shared)


def resolved_facts(facts: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """Each fact (subject_id, predicate, object_id) with the known fact it is, or a new one: signature, then score.

    Both tables may have ``embedding`` columns; of facts with one signature any vector counts, as they say the same.
    Candidates that share a part are scored within their array, so they never become rows. A null subject or object
    finds no candidate, but does not keep the other one from finding some; nulls on both sides count as equal.
    """
    own = ["subject_id", "predicate", "object_id"]
    f = facts.groupBy(*own).agg(F.first("embedding").alias("embedding")) if "embedding" in facts.columns else facts.select(*own).distinct()
    f = f.withColumn("signature", fact_signature(F.col("subject_id"), F.col("predicate"), F.col("object_id")))
    if "updated_at" not in known.columns:
        known = known.withColumn("updated_at", F.lit(None).cast("timestamp"))
    k = known.select(F.col("fact_id"), F.col("signature").alias("k_signature"), F.col("subject_id").alias("ks"), F.col("predicate").alias("kp"), F.col("object_id").alias("ko"))
    # written once: what is exact and what is left are read several times from here on
    signed = settled(f.join(k.groupBy(F.col("k_signature").alias("signature")).agg(F.min("fact_id").alias("fact_id")), "signature", "left"))
    exact = signed.where("fact_id is not null").select(*own, "signature", "fact_id", F.lit("exact").alias("route"), F.lit(1.0).alias("score"))
    rest = signed.where("fact_id is null").drop("fact_id")

    # what facts without similarity score, by the parts that agree: literals to Spark, so nothing is rounded for each candidate
    scores = F.array(*(fact_score(F.lit(bool(n & 1)), F.lit(bool(n & 2)), F.lit(bool(n & 4)), F.lit(0.0)) for n in range(8)))

    def better(c: Column) -> Column:
        subject, obj = c["of_subject"] | c["other"].eqNullSafe(F.col("subject_id")), ~c["of_subject"] | c["other"].eqNullSafe(F.col("object_id"))
        agree = subject.cast("int") + F.lit(2) * c["kp"].eqNullSafe(F.col("predicate")).cast("int") + F.lit(4) * obj.cast("int")
        return F.struct((-F.get(scores, agree)).alias("s"), c["fact_id"].alias("fact_id"))

    near = _near_facts(rest, known, most)
    left = rest
    if near is not None:
        near = settled(near)  # read twice
        left = rest.join(near.select("signature"), "signature", "left_anti")
    # named twice, the candidates stay a step of their own, whose sort is compiled; within the lambda's argument it would not be
    best = _shared_facts(left, known, most).select(*own, "signature", F.when(F.col("candidates").isNotNull(), F.array_min(F.transform("candidates", better))).alias("b"))
    if near is not None:
        scored = rest.drop("embedding").join(near, "signature").join(k.select("fact_id", F.struct("ks", "kp", "ko").alias("c")), "fact_id")
        score = fact_score(F.col("subject_id").eqNullSafe(F.col("c.ks")), F.col("predicate").eqNullSafe(F.col("c.kp")), F.col("object_id").eqNullSafe(F.col("c.ko")), F.col("similarity"))
        found = F.struct((-score).alias("s"), "fact_id")
        best = best.unionByName(scored.groupBy(*own, "signature").agg(F.min(found).alias("b")))
    routed = best.select(*own, "signature", F.col("b.fact_id").alias("best"), (-F.col("b.s")).alias("score"))
    routed = routed.select(*own, "signature", F.when(F.col("score") >= FACT_MERGE, F.col("best")).otherwise(hashed_id("F", F.col("signature"))).alias("fact_id"), route(F.col("score"), FACT_MERGE, FACT_NEW).alias("route"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return exact.unionByName(routed)


def claim_rows(claims: DataFrame) -> DataFrame:
    """Claims with their ids, from paper, chunk, fact, evidence and stance."""
    evidence_hash = F.sha2(evidence_form(F.col("evidence")).cast("binary"), 256)
    return claims.withColumn("evidence_hash", evidence_hash).withColumn("claim_id", hashed_id("C", F.col("paper_id"), F.col("chunk_index"), F.col("fact_id"), evidence_hash, F.lit("{}"), F.col("stance")))


def replaced_claims(old: DataFrame, new: DataFrame, papers: DataFrame) -> DataFrame:
    """The claims after papers were read anew: theirs are replaced, what people confirmed or rejected keeps its status."""
    kept = old.join(papers.select("paper_id").distinct(), "paper_id", "left_anti")
    human = old.where(F.col("review_status").isin("confirmed", "rejected")).select("claim_id", F.col("review_status").alias("__status"))
    fresh = new.join(human, "claim_id", "left").withColumn("review_status", F.coalesce("__status", "review_status")).drop("__status")
    human_gone = old.join(papers.select("paper_id").distinct(), "paper_id", "left_semi").where(F.col("review_status").isin("confirmed", "rejected")).join(new.select("claim_id"), "claim_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True).unionByName(human_gone, allowMissingColumns=True)


def fact_counts(claims: DataFrame, fact: str = "fact_id", stance: str = "stance", status: str = "review_status", usable: tuple[str, ...] = USABLE, waiting: str = "needs_review", support: str = "support", contradict: str = "contradict") -> DataFrame:
    """Support, contradiction and open reviews of each fact; only usable claims support or contradict."""
    ok = F.col(status).isin(*usable)
    return claims.groupBy(fact).agg(
        F.count_if(ok & (F.col(stance) == support)).alias("support_count"),
        F.count_if(ok & (F.col(stance) == contradict)).alias("contradict_count"),
        F.count_if(F.col(status) == waiting).alias("needs_review_count"),
    )


def recounted(facts: DataFrame, claims: DataFrame, touched: DataFrame) -> DataFrame:
    """Facts with new counts where claims changed; others keep theirs."""
    counts = fact_counts(claims.join(touched.select("fact_id").distinct(), "fact_id", "left_semi"))
    marked = facts.join(touched.select("fact_id").distinct().withColumn("__t", F.lit(True)), "fact_id", "left").join(counts.select("fact_id", *(F.col(c).alias(f"__{c}") for c in ("support_count", "contradict_count", "needs_review_count"))), "fact_id", "left")
    return marked.select("fact_id", *(F.when(F.col("__t"), F.coalesce(f"__{c}", F.lit(0))).otherwise(F.col(c)).alias(c) if c.endswith("_count") else F.col(c) for c in facts.columns if c != "fact_id"))


def reviewed(edges: DataFrame, claims: DataFrame, edge_ids: list[str] | DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """Edges and claims after a review of some edges (ids, or a table of them); a claim follows the edge that shows it."""
    if status not in ("confirmed", "rejected"):
        raise ValueError("a review confirms or rejects")
    if isinstance(edge_ids, list):
        edge_ids = edges.sparkSession.createDataFrame([(x,) for x in edge_ids], "edge_id string")
    ids = edge_ids.select("edge_id").distinct().withColumn("__hit", F.lit(True))
    shown = edges.join(ids, "edge_id", "left_semi").select("claim_id").distinct().withColumn("__hit", F.lit(True))
    follow = F.when(F.col("__hit"), status).otherwise(F.col("review_status"))
    new_claims = claims.join(shown, "claim_id", "left").withColumn("review_status", follow).select(*claims.columns)
    return edges.join(ids, "edge_id", "left").withColumn("review_status", follow).select(*edges.columns), new_claims


def edges_of(claims: DataFrame) -> DataFrame:
    """The projection of claims as edges of the older graph; of claims with one edge id the newest, then the least claim id."""
    target = hashed_id("N", F.col("object_type"), F.col("object"), size=20)
    out = claims.select(
        hashed_id("", F.col("paper_id"), target, F.col("predicate"), F.col("stance"), F.col("claim_id"), size=64).alias("edge_id"),
        "claim_id", F.col("paper_id").alias("source_paper_id"), target.alias("target_node_id"), F.col("object").alias("target_name"), relation_of_predicate(F.col("predicate")).alias("relation"), "review_status", "evidence",
        *(["updated_at"] if "updated_at" in claims.columns else []),
    )
    w = Window.partitionBy("edge_id").orderBy(*([F.desc("updated_at")] if "updated_at" in claims.columns else []), "claim_id")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def coverage(routes: DataFrame) -> DataFrame:
    """How many mentions or facts took each route."""
    return routes.groupBy("route").agg(F.count("*").alias("n"))
