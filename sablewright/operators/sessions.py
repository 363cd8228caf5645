"""Conversations and sessions: tails, summaries, contexts, profiles, agents' states, paper identity and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablewright.functions.text import COMPARE_WORDS, SIMILAR_WORDS, SWITCH_WORDS, arxiv_id, clipped, doi, has_any, has_word, is_search, title_form


def tail(messages: DataFrame, n: int, key: str, order: str, role: str | None = None, most: int = 500, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, context): the last ``n`` messages of each conversation in order, each as "role: text" of bounded length."""
    m = messages if role is None else messages.where(F.col(role_col) == role)
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = m.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    line = F.concat(F.col(role_col), F.lit(": "), clipped(F.col(text_col), most))
    return last.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x.line), "\n").alias("context"), F.count("*").alias("n_messages"))


def summary_due(messages: DataFrame, summarised: Column, key: str, at_least: int = 10) -> DataFrame:
    """Conversations with at least so many messages after their last summary."""
    return messages.groupBy(key).agg(F.count("*").alias("n_messages")).withColumn("open_messages", F.col("n_messages") - summarised).where(F.col("open_messages") >= at_least)


def latest_of(df: DataFrame, key: str, order: str, value: Column, where: Column) -> DataFrame:
    """The newest value of each key among the rows that fit."""
    return df.where(where).groupBy(key).agg(F.max_by(value, F.col(order)).alias("value"), F.max(order).alias("at"))


def focus(turns: DataFrame, key: str = "session_id", order: str = "turn") -> DataFrame:
    """The paper in focus after each turn: the turn's own if it resolved, else the one before; errors keep it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("status").isin("resolved", "switch") & F.col("error").isNull(), F.col("paper_id"))
    return turns.withColumn("focus", F.last(own, ignorenulls=True).over(w))


def agent_states(events: DataFrame, agents: tuple[str, ...], order: str = "seq") -> DataFrame:
    """The last status, message and time of every agent of the flow; those that never reported were skipped or wait."""
    seen = events.groupBy("run_id", "agent").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in ("status", "message", "finished_at")))
    dim = events.select("run_id").distinct().withColumn("agent", F.explode(F.array(*(F.lit(a) for a in agents))))
    return dim.join(seen, ["run_id", "agent"], "left").withColumn("status", F.coalesce("status", F.lit("skipped")))


def changed_profiles(old: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Audit rows (user_id, field, before, after) of the profile lists that changed."""
    empty = F.array().cast("array<string>")
    j = old.alias("o").join(new.alias("n"), "user_id", "full")
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(f"o.{f}", empty).alias("before"), F.coalesce(f"n.{f}", empty).alias("after")) for f in fields))
    return j.select("user_id", F.inline(rows)).where(F.col("before") != F.col("after"))


def with_unique(values: Column, more: Column) -> Column:
    """A list with what is new in another appended, compared by JSON, order kept."""
    both = F.concat(F.coalesce(values, F.array()), F.coalesce(more, F.array()))
    return F.array_distinct(both)


#: Characters of a title's normal form by which it meets questions; titles have at least as many.
ANCHOR = 6


def title_hits(turns: DataFrame, papers: DataFrame, text: str = "query") -> DataFrame:
    """(turn_id, paper_id) of titles whose normal form has six letters or more and stands in that of the question.

    Titles meet questions by their first six letters, an equi-join on every place of the question that takes no question along, and
    then in full. The places are cut out by one pass of a pattern, as counting to a place anew for each one is quadratic in the question.
    """
    q = turns.select("turn_id", title_form(F.col(text)).alias("__q")).where(F.length("__q") >= ANCHOR)
    places = q.select("turn_id", F.explode(F.regexp_extract_all("__q", F.lit(f"(?=(.{{{ANCHOR}}}))"), F.lit(1))).alias("__a"))
    titles = papers.select("paper_id", title_form(F.col("title")).alias("__t")).where(F.length("__t") >= ANCHOR).withColumn("__a", F.substring("__t", 1, ANCHOR))
    near = places.join(titles, "__a").select(F.col("turn_id").alias("__turn"), "paper_id", "__t").distinct()
    return near.join(q, F.col("turn_id").eqNullSafe(F.col("__turn"))).where(F.contains("__q", "__t")).select("turn_id", "paper_id").distinct()


def identified(turns: DataFrame, papers: DataFrame) -> DataFrame:
    """The papers of each turn and how they were found: ``paper_id``, ``paper_ids``, ``source``, ``status``, ``inherited``, ``switched_from``.

    In this order: the named target, an arXiv id, a DOI that one paper has, a title in the question (several are ambiguous; a
    comparison keeps the paper in focus and adds them), nothing if the question turns elsewhere or searches, the paper in
    focus, the newest resolved paper of the history, nothing. ``turns`` has turn_id, query, target, focus, and may have
    ``active`` (papers in focus) and ``history`` (an array of primary, paper_ids and status, the oldest first). A turn that
    finds another paper than the one in focus switches. Ids and titles are equi-joins.
    """
    ids_type, history_type = "array<string>", "array<struct<primary:string,paper_ids:array<string>,status:string>>"
    for name, kind in (("active", ids_type), ("history", history_type)):
        if name not in turns.columns:
            turns = turns.withColumn(name, F.lit(None).cast(kind))
    t = turns.withColumn("__arxiv", F.lower(arxiv_id(F.col("query")))).withColumn("__doi", F.lower(doi(F.col("query"))))
    by_doi = papers.where("doi is not null").groupBy(F.lower("doi").alias("__doi")).agg(F.min("paper_id").alias("__by_doi"), F.count("*").alias("__k")).where("__k = 1").drop("__k")
    ids = papers.select(F.lower("paper_id").alias("__arxiv")).distinct().withColumn("__has", F.lit(True))
    hits = title_hits(turns, papers).groupBy("turn_id").agg(F.array_sort(F.collect_set("paper_id")).alias("__titles"))
    j = t.join(by_doi, "__doi", "left").join(ids, "__arxiv", "left").join(hits, "turn_id", "left")

    none = F.array().cast(ids_type)
    past = F.filter(F.coalesce("history", F.array().cast(history_type)), lambda h: h.primary.isNotNull() & h.status.isin("resolved", "switch"))
    last = F.try_element_at(past, F.lit(-1))
    focus, titles, n_titles = F.col("focus"), F.coalesce("__titles", none), F.coalesce(F.size("__titles"), F.lit(0))

    def out(paper: Column, ids: Column, source: str, status: Column | str, inherited: bool) -> Column:
        status = F.lit(status) if isinstance(status, str) else status
        return F.struct(paper.cast("string").alias("paper_id"), F.array_distinct(ids).alias("paper_ids"), F.lit(source).alias("source"), status.alias("status"), F.lit(inherited).alias("inherited"))

    def direct(paper: Column, source: str) -> Column:
        return out(paper, F.array(paper), source, F.when(focus.isNotNull() & (focus != paper), "switch").otherwise("resolved"), False)

    nothing = out(F.lit(None), none, "none", "unresolved", False)
    similar = has_any(F.col("query"), SIMILAR_WORDS)
    found = (
        F.when(F.col("target").isNotNull(), direct(F.col("target"), "explicit_target"))
        .when(F.col("__has"), direct(F.col("__arxiv"), "arxiv_id"))
        .when(F.col("__by_doi").isNotNull(), direct(F.col("__by_doi"), "doi"))
        .when((n_titles > 0) & has_any(F.col("query"), COMPARE_WORDS) & focus.isNotNull(), out(focus, F.concat(F.array(focus), titles), "title_match", "resolved", True))
        .when(n_titles == 1, direct(titles[0], "title_match"))
        .when(n_titles > 1, out(F.lit(None), titles, "title_match", "ambiguous", False))
        .when(has_word(F.col("query"), SWITCH_WORDS) | (is_search(F.col("query")) & ~similar), nothing)
        .when(focus.isNotNull(), out(focus, F.concat(F.array(focus), F.coalesce("active", none)), "session_focus", "resolved", True))
        .when(last.isNotNull(), out(last.primary, F.concat(F.array(last.primary), F.coalesce(last.paper_ids, none)), "history_resolution", "resolved", True))
        .otherwise(nothing)
    )
    switched = F.when(F.col("found.status") == "switch", focus)
    return j.withColumn("found", found).select("turn_id", "found.paper_id", "found.paper_ids", "found.source", "found.status", "found.inherited", switched.alias("switched_from"))


def loaded(stored: DataFrame) -> DataFrame:
    """Sessions as stored, old ones too: those without a focus take it from their list of active papers, and defaults fill the rest."""
    have = set(stored.columns)

    def col(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(F.col(name).cast(kind), default) if name in have else default

    none = F.array().cast("array<string>")
    active = col("active_paper_ids", "array<string>", none)
    first = F.try_element_at(active, F.lit(1))
    focus_kind = "struct<primary_paper_id:string,active_paper_ids:array<string>,source:string,confidence:double>"
    old = F.struct(first.alias("primary_paper_id"), active.alias("active_paper_ids"), F.when(first.isNotNull(), "session_focus").alias("source"), F.when(first.isNotNull(), 0.9).alias("confidence"))
    focus = F.coalesce(F.col("paper_focus").cast(focus_kind), old) if "paper_focus" in have else old
    text = lambda name, default="": col(name, "string", F.lit(default)).alias(name)
    return stored.select("session_id", text("title"), text("user_id", "local-user"), active.alias("active_paper_ids"), focus.alias("paper_focus"), col("open_questions", "array<string>", none).alias("open_questions"), text("conversation_summary"), col("summary_through_message_count", "bigint", F.lit(0).cast("bigint")).alias("summary_through_message_count"))


def timeline(events: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """Each run's agents in the order in which they first reported: last status and detail, number of reports, time in work.

    Only an agent that completed or failed has a duration, the sum over its rounds.
    """
    g = events.groupBy(run, "agent").agg(
        F.min(order).alias("first"), F.max_by("status", order).alias("status"), F.max_by("detail", order).alias("detail"), F.count("*").alias("n_reports"),
        F.sum(F.when(F.col("status").isin("completed", "error"), F.col("duration_ms"))).alias("duration_ms"),
    )
    place = Window.partitionBy(run).orderBy("first", "agent")
    return g.withColumn("position", F.row_number().over(place).cast("long")).drop("first")
