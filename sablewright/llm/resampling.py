"""Resampling towards a target distribution: hashed features, log ratios as whole numbers, Gumbel top-k.

Only DataFrame expressions run. Each document's features become an array of buckets; its weight adds up the entries of a
literal array of gains, so scoring neither explodes nor shuffles. Only totals by bucket are shuffled before that, and the
scores of little more than the drawn documents after it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sablewright.llm.common import settled, table

#: A word: letters a-z, digits and all characters beyond ASCII, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def literal_longs(values: list[int]) -> Column:
    """An array literal; the optimizer folds it into one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def words(text: Column) -> Column:
    """The words of a text in order; of null none. Only A-Z are lowered (``lower`` alone would lower other letters too)."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def features(word: Column, longest: int = 1) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, repeats included."""
    if longest == 1:
        return word

    def of(w: Column, k: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.concat_ws(" ", *[F.element_at(w, i + j) for j in range(k)]))
        return F.when(F.size(w) >= k, some).otherwise(F.array().cast("array<string>"))

    # the words become a lambda's variable, so that they are found once and not once for each run
    return F.element_at(F.transform(F.array(word), lambda w: F.concat(w, *[of(w, k) for k in range(2, longest + 1)])), 1)


def bucket_array(feature: Column, buckets: int) -> Column:
    return F.transform(feature, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def bucket_totals(texts: DataFrame, text: str = "text", buckets: int = 10000, longest: int = 1) -> dict[int, int]:
    """How often each bucket occurs in all texts. At most ``buckets`` rows a task are shuffled, and ``buckets`` rows come to the driver."""
    b = texts.select(F.explode(bucket_array(features(words(F.col(text)), longest), buckets)).alias("bucket"))
    return {r.bucket: r.total for r in b.groupBy("bucket").agg(F.count("*").alias("total")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = 10000) -> list[int]:
    """``floor(1000 ln(p / q))`` of each bucket: p its smoothed share in the target, q in the source."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def fitted(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = 10000, longest: int = 1) -> list[int]:
    """The gains of ``target`` over ``docs``."""
    return gains(bucket_totals(docs, text, buckets, longest), bucket_totals(target, target_text, buckets, longest), buckets)


def score_columns(text: Column, key: Column, gain: list[int], longest: int = 1, seed: int = 2024) -> dict[str, Column]:
    """n_words, n_features, weight and score of a text; the noise of a score depends on seed and key alone. A null key has no score."""
    w = words(text)
    f = features(w, longest)
    entry = literal_longs(gain)
    weight = F.aggregate(bucket_array(f, len(gain)), F.lit(0).cast("long"), lambda a, b: a + F.element_at(entry, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")
    return {"n_words": F.size(w).cast("long"), "n_features": F.size(f).cast("long"), "weight": weight, "score": weight + gumbel}


def scored(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", longest: int = 1, seed: int = 2024, keep: tuple[str, ...] = ()) -> DataFrame:
    """The key, columns to keep, and n_words, n_features, weight and score of every row, in one pass without a shuffle."""
    c = score_columns(F.col(text), F.col(key), gain, longest, seed)
    return docs.select(key, *keep, *[v.alias(k) for k, v in c.items()])


def ranked(scores: DataFrame, key: str = "doc_id", percent: float = 10, least_words: int = 20) -> DataFrame:
    """All rows of a written table of scores with ``rank``: 1, 2, 3... for the drawn ones, null for the others.

    Of the N rows with a key and ``least_words`` words, ``floor(percent N / 100)`` are drawn: the highest scores, ties to smaller
    keys, and in any order rows that repeat both. A threshold near the cut, with its exact count, keeps the others out of the
    sort. What is left is sorted by ranges; ranks are places within a range plus the sizes of the ranges before, so no task
    sees more than a range.
    """
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    n = scores.where(able).count()
    k = int(percent * n // 100)
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scores.select("*", none)
    share = 1 - percent / 100
    marks = scores.where(able).agg(F.percentile_approx("score", [max(0.0, share - x) for x in (0.0, 0.005, 0.02, 0.1)], 10000)).first()[0]
    enough = scores.where(able).agg(*[F.count_if(F.col("score") >= m) for m in marks]).first()
    low = next((m for m, c in zip(marks, enough, strict=True) if c >= k), None)
    high = able if low is None else able & (F.col("score") >= low)
    order = [F.col("score").desc(), F.col(key).asc()]
    placed = settled(scores.where(high).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    rank = F.element_at(literal_longs(before), part.cast("int") + 1) + within + 1
    top = placed.withColumn("rank", F.when(rank <= k, rank)).drop("place")
    return top.unionByName(scores.where(~high).select("*", none))


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: float = 10, least_words: int = 20, buckets: int = 10000, longest: int = 1, seed: int = 2024) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a draw towards ``target`` takes.

    Scores are pure functions of key and text, so the last drawn pair of score and key picks the rows by a filter, without a join;
    rows that repeat key and score stand or fall together. Null texts have no words, null keys are never drawn.
    """
    gain = fitted(docs, target, text, target_text, buckets, longest)
    r = ranked(settled(scored(docs, gain, key, text, longest, seed)), key, percent, least_words)
    last = r.where(F.col("rank").isNotNull()).agg(F.max_by(F.struct("score", F.col(key).alias("key")), "rank")).first()[0]
    if last is None:
        return docs.limit(0)
    c = score_columns(F.col(text), F.col(key), gain, longest, seed)
    return docs.where((c["n_words"] >= least_words) & ((c["score"] > last["score"]) | ((c["score"] == last["score"]) & (F.col(key) <= F.lit(last["key"])))))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight, score and, where drawn, rank. Target: the texts of ``benchmark``.

    Null texts have no features and weight 0; rows that repeat are documents of their own; a null doc_id has neither score nor rank.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = fitted(docs, table(spark, sf_dir, "benchmark").select("text"))
    r = ranked(settled(scored(docs, gain)))
    return r.select(*[F.col(c).cast(T.LongType()) for c in ("doc_id", "n_features", "weight", "score", "rank")])
