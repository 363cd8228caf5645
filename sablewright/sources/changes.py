"""Writes as transforms: upserts, status changes, cascades and append-only sinks over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; ties must be broken by the caller's order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], keep_first: tuple[str, ...] = (), defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; columns missing in ``new`` keep their value.

    ``keep_first`` columns (such as created_at) stay as they were once set. Of several new rows with one key the first
    by ``order`` counts. ``defaults`` fill what is null in the end.
    """
    new = latest(new, keys, order)
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        sides = [F.col(f"{s}.{c}") for s, d in (("n", new), ("o", old)) if c in d.columns]
        if c in keep_first:
            sides.reverse()
        value = F.coalesce(*sides, *([defaults[c]] if c in (defaults or {}) else []))
        out.append(value.alias(c))
    return joined.select(*out)


def changed(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns set on the rows that meet the condition."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()})


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and the rows of ``new`` after it, in the columns and types of ``old``; what ``new`` lacks is null, what it has beyond them is left out."""
    fit = [(F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in old.schema]
    return old.unionByName(new.select(*fit))


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Cascade delete: rows whose key is in ``gone`` go."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def within_bytes(text: Column, most: int) -> Column:
    """The longest beginning of a text that has at most ``most`` bytes in UTF-8 and ends between characters."""
    # a character has at most four bytes, so the cut is at most three bytes before the limit
    cut = F.lit(None).cast("string")
    for back in (3, 2, 1, 0):
        part = F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, most - back).cast("string")) if most > back else F.lit("")
        cut = F.coalesce(part, cut)
    return F.when(F.octet_length(text) <= most, text).otherwise(cut)


def admitted(uploads: DataFrame, existing: DataFrame, pending: int, most_bytes: int, most_pending: int, most_files: int) -> DataFrame:
    """Upload admission with a verdict for each file: rejected by type, size or room; skipped if known; else accepted.

    ``uploads`` has batch_id, sequence, file_name, n_bytes; the id of a file is its name's stem and a hash of the name.
    """
    stem = F.regexp_replace("file_name", r"(?i)\.pdf$", "")
    df = uploads.withColumn("arxiv_id", F.concat(stem, F.lit("_"), F.substring(F.md5(F.col("file_name").cast("binary")), 1, 8)))
    known = existing.select("arxiv_id").distinct().withColumn("__known", F.lit(True))
    df = df.join(known, "arxiv_id", "left")
    w = Window.partitionBy("batch_id").orderBy("sequence", "file_name")
    place = F.row_number().over(w)
    verdict = (
        F.when(~F.lower("file_name").endswith(".pdf"), "rejected_type")
        .when(F.col("n_bytes") > most_bytes, "rejected_size")
        .when(place > most_files, "rejected_batch")
        .when(F.col("__known"), "skipped")
        .when(place + pending > most_pending, "rejected_queue")
        .otherwise("accepted")
    )
    return df.withColumn("verdict", verdict).drop("__known")
