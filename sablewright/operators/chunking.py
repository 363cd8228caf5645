"""Documents to sections and chunks, and folds over ordered pieces of text.

Greedy packing depends on order, so it is a fold; it runs as ``aggregate`` over an array within the row, in the JVM,
and needs no grouping or Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablewright.functions.text import heading_summary

MOST, OVERLAP, SHORT = 2000, 300, 200


def sections(docs: DataFrame, id_col: str = "paper_id", text_col: str = "markdown", levels: int = 6, default: str | None = None) -> DataFrame:
    """(id, section_index, heading, level, content, is_appendix) of a Markdown text.

    A heading is 1 to ``levels`` hash marks, white space and a title. Blank sections are dropped, what stands before the
    first heading has the default heading and no appendix mark. All within the row: no shuffle.
    """
    mark = rf"^(#{{1,{levels}}})\s+(.+)$"
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    piece = "struct<heading:string,level:int,content:string>"
    start = F.struct(F.array().cast(f"array<{piece}>").alias("done"), F.lit(default).cast("string").alias("heading"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("lines"))

    def closed(s: Column) -> Column:
        one = F.struct(s.heading.alias("heading"), s.level.alias("level"), F.array_join(s.lines, "\n").alias("content"))
        return F.when(F.trim(F.array_join(s.lines, "")) != "", F.concat(s.done, F.array(one))).otherwise(s.done)

    def step(s: Column, line: Column) -> Column:
        new = F.struct(closed(s).alias("done"), F.trim(F.regexp_extract(line, mark, 2)).alias("heading"), F.length(F.regexp_extract(line, mark, 1)).alias("level"), F.array().cast("array<string>").alias("lines"))
        more = F.struct(s.done.alias("done"), s.heading.alias("heading"), s.level.alias("level"), F.concat(s.lines, F.array(line)).alias("lines"))
        return F.when(F.rlike(line, F.lit(mark)), new).otherwise(more)

    found = F.aggregate(lines, start, step, closed)
    out = docs.select(id_col, F.posexplode(found).alias("section_index", "s"))
    return out.select(id_col, F.col("section_index").cast("long").alias("section_index"), "s.heading", "s.level", F.col("s.content").alias("content"), F.when(F.col("s.heading").isNotNull(), F.contains(F.lower("s.heading"), F.lit("appendix"))).alias("is_appendix"))


def title_of(text: Column, fallback: Column) -> Column:
    """The title of a Markdown text: its first heading or plain line within 20 lines, at most 100 characters."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20)
    fits = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("---") & (~x.startswith("#") | x.startswith("# ")))
    first = F.try_element_at(fits, F.lit(1))
    return F.coalesce(F.substring(F.regexp_replace(first, r"^#\s+", ""), 1, 100), fallback)


def sentences(c: Column) -> Column:
    """Pieces after which a sentence mark and white space stood."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?;:])\s+"), lambda x: x != "")


def overlap_tail(c: Column, most: int = OVERLAP) -> Column:
    """The whole last sentences of a chunk that fit into ``most`` characters together."""
    parts = F.reverse(F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: x != ""))
    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        full = s.full | (F.length(s.tail) + F.length(x) > most)
        return F.struct(F.when(full, s.tail).otherwise(F.concat(x, s.tail)).alias("tail"), full.alias("full"))

    return F.aggregate(parts, start, step, lambda s: s.tail)


def packed_sentences(c: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Chunks of at most ``most`` characters, from whole sentences joined without a separator.

    A chunk is closed when the next sentence would not fit; the next one begins with the closed one's tail. A sentence
    that is too long stays whole.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, x: Column) -> Column:
        full = (F.length(s.now) + F.length(x) > most) & (F.trim(s.now) != "")
        done = F.when(full, F.concat(s.done, F.array(s.now))).otherwise(s.done)
        now = F.when(full, F.concat(overlap_tail(s.now, overlap) if overlap else F.lit(""), x)).otherwise(F.concat(s.now, x))
        return F.struct(done.alias("done"), now.alias("now"))

    def end(s: Column) -> Column:
        return F.when(F.trim(s.now) != "", F.concat(s.done, F.array(s.now))).otherwise(s.done)

    text = F.coalesce(c, F.lit(""))
    return F.when(F.length(text) <= most, F.filter(F.array(text), lambda x: F.trim(x) != "")).otherwise(F.aggregate(sentences(text), start, step, end))


def merged_short(pieces: Column, short: int = SHORT, most: int = MOST) -> Column:
    """Joins a piece to the one before if that is short and both fit; items are (content, merged), joined by a line."""
    kind = "array<struct<content:string,merged:boolean>>"

    def step(s: Column, x: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        fits = (F.size(s) > 0) & (F.length(last.content) < short) & (F.length(last.content) + F.length(x) <= most)
        joined = F.struct(F.concat_ws("\n", last.content, x).alias("content"), F.lit(True).alias("merged"))
        alone = F.struct(x.alias("content"), F.lit(False).alias("merged"))
        return F.when(fits, F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(joined))).otherwise(F.concat(s, F.array(alone))).cast(kind)

    return F.aggregate(pieces, F.array().cast(kind), step)


def chunks(parts: DataFrame, id_col: str = "paper_id", order_col: str = "section_index", text_col: str = "content", overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, content, merged) from sections: packed, short ones merged, numbered from 0 within a paper."""
    ordered = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(order_col, packed_sentences(F.col(text_col), overlap=overlap).alias("c")))).alias("s"))
    pieces = F.flatten(F.transform("s", lambda x: x.c))
    return ordered.select(id_col, F.posexplode(merged_short(pieces)).alias("chunk_index", "m")).select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), "m.content", "m.merged")


def segments(c: Column, most: int = 4000) -> Column:
    """A long text cut without loss, each cut after a line, sentence or CJK full stop in the segment's second half."""
    limit = F.length(c)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(1).alias("at"))

    def cut(window: Column) -> Column:
        half = most // 2
        back = [F.instr(F.reverse(window), mark[::-1]) for mark in ("\n", ". ", "。", "！", "？")]
        after = F.greatest(*(F.when(b > 0, F.length(window) - b + 1).otherwise(0) for b in back))
        return F.when(after > half, after).otherwise(most)

    def step(s: Column, _: Column) -> Column:
        window = F.substring(c, s.at, F.lit(most))
        size = F.when(limit - s.at + 1 <= most, F.length(window)).otherwise(cut(window))
        return F.when(s.at > limit, s).otherwise(F.struct(F.concat(s.done, F.array(F.substring(c, s.at, size))).alias("done"), (s.at + size).cast("int").alias("at")))

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(limit / F.lit(most // 2)).cast("int")))
    return F.aggregate(rounds, start, step, lambda s: s.done)


def batches(lengths: Column, most: int = 12000) -> Column:
    """The batch number of each piece when pieces are packed in order and a batch closes before it would overflow."""
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("held"))

    def step(s: Column, n: Column) -> Column:
        over = (s.held > 0) & (s.held + n > most)
        batch = s.batch + over.cast("int")
        return F.struct(F.concat(s.at, F.array(batch)).alias("at"), batch.alias("batch"), F.when(over, n.cast("long")).otherwise(s.held + n).cast("long").alias("held"))

    return F.aggregate(lengths, start, step, lambda s: s.at)


def around_hit(content: Column, evidence: Column, most: int) -> Column:
    """``most`` (at least 400) characters of a text, a third of them before the evidence, or round the middle without it.

    ``evidence`` is one text or an array, of which the first that is found counts.
    """
    width, n = max(400, most), F.length(content)
    places = F.filter(F.transform(evidence, lambda e: F.when(F.trim(e) != "", F.position(F.trim(e), content))), lambda p: p > 0)
    centre = F.coalesce(F.try_element_at(places, F.lit(1)) - 1, F.floor(n / 2).cast("int"))
    begin = F.greatest(F.lit(0), F.least(n - width, centre - width // 3)).cast("int")
    return F.when(n <= width, content).otherwise(F.substring(content, begin + 1, F.lit(width)))


def halves(pieces: Column) -> Column:
    """An ordered batch cut in two near half of its characters: (left, right) arrays, each piece whole."""
    size = F.aggregate(pieces, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        held = F.when(s.full, s.held).otherwise(s.held + F.length(x))
        return F.struct(F.when(s.full, s.n).otherwise(s.n + 1).alias("n"), held.alias("held"), (s.full | (held >= size / 2)).alias("full"))

    cut = F.greatest(F.lit(1), F.least(F.size(pieces) - 1, F.aggregate(pieces, start, step, lambda s: s.n)))
    return F.struct(F.slice(pieces, F.lit(1), cut).alias("left"), F.slice(pieces, cut + 1, F.greatest(F.lit(0), F.size(pieces) - cut)).alias("right"))


def halved_text(c: Column) -> Column:
    """A text cut at the space nearest to its middle, or in the middle without one: (left, right), trimmed."""
    n = F.length(c)
    mid = F.floor(n / 2).cast("int")
    left = mid - F.instr(F.reverse(F.substring(c, F.lit(1), mid)), " ")
    has_left = (F.instr(F.substring(c, F.lit(1), mid), " ") > 0) & (left > 0)
    right = mid + F.instr(F.substring(c, mid + 1, n), " ") - 1
    has_right = F.instr(F.substring(c, mid + 1, n), " ") > 0
    at = F.when(~has_left & ~has_right, mid).when(~has_left, right).when(~has_right, left).otherwise(F.when(mid - left <= right - mid, left).otherwise(right))
    return F.struct(F.trim(F.substring(c, F.lit(1), at)).alias("left"), F.trim(F.substring(c, at + 1, n)).alias("right"))


def cited_or_all(batch: DataFrame, candidates: DataFrame, key: str = "batch_id", chunk: str = "chunk_index") -> DataFrame:
    """The chunks of each batch that its candidates cite; the whole batch if they cite none of it."""
    cited = candidates.select(key, chunk).distinct().withColumn("__cited", F.lit(True))
    marked = batch.join(cited, [key, chunk], "left").withColumn("__any", F.max(F.coalesce("__cited", F.lit(False))).over(Window.partitionBy(key)))
    return marked.where(F.col("__cited") | ~F.col("__any")).drop("__cited", "__any")


def rebuilt(parts: DataFrame, id_col: str = "paper_id", order_col: str = "chunk_index", section: str = "section", text_col: str = "content") -> DataFrame:
    """A paper's text from its chunks: a heading line for each chunk's section, then the chunk, in order."""
    one = F.concat(F.lit("# "), F.coalesce(F.col(section), F.lit("Abstract")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, one.alias("t")))), lambda x: x.t), "\n").alias("markdown"))


def selected_sections(parts: DataFrame, patterns: list[str], id_col: str = "paper_id", order_col: str = "section_index", each: int = 5000, total: int = 20000) -> DataFrame:
    """Sections whose heading fits a pattern, each cut to ``each`` characters, until ``total`` is reached."""
    fits = F.lit(False)
    for p in ["abstract|摘要", *patterns]:
        fits = fits | F.rlike(F.coalesce(F.col("heading"), F.lit("")), F.lit(f"(?i){p}"))
    cut = parts.where(fits & (F.trim("content") != "")).withColumn("content", F.substring("content", 1, each))
    w = Window.partitionBy(id_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("__before", F.coalesce(F.sum(F.length("content")).over(w), F.lit(0))).where(F.col("__before") < total).drop("__before")


def previews(parts: DataFrame, id_col: str = "paper_id") -> DataFrame:
    return parts.select(id_col, "section_index", "heading", heading_summary(F.col("content")).alias("preview"))


def paper_text(title: Column, abstract: Column, title_only: bool = False) -> Column:
    """The text whose vector stands for a paper."""
    return F.coalesce(title, F.lit("")) if title_only else F.concat_ws("\n", title, abstract)
