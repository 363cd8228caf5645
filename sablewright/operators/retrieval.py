"""Retrieval: term statistics, BM25, vector search, rank fusion and the two-level hybrid search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablewright.functions.scores import cosine
from sablewright.functions.text import tokens
from sablewright.shared import settled

K1, B = 1.5, 0.75
#: Terms of questions that are broadcast at once, about.
ASKED = 100_000


def query_terms(query: str) -> list[str]:
    return query.lower().split()


def corpus_size(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: number of chunks and mean length in tokens."""
    return chunks.agg(F.count(F.col(id_col)).alias("n_docs"), F.avg(F.size(tokens(F.col(text_col)))).alias("avg_len"))


def term_hits(chunks: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_len, hits): the length in tokens and those tokens that are asked for. Each text is cut once; no token becomes a row."""
    wanted = F.array(*(F.lit(x) for x in dict.fromkeys(terms))) if terms else F.array().cast("array<string>")
    # the tokens are bound once as the only entry of an array; named twice in a projection, the text would be cut twice
    both = F.transform(F.array(tokens(F.col(text_col))), lambda t: F.struct(F.size(t).alias("doc_len"), F.filter(t, lambda x: F.array_contains(wanted, x)).alias("hits")))
    return chunks.select(F.col(id_col), F.inline(both))


def hit_stats(hits: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row: number of chunks, mean length, and how many chunks hold each term (df_0, df_1, ...)."""
    counts = [F.count_if(F.array_contains("hits", t)).alias(f"df_{k}") for k, t in enumerate(dict.fromkeys(terms))]
    return hits.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"), *counts)


def _idf(df: Column) -> Column:
    return F.log((F.col("n_docs") - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def term_stats(chunks: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df, idf) of each asked term that occurs."""
    one = hit_stats(term_hits(chunks, terms, id_col, text_col), terms)
    rows = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"df_{k}").alias("df"), _idf(F.col(f"df_{k}")).alias("idf")) for k, t in enumerate(dict.fromkeys(terms))))
    return one.select(F.inline(rows)).where("df > 0")


def _occurrences(term: str) -> Column:
    return F.size(F.filter("hits", lambda x: x == F.lit(term))).cast("double")


def _scores(terms: Sequence[str], place: dict[str, int]) -> Column:
    score = F.lit(0.0)
    for t in dict.fromkeys(terms):
        tf = _occurrences(t)
        score = score + F.lit(float(terms.count(t))) * _idf(F.col(f"df_{place[t]}")) * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("avg_len")))
    return score


def bm25(chunks: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every chunk that holds a term; a term that the query repeats counts as often.

    One scan of the texts and no shuffle of rows, see ``bm25_many``.
    """
    return bm25_many(chunks, [query], id_col, text_col).select(id_col, "score")


def bm25_many(chunks: DataFrame, queries: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, query, score) of every chunk and every one of a few queries (by number) whose terms it holds.

    Texts are read and cut once: what is left of them, lengths and asked tokens, is written. It is read twice, for one row of
    statistics, which is broadcast, and for the scores, a projection.
    """
    asked = [query_terms(q) for q in queries]
    terms = list(dict.fromkeys(t for q in asked for t in q))
    place = {t: k for k, t in enumerate(terms)}
    hits = settled(term_hits(chunks, terms, id_col, text_col))
    scored = hits.where(F.size("hits") > 0).crossJoin(F.broadcast(hit_stats(hits, terms)))
    each = F.array(*(F.struct(F.lit(k).alias("query"), _scores(q, place).alias("score")) for k, q in enumerate(asked)))
    return scored.select(id_col, F.inline(each)).where("score > 0")


def bm25_batch(chunks: DataFrame, questions: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", key: str = "question_id", question: str = "question") -> DataFrame:
    """(key, id, score, rank): the ``n`` best chunks for each of many questions, by the scores of ``bm25`` to nine places, so that the
    order of adding does not part equal chunks.

    For question sets of any size, as in evaluation runs: terms of all questions meet the chunks in one equi-join, which drops
    all other words before anything is shuffled; counts are combined in the tasks first. What is left of a chunk goes to one task, where it
    meets a block of questions (about ``ASKED`` terms, broadcast) after the other, so that scores are summed and cut to the best without a
    shuffle of hits, which are many times the texts. Chunks and questions
    without a common term do not meet. A null text has no tokens but counts as a chunk of no length; a null or empty question finds nothing.
    """
    spark = chunks.sparkSession
    asked = questions.select(key, F.explode(tokens(F.col(question))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("__q"))
    # tokens are a column before they are exploded; else every token would have the whole text cut again for its length
    cut = chunks.select(id_col, tokens(F.col(text_col)).alias("__t"))
    words = cut.select(id_col, F.size("__t").alias("__len"), F.explode("__t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    # read for how many chunks hold a term, and for the scores
    postings = settled(words.groupBy(id_col, "term").agg(F.count("*").cast("double").alias("__tf"), F.first("__len").alias("__len")))
    weight = postings.groupBy("term").agg(F.count("*").alias("__df")).crossJoin(F.broadcast(corpus_size(chunks, id_col, text_col)))
    weighted = settled(asked.join(weight, "term").select(key, "term", (F.col("__q") * _idf(F.col("__df")) * F.lit(K1 + 1)).alias("__w"), "avg_len"))
    part = F.col("__w") * F.col("__tf") / (F.col("__tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("__len") / F.col("avg_len")))
    # postings are few bytes and hits many rows: as many tasks as the session has partitions
    own = postings.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), id_col)
    blocks = -(-weighted.count() // ASKED) or 1
    found = None
    for k in range(blocks):
        some = weighted.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
        scores = own.join(F.broadcast(some), "term").groupBy(key, id_col).agg(F.round(F.sum(part), 9).alias("score"))
        best = top_in(scores.where("score > 0"), n, [key], "score", id_col)
        found = best if found is None else found.unionByName(best)
    return found


def top(df: DataFrame, n: int, score: str = "score", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The ``n`` best rows by score, ties by ``tie``, with their rank from 1. The sort is cut per partition first."""
    best = df.orderBy(F.desc(score), F.asc(tie)).limit(n)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), F.asc(tie))).cast("long"))


def top_in(df: DataFrame, n: int, by: Sequence[str], score: str, tie: str, rank: str = "rank") -> DataFrame:
    """The ``n`` best rows of each group; the window is limited before its shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= n)


def vector_scores(vectors: DataFrame, query: Sequence[float], vector_col: str = "embedding") -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("score", cosine(F.col(vector_col), q))


def vector_of(vectors: DataFrame, id_col: str, value: int, vector_col: str = "embedding") -> list[float]:
    """One vector by id; an empty list if there is none."""
    row = vectors.where(F.col(id_col) == value).select(vector_col).first()
    return list(row[0]) if row else []


def vector_top(vectors: DataFrame, query: Sequence[float], n: int, id_col: str = "vec_id", where: Column | None = None, vector_col: str = "embedding") -> DataFrame:
    """Exact nearest vectors by cosine; the filter stands before the search."""
    if where is not None:
        vectors = vectors.where(where)
    return top(vector_scores(vectors, query, vector_col).where("score is not null"), n, "score", id_col)


def fused(lists: Sequence[tuple[DataFrame, float]], id_col: str = "doc_id", k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (id, rank)."""
    parts = [df.select(id_col, (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_col).agg(F.sum("part").alias("score"))


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], n: int = 10, lexical: float = 0.3, dense: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """BM25 and vector hits fused; ``vectors`` carry the chunk's id under ``id_col``, hits without a chunk are dropped."""
    words = top(bm25(chunks, query, id_col), 2 * n, "score", id_col)
    near = vector_top(vectors.join(chunks.select(id_col), id_col, "left_semi"), query_vector, n, id_col)
    out = fused([(words, lexical), (near, dense)], id_col)
    return top(out, n, "score", id_col)


def merged_variants(lists: Sequence[DataFrame], n: int = 15, id_col: str = "doc_id") -> DataFrame:
    """The hits of several query variants: each chunk once with its best score, the best ``n``."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return top(out.groupBy(id_col).agg(F.max("score").alias("score")), n, "score", id_col)


def two_level(chunks: DataFrame, vectors: DataFrame, papers: DataFrame, query: str, query_vector: Sequence[float], paper_col: str, n_papers: int = 5, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Papers by their vectors first, then hybrid search within the chunks of the best papers.

    ``papers`` has (paper, embedding). The few best papers restrict the chunks by a semi-join.
    """
    scope = vector_top(papers, query_vector, n_papers, paper_col).select(paper_col)
    inside = chunks.join(F.broadcast(scope), paper_col, "left_semi")
    return hybrid(inside, vectors, query, query_vector, n, id_col=id_col)


def cases_run(cases: DataFrame, chunks: DataFrame, words: int, n: int, case: str = "case_id", id_col: str = "doc_id") -> DataFrame:
    """(case, id, score, rank): for each case the chunks that hold all of its first words, the ``n`` with most of them first.

    Cases meet chunks by their longest of these words, an equi-join, and are then looked at in full.
    """
    asked = cases.select(case, F.array_distinct(F.slice(tokens(F.col("text")), 1, words)).alias("__t")).where(F.size("__t") > 0)
    rarest = F.array_max(F.transform("__t", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    w = chunks.select(id_col, tokens(F.col("text")).alias("__w"))
    met = w.select(id_col, F.explode(F.array_distinct("__w")).alias("__x")).join(asked.withColumn("__x", rarest["x"]), "__x")
    hits = met.join(w, id_col).where(F.size(F.array_intersect("__w", "__t")) == F.size("__t"))
    scored = hits.select(case, id_col, F.size(F.filter("__w", lambda x: F.array_contains("__t", x))).alias("score"))
    return top_in(scored, n, [case], "score", id_col)


def section_filtered(hits: DataFrame, sections: Sequence[str], section_col: str = "section", more_than: int = 3, at_least: int = 3) -> DataFrame:
    """Hits of the wanted sections or without one, if there are more than three hits and at least three stay; else all."""
    all_rows = Window.partitionBy(F.lit(1))
    low = F.lower(F.coalesce(F.col(section_col), F.lit("")))
    fits = low == ""
    for s in sections:
        fits = fits | F.contains(low, F.lit(s))
    df = hits.withColumn("__fit", fits).withColumn("__n", F.count("*").over(all_rows)).withColumn("__k", F.count_if(F.col("__fit")).over(all_rows))
    return df.where(F.col("__fit") | (F.col("__n") <= more_than) | (F.col("__k") < at_least)).drop("__fit", "__n", "__k")


def titled(hits: DataFrame, papers: DataFrame, key: str, title: str = "title") -> DataFrame:
    """Every hit with its paper's title, or the key where there is none."""
    return hits.join(papers.select(key, F.col(title).alias("__t")), key, "left").withColumn(title, F.coalesce("__t", F.col(key).cast("string"))).drop("__t")


def packed(hits: DataFrame, most_chars: int, order: Sequence[Column], length: Column) -> DataFrame:
    """The leading hits whose texts fit together; it ends at the first that does not, even if later ones would."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = hits.withColumn("total", F.sum(length.cast("long")).over(w))
    return df.where(F.col("total") <= most_chars)


def packed_by(rows: DataFrame, most_chars: int, group: str, order: str, length: Column) -> DataFrame:
    """The leading rows of each group whose texts fit together, with the running ``total``; groups of any size.

    No more rows that have a character can fit than characters, so that is how many of a group are looked at; each task
    keeps that many before they meet. The first of them that does not fit ends the group; rows before it are summed up.
    """
    sized = rows.withColumn("__n", length.cast("long"))
    w = Window.partitionBy(group).orderBy(order)
    first = sized.where("__n > 0").select(group, order, "__n").withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most_chars + 1)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = first.withColumn("__t", F.sum("__n").over(run)).where(F.col("__t") > most_chars).groupBy(group).agg(F.min(order).alias("__end"))
    g = F.col(group).eqNullSafe(F.col("__g"))
    inside = sized.join(end.withColumnRenamed(group, "__g"), g, "left").where(F.col("__end").isNull() | (F.col(order) < F.col("__end"))).drop("__g", "__end")
    return inside.withColumn("total", F.sum("__n").over(run)).drop("__n")


# Words of a question that its variants replace, and by what.
THIS_PAPER = "(这篇论文|该论文|本文)"
THIS_PAPER_TAIL = "(的|主要|核心)?"
PAPER = "论文"
REWORDED = (("主要贡献", ("主要贡献",), ("创新点和方法", "novelty and contribution")), ("区别", ("区别", "差异"), ("对比", "difference")))
# End of the fixed values.


def variants(query: str) -> list[str]:
    """Rule-made variants of a question, the original first."""
    out = [query]
    rest = re.sub(THIS_PAPER + THIS_PAPER_TAIL, "", query).strip()
    if rest and re.search(THIS_PAPER, query):
        out.append(f"{PAPER} {rest}")
    for old, signs, new in REWORDED:
        if any(s in query for s in signs):
            out += [query.replace(old, x) for x in new]
    return out


def hashing_embedder(dim: int = 64):
    """A deterministic stand-in for an embedding model: an Arrow UDF from texts to unit vectors of hashed tokens."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 31 else -1
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype("float32").tolist())
        return pd.Series(out)

    return embed


def register(spark: SparkSession) -> None:
    """The engine's expressions as SQL functions of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ws_tokens(x STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(coalesce(x, '')), '(?U)\\\\s+'), t -> t <> '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION token_jaccard(a STRING, b STRING) RETURNS DOUBLE RETURN coalesce(cast(size(array_intersect(ws_tokens(a), ws_tokens(b))) as double) / nullif(size(array_union(ws_tokens(a), ws_tokens(b))), 0), 0D)")
    from sablewright.functions.names import block_similarity

    spark.udf.register("block_similarity", block_similarity)
