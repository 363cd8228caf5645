"""Retrieval queries. ``documents`` stand for chunks, their source for the paper and their language for the section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.functions.text import contains_folded
from sablewright.operators import retrieval as R
from sablewright.plans.registry import query
from sablewright.sources.tables import table

QUESTION = "the worthless onble idiot the"
VARIANTS = (QUESTION, "pathetic clown of", "loser der und")


def _bm25_sql(text: str, out: str, where: str = "true", source: str = "documents") -> str:
    terms = ", ".join(f"('{t}')" for t in text.split())
    return f"""
{out}_tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS t FROM {source} WHERE {where}),
{out}_n AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avg_len FROM {out}_tok),
{out}_q AS (SELECT term, count(*)::DOUBLE AS repeats FROM (VALUES {terms}) v(term) GROUP BY term),
{out}_tf AS (SELECT doc_id, len(t)::DOUBLE AS doc_len, term, repeats, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf FROM {out}_tok, {out}_q),
{out}_idf AS (SELECT term, ln((any_value(n) - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1e0) AS idf, count(*) AS df FROM {out}_tf, {out}_n WHERE tf > 0 GROUP BY term),
{out} AS (SELECT doc_id, sum(repeats * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * doc_len / avg_len))) AS score
  FROM {out}_tf JOIN {out}_idf USING (term), {out}_n WHERE tf > 0 GROUP BY doc_id)"""


_COS = "list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))"
_VEC = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    v = table(spark, d, "embeddings")
    return v, R.vector_of(v, "vec_id", 0)


def _ranked(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_bm25_sql(QUESTION, 'b')} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(R.top(R.bm25(_docs(spark, d), QUESTION), 10), "doc_id")


@query("""WITH d AS (SELECT doc_id, TOK AS t FROM documents), n AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avg_len FROM d),
q AS (SELECT item_id, term, count(*)::DOUBLE AS asked FROM (SELECT item_id, unnest(TOK) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, doc_len, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(t)::DOUBLE AS doc_len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, ln((any_value(n) - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1e0) AS idf FROM p, n GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(asked * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * doc_len / avg_len))), 9) AS whole FROM q JOIN p USING (term) JOIN i USING (term), n GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(whole, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY whole DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""".replace("TOK", r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"))
def bm25_cases(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for the text of every benchmark item."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    return _ranked(R.bm25_batch(_docs(spark, d), items, 10, key="item_id"), "item_id", "doc_id")


@query(f"WITH {_bm25_sql(QUESTION, 'b')} SELECT term, df, round(idf, 6) AS idf FROM b_idf")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.term_stats(_docs(spark, d), R.query_terms(QUESTION)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("SELECT count(*) AS n_docs, round(avg(len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''))), 6) AS avg_len FROM documents")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus_size(_docs(spark, d), "doc_id", "text").select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {_VEC} SELECT vec_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings, qv ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return _ranked(R.vector_top(v, q, 10), "vec_id")


@query(f"WITH {_VEC} SELECT vec_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings, qv WHERE label IN (1, 3) ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return _ranked(R.vector_top(v, q, 10, where=F.col("label").isin(1, 3)), "vec_id")


@query(f"WITH {_VEC}, s AS (SELECT label, vec_id, {_COS} AS score FROM embeddings, qv) SELECT label, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 8")
def vector_topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return _ranked(R.top_in(R.vector_scores(v, q), 8, ["label"], "score", "vec_id"), "label", "vec_id")


@query("SELECT label, count(*) AS n_vectors FROM embeddings GROUP BY label")
def vector_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n_vectors"))


_NEAR = f"near AS (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings, qv WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY score DESC, doc_id LIMIT 10)"
_FUSE = """words AS (SELECT doc_id, 0.3e0 / (60e0 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 20)),
dense AS (SELECT doc_id, 0.7e0 / (60e0 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM near),
fused AS (SELECT doc_id, sum(part) AS score FROM (SELECT * FROM words UNION ALL SELECT * FROM dense) GROUP BY doc_id)"""


def _chunk_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    v, q = _vectors(spark, d)
    return v.select(F.col("vec_id").alias("doc_id"), "embedding"), q


@query(f"WITH {_bm25_sql(QUESTION, 'b')}, {_VEC}, {_NEAR}, {_FUSE} SELECT doc_id, source AS title, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM fused JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    v, q = _chunk_vectors(spark, d)
    hits = R.hybrid(docs, v, QUESTION, q, 10)
    return _ranked(R.titled(hits, docs.select("doc_id", F.col("source").alias("title")), "doc_id"), "doc_id", "title")


@query(f"WITH {_bm25_sql(QUESTION, 'b')}, {_VEC}, {_NEAR}, {_FUSE} SELECT doc_id, round(score, 6) AS score FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    v, q = _chunk_vectors(spark, d)
    words = R.top(R.bm25(_docs(spark, d), QUESTION), 20)
    near = R.vector_top(v.join(_docs(spark, d).select("doc_id"), "doc_id", "left_semi"), q, 10, "doc_id")
    return R.fused([(words, 0.3), (near, 0.7)]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {', '.join(_bm25_sql(v, f'v{k}') for k, v in enumerate(VARIANTS))}, u AS ({' UNION ALL '.join(f'(SELECT * FROM v{k} ORDER BY score DESC, doc_id LIMIT 10)' for k in range(len(VARIANTS)))}), m AS (SELECT doc_id, max(score) AS score FROM u GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM m ORDER BY score DESC, doc_id LIMIT 15")
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    best = R.top_in(R.bm25_many(_docs(spark, d), VARIANTS), 10, ["query"], "score", "doc_id").select("doc_id", "score")
    return _ranked(R.merged_variants([best]), "doc_id")


_PAPERS = f"papers AS (SELECT source, {_COS.replace('embedding', 'e')} AS score FROM (SELECT source, any_value(embedding)::DOUBLE[] AS e, q FROM (SELECT d.source, first(v.embedding ORDER BY d.doc_id) AS embedding FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id GROUP BY d.source), qv GROUP BY source, q) ORDER BY score DESC, source LIMIT 5)"


@query(f"WITH {_VEC}, {_PAPERS}, scoped AS (SELECT * FROM documents WHERE source IN (SELECT source FROM papers)), {_bm25_sql(QUESTION, 'b', source='scoped')}, {_NEAR.replace('SELECT doc_id FROM documents', 'SELECT doc_id FROM scoped')}, {_FUSE} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM fused ORDER BY score DESC, doc_id LIMIT 10")
def two_level_retrieval(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    v, q = _chunk_vectors(spark, d)
    papers = docs.join(v, "doc_id").groupBy("source").agg(F.min_by("embedding", "doc_id").alias("embedding"))
    return _ranked(R.two_level(docs, v, papers, QUESTION, q, "source"), "doc_id")


@query(f"WITH {_VEC}, newest AS (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 50) SELECT vec_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM newest, qv ORDER BY {_COS} DESC, vec_id LIMIT 5")
def brute_force_paper_rank(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return _ranked(R.vector_top(v.orderBy(F.desc("vec_id")).limit(50), q, 5), "vec_id")


@query(f"WITH {_bm25_sql(QUESTION, 'b')}, h AS (SELECT b.doc_id, d.lang AS section, score FROM b JOIN documents d USING (doc_id) ORDER BY score DESC, b.doc_id LIMIT 15), f AS (SELECT *, (section IS NULL OR section LIKE '%fr%' OR section LIKE '%en%') AS fit, count(*) OVER () AS n, count(*) FILTER (WHERE section IS NULL OR section LIKE '%fr%' OR section LIKE '%en%') OVER () AS k FROM h) SELECT doc_id, section, round(score, 6) AS score FROM f WHERE fit OR n <= 3 OR k < 3")
def fallback_section_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    hits = R.top(R.bm25(docs, QUESTION).join(docs.select("doc_id", F.col("lang").alias("section")), "doc_id"), 15)
    return R.section_filtered(hits, ["fr", "en"]).select("doc_id", "section", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') ")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(contains_folded(F.col("p_name"), "AN")).select("p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)license|copyright') AND lang IN ('en', 'de')")
def regex_enum_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.rlike("text", F.lit("(?i)license|copyright")) & F.col("lang").isin("en", "de")).select("doc_id", "lang")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 50")
def conversation_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("conv_id = 3").orderBy("turn").limit(50)


_PACK = "SELECT doc_id, sum(len(text)) OVER (PARTITION BY lang ORDER BY doc_id) AS total, lang FROM documents WHERE text IS NOT NULL"


@query(f"SELECT doc_id, lang, total::BIGINT AS total FROM ({_PACK}) WHERE total <= 50000")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The leading documents of each language that fit into 50 000 characters."""
    docs = _docs(spark, d).where("text is not null").select("doc_id", "lang", F.length("text").alias("n"))
    return R.packed_by(docs, 50_000, "lang", "doc_id", F.col("n")).select("doc_id", "lang", "total")
