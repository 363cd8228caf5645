"""The pipeline against its stages done by brute force on the smallest tables."""

import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sablewright.llm import bpe, pii, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    import zlib

    # toxicity
    rows = [(texts[i] or "", y) for i, y in labels.items() if i in texts and zlib.crc32(str(i).encode()) % 5]
    s = toxicity.Scorer(toxicity.fit(rows))
    kept = {i: t for i, t in texts.items() if s.score(t or "") < 0.5}
    # near duplicates: all pairs of sets of words
    def grams(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()}

    sets = {i: grams(t or "") for i, t in kept.items()}
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(kept)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and len(sets[i] & sets[j]) * 9 >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = {i: t for i, t in kept.items() if find(i) == i}
    # decontamination: the items stand word for word
    kept = {i: t for i, t in kept.items() if not any(x in (t or "") for x in items)}
    # personal data and tokens
    m = pii.model()
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in kept.items():
        base = pii.base_spans(t or "")
        ids_ = e.encode_ordinary(pii.redact(t or "", base + m.select(t or "", base)))
        want[i] = (len(ids_), hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_columns_and_edges(spark, sf):
    docs = spark.createDataFrame([(1, None, "en", None, None), (None, "alone with words and more", None, "s", 1), (3, "", None, None, 0), (3, "", None, None, 0), (4, "mail a@b.co now", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, sf)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == list(corpus_pipeline.COLUMNS)
            n = out.count()
            assert n == (0 if d is not docs else 4 if k == 1 else 5)
    clean = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data(spark, docs, sf).collect()}
    assert clean[4] == ("mail <EMAIL> now", 16) and clean[1] == (None, None)


def test_clashing_columns_and_no_labels(spark, sf, tmp_path):
    """Columns with the stages' own names do no harm, and without usable labels no document goes as toxic."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(30)
    for name in ("rejected", "__id", "__key", "__codes", "codes", "several", "class_id", "grams_key", "stays"):
        extra = extra.withColumn(name, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, extra, sf).count() > 20
    spark.createDataFrame([(-1, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == docs.count()


def test_rows_of_one_id(spark, sf):
    """Rows that share an id are judged each for itself in every stage."""
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "uv")
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (None, a, "en", "s", 1), (2, b, "en", "s", 1), (1, a, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, a), (1, a), (1, b)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    docs = docs.limit(4).withColumn("text", F.when(F.col("text") == a, item).otherwise(F.col("text")))
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, sf).collect()) == [(1, b), (2, b)]
