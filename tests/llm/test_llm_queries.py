"""The operators' queries: against SQL where there is some, else against brute force on the smallest tables."""

import hashlib
import re
import zlib

import oracle
import public_tokenizers as P
import pytest
import tiktoken

from sablewright.llm import queries as Q
from sablewright.llm.bpe import load_ranks


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, sf, name):
    assert oracle.rows_of_spark(Q.queries()[name](spark, sf)) == oracle.rows_of_sql(oracle.connect(sf), Q.oracle_sql()[name])


def run(spark, sf, name):
    return [r.asDict() for r in Q.queries()[name](spark, sf).collect()]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_op1(spark, sf, texts):
    rows = run(spark, sf, "op1_boosted_pii")
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_pii(texts[r["doc_id"]])
        line = ",".join("%s:%d:%d" % s for s in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert r["spans"].startswith(line)


def test_op3(spark, sf, texts):
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in run(spark, sf, "op3_prefix_bpe"):
        ids = e.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op4(spark, sf, texts):
    rows = run(spark, sf, "op4_flow_reshard")
    assert len(rows) == len(texts)
    size = [0] * 8
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r["shard"]] += r["size"]
    for k in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    biggest = max(r["size"] for r in rows)
    assert max(size) - min(size) <= 2 * biggest


def test_op6(spark, sf, texts):
    rows = run(spark, sf, "op6_subword_language")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["lang_pred"] in {*lang.values(), "und"} and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op8(spark, sf):
    rows = {r["doc_id"]: r for r in run(spark, sf, "op8_ftrl_toxicity")}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())


def test_op8_labels(spark):
    """On a larger table, the labels of held-out documents are found again."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in run(spark, sf, "op8_ftrl_toxicity") if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    print(sum(toxic), len(toxic), sum(clean), len(clean))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_op7(spark, sf, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    flat = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", t.lower().encode())
    joined = {i: b" ".join([b"", *flat(t), b""]) for i, t in texts.items()}
    want = {(i, k) for k, t in items.items() for i, x in joined.items() if b" ".join([b"", *flat(t), b""]) in x}
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, sf, "op7_latent_decontamination")}
    assert want and want <= got
    assert len(got - want) <= 2


def test_op5(spark, sf):
    rows = run(spark, sf, "op5_local_descriptors")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    same = {}
    for r in sorted(vectors):
        same.setdefault(tuple(r.embedding), r.vec_id)
    by = {r["vec_id"]: r for r in rows}
    assert len(by) == len(vectors)
    assert all(by[r.vec_id]["class_id"] <= same[tuple(r.embedding)] for r in vectors)


def test_op9(spark, sf):
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in run(spark, sf, "op9_tree_scored_text"):
        h = pages[r["page_id"]].html or ""
        part = h[h.index("<article>") : h.index("</article>") if "</article>" in h else h.index("<footer")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1|article)>", part)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]].url


def test_optional_package():
    """Without this package and the pipeline the entry points still work."""
    import subprocess
    import sys
    import tempfile
    from pathlib import Path
    from shutil import copytree, ignore_patterns

    repo = Path(__file__).resolve().parents[2]
    with tempfile.TemporaryDirectory() as d:
        copytree(repo, f"{d}/r", ignore=ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
        code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=f"{d}/r", check=True)
