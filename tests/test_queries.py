"""Every registered query against its SQL on the smallest tables; those without SQL must run."""

import oracle
import pytest

from sablewright.plans import graph, operations, registry, resolution, retrieval, service, texts  # noqa: F401


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, con, name):
    got = oracle.rows_of_spark(registry.QUERIES[name](spark, sf))
    assert got == oracle.rows_of_sql(con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    text = plan(registry.QUERIES["vector_topk"](spark, sf))
    assert "TakeOrderedAndProject" in text and "Cartesian" not in text
    text = plan(registry.QUERIES["vector_topk_per_label"](spark, sf))
    assert "WindowGroupLimit" in text
    text = plan(registry.QUERIES["regex_enum_filter"](spark, sf))
    assert "PushedFilters: [" in text and "Exchange" not in text
    for name in ("paper_links", "blocking_candidates", "fact_counts"):
        assert "Cartesian" not in plan(registry.QUERIES[name](spark, sf))


def test_entity_scores_of_all_parts(spark, sf, con):
    """Each pair of one type and one first word has a score, whatever the parts' sizes."""
    want = con.execute("SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_type = b.p_type AND split_part(lower(a.p_name), ' ', 1) = split_part(lower(b.p_name), ' ', 1) AND a.p_partkey < b.p_partkey").fetchall()
    got = {(r.left_id, r.right_id) for r in registry.QUERIES["entity_scores"](spark, sf).collect()}
    assert want and set(want) <= got


def test_entity_scores_in_python(spark, sf, con):
    """Every tenth score against its definition in plain Python."""
    from difflib import SequenceMatcher

    part = {r[0]: r[1:] for r in con.execute("SELECT p_partkey, lower(p_name), lower(p_brand) FROM part").fetchall()}
    for r in registry.QUERIES["entity_scores"](spark, sf).where("left_id % 10 = 0").collect():
        (a, x), (b, y) = part[r.left_id], part[r.right_id]
        # these names have no plural and two words each
        want = 1.0 if a == b else round(0.55 * SequenceMatcher(None, a, b).ratio() + 0.15 * (x == y), 6)
        assert r.score == pytest.approx(want, abs=1e-6), (a, b)


def test_no_python_on_the_way(spark, sf):
    """Names, folds, waits and texts stay in the JVM."""
    for name in ("normalize_names", "capacity_slots", "breaker_states", "admitted_rates", "markdown_chunks", "identified_papers", "fact_routes", "context_pack", "multi_query_merge", "title_matches"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert "Python" not in text and "InArrow" not in text and "Cartesian" not in text, name
    assert plan(registry.QUERIES["entity_scores"](spark, sf)).count("ArrowEvalPython") <= 2
    assert "NestedLoop" not in plan(registry.QUERIES["title_matches"](spark, sf))


def test_normal_forms_of_large_ids(spark, tmp_path):
    """Ids made from document numbers of more than five digits stay whole, as in the SQL."""
    import duckdb

    spark.range(89_998, 90_003).selectExpr("id AS doc_id", "'A  text' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert oracle.rows_of_spark(registry.QUERIES["normal_forms"](spark, str(tmp_path))) == oracle.rows_of_sql(con, registry.SQL["normal_forms"])
