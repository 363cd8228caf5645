"""Readers: the relational tables, labelled evaluation cases, parser archives, and the schemas of the collections."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The collections of the research application, as DDL; keys come first.
COLLECTIONS = {
    "papers": "paper_id string, title string, abstract string, authors array<string>, pdf_url string, doi string, status string, title_embedding array<float>, graph_status string, created_at timestamp, updated_at timestamp",
    "chunks": "paper_id string, chunk_index bigint, content string, metadata struct<section:string,page:bigint,level:bigint,is_appendix:boolean,merged:boolean>",
    "conversations": "session_id string, role string, content string, metadata map<string,string>, created_at timestamp",
    "sessions": "session_id string, title string, messages array<struct<role:string,content:string,created_at:timestamp>>, paper_focus string, active_paper_ids array<string>, open_questions array<string>, conversation_summary string, updated_at timestamp",
    "upload_jobs": "job_id string, batch_id string, sequence bigint, status string, attempt_count bigint, max_attempts bigint, arxiv_id string, created_at timestamp, finished_at timestamp",
    "graph_jobs": "job_id string, paper_id string, run_number bigint, status string, priority bigint, attempt_count bigint, max_attempts bigint, next_attempt_at timestamp, created_at timestamp, lease_expires_at timestamp, worker_id string",
    "entities": "entity_id string, type string, canonical_name string, canonical_normalized string, aliases array<string>, blocking_keys array<string>, context string, embedding array<float>, resolution_status string, updated_at timestamp",
    "facts": "fact_id string, signature string, subject_id string, predicate string, object_id string, support_count bigint, contradict_count bigint, needs_review_count bigint, updated_at timestamp",
    "claims": "claim_id string, paper_id string, fact_id string, chunk_index bigint, stance string, review_status string, evidence string, evidence_hash string, confidence double, qualifiers map<string,string>, updated_at timestamp",
    "edges": "edge_id string, source_paper_id string, target_node_id string, target_name string, relation string, review_status string, evidence string, updated_at timestamp",
    "nodes": "node_id string, node_type string, name string, normalized_name string",
    "user_memory": "memory_id string, user_id string, type string, content string, weight double, last_accessed timestamp, access_count bigint",
    "chunk_vectors": "paper_id string, chunk_index bigint, content string, section string, embedding array<float>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps without zone become UTC instants, as watermarks need them."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def conforms(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of ``ddl``; raises if one is missing. Extra columns are dropped."""
    want = StructType.fromDDL(ddl)
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in want))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from JSON, a document or a list of them; every case needs an id and a question."""
    schema = "id string, question string, expected_papers array<string>, expect_abstention boolean, _corrupt string"
    df = spark.read.json(path, schema=schema, multiLine=True, columnNameOfCorruptRecord="_corrupt")
    ok = F.col("_corrupt").isNull() & (F.trim(F.coalesce("id", F.lit(""))) != "") & (F.trim(F.coalesce("question", F.lit(""))) != "")
    return df.select(F.when(ok, F.col("id")).otherwise(F.raise_error(F.lit("an evaluation case lacks an id or a question"))).alias("id"), "question", "expected_papers", "expect_abstention")


def markdown_from_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown, error) for each ZIP under ``path``: the file ``full.md`` with the shortest name, read as UTF-8."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for where, content in zip(part["path"], part["content"], strict=True):
                text, error = None, None
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == "full.md"]
                        if not names:
                            error = "no full.md"
                        else:
                            text = z.read(min(names, key=lambda n: (len(n), n))).decode("utf-8-sig")
                            if not text.strip():
                                text, error = None, "full.md is empty"
                except (zipfile.BadZipFile, UnicodeDecodeError) as e:
                    error = str(e) or type(e).__name__
                rows.append((where, text, error))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, markdown string, error string")
