"""Search results as tables: field adaptation, strategies in order of trust, citations, previews, fetch buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adapted(results: DataFrame) -> DataFrame:
    """Results of several services with one set of names: id, title, abstract, authors, pdf_url; missing columns are null."""

    def first(*names: str, kind: str = "string") -> Column:
        have = [F.col(n).cast(kind) for n in names if n in results.columns]
        return F.coalesce(*have) if have else F.lit(None).cast(kind)

    arxiv = F.regexp_replace(F.regexp_extract(first("arxiv_id", "id", "external_arxiv"), r"(\d{4}\.\d{4,5}(?:v\d+)?)$", 1), r"v\d+$", "")
    key = F.coalesce(F.nullif(arxiv, F.lit("")), first("paper_id", "id", "paperId"))
    pdf = F.coalesce(first("pdf_url", "pdf_link", "open_access_pdf"), F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)))
    return results.select(key.alias("paper_id"), first("title").alias("title"), first("abstract", "summary").alias("abstract"), first("authors", kind="array<string>").alias("authors"), pdf.alias("pdf_url"))


def by_strategy(results: DataFrame, n: int, query: str = "query_id", key: str = "paper_id", strategy: str = "strategy", order: str = "position") -> DataFrame:
    """Of each query the results of its first strategy that found anything, each paper once, at most ``n``."""
    best = results.groupBy(query).agg(F.min(strategy).alias(strategy))
    once = Window.partitionBy(query, key).orderBy(order)
    kept = results.join(best, [query, strategy]).withColumn("__k", F.row_number().over(once)).where("__k = 1")
    w = Window.partitionBy(query).orderBy(order, key)
    return kept.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n).drop("__k")


def citation_edges(papers: DataFrame, most: int = 20) -> DataFrame:
    """(paper_id, kind, other_id, title) of the first references and citations of each paper."""
    empty = F.array().cast("array<struct<title:string,paperId:string>>")
    parts = [papers.select("paper_id", F.lit(k).alias("kind"), F.inline(F.slice(F.coalesce(c, empty), 1, most))) for k, c in (("reference", "references"), ("citation", "citations"))]
    out = parts[0].unionByName(parts[1])
    return out.select("paper_id", "kind", F.col("paperId").alias("other_id"), "title")


def summary_text(title: Column, authors: Column, abstract: Column, link: Column) -> Column:
    """A paper as a few lines of Markdown."""
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.concat(F.lit("**Authors:** "), F.array_join(authors, ", ")), F.concat(F.lit("**Link:** "), link), F.lit(""), abstract)


def preview(pages: Column, most_pages: int = 5, most_chars: int = 5000) -> Column:
    """The beginning of a document from its first pages."""
    return F.substring(F.array_join(F.slice(pages, 1, most_pages), "\n"), 1, most_chars)


def fetch_bucket(exists: Column, pdf_url: Column, n_chunks: Column) -> Column:
    """What became of a found paper: exists, no_pdf, failed or fetched."""
    return F.when(exists, "exists").when(F.coalesce(pdf_url, F.lit("")) == "", "no_pdf").when(F.coalesce(n_chunks, F.lit(0)) == 0, "failed").otherwise("fetched")


def comparison(chunks: DataFrame, papers: list[str], n: int = 20, key: str = "paper_id", order: str = "chunk_index") -> DataFrame:
    """The leading chunks of two or more papers, for a comparison."""
    if len(dict.fromkeys(papers)) < 2:
        raise ValueError("a comparison needs two papers")
    place = F.array_position(F.array(*(F.lit(p) for p in papers)), F.col(key))
    return chunks.where(F.col(key).isin(*papers)).withColumn("__p", place).orderBy("__p", order).limit(n).drop("__p")
