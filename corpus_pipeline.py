"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; ``run`` writes each stage's
result as Parquet in shared storage and reads it again for the next.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sablewright.llm.bpe import encode_texts
from sablewright.llm.common import by_batch, settled, small_batches, table
from sablewright.llm.decontamination import uncontaminated
from sablewright.llm.near_duplicates import one_of_each
from sablewright.llm.pii import base_spans, model, redact
from sablewright.llm.toxicity import accepted_rows, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay; the model learns from the labels of documents that are still there.

    Without labels of both classes nothing goes. Null texts count as empty; every row, repeated ones and those with a null
    id too, is judged by its own text.
    """
    return accepted_rows(docs.select(*COLUMNS), train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays.

    Rows that share an id are judged each by its own text; of rows that repeat id and text one stays. Rows with a null id
    and texts without words belong to no class and stay.
    """
    return one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay. Every row, repeated ones and those with a null id too, is judged by its own text.
    """
    return uncontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its personal data are replaced by their kinds.

    Null and empty texts, and the counts of unchanged ones, stay as they are; rows are independent of each other.
    """
    small_batches(spark)
    m = model()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = base + m.select(text, base)
        return redact(text, spans) if spans else text

    def make():
        def run(cols):
            texts = [clean(t) for t in cols["text"]]
            # the count follows the text where it changed
            sizes = [n if a == b else len(b) for n, a, b in zip(cols["n_chars"], cols["text"], texts, strict=True)]
            return cols | {"text": texts, "n_chars": sizes}

        return run

    return docs.select(*COLUMNS).mapInArrow(by_batch(make, schema), "doc_id long, text string, lang string, source string, n_chars long")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document; a null text has none. Rows are independent of each other."""
    import public_tokenizers as P

    return encode_texts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Trained models and byte-level BPE are beyond SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
    return docs
