"""What the corpus operators share: reading tables, shared storage, Arrow batches, small helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of an Arrow batch at most (a row that is longer stands alone).
BATCH_ROWS, BATCH_BYTES = 10_000, "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field_of(df: DataFrame, column: str, name: str) -> tuple[pa.Field, str]:
    """The Arrow field and the DDL of a column of any plain type, under another name."""
    kind = df.schema[column].dataType
    return pa.field(name, to_arrow_type(kind)), f"{name} {kind.simpleString()}"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch; texts of any length then fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the storage that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session is local, as in tests, a
    temporary folder of this machine serves; on a cluster each executor would write to a disk of its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/sablewright-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back: the lineage is cut, and a lost executor loses nothing.

    Without a place of its own (``where``) the table goes when the application ends, as lazy results may read it till then.
    """
    spark = df.sparkSession
    path = where or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    if where is None:
        written = spark._jvm.org.apache.hadoop.fs.Path(path)
        written.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def held(key, make: Callable):
    """The value of ``make()`` for a key, kept in this Python process until another key is asked for.

    Workers are used again by later stages; what an earlier operator remembered would add to their memory.
    """
    if _HELD.get("key") != key:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # give freed memory back, where the C library can
        _HELD.update(key=key, value=make())
    return _HELD["value"]


def by_batch(make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: pa.Schema):
    """A ``mapInArrow`` function from one over columns as Python lists.

    ``make`` runs once in each task and returns the function, so models are loaded once and not once a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                out = f({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in schema], schema=schema)

    return run
