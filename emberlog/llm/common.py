"""Shared helpers: table reading, the shared folder, row keys and numpy views of text.

Row conventions used by every operator here:

* ``doc_id`` may be null or repeated. A null id sorts after every other id
  (``NULL_ID``). Rows with the same id *and* text are one document and get the same
  answer; rows with the same id and other text are separate documents.
* A null text is the empty text.
* Only the columns an operator needs are read, so extra columns never clash.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a session in one process gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="emberlog-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def run_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables and files lie."""
    return f"{shared_dir(spark).rstrip('/')}/emberlog-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes what this application has written with stored() and new_path(); call it when its results have been saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, text (null: empty) and what else is asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def order_id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NULL_ID))


def row_key() -> Column:
    """The same for rows with equal id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), F.col("text"))


def encoded(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, end to end, and the n+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces_of(batch: pa.RecordBatch, most: int = 8 << 20, column: str = "text"):
    """Slices of a batch with about ``most`` bytes of text each, or one row if it is longer."""
    _, at = encoded(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def tidied(run):
    """A function over batches that gives its memory back to the system when its task ends, since workers live on."""

    def tidy(batches):
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidy


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; looked up where it is used, never copied."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def positional(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with doc_id, ``given`` (the text) and text (null: empty), and its other columns as c0, c1 and so on, so that no name clashes; and the other columns' names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]
    return docs.select("doc_id", F.col("text").alias("given"), F.coalesce("text", F.lit("")).alias("text"), *carried), others


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose order_id() and row_key() are in gone (id, uid)."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    own, text, key = (mark + x for x in ("id", "text", "key"))
    left = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), text: F.coalesce("text", F.lit(""))})
    left = left.withColumn(key, F.xxhash64(own, text)).drop(text)
    gone = gone.select(F.col("id").alias(own), F.col("uid").alias(key))
    return left.join(gone, [own, key], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
