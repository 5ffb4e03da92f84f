"""What the text operators share: the shared folder, batch limits, ragged word arrays."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: texts may be long, so a batch is kept small.
BATCH_ROWS, BATCH_BYTES = 4096, 6 << 20
#: The contract's word separators: the ASCII white space U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset a local session takes a temporary one; a cluster must name it."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="selfsim-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", there)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(there)
    return there


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; it goes when the application ends."""
    there = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, there)
    return there


def remove(spark: SparkSession, there: str) -> None:
    """Deletes a folder, if the session still runs."""
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(there)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(session_of(df))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as a table of the shared folder and read again, so that its size is known to the planner."""
    spark = session_of(df)
    there = scratch(spark, "table")
    df.write.parquet(there)
    return spark.read.schema(df.schema).parquet(there)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch unless the session asks for fewer still."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key, "2147483646"))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that an operator reads; other columns, whatever their names, don't matter."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cum, start = np.cumsum(size), 0
    while start < batch.num_rows:
        base = cum[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(cum, base + limit, "right")))
        # a copy: some string kernels misread the offsets of a slice
        yield batch.take(pa.array(np.arange(start, end)))
        pa.default_memory_pool().release_unused()
        start = end


def ragged(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(offsets, distinct words, codes): the words of text i are distinct[codes[offsets[i]:offsets[i + 1]]]; null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.ascii_lower(texts) if lower else texts
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return offsets.astype(np.int64), coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def gather(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, new offsets) that pick ragged rows in the given order."""
    lens = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lens)
    out = np.concatenate([[0], ends]).astype(np.int64)
    at = np.arange(out[-1]) - np.repeat(out[:-1], lens) + np.repeat(offsets[rows], lens)
    return at, out
