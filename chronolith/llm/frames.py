"""Plumbing shared by the corpus operators: tables, batches, durable intermediate results."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes a kernel works on at once; bounds a Python worker's memory at every input size.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch between the JVM and Python, where the session has Spark's default of 10,000: whole
#: texts are some kB each, and both sides hold a batch at once.
BATCH_ROWS = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: With it Spark deletes a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a checkpoint file where their number is known beforehand: small results lie in few files.
ROWS_A_FILE = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the context's checkpoint folder, else ``spark.checkpoint.dir``.

    Only a local master may do without (tests on one machine); elsewhere a temporary folder of
    the driver would be out of the executors' reach, so its lack is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return context._jsc.sc().getCheckpointDir().get()
    home = spark.conf.get("spark.checkpoint.dir", None)
    if home is None:
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        home = tempfile.mkdtemp(prefix="chronolith-")
    context.setCheckpointDir(home)
    return home


#: Bytes of an operator's input for each checkpoint file, where there are more files than four for each core.
INPUT_A_FILE = 16 << 20


def durable(df: DataFrame, rows: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that all executors share.

    The shuffle files that led to it go at once, so the disk holds one step's shuffle and not
    those of all steps. Two things bound the number of files, and of tasks that write them: ``rows``, an upper
    bound of the frame's rows, and ``of``, the operator's input (one file for each ``INPUT_A_FILE`` bytes, or four for
    each core); so a small input that lies in many partitions does not become many small files. The result's plan knows nothing of what it was made from; the
    optimizer's estimates of a loop's frames would otherwise double their digits in every round.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if rows is not None:
        df = df.coalesce(-(-max(rows, 1) // ROWS_A_FILE))
    elif of is not None:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-input_bytes(of) // INPUT_A_FILE)))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint()  # a frame takes the setting up when it is made
    finally:
        spark.conf.set(_CLEANUP, before)
    plan = kept._jdf.queryExecution().logical()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), kept._jdf.schema(), False), spark)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the frame's size; for a plain scan, the bytes of its files.

    Where the optimizer knows nothing (frames made from rows, checkpoints), the strings are measured in one pass.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 60:
        return size
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.agg(F.sum(functools.reduce(Column.__add__, strings, F.lit(16)).cast("long"))).first()[0] or 0


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """How many hash ranges to deal the frame's tokens into, so that none outgrows a task."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, -(-input_bytes(df) // bytes_each)))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or one row."""
    import numpy as np

    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(column).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for frames that hold whole texts; a setting of the session's own stays."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, BATCH_ROWS)


def release() -> None:
    """Give memory that a Python worker has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str, column: str = "text", only: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Apply ``kernel`` to bounded Arrow slices of the frame, of the rows that ``only`` leaves."""
    target = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches if only is None else map(only, batches), column):
            out = kernel(piece)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def keyed_text(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that clashing names elsewhere cannot matter."""
    small_batches(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
