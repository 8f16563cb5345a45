"""Shared plumbing of the training-data operators: tables, keys, shared folders."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_CHECKPOINT_DIR = "/tmp/evispark-checkpoints"
#: Bytes of text that a Python worker handles at a time; numpy's temporaries are some dozen times as large.
SLICE_BYTES = 1 << 19
ROWS_PER_FILE = 100_000
#: Rows that go to Python at a time where the session doesn't say: texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS, _BATCH_ROWS_KEY = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of this machine where it is unset and Spark runs on this machine alone (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or LOCAL_CHECKPOINT_DIR).rstrip("/")


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts the lineage, survives lost executors.

    ``rows``, where it is known, is no less than the rows there are: a small table goes into few files, ROWS_PER_FILE to each.
    """
    spark = df.sparkSession
    if rows is not None:
        files = -(-rows // ROWS_PER_FILE)
        if files < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(max(1, files))
    path = f"{shared_dir(spark)}/evispark/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Removes tables that ``materialise`` wrote and nothing reads any more."""
    for df in written:
        if path := getattr(df, "written_to", None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Returns freed memory to the system, so that an idle worker doesn't hold what its last task used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_CACHES: list[Callable[[], None]] = []


def cached(clear: Callable[[], None]) -> None:
    """Names a cache that a worker process keeps between tasks, by what empties it."""
    _CACHES.append(clear)


def drop_caches() -> None:
    """Empties what earlier tasks of this worker have kept for operators of their kind."""
    for clear in _CACHES:
        clear()


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batch size, unless it has one."""
    if spark.conf.get(_BATCH_ROWS_KEY, None) is None:
        spark.conf.set(_BATCH_ROWS_KEY, str(BATCH_ROWS))


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: T.StructType | str,
    text_col: str | None = "text",
    slice_bytes: int = SLICE_BYTES,
    warm: bool = False,
) -> DataFrame:
    """mapInArrow in slices of at most ``slice_bytes`` of ``text_col``; ``make`` runs once per task and returns the slice function.

    Only a ``warm`` operator finds what its worker has cached before; others drop that first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not warm:
            drop_caches()
        work = make()
        for batch in batches:
            for part in slices(batch, text_col, slice_bytes):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text_col: str | None, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if text_col is None or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    col = batch.column(text_col)
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > slice_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def doc_key(col: str = "doc_id") -> F.Column:
    """Null ids sort first: they count as the smallest id there is."""
    return F.coalesce(F.col(col), F.lit(-(1 << 63)).cast("long"))
