"""What the corpus operators share: reading, batches, keys and shared folders."""

from __future__ import annotations

import atexit
import ctypes
import math
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker.
SLICE_BYTES = 8 << 20

#: Bytes of documents that a reducer of Python code is given, roughly.
PART_BYTES = 32 << 20

#: Groups aren't made smaller than this to keep cores busy.
SMALL_BYTES = 1 << 20

#: Tables up to this size are dealt anew if they lie in few pieces.
DEALT_BYTES = 256 << 20

#: Rows that the JVM hands to Python at once: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session, unless they are bounded lower already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of DEALT_BYTES at most that lies in fewer pieces than there are cores is dealt to all of them."""
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= DEALT_BYTES else rows


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators on text use, under fixed names. Other columns go."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with a number after it where df has a column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = next(n for n in (name, *(f"{name}_{k}" for k in range(2, len(taken) + 3))) if n.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a session whose executors are threads of the driver may have none; it
    gets a local folder. Elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        checkpoint = spark.sparkContext.getCheckpointDir()
        if checkpoint:
            return checkpoint.rsplit("/", 1)[0]
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


#: Folders that this thread has written and not removed, oldest first.
_STAGED = threading.local()


def _staged() -> list[str]:
    if not hasattr(_STAGED, "paths"):
        _STAGED.paths = []
    return _STAGED.paths


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _at_exit(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        _remove(spark, path)


_HOMES: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it: lineage is cut, lost executors lose nothing.

    The folder is the application's own and goes when Python ends, if not before (see `sweep`).
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(_at_exit, home)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def mark() -> int:
    """Where `sweep` begins: folders written up to now stay."""
    return len(_staged())


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Remove the folders written since the mark, but those of the tables that are still to be read."""
    stay = {getattr(k, "staged_at", None) for k in keep}
    paths = _staged()
    for path in paths[since:]:
        if path not in stay:
            _remove(spark, path)
    paths[since:] = [p for p in paths[since:] if p in stay]


def partitions_for(total_bytes: float, each: int = PART_BYTES, least: int = 1) -> int:
    return max(least, math.ceil(total_bytes / each))


def spread(spark: SparkSession, total_bytes: float, each: int) -> int:
    """How many groups of about `each` bytes, or more and smaller ones (of SMALL_BYTES at least) where that leaves cores idle."""
    return max(partitions_for(total_bytes, each), min(3 * spark.sparkContext.defaultParallelism, int(total_bytes) // SMALL_BYTES))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about limit bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rows = max(1, int(n * limit / max(1, batch.nbytes)))
        for at in range(0, n, rows):
            yield batch.slice(at, rows)


def ids_and_texts(batch: pa.RecordBatch) -> tuple[list[int], list[str]]:
    """doc_id and text of a batch; a null text is empty."""
    texts = batch.column("text").to_pylist()
    return batch.column("doc_id").to_pylist(), [t or "" for t in texts]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc32_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def trim() -> None:
    """Give freed memory back to the system: workers live on, and other operators' tasks run in them."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def trimmed(run: Callable) -> Callable:
    """run for mapInArrow, with memory given back at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trimmed_group(run: Callable) -> Callable:
    """The same for a function of one group."""

    def wrapped(group: pa.Table) -> pa.Table:
        out = run(group)
        trim()
        return out

    return wrapped


def trimmed_pair(run: Callable) -> Callable:
    """The same for a function of a key and two groups."""

    def wrapped(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(key, left, right)
        trim()
        return out

    return wrapped
