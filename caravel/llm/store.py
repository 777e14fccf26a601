"""Cutting lineage through the shared folder, filters over keys, and small helpers for sessions."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session of one machine (a local master) takes a
    temporary folder; a cluster raises, as its machines share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="caravel-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that this program wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_file(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that holds a file of the shared folder, and the file's path there; for tasks."""
    return pyarrow.fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def mapped(uri: str) -> np.ndarray:
    """The 64-bit whole numbers of a shared file: memory-mapped where the folder is mounted, else read."""
    system, path = shared_file(uri)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, "<i8", "r") if system.get_file_info(path).size else np.zeros(0, "<i8")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), "<i8")


#: Rows and bytes of an Arrow batch: rows may hold whole documents, and a task holds several copies of a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def lean(spark: SparkSession) -> SparkSession:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES``, unless they are lower; call it before Arrow functions over texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return spark


#: Whether Spark deletes an action's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder; what follows survives lost executors without computing it again.

    Its shuffle files go at once: else they stay until the driver happens to
    collect its garbage, and all steps' files add up.  The setting holds for
    this action alone, as frames that are read again need theirs.
    """
    spark = lean(df.sparkSession)
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a frame that nothing else reads
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Resident memory, in pages, from which a worker gives back what it doesn't use.
TIDY_PAGES = 60_000


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives the memory of a large task back to the system: workers live on for other tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if _pages() > TIDY_PAGES:
                pa.default_memory_pool().release_unused()
                if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                    trim(0)

    return tidied


def _pages() -> int:
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1])
    except OSError:
        return 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Least and most bits of a key filter; it has 16 bits a key between them, so 32 MB are the bound of its broadcast.
FILTER_BITS = (1 << 16, 1 << 28)


def key_filter(hashes: DataFrame) -> np.ndarray:
    """Bit array over a column of 64-bit hashes, sized to their number; an exact join follows wherever it is used.

    Beyond the bound more keys pass it than have to, which costs time and no result.
    """
    name = hashes.columns[0]
    least, most = FILTER_BITS
    bits = min(most, max(least, 1 << (16 * hashes.count()).bit_length()))
    cells = hashes.select((F.pmod(name, F.lit(bits)) + 1).alias("at"))
    found = cells.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    table = np.zeros(bits // 8, np.uint8)
    for k, piece in found:  # bucket k starts at position 32768 * (k - 1) + 1
        own = np.frombuffer(bytes(piece), np.uint8)
        own = own[: len(table) - (k - 1) * 4096]
        table[(k - 1) * 4096 : (k - 1) * 4096 + len(own)] |= own
    return table


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a ``key_filter`` lets through."""
    cell = np.mod(hashes, len(table) * 8)
    return ((table[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)


def touched(spark: SparkSession, table: np.ndarray):
    """An Arrow function of a column of hashes: whether a ``key_filter`` lets each through.  Only the hashes go to Python."""
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(holds(shared.value, hashes.to_numpy(zero_copy_only=False)))

    return test
