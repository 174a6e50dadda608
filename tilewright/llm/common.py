"""Scratch tables, hashing and word rules that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of the contracts: after lower-casing A-Z, digits, a-z and everything beyond ASCII.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(WORD_CLASS)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def words_of(text: str | None) -> list[str]:
    """The words of a whole text; null has none."""
    return WORD.findall(text.translate(ASCII_LOWER)) if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a local one, in a local session only."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tilewright-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Rows and bytes of an Arrow batch: what a task holds of its input, in the JVM and in Python, is a small multiple.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside is planned with batches of BATCH; the session's settings are put back after it."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Tables of one operator call, in the shared folder. They cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        spark._jvm.java.lang.System.gc()  # shrinks the driver's heap to about what is in use
        trim_driver(spark)

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path := f"{self.at}/{name}", compression=compression)
        trim_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def drop(self, *names: str) -> None:
        """Frees tables that no returned DataFrame reads; without names, all of them."""
        jvm = self.spark._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}" if name else self.at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Gives memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def trim_driver(spark: SparkSession) -> bool:
    """The driver's JVM gives native memory that it freed back to the system, where it can; tells whether it did.

    Hundreds of plans a call, each with threads and compiled code of its own, leave freed memory in the C library's
    arenas, which that keeps for reuse: it adds up over the calls of a session, beside the heap and not bounded by it.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class is not open to reflection
        given = new(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
        invoke.invoke(server, given)
        return True
    except Py4JError:  # not a JVM, or not a C library, that has it
        return False


def tidy(run: Callable[..., Iterable]) -> Callable[..., Iterator]:
    """A function on batches that gives the memory it no longer uses back to the system when its task ends.

    A Python worker outlives its tasks and serves other stages next; what Arrow and the C library keep for reuse
    would add up over the stages.
    """

    @functools.wraps(run)
    def whole(*batches) -> Iterator:
        try:
            yield from run(*batches)
        finally:
            give_back()

    return whole


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names cannot meet the operator's own."""
    return df.select(*names)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone; plain ASCII takes the fast built-in."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def text_key(col: Column) -> Column:
    """A 160-bit name for a text: equal texts and no others share it."""
    return F.sha1(F.coalesce(col, F.lit("")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about `most`."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
