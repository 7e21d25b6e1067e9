"""Column helpers, bounded broadcasts and materialised intermediates shared by the operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: White space that separates words, everywhere in this subpackage: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 200_000


def text_of(name: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    while name in df.columns:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    A higher-order function binds its argument, so Catalyst can't inline the value's expression into
    a lambda that would then run it again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def rolled(hashes: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` consecutive elements of an array of hashes; empty if too short."""
    n = F.size(hashes)
    each = F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]),
    )
    return F.when(n >= width, each).otherwise(F.array().cast("array<bigint>"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on a local master one of our own where it is unset."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trackloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = jsc.getCheckpointDir().get()
    return found


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage ends there.

    The files stay until ``discard`` is called: what is returned to a caller reads them later. All of
    an application's lie in one folder, which may go when it has ended.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/trackloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Python workers get at most so many rows at once, in what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # 0 or less means no limit.
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is run inside leaves no shuffle files: each run's go when it ends, where else they'd stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted and small enough, else as it is.

    ``df`` should be cheap to count: a stored intermediate or a small table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` make ``total``."""
    return max(least, -(-int(total) // each))
