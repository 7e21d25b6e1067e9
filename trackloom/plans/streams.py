"""Queries that run as streams over the given tables: the table is landed as files in which times are out of order, and streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import ship
from ..storage import shared_folder
from ..streaming.ordered import STORE

#: Files' slices of the table, and the disorder: a row may lie so many minutes behind rows that came before it.
SLICES, DISORDER_MINUTES = 6, 8
DELAY = f"{DISORDER_MINUTES + 1} minutes"
#: Rows in a file, once a slice has more than two files of them.
FILE_ROWS = 200_000


def landed(rows: DataFrame, width_us: int | None = None) -> str:
    """Writes rows (with ``us`` and ``id``) as files, one slice behind the other, each row up to some minutes late; then a row that
    only moves the watermark past all others. ``width_us``: what a minute of the disorder means, if the table's span isn't an hour."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/landed"
    minute = width_us or 60_000_000
    # The disorder is less than the delay in the rows' own time.
    came = F.col("us") + F.pmod(F.xxhash64("id"), F.lit(DISORDER_MINUTES * minute))
    rows = rows.withColumn("_came", came).persist()
    low, high, n = rows.agg(F.min("_came"), F.max("_came"), F.count(F.lit(1))).first()
    files = -(-n // (SLICES * FILE_ROWS))
    if low is not None:
        each = (high - low) // SLICES + 1
        for k in range(SLICES):
            slice_ = rows.where((F.col("_came") >= low + k * each) & (F.col("_came") < low + (k + 1) * each))
            slice_ = slice_.drop("_came")
            (slice_.repartition(files) if files > 2 else slice_.coalesce(2)).write.mode("append").parquet(path)
            # A batch is so many files and must be a whole slice: one of few rows gets empty files.
            while files > 2 and len(spark.read.schema(slice_.schema).parquet(path).inputFiles()) < (k + 1) * files:
                slice_.limit(0).write.mode("append").parquet(path)
        last = rows.agg(F.max("us")).first()[0] + 1_000 * minute
        end = rows.limit(1).select(*[(F.lit(last) if c == "us" else F.lit(None)).cast(t).alias(c) for c, t in rows.drop("_came").dtypes])
        end.write.mode("append").parquet(path)
    else:
        rows.drop("_came").write.parquet(path)
    rows.unpersist()
    return path


def streamed(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Landed files as a stream, some files a batch: a slice of them, if nothing else is said."""
    files = files or max(2, (len(spark.read.parquet(path).inputFiles()) - 1) // SLICES)
    for key, value in STORE.items():
        spark.conf.set(key, value)
    return ship(spark).readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def run(writer: DataStreamWriter) -> None:
    """Runs a query to the end of what there is."""
    query = writer.start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def appended(stream: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Each batch overwrites the slice with its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
