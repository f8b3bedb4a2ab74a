"""Incremental forms of the register's operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators import merge


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream of the parquet files that arrive in a folder, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


#: Parts of a streamed register by hash of the key; a batch rewrites only those that it has keys of.
STATE_PARTS = 64


def merge_stream(stream: DataFrame, state: str, fields: Sequence[str], seq: str, checkpoint: str, parts: int = STATE_PARTS):
    """Start merging a stream of captures into a table, one record per key, each batch once.

    The state lies in parts by hash of the key. A batch writes a new version of the parts that it has keys of,
    beside the last, and names them by its number, so a batch that is run again after a failure reads the same
    older versions and writes the same result. Within a field the first value in the order of ``seq`` wins, as
    in one batch over all captures.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        incoming = merge.keyed(batch).groupBy("key").agg(*_firsts(fields, seq), F.count("*").alias("n_rows")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        touched = sorted(r.part for r in incoming.select("part").distinct().collect())  # at most ``parts``
        known = versions(spark, state, number - 1)
        old = [f"{state}/part={p}/v={known[p]}" for p in touched if p in known]
        if old:
            stored = spark.read.option("basePath", state).parquet(*old).drop("v")
            incoming = stored.unionByName(incoming).groupBy("key", "part").agg(*[F.min_by(f, f"{f}.s").alias(f) for f in fields], F.sum("n_rows").alias("n_rows"))
        incoming.withColumn("v", F.lit(number)).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "v").parquet(state)
        spark.createDataFrame([(p, number) for p in touched], "part int, v long").coalesce(1).write.mode("overwrite").parquet(f"{state}-batches/{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, state: str, last: int | None = None) -> dict[int, int]:
    """The newest version of each part of a state, as of a batch or of all."""
    try:
        seen = spark.read.schema("part int, v long").parquet(f"{state}-batches/*")
    except AnalysisException:
        return {}
    upto = seen if last is None else seen.filter(F.col("v") <= last)
    return {r.part: r.v for r in upto.groupBy("part").agg(F.max("v").alias("v")).collect()}


def _firsts(fields: Sequence[str], seq: str):
    blank = lambda f: (F.col(f).cast("string").isNull()) | (F.col(f).cast("string") == "")
    return [F.min(F.when(~blank(f), F.struct(F.col(seq).alias("s"), F.col(f).cast("string").alias("v")))).alias(f) for f in fields]


def merged_state(spark: SparkSession, state: str, last: int | None, fields: Sequence[str]) -> DataFrame:
    """The table as of a batch, or as it is: key, fields, n_rows."""
    paths = [f"{state}/part={p}/v={v}" for p, v in sorted(versions(spark, state, last).items())]
    return spark.read.option("basePath", state).parquet(*paths).select("key", *[F.col(f"{f}.v").alias(f) for f in fields], "n_rows")


def first_seen(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key of a stream once within the lateness of its time."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(df: DataFrame, who: str, at: str, quiet: str = "150 seconds") -> DataFrame:
    """(who, start, end, n): bursts of events with no pause of ``quiet`` or longer; works on tables and streams."""
    if df.isStreaming:
        df = df.withWatermark(at, quiet)
    return df.groupBy(who, F.session_window(at, quiet).alias("w")).agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def overdue(df: DataFrame, who: str, at: str, now: str, silence: str = "120 seconds") -> DataFrame:
    """(who, last, silent): the last sign of life of each, and whether it is longer ago than ``silence``."""
    last = df.groupBy(who).agg(F.max(at).alias("last"))
    return last.withColumn("silent", F.col("last") < F.expr(f"timestamp'{now}' - interval {silence}"))
