"""The interval join of the log and the voyages as a join of two streams.

A gate comes first: rows of the log that are more than ``DELAY_DAYS`` behind
the newest row of earlier triggers are late and go to a table of their own.
What passes is joined with the voyages' days, another stream, on vessel and
day with the range test as the rest; both sides keep a day in state until the
watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import log_of, sensor
from ..operators.intervals import with_days
from ..operators.voyages import ORACLES as VOYAGE_ORACLES
from ..operators.voyages import figures_of, segments
from ..sources.tables import scratch_folder
from .twins import events_stream, finished

#: A row of the log may come so many days after newer ones.
DELAY_DAYS = 2


def gate(log: DataFrame, folder: str, delay_days: int = DELAY_DAYS) -> None:
    """Deal a stream of log rows to ``folder``/accepted and ``folder``/late; a trigger that runs again writes the same."""
    spark = log.sparkSession

    def deal(batch: DataFrame, number: int) -> None:
        newest = spark.read.schema("newest timestamp, batch bigint").option("recursiveFileLookup", True).json(f"{folder}/newest").where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else F.coalesce(F.col("ts") < F.lit(newest) - F.expr(f"INTERVAL {delay_days} DAYS"), F.lit(False))
        rows = batch.withColumn("late", late).persist()
        try:
            rows.where("NOT late").drop("late").write.mode("overwrite").parquet(f"{folder}/accepted/{number}")
            rows.where("late").drop("late").write.mode("overwrite").parquet(f"{folder}/late/{number}")
            rows.agg(F.max("ts").alias("newest"), F.lit(number).alias("batch")).write.mode("overwrite").json(f"{folder}/newest/{number}")
        finally:
            rows.unpersist()

    spark.createDataFrame([], "newest timestamp, batch bigint").write.mode("append").json(f"{folder}/newest/start")
    finished(log.writeStream.foreachBatch(deal), f"{folder}/gate")


def joined_stream(log: DataFrame, voyages: DataFrame, delay_days: int = DELAY_DAYS) -> DataFrame:
    """Rows of the log (vessel, ts, ...) in voyages (vessel, voyage, start_ts, end_ts), both streams; ends are included and overlaps give several rows."""
    day = lambda c: F.date_trunc("day", c)
    left = log.withColumn("day", day(F.col("ts"))).withWatermark("day", f"{delay_days + 1} days").alias("p")
    right = with_days(voyages, "start_ts", "end_ts").withColumn("day", F.col("_day").cast("timestamp")).drop("_day").withWatermark("day", f"{delay_days + 1} days").alias("i")
    same = (F.col("p.vessel") == F.col("i.vessel")) & (F.col("p.day") == F.col("i.day")) & F.col("p.ts").between(F.col("i.start_ts"), F.col("i.end_ts"))
    return left.join(right, same).select(*[F.col(f"p.{c}") for c in log.columns], "i.voyage", "i.start_ts", "i.end_ts")


def _files(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def joined_log(events: DataFrame, voyages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the log beside their voyages, late rows) after all that the stream of events has; ``voyages`` is a table.

    The voyages are written to ``folder`` and read as a stream of files.
    """
    spark = events.sparkSession
    log = log_of(events)
    gate(log, folder)
    voyages = voyages.select("vessel", "voyage", F.col("start_ts").cast("timestamp").alias("start_ts"), F.col("end_ts").cast("timestamp").alias("end_ts"))
    voyages.write.parquet(f"{folder}/voyages/0")
    both = joined_stream(_files(spark, f"{folder}/accepted/*", log), _files(spark, f"{folder}/voyages/*", voyages))
    finished(both.writeStream.format("parquet").option("path", f"{folder}/joined").outputMode("append"), f"{folder}/join")
    late = spark.read.schema(log.schema).option("recursiveFileLookup", True).parquet(f"{folder}/late")
    return spark.read.schema(both.schema).parquet(f"{folder}/joined"), late


def stream_voyage_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's twin of ``voyage_kpi``: all of the log's rows beside their voyages, and the voyages' figures."""
    voyages = segments(sensor(spark, sf_dir))
    joined, _ = joined_log(events_stream(spark, sf_dir), voyages, scratch_folder(spark))
    return figures_of(joined)


QUERIES = {"stream_voyage_kpi": stream_voyage_kpi}
ORACLES = {"stream_voyage_kpi": VOYAGE_ORACLES["voyage_kpi"]}
