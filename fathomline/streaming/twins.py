"""Structured Streaming twins of batch queries.

Each twin reads the events as a file stream, runs until all files are read,
writes to the shared folder and returns what it wrote.  Every batch query is
the oracle of its twin.  State is bounded by a watermark: rows that come later
than that are dropped, and a session is written once, when it is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..model import load
from ..sources.tables import scratch_folder


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events as a stream; a single file or a folder of files."""
    schema = load(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(writer: DataStreamWriter, folder: str) -> None:
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def _changes(out: DataFrame, keys: list[str], order: str, folder: str) -> DataFrame:
    """Run ``out`` in update mode; the last state of each key is the result."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    finished(out.writeStream.outputMode("update").foreachBatch(keep), folder)
    rows = out.sparkSession.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/*")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r"))
    return last.select(*keys, "r.*")


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days: events, sum and most of each type, with a watermark of two days."""
    e = events_stream(spark, sf_dir).withWatermark("ts", "2 days")
    d = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("most"))
    out = d.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total", "most")
    return _changes(out, ["day", "event_type"], "n", scratch_folder(spark))


SESSION_GAP, SESSION_DELAY, REPEAT_DELAY = "6 hours", "1 day", "2 hours"


def sessions(events: DataFrame) -> DataFrame:
    """Sessions of a user, events less than six hours apart, that are over by the watermark of a day."""
    e = events.withWatermark("ts", SESSION_DELAY)
    s = e.groupBy(F.session_window("ts", SESSION_GAP).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return s.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n")


def first_of_minute(events: DataFrame) -> DataFrame:
    """The first event of each user, type and minute to arrive; repeats within the watermark of two hours are dropped."""
    e = events.withColumn("minute", F.date_trunc("minute", "ts")).withWatermark("ts", REPEAT_DELAY)
    return e.dropDuplicatesWithinWatermark(["user_id", "event_type", "minute"]).select("user_id", "event_type", F.col("minute").cast("timestamp_ntz").alias("minute"))


def appended(out: DataFrame) -> DataFrame:
    """Run ``out`` in append mode and read what it wrote."""
    folder = scratch_folder(out.sparkSession)
    finished(out.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), folder)
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appended(sessions(events_stream(spark, sf_dir)))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appended(first_of_minute(events_stream(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (stream_daily, stream_sessions, stream_dedup)}
ORACLES = {
    "stream_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS most FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) AS minute FROM events",
}
