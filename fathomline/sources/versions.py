"""Versioned tables: numbered manifests that name what belongs to a version.

Data goes to new folders only.  A version exists once its manifest is complete,
which Spark's committer marks with a file of its own, so a driver that is lost
half way leaves the version before it readable, and two writers of one number
can't both succeed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[tuple[int, bool]]:
    """(number, complete) of every version that was begun."""
    where, fs = _files(spark, f"{root}/versions")
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().isdigit()]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted((int(p.getName()), bool(fs.exists(path(p, "_SUCCESS")))) for p in found)


@dataclass(frozen=True)
class Version:
    number: int
    entries: list[dict]

    def of(self, kind: str) -> list[dict]:
        return [e for e in self.entries if e["kind"] == kind]


def current(spark: SparkSession, root: str) -> Version | None:
    """The newest complete version; a manifest has an entry per bucket or segment, so reading it here is bounded."""
    done = [n for n, complete in _numbers(spark, root) if complete]
    if not done:
        return None
    lines = spark.read.text(f"{root}/versions/{done[-1]:08d}").collect()
    return Version(done[-1], sorted((json.loads(r["value"]) for r in lines), key=lambda e: e["order"]))


def publish(spark: SparkSession, root: str, entries: list[dict]) -> Version:
    """Make ``entries`` (each with its ``kind``) the next version; fails if another writer took its number."""
    number = max([n for n, _ in _numbers(spark, root)], default=0) + 1
    ordered = [e | {"order": i} for i, e in enumerate(entries)]
    lines = spark.createDataFrame([(json.dumps(e, sort_keys=True),) for e in ordered], "value string")
    lines.coalesce(1).write.mode("errorifexists").text(f"{root}/versions/{number:08d}")
    return Version(number, ordered)


def fresh_folder(root: str) -> str:
    return f"{root}/data/{uuid.uuid4().hex}"


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files below ``path`` in one digest; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    row = F.xxhash64("path", "length", "modificationTime")
    n, low, total = files.select(row.alias("h")).agg(F.count("h"), F.bit_xor("h"), F.sum(F.col("h") % (1 << 31))).first()
    return f"{n}:{low}:{total}"


# --- tables by key --------------------------------------------------------------------------------


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _written(rows: DataFrame, root: str) -> list[dict]:
    """``rows`` with ``bucket`` in a new folder: one entry per bucket with its rows and a fingerprint of their values."""
    folder = fresh_folder(root)
    rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    back = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    values = F.xxhash64(*[c for c in rows.columns if c != "bucket"])
    found = back.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(values).alias("x"), F.sum(values % (1 << 31)).alias("s"))
    return [{"kind": "bucket", "bucket": r["bucket"], "path": f"{folder}/bucket={r['bucket']}", "n": r["n"], "fingerprint": f"{r['x']}:{r['s']}"} for r in found.collect()]


def _one_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows of one key the last by ``order``; ties by all values, so that runs agree."""
    last = rows.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_order"), F.struct(*[c for c in rows.columns if c != key]).alias("_row"))).alias("_last"))
    return last.select(key, "_last._row.*").select(*rows.columns)


def rebuild(rows: DataFrame, root: str, key: str, order: str, *, buckets: int = BUCKETS) -> Version:
    """Replace the whole table by ``rows``, one row per key (null is a key like any other)."""
    spark = rows.sparkSession
    entries = _written(_bucketed(_one_per_key(rows, key, order), key, buckets), root)
    schema = {"kind": "table", "schema": rows.schema.json(), "key": key, "order_by": order, "buckets": buckets}
    return publish(spark, root, [schema, *sorted(entries, key=lambda e: e["bucket"])])


def upsert(rows: DataFrame, root: str) -> Version:
    """The current table with ``rows`` in place of those of the same key that aren't newer; buckets without new rows keep their files."""
    spark, now = rows.sparkSession, current(rows.sparkSession, root)
    if now is None:
        raise ValueError(f"{root}: no complete version")
    table = now.of("table")[0]
    key, order, buckets = table["key"], table["order_by"], table["buckets"]
    news = _bucketed(rows, key, buckets)
    touched = {r["bucket"] for r in news.select("bucket").distinct().collect()}  # no more than there are buckets
    before = {e["bucket"]: e for e in now.of("bucket")}
    merged = news
    old = [before[b]["path"] for b in sorted(touched & set(before))]
    if old:
        merged = _bucketed(spark.read.schema(rows.schema).parquet(*old).select(*rows.columns), key, buckets).unionByName(news)
    entries = _written(_bucketed(_one_per_key(merged.drop("bucket"), key, order), key, buckets), root)
    kept = [e for b, e in before.items() if b not in touched]
    return publish(spark, root, [table, *sorted([*kept, *entries], key=lambda e: e["bucket"])])


def read_version(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """The rows of a version, by default the newest complete one."""
    from pyspark.sql.types import StructType

    version = version or current(spark, root)
    if version is None:
        raise ValueError(f"{root}: no complete version")
    schema = StructType.fromJson(json.loads(version.of("table")[0]["schema"]))
    paths = [e["path"] for e in version.of("bucket")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def fingerprint(version: Version) -> str:
    """What a version holds, whatever folders it is in: equal tables have equal ones."""
    parts = sorted((e["bucket"], e["n"], e["fingerprint"]) for e in version.of("bucket"))
    return f"{sum(n for _, n, _ in parts)}:{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(parts)).hex}"
