"""Documents in stages: each stage is committed, a run goes on where another ended, and rows that fail stop nothing.

``root`` holds versions whose entries say which folder has what a stage made
of which documents.  A document is known by its id and its text, so one that
has changed is worked on again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import load
from ..sources import versions
from ..sources.tables import scratch_folder

#: A stage takes rows with doc_id and state and gives these two columns, ``error`` (null where it went well) and its own.
Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def _read(spark: SparkSession, entries: list[dict], like: DataFrame) -> DataFrame:
    paths = [e["path"] for e in entries]
    return spark.read.schema(like.schema).parquet(*paths) if paths else spark.createDataFrame([], like.schema)


def _known(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """doc_id and state of the rows below these entries."""
    schema = "doc_id bigint, state string"
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(e["path"]) for e in entries]) if entries else spark.createDataFrame([], schema)


def run_batch(docs: DataFrame, stages: list[Stage], root: str) -> DataFrame:
    """Every document of ``docs`` (doc_id, text, ...) through the stages, but for what earlier runs on ``root`` did: the rows of the last stage.

    Rows with an error go to the errors' table, see ``errors``, and to no
    further stage; they are tried again when their text changes.  A null
    doc_id is an error of the first stage.  A stage's output counts from the
    moment its version is published, so a run that is lost in between repeats
    that stage only.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("state", F.sha2(F.coalesce("text", F.lit("\x00")), 256)).dropDuplicates(["doc_id", "state"])
    wanted = rows.select("doc_id", "state")
    for name, stage in stages:
        now = versions.current(spark, root)
        entries = [{k: v for k, v in e.items() if k != "order"} for e in now.entries] if now else []
        done = [e for e in entries if e["kind"] == "stage" and e["stage"] == name]
        failed = [e for e in entries if e["kind"] == "error" and e["stage"] == name]
        known = _known(spark, done).unionByName(_known(spark, failed))
        same = ["doc_id", "state"]
        todo = rows.where("doc_id IS NOT NULL").join(known, same, "left_anti")
        made = stage(todo)
        if not todo.isEmpty():
            folder = versions.fresh_folder(root)
            made.write.partitionBy().parquet(f"{folder}/all")
            all_rows = spark.read.schema(made.schema).parquet(f"{folder}/all")
            all_rows.where("error IS NULL").drop("error").write.parquet(f"{folder}/ok")
            all_rows.where("error IS NOT NULL").select("doc_id", "state", "error").write.parquet(f"{folder}/bad")
            entries = [*entries, {"kind": "stage", "stage": name, "path": f"{folder}/ok"}, {"kind": "error", "stage": name, "path": f"{folder}/bad"}]
            versions.publish(spark, root, entries)
        mine = [e for e in entries if e["kind"] == "stage" and e["stage"] == name]
        # what earlier runs made of documents that are no longer asked for stays where it is
        rows = _read(spark, mine, made.drop("error")).join(wanted, same, "left_semi")
    return rows


def errors(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, state, stage, error of all rows that failed."""
    now = versions.current(spark, root)
    schema = "doc_id bigint, state string, error string"
    parts = [spark.read.schema(schema).parquet(e["path"]).withColumn("stage", F.lit(e["stage"])) for e in (now.of("error") if now else [])]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, stage string")


def failing(*cases: tuple[Column, str]) -> Column:
    """The reason of the first case that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(cases):
        out = F.when(condition, F.lit(reason)).otherwise(out)
    return out


def _lines(rows: DataFrame) -> DataFrame:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return rows.select("doc_id", "state", "source", lines.alias("lines"), failing((F.col("text").isNull(), "no text"), (F.trim("text") == "", "empty text")).alias("error"))


def _chunks(rows: DataFrame) -> DataFrame:
    sizes = F.transform("lines", lambda x: F.char_length(x))
    return rows.select("doc_id", "state", "source", F.size("lines").cast("long").alias("n_lines"), F.array_max(sizes).cast("long").alias("longest"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_chars"), failing((F.array_max(sizes) > 8000, "line too long")).alias("error"))


def _quality(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "state", "source", "n_lines", "n_chars", failing((F.col("n_chars") < 40, "too short")).alias("error"))


PREPARATION: list[Stage] = [("lines", _lines), ("chunks", _chunks), ("quality", _quality)]


def batch_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through three stages in two runs, the labelled ones first: what became of each, with the stage that it failed in."""
    root, docs = scratch_folder(spark), load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    run_batch(docs.join(load(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), PREPARATION, root)
    done = run_batch(docs, PREPARATION, root).select("doc_id", F.lit("done").alias("outcome"), "n_lines", "n_chars")
    failed = errors(spark, root).select("doc_id", F.concat_ws(": ", "stage", "error").alias("outcome"), F.lit(None).cast("long").alias("n_lines"), F.lit(None).cast("long").alias("n_chars"))
    return done.unionByName(failed)


BATCH_SQL = r"""WITH l AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM documents),
s AS (SELECT *, len(lines) AS n_lines, list_sum([length(x) FOR x IN lines])::BIGINT AS n_chars, list_max([length(x) FOR x IN lines]) AS longest FROM l),
o AS (SELECT *, CASE WHEN text IS NULL THEN 'lines: no text' WHEN trim(text, ' ') = '' THEN 'lines: empty text' WHEN longest > 8000 THEN 'chunks: line too long' WHEN n_chars < 40 THEN 'quality: too short' ELSE 'done' END AS outcome FROM s)
SELECT doc_id, outcome, CASE WHEN outcome = 'done' THEN n_lines END AS n_lines, CASE WHEN outcome = 'done' THEN n_chars END AS n_chars FROM o"""

QUERIES = {"batch_preparation": batch_preparation}
ORACLES = {"batch_preparation": BATCH_SQL}
