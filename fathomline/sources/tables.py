"""Readers and writers: CSV manifests, JSON lines, file listings, table exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "doc_id string, source string, category string, file_path string, file_name string, status string, priority int"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A CSV manifest with a header; missing columns are null."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, *, keep_bad: bool = False) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, bad ones are dropped or kept as nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE" if keep_bad else "DROPMALFORMED").json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of all files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


def projected(df: DataFrame, columns: dict[str, str], fill: float = 0.0) -> DataFrame:
    """``columns`` (source name to name) of ``df``; those that are missing or null become ``fill``."""
    have = set(df.columns)
    return df.select([(F.coalesce(F.col(a).cast("double"), F.lit(fill)) if a in have else F.lit(fill)).alias(b) for a, b in columns.items()])


def where_clause(condition: dict) -> Column:
    """A filter from a nested dict with $and, $or, $in, $eq and $ne; a missing value never equals."""
    parts = []
    for key, value in condition.items():
        if key in ("$and", "$or"):
            inner = [where_clause(x) for x in value]
            joined = inner[0]
            for x in inner[1:]:
                joined = joined & x if key == "$and" else joined | x
            parts.append(joined)
            continue
        tests = value if isinstance(value, dict) else {"$eq": value}
        for op, x in tests.items():
            if op == "$in":
                test = F.col(key).isin(list(x))
            elif op in ("$eq", "$ne"):
                test = F.col(key).eqNullSafe(F.lit(x))
                test = ~test if op == "$ne" else test
            else:
                test = F.lit(False)
            parts.append(F.coalesce(test, F.lit(False)))
    out = parts[0] if parts else F.lit(True)
    for x in parts[1:]:
        out = out & x
    return out


def scratch_folder(spark: SparkSession) -> str:
    """A new sub-folder of ``spark.checkpoint.dir``; where that is unset a session on one machine takes a temporary folder, and on a cluster it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fathomline-")
    return f"{base.rstrip('/')}/fathomline-{uuid.uuid4().hex}"
