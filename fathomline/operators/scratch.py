"""Tables in the shared folder that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.tables import scratch_folder

#: Whether shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, **options: object) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back."""
    path = scratch_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame, settings: dict[str, str] | None = None, **options: object) -> DataFrame:
    """As ``written``, and the shuffle files of the write go with it, not when the driver happens to collect its garbage; ``df`` is for this one use, in which ``settings`` hold."""
    conf, wanted = df.sparkSession.conf, {CLEANUP: "true"} | (settings or {})
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        return written(df, **options)
    finally:
        for k, v in before.items():
            conf.set(k, v)
