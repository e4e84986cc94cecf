"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within each group of ``keys`` by ``order``, which must leave no ties.

    A window by the keys would sort a large group in one task.  Here rows are
    dealt by ranges of keys and order, numbered within each range, and moved
    on by how many rows of their group the ranges before have.
    """
    dealt = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    own = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)).cast("long"))
    # a row per range and group that is in it
    sizes = dealt.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.withColumn("_before", before).select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(moved, same).withColumn(name, F.col("_n") + F.col("_before")).select(*df.columns, name)


def with_next(df: DataFrame, keys: list[str], order: list[Column | str], column: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``column`` of the next row of the group by ``order``, null for the last one."""
    numbered = written(ranked(df, keys, order, "_rank"))
    after = numbered.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_rank") - 1).alias("_r"), F.col(column).alias(name))
    same = F.col("_rank") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return numbered.join(after, same, "left").select(*df.columns, name)
