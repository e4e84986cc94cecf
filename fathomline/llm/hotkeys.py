"""Joins of many rows with a table of one row per key, where a few keys may have most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import free_name

#: A key is hot if it has more than one row in so many, so there are fewer hot keys than this.
HOT = 1000
#: Parts of a hot key.
SALTS = 64


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """The hot ones of ``counts``, which has one row per key with its rows in ``n``; fewer than ``HOT`` whatever the size."""
    return counts.where(F.col(n) * HOT > total).select(*keys)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, by: str) -> DataFrame:
    """``rows`` left joined with ``table`` on ``keys``, which are unique in it.

    Rows of ``hot`` keys are dealt to ``SALTS`` parts by the hash of ``by``,
    and each part gets the key's row of the table; ``rows`` are read once.
    """
    flag, salt = free_name(rows, "hot"), free_name(rows, "salt")
    few = F.broadcast(hot.select(*keys, F.lit(True).alias(flag)))
    parts = F.when(F.col(flag), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    many = table.join(few, keys, "left").withColumn(salt, F.explode(parts)).drop(flag)
    dealt = rows.join(few, keys, "left").withColumn(salt, F.when(F.col(flag), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop(flag)
    return dealt.join(many, [*keys, salt], "left").drop(salt)
