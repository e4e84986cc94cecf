"""A small lookup table as one array value, for use inside array functions.

Rows are dealt to buckets by hash; the table is the array of buckets, held as
a session variable, whose value goes to every task with its plan.  It is meant
for tables whose size has been checked first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def buckets_for(rows: int) -> int:
    """A power of two with at most one row in two buckets on average."""
    return 1 << max(4, (2 * rows).bit_length())


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") + 1


def lookup_table(rows: DataFrame, key: str, buckets: int) -> Column:
    """array<array<struct>> of ``rows``; element ``bucket(key, buckets)`` has the rows of a key, if any."""
    spark = rows.sparkSession
    full = rows.select(bucket(F.col(key), buckets).alias("at"), F.struct(*rows.columns).alias("row")).groupBy("at").agg(F.collect_list("row").alias("rows"))
    places = spark.range(1, buckets + 1).select(F.col("id").cast("int").alias("at"))
    dense = places.join(full, "at", "left").select("at", "rows")
    whole = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "rows"))), lambda x: x["rows"]).alias("value"))
    name = f"fathomline_{uuid.uuid4().hex}"
    whole.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} {whole.schema[0].dataType.simpleString()}")
    spark.sql(f"SET VARIABLE {name} = (SELECT value FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(f"system.session.{name}")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, evaluated once per row.

    A plain projection can be folded into what stands above it, even into
    the body of an array function, where it would run again for each element;
    a generator of one row can't.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
