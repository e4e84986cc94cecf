"""Greedy operators over bounded groups: farthest points and blocks of a page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import load

PICKS = 12
PAGE = 100


def farthest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve parts of each page of a hundred keys, each as far as can be from those before, by likeness of their names' 3-grams."""
    names = load(spark, sf_dir, "part").select(F.expr(f"p_partkey div {PAGE}").alias("page"), "p_partkey", "p_name")

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p_partkey", ignore_index=True)
        grams = [frozenset(n[i : i + 3] for i in range(max(1, len(n) - 2))) for n in frame["p_name"].fillna("")]
        far = lambda a, b: 1 - len(a & b) / max(1, len(a | b))
        chosen = [max(range(len(grams)), key=lambda i: (len(grams[i]), -i))]
        nearest = [far(g, grams[chosen[0]]) for g in grams]
        while len(chosen) < min(PICKS, len(grams)):
            best = max((i for i in range(len(grams)) if i not in chosen), key=lambda i: (nearest[i], -i))
            chosen.append(best)
            nearest = [min(d, far(g, grams[best])) for d, g in zip(nearest, grams, strict=True)]
        return pd.DataFrame({"page": frame["page"][0], "p_partkey": frame["p_partkey"][chosen].to_numpy(), "place": range(1, len(chosen) + 1)})

    return names.groupBy("page").applyInPandas(pick, "page bigint, p_partkey bigint, place bigint")


def boxes(parts: DataFrame) -> DataFrame:
    """Parts as text blocks on pages of a hundred keys; a block's place follows from its key."""
    k = F.col("p_partkey")
    return parts.select(
        F.expr(f"p_partkey div {PAGE}").alias("page"), k.alias("block"), (k % 3 * 200).cast("double").alias("x0"), (k % 3 * 200 + 150).cast("double").alias("x1"),
        (k % 97 * 10).cast("double").alias("y0"), (k % 97 * 10 + 8).cast("double").alias("y1"),
    )


def block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page in reading order, merged with the one above where the gap is small and the columns agree: gaps and islands."""
    order = Window.partitionBy("page").orderBy("x0", "y0", "block")
    above = F.max("y1").over(Window.partitionBy("page", "x0").orderBy("y0", "block").rowsBetween(Window.unboundedPreceding, -1))
    joins = (F.lag("x0").over(order) == F.col("x0")) & (F.col("y0") - above <= 15)
    begun = boxes(load(spark, sf_dir, "part")).withColumn("begins", F.when(joins, 0).otherwise(1))
    runs = begun.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min(F.struct("y0", "block"))["block"].alias("block")
    return runs.groupBy("page", "run").agg(first, F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n")).drop("run")


QUERIES = {f.__name__: f for f in (farthest_point, block_merge)}
ORACLES = {
    "block_merge": """WITH b AS (SELECT p_partkey // 100 AS page, p_partkey AS block, (p_partkey % 3 * 200)::DOUBLE AS x0, (p_partkey % 3 * 200 + 150)::DOUBLE AS x1, (p_partkey % 97 * 10)::DOUBLE AS y0, (p_partkey % 97 * 10 + 8)::DOUBLE AS y1 FROM part),
g AS (SELECT *, CASE WHEN lag(x0) OVER w = x0 AND y0 - max(y1) OVER (PARTITION BY page, x0 ORDER BY y0, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 15 THEN 0 ELSE 1 END AS s FROM b WINDOW w AS (PARTITION BY page ORDER BY x0, y0, block)),
k AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY x0, y0, block ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT page, arg_min(block, y0 * 1000000 + block) AS block, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM k GROUP BY page, k""",
}
