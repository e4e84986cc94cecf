"""Rows of routed tables by classes and counts, against SQL on parts with nulls and many rows of a class."""

import random

import pytest
from oracle import rows_of, sql_rows

from fathomline import registry
from fathomline.operators import tables


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    draw, folder = random.Random(4), tmp_path_factory.mktemp("parts")
    maybe = lambda x: None if draw.random() < 0.08 else x
    # keys in runs, so that a class's first rows stand far behind the other's
    rows = [(i, maybe(f"Hot {'abc'[min(2, i // 150)] if draw.random() < 0.7 else draw.choice('abcd')}"), maybe(f"B{draw.choice('1234')}"), maybe(draw.choice(["X", "Y", "Z"])), draw.randrange(9), maybe(draw.randrange(900) / 4)) for i in range(600)]
    df = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    df.coalesce(1).write.parquet(f"{folder}/p")
    (file,) = (folder / "p").glob("*.parquet")
    (folder / "sql").mkdir()
    (folder / "sql" / "part.parquet").write_bytes(file.read_bytes())
    return str(folder / "sql")


@pytest.mark.parametrize("name", ["table_stage2", "cell_rank", "table_answers", "table_confidence", "table_qa_metrics", "literal_row_lane"])
def test_against_sql_with_nulls(spark, parts, name):
    assert rows_of(registry.QUERIES[name](spark, parts)) == sql_rows(registry.ORACLES[name], parts)


def test_rows_and_questions_are_not_paired(spark):
    # 4,000 rows of one table and two keys, asked for by 60 pairs: every pair with its rows would be over 100,000 rows
    p = spark.range(4000).selectExpr("'t' AS table_id", "id AS row_id", "concat('k', id % 2) AS key", "concat('y', id % 30) AS kind")
    asked = p.selectExpr("table_id", "key AS row_key", "kind AS topic").distinct().union(p.selectExpr("table_id", "concat('k', 1 - substr(key, 2)) AS row_key", "kind AS topic").distinct()).distinct()
    rows, sizes = tables.fitting_rows(p, asked, 8)
    assert rows.count() <= 60 * 3 * 8
    got = {(r["row_key"], r["topic"]): (r["n2"], r["n1"]) for r in sizes.collect()}
    for (k, t), n in got.items():
        fits = [(i % 2 == int(k[1:])) + (i % 30 == int(t[1:])) for i in range(4000)]
        assert n == (fits.count(2), fits.count(1))
