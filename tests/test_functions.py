"""Constants and small functions."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import carbon
from fathomline.operators.intervals import range_join
from fathomline.sources.tables import projected, read_json_lines, where_clause, write_json_lines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_carbon_values(spark):
    assert one(spark, carbon.reference(F.lit(81200.0))) == pytest.approx(4.192686272987268)
    assert one(spark, carbon.required(F.lit(81200.0), F.lit(2025))) == pytest.approx(3.815344508418414)
    assert one(spark, carbon.required(F.lit(81200.0), F.lit(2022))) is None


@pytest.mark.parametrize(("share", "grade"), [(0.86, "A"), (0.94, "B"), (1.06, "C"), (1.18, "D"), (1.19, "E")])
def test_ties_go_to_the_better_grade(spark, share, grade):
    assert one(spark, carbon.grade(F.lit(100.0 * share), F.lit(100.0))) == grade


def test_status_order(spark):
    none = F.lit(None).cast("double")
    assert one(spark, carbon.status(F.lit(2022), F.lit(0.0), none, none)) == "year"
    assert one(spark, carbon.status(F.lit(2024), F.lit(0.0), none, none)) == "dwt"
    assert one(spark, carbon.status(F.lit(2024), F.lit(1.0), none, none)) == "co2"
    assert one(spark, carbon.status(F.lit(2024), F.lit(1.0), F.lit(1.0), F.lit(0.0))) == "distance"


def test_interval_ends_are_inside_and_overlaps_fan_out(spark):
    p = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS ts UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-01-05 00:00:00'")
    i = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS a, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS b UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-01-02 00:00:00', TIMESTAMP_NTZ '2024-01-03 12:00:00'")
    assert range_join(p, i, ["k"], "ts", "a", "b").count() == 2
    assert range_join(p, i, ["k"], "ts", "a", "b", "left_anti").count() == 1
    assert range_join(p, i, ["k"], "ts", "a", "b", "left").count() == 3


def test_where_clause_and_projection(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert df.where(where_clause({"s": "a"})).count() == 1
    assert df.where(where_clause({"s": {"$ne": "a"}})).count() == 1
    assert df.where(where_clause({"$or": [{"n": {"$in": [2]}}, {"s": "a"}]})).count() == 2
    assert df.where(where_clause({"n": {"$gt": 1}})).count() == 0
    assert projected(df, {"n": "x", "m": "y"}).first() == (1.0, 0.0)


def test_json_lines(spark, tmp_path):
    write_json_lines(spark.range(3), str(tmp_path / "j"))
    (tmp_path / "j" / "bad.json").write_text("\nnot json\n")
    assert read_json_lines(spark, str(tmp_path / "j"), "id bigint").count() == 3
