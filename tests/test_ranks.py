"""Row numbers of groups that no task sorts alone."""

import random

from pyspark.sql import functions as F

from fathomline.operators import ranks


def rows():
    draw = random.Random(7)
    out = [(draw.choice(["hot", "hot", "a", None]), draw.choice([1.0, 2.0, None]), i) for i in range(900)]
    draw.shuffle(out)
    return out


def test_numbers_within_groups(spark):
    df = spark.createDataFrame(rows(), "g string, v double, id int").repartition(5)
    expected = {}
    for g in ("hot", "a", None):
        own = sorted((r for r in rows() if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        expected |= {r[2]: i for i, r in enumerate(own, 1)}
    got = ranks.ranked(df, ["g"], [F.desc_nulls_last("v"), "id"], "n").collect()
    assert {r["id"]: r["n"] for r in got} == expected and len(got) == 900


def test_the_next_row(spark):
    df = spark.createDataFrame(rows(), "g string, v double, id int")
    expected = {}
    for g in ("hot", "a", None):
        own = sorted(r[2] for r in rows() if r[0] == g)
        expected |= dict(zip(own, [*own[1:], None], strict=True))
    got = ranks.with_next(df.select("g", "id"), ["g"], ["id"], "id", "after").collect()
    assert {r["id"]: r["after"] for r in got} == expected and len(got) == 900
    assert ranks.ranked(df.where("false"), ["g"], ["id"], "n").count() == 0
