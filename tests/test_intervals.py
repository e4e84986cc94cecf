"""Interval joins: what is shuffled, broadcast and dealt to days."""

import datetime

from oracle import SF

from fathomline import registry
from fathomline.operators import intervals


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_intervals_are_not_sent_through_the_driver(spark):
    for name in ("annual_voyages", "recent_left_interval", "voyage_kpi", "uncovered_points"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text, name


def test_orders_are_not_dealt_to_days(spark):
    for name in ("annual_voyages", "recent_left_interval", "voyage_union"):
        assert "Generate explode" not in plan(registry.QUERIES[name](spark, SF)), name


def test_cover_against_brute_force(spark):
    at = lambda d: None if d is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=d)
    points = [(i, k, at(t)) for i, (k, t) in enumerate([(1, 5), (1, 10), (1, 10.5), (1, 0), (1, 20), (1, 5000), (2, 5), (None, 5), (1, None), (1, 30), (1, 31)])]
    spans = [(1, at(5), at(10)), (1, at(6), at(7)), (1, at(25), at(5000)), (1, at(20), at(19)), (None, at(0), at(9)), (2, at(6), None), (1, at(30), at(30))]
    p = spark.createDataFrame(points, "id bigint, k bigint, ts timestamp_ntz")
    i = spark.createDataFrame(spans, "k bigint, s timestamp_ntz, e timestamp_ntz")
    inside = lambda k, t: any(k is not None and t and k == a and e and s <= t <= e for a, s, e in spans)
    got = {(r["id"], r["inside"]) for r in intervals.with_cover(p, i, ["k"], "ts", "s", "e", "inside").collect()}
    assert got == {(n, bool(inside(k, t))) for n, k, t in points}
