"""Signals of questions, lanes, and what is chosen from pools, on rows with nulls, ties and one large group."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from fathomline.operators import signals


def test_signals_of_odd_questions(spark):
    asked = [
        (1, "Only IMO rules, not in ABS: is CG-0123-4 or CG-0123-4 at 3.2.1 and 12 mm or 5.5kV?"), (2, None), (3, ""), (4, "only DNV except DNV in MEPC 82, mepc-82 and MSC 107"),
        (5, " ".join(f"word{i}" for i in range(40)) + " CODE-7"), (6, "12 mmx 30% 7 t"),
    ]
    got = {r["question_id"]: r.asDict() for r in signals.signals(spark.createDataFrame(asked, "question_id bigint, question string")).collect()}
    one = got[1]
    assert (one["codes"], one["clauses"], one["quantities"], one["only"], one["excluded"]) == (["CG-0123-4"], ["3.2.1"], ["12mm", "5.5kv"], ["IMO"], ["ABS"])
    assert one["features"][:5] == ["cg-0123-4", "cg 0123 4", "cg01234", "3.2.1", "12mm"] and one["facets"] == ["numbers", "scope"]
    assert all(got[i][c] == [] for i in (2, 3) for c in ("codes", "clauses", "quantities", "sessions", "only", "excluded", "features", "facets"))
    assert (got[4]["only"], got[4]["excluded"], got[4]["sessions"]) == ([], ["DNV"], ["MEPC82", "MSC107"])
    assert len(got[5]["features"]) == signals.FEATURES and got[5]["features"][0] == "code-7"
    assert got[6]["quantities"] == ["30%", "7t"]
    lanes = defaultdict(list)
    for r in signals.lanes(signals.signals(spark.createDataFrame(asked, "question_id bigint, question string"))).orderBy("priority").collect():
        lanes[r["question_id"]].append(r["lane"])
    assert lanes == {1: ["literal", "table", "scoped"], 2: ["sparse"], 3: ["sparse"], 4: ["scoped", "sparse"], 5: ["literal", "sparse"], 6: ["table", "sparse"]}


def test_lanes_are_united_in_turns(spark):
    chosen = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1), (3, "a", 1)], "question_id bigint, lane string, priority bigint")
    hits = lambda rows: spark.createDataFrame(rows, "question_id bigint, id bigint, rank bigint")
    a = hits([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 90, 1)])
    b = hits([(1, 11, 1), (1, 20, 2), (2, 20, 1), (2, 21, 2), (1, 30, 9)])
    got = signals.dispatched(chosen, {"a": a, "b": b}, 4).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 10, "a"), (1, 2, 11, "b"), (1, 3, 20, "b"), (1, 4, 12, "a"), (2, 1, 20, "b"), (2, 2, 21, "b")]


def test_filters_of_pools(spark):
    rows = [(1, "Document code and TITLE of all"), (2, "AB-12 and CD-3/4 and EF-5"), (3, "AB-12 and CD-3"), (4, None)]
    assert {r["id"] for r in signals.rule_pool(spark.createDataFrame(rows, "id bigint, text string")).collect()} == {3, 4}
    kinds = [("report", 0.0), ("Decision", 0.1), ("decision", 0.09), ("agenda", None), ("summary", 0.3), ("other", 9.0), (None, 9.0)]
    got = signals.eligible(spark.createDataFrame(kinds, "kind string, score double")).collect()
    assert sorted((r["kind"], r["tier"], r["final"]) for r in got) == [("Decision", 1, 0.0), ("report", 0, 0.0), ("summary", 2, 0.1)]


def test_forced_hits_against_a_loop(spark):
    draw = random.Random(4)
    rows = [(0 if i % 3 == 0 else draw.randrange(1, 12), i, draw.choice([None, 0.1, 0.2, 0.3, 0.4]), draw.choice([True, False, False, None]), draw.choice([True, False, False, None])) for i in range(240)]
    expected = set()
    for group in range(12):
        own = [r for r in rows if r[0] == group]
        key = lambda r: (not r[3], r[2] is None, r[2] or 0.0, r[1])
        near = sorted(own, key=key)
        forced = [r for r in near if r[3] or r in [x for x in near if x[4]][:3]]
        taken = (forced + [r for r in near if r not in forced])[:8]
        expected |= {(group, r[1], place) for place, r in enumerate(sorted(taken, key=key), 1)}
    pool = spark.createDataFrame(rows, "group_id bigint, id bigint, distance double, literal boolean, outcome boolean")
    got = signals.forced_merge(pool, 8, 3).collect()
    assert {(r["group_id"], r["id"], r["place"]) for r in got} == expected and len(got) == len(expected)


def test_slots_by_type_against_a_loop(spark):
    draw = random.Random(5)
    rows = [(g, k, i, draw.choice([0.5, 0.5, 0.9, None]), draw.choice(["x", "y", None])) for i in range(150) for g, k in [draw.choice([(1, "table"), (2, "rule"), (3, "none"), (1, "table")])]]
    slots = {"table": [("first", F.col("tag") == "x"), ("rest", F.lit(True))], "rule": [("only", F.col("tag") == "y")]}
    plain = {"table": [("first", lambda t: t == "x"), ("rest", lambda t: True)], "rule": [("only", lambda t: t == "y")]}
    expected = set()
    for g, k in {(r[0], r[1]) for r in rows}:
        filled = defaultdict(list)
        for r in (r for r in rows if r[:2] == (g, k)):
            slot = next((i for i, (_, test) in enumerate(plain.get(k, [])) if test(r[4])), None)
            filled[slot].append(r)
        filled.pop(None, None)
        for place, i in enumerate(sorted(filled), 1):
            expected.add((g, k, plain[k][i][0], min(filled[i], key=lambda r: (r[3] is None, -(r[3] or 0), r[2]))[2], place))
    got = signals.slots_by_type(spark.createDataFrame(rows, "group_id bigint, kind string, id bigint, score double, tag string"), slots).collect()
    assert set(map(tuple, got)) == expected and len(got) == len(expected) == 3


def test_key_clauses(spark):
    questions = spark.createDataFrame([(1, "pressure of the tank"), (2, None)], "question_id bigint, question string")
    clauses = [(1, "a", 3, "The tank shall hold 5 bar at 3.2 per AB-1", None), (1, "b", 1, "pressure tank", 0.1), (1, "c", 2, "pressure tank", 0.1), (1, "d", 9, None, None), (2, "e", 1, "must", 1.0)]
    got = signals.key_clauses(spark.createDataFrame(clauses, "question_id bigint, clause_id string, pos bigint, text string, authority double"), questions, 3).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 2.4, 1), (1, "b", 2.1, 2), (1, "c", 2.1, 3), (2, "e", 1.35, 1)]
