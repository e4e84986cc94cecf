"""Sets within longer ones against all pairs, in blocks of any size, and what is shuffled for them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.operators import containment, setblocks

WORDS = [f"w{i}" for i in range(14)]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    drawn = [("x" if i % 3 else "y", sorted({"all", *draw.sample(WORDS, draw.randrange(0, 9))})) for i in range(220)]
    drawn += [("x", []), ("z", ["all"]), ("x", ["all"]), *drawn[:9], *drawn[:9]]
    drawn += [("x", ["w3", "all", "w3"])]
    return spark.createDataFrame([(s, " ".join(w), w) for s, w in drawn], "scope string, text string, words array<string>").repartition(3).cache()


def all_pairs(rows):
    named = containment.distinct_sets(rows, ["scope"], F.col("words")).collect()
    out = {}
    for a in named:
        longer = [(-len(b["words"]), b["set_id"]) for b in named if a["scope"] == b["scope"] and set(a["words"]) < set(b["words"])]
        if longer:
            out[a["scope"], a["set_id"]] = (len(longer), min(longer)[1])
    return out


def found(rows):
    got = setblocks.longer_sets(rows).collect()
    out = {(r["scope"], r["set_id"]): (r["n_longer"], r["longest"]) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize(("common", "block"), [(0, 1 << 23), (5, 64), (1 << 16, 64), (1 << 16, 1 << 23)], ids=["no common word", "small blocks", "common words only", "a block per scope"])
def test_longer_sets_against_all_pairs(rows, monkeypatch, common, block):
    monkeypatch.setattr(setblocks, "BLOCK", block)
    monkeypatch.setattr(setblocks, "COMMON", common)
    assert found(rows) == all_pairs(rows) and len(all_pairs(rows)) > 80


def test_words_with_one_code_are_told_apart_by_another_seed(rows, monkeypatch):
    code, seeds = setblocks.code, []

    def same(seed, scope, word):
        seeds.append(seed)
        return F.lit(7).cast("long") if seed < 2 else code(seed, scope, word)

    monkeypatch.setattr(setblocks, "code", same)
    assert found(rows) == all_pairs(rows) and set(seeds) == {0, 1, 2}


def test_no_sets(rows):
    assert found(rows.where("false")) == {} and found(rows.where("size(words) = 0")) == {}


def test_a_set_is_shuffled_once_however_many_blocks_there_are(spark, rows, monkeypatch):
    """``containers`` sends a set to each part that one of its words is dealt to, and to each split."""
    monkeypatch.setattr(setblocks, "BLOCK", 64)
    kept = setblocks.blocks(rows)
    assert kept.count() > 10
    ids = [i for r in kept.collect() for i in setblocks.Block(r["sets"], r["others"]).ids.to_pylist()]
    assert len(ids) == containment.distinct_sets(rows, ["scope"], F.col("words")).count()
    plan = setblocks.met(kept)._jdf.queryExecution().executedPlan().toString()
    # blocks are read where they meet; the one exchange is that of what was found
    assert "CartesianProduct" in plan and plan.count("Exchange ") == 1 and "FlatMapCoGroups" not in plan


def test_many_copies_of_a_short_line_make_no_large_block(spark, monkeypatch):
    monkeypatch.setattr(setblocks, "BLOCK", 4000)
    draw = random.Random(7)
    lines = [["a"]] * 30_000 + [[]] * 9000 + [sorted(draw.sample([f"w{i}" for i in range(300)], 10)) for _ in range(4000)]
    rows = spark.createDataFrame([("x", " ".join(w), w) for w in lines], "scope string, text string, words array<string>")
    sizes = [len(setblocks.Block(r["sets"], r["others"]).words) for r in setblocks.blocks(rows).collect()]
    assert sum(sizes) == 40_001 and max(sizes) < 8000 and len(sizes) < 20


def test_a_query_makes_use_of_blocks(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(containment, "longer_sets", lambda sets: (asked.append(sets.columns), setblocks.longer_sets(sets))[1])
    assert containment.subsumed_lines(spark, "/root/testdata/sf0.001").columns == ["lang", "set_id", "n_longer", "longest"] and asked == [["scope", "text", "words"]]


def rows_of(sets, scope="s"):
    """Sets of numbers as rows of ``ENCODED``; those from ``COMMON`` on are codes of other words."""
    common = [np.array([w for w in s if w < setblocks.COMMON], np.uint16).tobytes() for s in sets]
    other = [np.array([w for w in s if w >= setblocks.COMMON], np.uint64).tobytes() for s in sets]
    ids = [i.to_bytes(32, "big") for i in range(len(sets))]
    return pa.table({"scope": [scope] * len(sets), "share": pa.array([0] * len(sets), pa.int32()), "set_id": ids, "common": pa.array(common, pa.binary()), "other": pa.array(other, pa.binary())})


@pytest.mark.parametrize("pairs", [1, 50, 1 << 20])
def test_a_cell_in_calls_of_any_size(monkeypatch, pairs):
    monkeypatch.setattr(setblocks, "PAIRS", pairs)
    draw = random.Random(5)
    words = [*range(8), *(2**63 + 2**40 * i for i in range(8))]
    left, right = ([sorted(draw.sample(words, draw.randrange(1, 9))) for _ in range(90)] for _ in range(2))
    few, many = (setblocks.block(rows_of(s)).to_pylist()[0] for s in (left, right))
    got = setblocks.Containers(many["sets"], many["others"]).of(setblocks.Block(few["sets"], few["others"])).to_pylist()
    expected = {}
    for a, x in enumerate(left):
        longer = [(-len(y), b) for b, y in enumerate(right) if set(x) < set(y)]
        if longer:
            expected[a] = (len(longer), -min(longer)[0], min(longer)[1])
    number = lambda i: int.from_bytes(i, "big")
    assert {number(r["set_id"]): (r["n_longer"], r["n"], number(r["longest"])) for r in got} == expected and len(expected) > 5
