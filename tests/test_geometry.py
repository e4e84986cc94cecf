"""Overlaps, greedy suppression and captions against brute force, on boxes that no generator of the queries makes."""

import random

import pytest

from fathomline.operators import geometry

SCHEMA = "page bigint, block bigint, x0 double, y0 double, x1 double, y1 double, sure double"


def random_boxes(n, pages, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all boxes on page 0; small shifts, so that chains come about; ties in score
        page = 0 if i % 3 == 0 else draw.randrange(pages)
        x, y = draw.choice([0, 130, 395]) + draw.randrange(8), draw.choice([-60, 95]) + draw.randrange(5)
        rows.append((page, i, float(x), float(y), float(x + draw.choice([100, 103, 260])), float(y + draw.choice([40, 41])), draw.choice([None, 0.5, 0.5, 0.9, 0.2])))
    rows += [(0, n, None, 0.0, 9.0, 9.0, 1.0), (None, n + 1, 0.0, 95.0, 100.0, 135.0, 1.0), (0, n + 2, 5.0, 5.0, 5.0, 9.0, 1.0)]
    return rows


def iou(a, b):
    side = lambda i, j: max(0.0, min(a[j], b[j]) - max(a[i], b[i]))
    both = side(2, 4) * side(3, 5)
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return both / (area(a) + area(b) - both)


def usable(rows):
    return [r for r in rows if None not in r[:6] and r[4] > r[2] and r[5] > r[3]]


def test_overlaps_against_all_pairs(spark):
    rows = random_boxes(150, 4, 1)
    expected = {(a[0], a[1], b[1]) for a in usable(rows) for b in usable(rows) if a[0] == b[0] and a[1] < b[1] and iou(a, b) >= 0.6}
    got = geometry.overlaps(spark.createDataFrame(rows, SCHEMA), 0.6, tile=64.0).collect()
    assert {(r["page"], r["a"], r["b"]) for r in got} == expected and len(got) == len(expected) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_suppression_is_greedy(spark, seed):
    rows = random_boxes(150, 4, seed)
    gone = set()
    for page in range(4):
        kept = []
        for r in sorted((r for r in usable(rows) if r[0] == page), key=lambda r: (-(float("-inf") if r[6] is None else r[6]), r[1])):
            if any(iou(r, k) >= 0.92 for k in kept):
                gone.add((page, r[1]))
            else:
                kept.append(r)
    got = geometry.suppressed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["page"], r["block"]) for r in got} == gone and len(got) == len(gone) > 20


def test_what_a_dropped_box_overlaps_stays(spark):
    # A over B, B over C, A and C apart; and a longer chain of equal scores
    rows = [(1, 1, 0.0, 0.0, 100.0, 10.0, 0.9), (1, 2, 4.0, 0.0, 104.0, 10.0, 0.8), (1, 3, 8.0, 0.0, 108.0, 10.0, 0.7)]
    rows += [(2, i, 4.0 * i, 0.0, 4.0 * i + 100, 10.0, 0.5) for i in range(7)]
    got = geometry.suppressed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["page"], r["block"]) for r in got} == {(1, 2), (2, 1), (2, 3), (2, 5)}
    assert geometry.suppressed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_captions_against_brute_force(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(3), i, x := float(draw.randrange(-100, 500)), y := float(draw.randrange(900)), x + draw.randrange(-3, 200), y + draw.randrange(1, 60), 0.0) for i in range(200)]
    figures, captions = rows[:100], rows[100:]
    expected = {}
    for f in figures:
        near = [(c[3] - f[5], c[1]) for c in captions if c[0] == f[0] and 0 <= c[3] - f[5] <= 120 and min(f[4], c[4]) > max(f[2], c[2])]
        if near:
            expected[f[1]] = min(near)
    got = geometry.nearest_below(spark.createDataFrame(figures, SCHEMA), spark.createDataFrame(captions, SCHEMA), 120.0).collect()
    assert {r["block"]: (r["gap"], r["caption"]) for r in got} == expected and len(got) == len(expected)
