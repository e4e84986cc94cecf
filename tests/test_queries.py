"""Every query with SQL gives the rows of its SQL; the others are held against brute force."""

import statistics

import numpy as np
import pytest
from oracle import SF, rows_of, sql_rows

from fathomline import registry
from fathomline.operators import vectors


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == sql_rows(registry.ORACLES[name], SF)


def test_names_match():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_diverse_choice_against_brute_force(spark):
    pool = {}
    for r in vectors.mmr_pool(spark, SF).collect():
        pool.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"], r["doc"], r["page"], set(r["words"])))
    expected = set()
    for q, rows in pool.items():
        best = {}
        for row in sorted(rows, key=lambda r: r[:2]):
            best.setdefault(row[2:4], row)
        left, chosen = sorted(best.values(), key=lambda r: r[:2]), []
        while left and len(chosen) < 8:
            docs = [c[2] for c in chosen]
            allowed = [r for r in left if docs.count(r[2]) < 2 and (r[2] in docs or len(set(docs)) < 6)]
            if not allowed:
                break

            def score(r):
                relevance = 0.72 * -r[0] - 0.28 * max(jaccard(r[4], c[4]) for c in chosen) if chosen else -r[0]  # noqa: B023
                return relevance - 0.06 * docs.count(r[2])  # noqa: B023

            top = max(map(score, allowed))
            pick = next(r for r in allowed if score(r) > top - 1e-12)
            left.remove(pick)
            chosen.append(pick)
        expected |= {(q, r[1], i) for i, r in enumerate(chosen, 1)}
    got = registry.QUERIES["mmr_select"](spark, SF).collect()
    assert {(r["query_id"], r["vec_id"], r["place"]) for r in got} == expected


def test_knees_by_the_rule(spark):
    hits = {}
    for r in vectors.lane(spark, SF).collect():
        hits.setdefault(r["query_id"], []).append((r["rank"], round(1 - r["score"], 6)))
    for r in registry.QUERIES["knee_cut"](spark, SF).collect():
        d = [x for _, x in sorted(hits[r["query_id"]])][:13]
        gaps = [round(b - a, 6) for a, b in zip(d, d[1:])]
        least = max(0.01, round(2 * statistics.median([g for g in gaps if g >= 0]), 6))
        fits = [(g, -cut) for cut, g in enumerate(gaps, 1) if 3 <= cut <= 12 and g >= least]
        assert r["kept"] == (-max(fits)[1] if fits else None)


def test_the_second_stage_searches_all_rows_of_the_routed_labels(spark, tmp_path):
    # the 20 nearest of query 0 are of labels 1 and 2 but for two rows of each below them
    draw, rows = np.random.default_rng(3), [(0, [1.0, 0.0], 1)]
    for i in range(1, 60):
        angle = 0.01 * i if i % 20 else 3.0
        rows.append((i, [float(np.cos(angle)), float(np.sin(angle))], 1 if i in (1, 2, 30, 31, 41) else 2 if i in (3, 33, 43) else 3 + i % 9))
    order = draw.permutation(len(rows))
    spark.createDataFrame([rows[i] for i in order], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    routed = {(r["query_id"], r["label"]): r["route"] for r in registry.QUERIES["doc_routing"](spark, str(tmp_path)).where("route <= 2").collect()}
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v, _ in rows}
    expected = set()
    for q in (0, 20, 40):
        near = [(round(1 - round(float(unit[q] @ unit[i]), 6) - (0.2 if routed[q, label] == 1 else 0.13), 6), i) for i, _, label in rows if i != q and (q, label) in routed]
        expected |= {(q, i, place) for place, (_, i) in enumerate(sorted(near)[:10], 1)}
    got = registry.QUERIES["routed_stage2"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["vec_id"], r["place"]) for r in got} == expected


def test_farthest_points_against_brute_force(spark):
    pages = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        name = r["p_name"] or ""
        pages.setdefault(r["p_partkey"] // 100, {})[r["p_partkey"]] = {name[i : i + 3] for i in range(max(1, len(name) - 2))}
    expected = set()
    for page, grams in pages.items():
        far = lambda a, b: 1 - len(a & b) / max(1, len(a | b))
        chosen = [min(grams, key=lambda k: (-len(grams[k]), k))]  # noqa: B023
        while len(chosen) < min(12, len(grams)):
            rest = [k for k in sorted(grams) if k not in chosen]
            chosen.append(max(rest, key=lambda k: (min(far(grams[k], grams[c]) for c in chosen), -k)))  # noqa: B023
        expected |= {(page, k, i) for i, k in enumerate(chosen, 1)}
    got = registry.QUERIES["farthest_point"](spark, SF).collect()
    assert {(r["page"], r["p_partkey"], r["place"]) for r in got} == expected


def test_boundary_chunks_against_brute_force(spark):
    expected = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words, at, chunk = (r["text"] or "").split(), 0, 0
        while at < len(words):
            n = len(words[at : at + 120])
            ends = [k for k in range(81, n + 1) if words[at + k - 1].endswith((".", "!", "?"))]
            n = max(ends) if ends and at + n < len(words) else n
            expected.add((r["doc_id"], chunk, at, n))
            at, chunk = at + n, chunk + 1
    got = registry.QUERIES["boundary_chunks"](spark, SF).collect()
    assert {(r["doc_id"], r["chunk"], r["first_word"], r["n_words"]) for r in got} == expected
