"""Batches that go on where they ended, and follow-up questions against a loop over items."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomline.operators import batches, followup, inverted


def stages(log, fail_in=None):
    def stage(name):
        def run(rows):
            log.append((name, sorted(str(r["doc_id"]) for r in rows.select("doc_id").collect())))
            if name == fail_in:
                raise RuntimeError("killed")
            keep = [c for c in rows.columns if c != "error"]
            return rows.select(*keep, batches.failing((F.col("text").contains(f"bad {name}"), f"{name} broke")).alias("error"))

        return run

    return [(n, stage(n)) for n in ("one", "two", "three")]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, error string")


def test_a_run_goes_on_where_another_ended(spark, tmp_path):
    root, log = str(tmp_path), []
    docs = docs_of(spark, [(1, "fine", None), (2, "bad two", None), (3, None, "x"), (4, "fine", None), (4, "fine", None), (None, "lost", None)])
    with pytest.raises(RuntimeError):
        batches.run_batch(docs, stages(log, fail_in="three"), root)
    assert [n for n, _ in log] == ["one", "two", "three"]
    log.clear()
    out = batches.run_batch(docs, stages(log), root)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]
    # the first two stages had nothing left to do, and what failed in the second never came to the third
    assert log == [("one", []), ("two", []), ("three", ["1", "3", "4"])]
    assert [(r["doc_id"], r["stage"], r["error"]) for r in batches.errors(spark, root).collect()] == [(2, "two", "two broke")]


def test_new_and_changed_documents_only(spark, tmp_path):
    root, log = str(tmp_path), []
    batches.run_batch(docs_of(spark, [(1, "a", None), (2, "bad one", None), (5, "e", None)]), stages([]), root)
    out = batches.run_batch(docs_of(spark, [(1, "a", None), (2, "mended", None), (3, "new", None)]), stages(log), root)
    assert log == [(n, ["2", "3"]) for n in ("one", "two", "three")]
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, "a"), (2, "mended"), (3, "new")}


def test_a_batch_of_nothing(spark, tmp_path):
    out = batches.run_batch(docs_of(spark, []), stages([]), str(tmp_path))
    assert out.count() == 0 and batches.errors(spark, str(tmp_path)).count() == 0


def words(text):
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 1]


def by_hand(docs, items):
    held = {d: Counter(words(t)) for d, t, _ in docs}
    source = {d: s or "" for d, _, s in docs}
    n, total = len(held), sum(sum(c.values()) for c in held.values())
    df = Counter(w for c in held.values() for w in c)
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)

    def best(asked, depth):
        q, found = Counter(asked), []
        for d, c in held.items():
            s = round(sum(m * (0.25 * mean if raw[w] < 0 else raw[w]) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / (total / n))) for w, m in q.items() if c[w]), 6)
            if s > 0:
                found.append((-s, d))
        return [d for _, d in sorted(found)[:depth]]

    out = []
    for item, text in items:
        first = best(words(text), 5)
        facets = [w for w in dict.fromkeys(words(text)) if not any(held[d][w] for d in first)][:4]
        lists, main = [best([w], 3) for w in facets], list(first)
        for place in range(3):
            for hits in lists:
                if len(hits) > place and hits[place] not in main:
                    main.append(hits[place])
        context = []
        for d in main:
            for near in (d - 1, d + 1):
                if near in source and source[near] == source[d] and near not in main and near not in context:
                    context.append(near)
        rows = [(d, "first" if i < len(first) else "follow") for i, d in enumerate(main)] + [(d, "context") for d in context[:8]]
        out += [(item, place, d, kind) for place, (d, kind) in enumerate(rows, 1)]
    return sorted(out)


def test_follow_ups_against_a_loop(spark, tmp_path):
    names = ["harbour", "engine", "ballast", "crane", "anchor", "rudder", "pilot", "signal"]
    docs = [(i, f"report {names[i % 8]} {names[(i * 3) % 8]} " + "filler " * (i % 5), f"s{i // 20}") for i in range(90)]
    docs += [(200 + i, f"{w} alone", None) for i, w in enumerate(["keel", "mast", "galley", "stern", "bilge"] * 2)] + [(300, None, "s"), (301, "", "s")]
    items = [(1, "harbour engine keel mast galley stern bilge"), (2, "report"), (3, None), (4, "unknown words only"), (5, "anchor keel keel"), (6, "crane anchor rudder pilot signal")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    index = inverted.build_index(frame.select("doc_id", "text"), str(tmp_path))
    got = followup.follow_up(index, spark.createDataFrame(items, "item_id bigint, text string"), frame).collect()
    assert sorted((r["item_id"], r["place"], r["doc_id"], r["kind"]) for r in got) == by_hand(docs, items)
    assert {"first", "follow", "context"} <= {r["kind"] for r in got}
