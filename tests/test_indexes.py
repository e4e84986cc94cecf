"""Versioned tables, the inverted index and the vector index."""

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from fathomline.operators import cells, inverted, texts, vectors
from fathomline.sources import versions

WORDS = [f"{a}{b}" for a in ("ka", "mo", "ri", "tu") for b in ("lan", "dor", "vex", "nim", "sol")]


def corpus(spark, n, seed=1, base=0):
    """Documents with a word that all have, rare ones, empty and null texts."""
    draw = np.random.default_rng(seed)
    rows = [(base + i, None if i % 41 == 7 else "" if i % 41 == 8 else "the " * (1 + i % 3) + " ".join(draw.choice(WORDS, int(draw.integers(1, 30))))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(0, "the kalan mosol"), (1, "tunim tunim ridor"), (2, "the the the"), (3, None), (4, "unknownword"), (5, " ".join(WORDS))]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def scores(df):
    return {(r["item_id"], r["doc_id"]): r["score"] for r in df.collect()}


def okapi_by_hand(docs, items):
    import math
    import re
    from collections import Counter

    words = lambda t: [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1]
    held = {r["doc_id"]: Counter(words(r["text"])) for r in docs}
    n, total = len(held), sum(sum(c.values()) for c in held.values())
    df = Counter(w for c in held.values() for w in c)
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = {}
    for item in items:
        for doc, c in held.items():
            s = sum(q * (0.25 * mean if raw[w] < 0 else raw[w]) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / (total / n))) for w, q in Counter(words(item["text"])).items() if c[w])
            if round(s, 6) > 0:
                out[item["item_id"], doc] = pytest.approx(s, abs=2e-6)
    return out


def test_search_reads_the_index(spark, items, tmp_path):
    docs = corpus(spark, 300)
    index = inverted.build_index(docs, str(tmp_path))
    expected = okapi_by_hand(docs.collect(), items.collect())
    assert scores(inverted.okapi(index, items)) == expected
    best = scores(texts.top_ranked(inverted.okapi(index, items), "item_id", "doc_id", 5))
    assert scores(texts.top_ranked(inverted.best_documents(index, items, 5), "item_id", "doc_id", 5)) == best


def test_blocks_below_the_bound_are_not_read(spark, tmp_path):
    # one document of 3,000 has both rare words; the others share a common one
    rows = [(i, "common filler text" if i != 2500 else "needle haystack common") for i in range(3000)] + [(3000 + i, "needle alone") for i in range(4)]
    index = inverted.build_index(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path))
    asked = spark.createDataFrame([(1, "needle haystack common")], "item_id bigint, text string")
    found = inverted.best_documents(index, asked, 1)
    assert texts.top_ranked(found, "item_id", "doc_id", 1).first()["doc_id"] == 2500
    # the first blocks are scored for the bound; of the result only the block of the needle is left
    assert {r["doc_id"] // inverted.BLOCK for r in found.collect()} == {2500 // inverted.BLOCK}


def test_segments_replace_documents(spark, items, tmp_path):
    docs, changed = corpus(spark, 200), corpus(spark, 60, seed=2, base=170)
    inverted.build_index(docs, str(tmp_path))
    inverted.add_documents(changed, str(tmp_path))
    index = inverted.add_documents(corpus(spark, 10, seed=3, base=165), str(tmp_path))
    newest = {r["doc_id"]: r for d in (docs, changed, corpus(spark, 10, seed=3, base=165)) for r in d.collect()}
    assert scores(inverted.okapi(index, items)) == okapi_by_hand(list(newest.values()), items.collect())
    fresh = inverted.build_index(spark.createDataFrame([tuple(r) for r in newest.values()], docs.schema), f"{tmp_path}/other")
    counts = lambda i: {tuple(r) for r in i.terms().select("term", "df", "cf").collect()}
    assert counts(index) == counts(fresh) and (index.n, index.words) == (fresh.n, fresh.words)
    assert scores(inverted.best_documents(index, items, 300)) == scores(inverted.okapi(index, items))


def test_an_index_of_nothing(spark, items, tmp_path):
    index = inverted.build_index(corpus(spark, 1).where("false"), str(tmp_path))
    assert inverted.okapi(index, items).count() == 0 and index.terms().count() == 0


def test_only_asked_terms_are_read(spark, tmp_path):
    index = inverted.build_index(corpus(spark, 100), str(tmp_path))
    asked = spark.createDataFrame([("kalan",)], "term string")
    assert {r["term"] for r in index.postings(asked).collect()} == {"kalan"}
    plan = index.postings(asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_the_index_is_built_once_and_again_when_files_change(spark, tmp_path, monkeypatch):
    built = []
    monkeypatch.setattr(inverted, "build_index", lambda *a, f=inverted.build_index: built.append(1) or f(*a))
    corpus(spark, 20).write.parquet(f"{tmp_path}/documents.parquet")
    first = inverted.text_index(spark, str(tmp_path))
    assert inverted.text_index(spark, str(tmp_path)).segments == first.segments and len(built) == 1
    corpus(spark, 5, base=50).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert inverted.text_index(spark, str(tmp_path)).n == 25 and len(built) == 2


# --- versions -------------------------------------------------------------------------------------


def table_rows(df):
    return sorted((tuple(r) for r in df.select("k", "v", "at").collect()), key=str)


def test_rebuilding_twice_gives_one_table(spark, tmp_path):
    rows = spark.createDataFrame([(i % 40, f"v{i}", i) for i in range(100)] + [(None, "none", 1), (None, None, 2)], "k int, v string, at int")
    a = versions.rebuild(rows, f"{tmp_path}/a", "k", "at", buckets=8)
    b = versions.rebuild(rows.repartition(7), f"{tmp_path}/b", "k", "at", buckets=8)
    c = versions.rebuild(rows.limit(50), f"{tmp_path}/c", "k", "at", buckets=8)
    assert versions.fingerprint(a) == versions.fingerprint(b) != versions.fingerprint(c)
    expected = sorted([(k, f"v{k + 80 if k < 20 else k + 40}", k + 80 if k < 20 else k + 40) for k in range(40)] + [(None, None, 2)], key=str)
    assert table_rows(versions.read_version(spark, f"{tmp_path}/a")) == expected


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    root, schema = str(tmp_path), "k int, v string, at int"
    before = versions.rebuild(spark.createDataFrame([(i, "old", 5) for i in range(100)], schema), root, "k", "at", buckets=16)
    after = versions.upsert(spark.createDataFrame([(3, "new", 9), (3, "newer", 10), (4, "late", 1), (200, "added", 1)], schema), root)
    rows = {r["k"]: r["v"] for r in versions.read_version(spark, root).collect()}
    assert (rows[3], rows[4], rows[200], len(rows)) == ("newer", "old", "added", 101)
    paths = lambda v: {e["bucket"]: e["path"] for e in v.of("bucket")}
    kept = [b for b, p in paths(before).items() if paths(after)[b] == p]
    assert len(kept) >= 13
    assert {r["v"] for r in versions.read_version(spark, root, before).collect()} == {"old"}


def test_a_lost_writer_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path), "k int, v string, at int"
    versions.rebuild(spark.createDataFrame([(1, "good", 1)], schema), root, "k", "at")
    # a manifest that was begun and never committed
    (tmp_path / "versions" / "00000002").mkdir()
    (tmp_path / "versions" / "00000002" / "part-0.txt").write_text('{"kind": "tab')
    assert table_rows(versions.read_version(spark, root)) == [(1, "good", 1)]
    with monkeypatch.context() as m:
        m.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            versions.upsert(spark.createDataFrame([(1, "half", 2)], schema), root)
    assert table_rows(versions.read_version(spark, root)) == [(1, "good", 1)]
    assert versions.upsert(spark.createDataFrame([(1, "next", 3)], schema), root).number == 3
    assert table_rows(versions.read_version(spark, root)) == [(1, "next", 3)]


# --- vectors --------------------------------------------------------------------------------------


def test_recall_of_the_index(spark):
    rows = cells.dense_recall(spark, SF.replace("0.001", "0.01")).agg(F.sum("found"), F.sum("wanted")).first()
    assert rows[0] / rows[1] >= 0.9


@pytest.fixture(scope="module")
def clustered(spark):
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(30, 16))
    # a third of all rows in one cluster, rows that repeat, a zero vector, nulls
    own = np.where(np.arange(3000) % 3 == 0, 0, draw.integers(0, 30, 3000))
    data = centers[own] + 0.15 * draw.normal(size=(3000, 16))
    rows = [(i, int(own[i]), [float(x) for x in data[i]]) for i in range(3000)]
    rows += [(5000, None, rows[20][2]), (5001, 1, [0.0] * 16), (5002, 1, None), (None, 1, rows[0][2])]
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")


def hits(df):
    return {(r["query_id"], r["vec_id"], r["score"]) for r in df.collect()}


def test_cells_of_clustered_vectors(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "VECTORS", 64)
    index = cells.build_vector_index(clustered, str(tmp_path))
    queries = clustered.where("vec_id % 20 = 0")
    exact = hits(vectors.search(clustered, queries, 10))
    assert hits(cells.search_cells(index, queries, 10, share=1.0)) == exact
    found = hits(cells.search_cells(index, queries, 10))
    assert len(found & exact) >= 0.9 * len(exact) and index.share < 0.6
    assert index.blocks().agg(F.sum(F.size("id"))).first()[0] == 3002
    assert index.parts().agg(F.max("parts")).first()[0] > 1  # a large cell is several blocks


@pytest.mark.parametrize("split", [200, 1000], ids=["a split per block of the large cell", "more blocks than splits"])
def test_splits_of_the_index_change_no_hit(spark, clustered, tmp_path, monkeypatch, split):
    monkeypatch.setattr(cells, "VECTORS", 64)
    queries = clustered.where("vec_id % 20 = 0")
    index = cells.build_vector_index(clustered, str(tmp_path))
    found = cells.search_cells(index, queries, 10)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    whole = hits(found)
    for name, n in (("SPLIT", split), ("GROUP", 40)):
        monkeypatch.setattr(cells, name, n)
    assert index.splits == -(-3002 // split) and hits(cells.search_cells(index, queries, 10)) == whole
    assert hits(cells.search_cells(index, queries, 10, share=1.0)) == hits(vectors.search(clustered, queries, 10))
    # a list for each query and split, not for each block that it visits; tasks as many as there are of both
    lists = cells._scored(index, queries, len(index.centers), 10, None)
    assert lists.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 10 * index.splits
    assert lists.rdd.getNumPartitions() == index.splits * -(-queries.count() // 40)


def test_few_rows_go_to_the_driver_for_the_sample(spark):
    rows = spark.range(30_000).withColumnRenamed("id", "vec_id")
    order = [F.xxhash64("vec_id"), "vec_id"]
    few = cells.candidates(rows, 30_000, 500)
    assert 500 <= few.count() < 1000
    assert few.orderBy(*order).limit(500).collect() == rows.orderBy(*order).limit(500).collect()
    # ids that repeat share a hash, which may be large; tables no larger than the sample go whole
    for same in range(8):
        assert cells.candidates(rows.withColumn("vec_id", F.lit(same).cast("long")), 30_000, 500).count() == 30_000
    assert cells.candidates(rows.limit(10), 10, 500).count() == 10 and cells.candidates(rows.limit(0), 0, 500).count() == 0


def test_no_label_is_not_a_label(spark, clustered, tmp_path):
    index = cells.build_vector_index(clustered, str(tmp_path))
    queries = clustered.where("vec_id IN (20, 40)")
    # row 5000 has no label and the vector of row 20
    allowed = spark.createDataFrame([(20, -1), (40, 0)], "query_id bigint, label bigint")
    assert {q for q, _, _ in hits(cells.search_within(index, queries, allowed, 10))} == {40}


def test_filtered_search_climbs_until_it_has_enough(spark, clustered, tmp_path):
    index = cells.build_vector_index(clustered, str(tmp_path))
    queries = clustered.where("vec_id % 200 = 0")
    # one query's own cluster, another's far one, and a label that nothing has
    allowed = spark.createDataFrame([(r["vec_id"], lab) for i, r in enumerate(queries.select("vec_id").collect()) for lab in ([0], [7], [99], [3, 4])[i % 4]], "query_id bigint, label bigint")
    got = hits(cells.search_within(index, queries, allowed, 10))
    everything = vectors.search(clustered, queries, 4000).join(allowed, ["query_id", "label"], "left_semi")
    exact = hits(cells._best(everything.select("query_id", "vec_id", "label", "score"), 10))
    assert {q for q, _, _ in got} == {q for q, _, _ in exact}
    full = {q: sum(x[0] == q for x in exact) for q, _, _ in exact}
    assert all(sum(x[0] == q for x in got) == n for q, n in full.items())
    assert len(got & exact) >= 0.9 * len(exact)


def test_an_index_of_no_vectors(spark, clustered, tmp_path):
    index = cells.build_vector_index(clustered.where("false"), str(tmp_path))
    assert cells.search_cells(index, clustered.where("vec_id % 20 = 0"), 10).count() == 0


def test_cells_of_the_grid_change_no_hit(spark, clustered, monkeypatch):
    queries = clustered.where("vec_id % 20 = 0")
    whole = hits(vectors.search(clustered, queries, 10))
    for name, n in (("SPLIT", 300), ("GROUP", 40), ("VECTORS", 32), ("QUERY_VECTORS", 16)):
        monkeypatch.setattr(vectors, name, n)
    found = vectors.search(clustered, queries, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert hits(found) == whole and "FlatMapCoGroupsInArrow" in plan
    assert hits(vectors.search(clustered, queries.where("false"), 10)) == set()
