"""Operator 1 against the weighted similarity of all pairs."""

import collections
import math
import re
import string

import numpy as np
import pytest
from oracle import SF

from fathomline.llm import near_dup, queries
from fathomline.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return tuple(WORD.findall((text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))


def shingles(words):
    return collections.Counter(words[i : i + 5] for i in range(max(1, len(words) - 4)))


def weigher(texts):
    """similarity(words, words) with the weights that all distinct texts give."""
    distinct = {w for w in map(words_of, texts) if w}
    sets = {w: shingles(w) for w in distinct}
    counts = collections.Counter(s for x in sets.values() for s in x)
    widest = math.log((1 + len(distinct)) / 2)
    weight = {s: (1 + math.log((1 + len(distinct)) / (1 + n)) / widest) / 2 if widest > 0 else 1.0 for s, n in counts.items()}
    total = {w: sum(n * weight[s] for s, n in x.items()) for w, x in sets.items()}

    def similarity(a, b):
        both = sum(min(n, sets[b][s]) * weight[s] for s, n in sets[a].items() if s in sets[b])
        return both / (total[a] + total[b] - both)

    return sets, similarity


def classes_of(texts, limit=0.8):
    """Smallest id of every text's class, from all pairs of texts."""
    sets, similarity = weigher(texts.values())
    parent = {w: w for w in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    nodes = list(sets)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if not sets[a].keys().isdisjoint(sets[b]) and root(a) != root(b) and similarity(a, b) >= limit:
                parent[root(a)] = root(b)
    least = {}
    for i, t in texts.items():
        if w := words_of(t):
            least[root(w)] = min(i, least.get(root(w), i))
    return {i: least[root(words_of(t))] if words_of(t) else i for i, t in texts.items()}


def found(docs, **options):
    return {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs, **options).collect()}


def test_against_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["class_id"] for r in queries.op1_near_duplicates(spark, SF).collect()} == classes_of(texts)


def test_a_large_group_of_near_copies(spark):
    draw = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[int(draw.integers(120))] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"z{i}x{j}" for j in range(80)) + " " + " ".join(base[:30])) for i in range(40)]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == classes_of(dict(rows))


def test_shared_shingles_of_little_weight_make_no_copies(spark):
    # two texts are alike by the number of their shingles, but what they share is in all texts
    common = " ".join(f"c{i}" for i in range(100))
    rows = [(i, f"{common} " + " ".join(f"own{i}x{j}" for j in range(9))) for i in range(60)]
    texts = dict(rows)
    plain = len(shingles(words_of(texts[0])) & shingles(words_of(texts[1]))) / len(shingles(words_of(texts[0])) | shingles(words_of(texts[1])))
    assert plain > 0.8 > weigher(texts.values())[1](words_of(texts[0]), words_of(texts[1]))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == {i: i for i in texts}


def hub_group(n, words, changed, seed=2):
    """An original and ``n`` copies with ``changed`` words each: copies are like the original, not like each other."""
    draw = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):
        w = list(base)
        for j in draw.choice(np.arange(5, words - 5, 6), changed, replace=False):
            w[j] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_hub_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE_BYTES", 100_000)
    rows = hub_group(700, 200, 2)
    others = [(10_000 + i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(1000)]
    _, similarity = weigher([t for _, t in rows + others])
    first = words_of(rows[0][1])
    assert min(similarity(first, words_of(t)) for _, t in rows[1:]) >= 0.8  # so all are of one class, whatever their own pairs are
    docs = spark.createDataFrame(rows + others, "doc_id bigint, text string").repartition(4)
    got = found(docs)
    assert {got[i] for i, _ in rows} == {0} and all(got[i] == i for i, _ in others)


def test_open_buckets_are_compared_in_full(spark, monkeypatch):
    # without the original most copies are left to the tiles
    monkeypatch.setattr(near_dup, "TILE_BYTES", 30_000)
    rows = hub_group(150, 200, 3)[1:]
    rows += [(1000 + i, t.replace("w1 ", "w1x ")) for i, t in hub_group(40, 200, 3, 5)[1:]]
    rows += [(2000 + i, re.sub(r"w19[0-9]", "end", t)) for i, t in rows[::3]]
    expected = classes_of(dict(rows))
    assert 20 < len(set(expected.values())) < len(rows)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected


def test_recall_in_large_buckets(spark):
    # pairs just over the limit among many that are just under it
    draw = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        w[60:] = [f"own{i // 2}x{j}" for j in range(90)]
        if i % 2:
            for j in draw.choice(np.arange(70, 145, 6), 2, replace=False):
                w[j] = f"mine{i}x{j}"
        rows.append((i, " ".join(w)))
    expected, got = classes_of(dict(rows)), found(spark.createDataFrame(rows, "doc_id bigint, text string"))
    linked = [i for i in expected if expected[i] != i]
    assert len(linked) > 150 and sum(got[i] == expected[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] in (i, expected[i]) for i in expected)


def test_edges(odd, none):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] not in (None, 9)}
    assert got[1] == got[2] == 1
    assert all(got[i] == i for i in (4, 5, 6, 8, 11))
    assert {r["class_id"] for r in rows if r["doc_id"] is None} == {1, None}
    assert near_dup.near_duplicates(none).count() == 0


def test_one_row_of_each_class(spark, odd, none):
    kept = near_dup.representatives(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "4", "5", "6", "7", "8", "9", "9", "10", "11", "None"])  # the row without id has no words
    twice = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c, d e f"), (7, "x y"), (7, "x y"), (7, "z")], "doc_id bigint, text string")
    assert sorted(str(r["doc_id"]) for r in near_dup.representatives(twice).collect()) == ["7", "7", "None"]
    assert near_dup.representatives(none).count() == 0


def test_samples_agree_as_often_as_sets_are_alike():
    def drawn(words, weights):
        h = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return near_dup.draw(h, np.array(weights, float), np.array([0]))[0]

    same = 0
    for t in range(300):
        a, b = drawn([4 * t + 1, 4 * t + 2], [2.0, 1.0]), drawn([4 * t + 1, 4 * t + 3], [1.0, 1.0])
        same += (a == b).sum()
    assert abs(same / 300 / 30 - 1 / 4) < 0.03  # (1) / (2 + 1 + 1)


@pytest.mark.parametrize("bits", [4, 10, 20])
def test_hashes_in_six_bytes(bits):
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64)
    part = int(hashes[0]) >> (64 - bits)
    of = hashes[hashes >> np.uint64(64 - bits) == part] & near_dup._mask(bits)
    assert (near_dup._long(near_dup._short(of, bits), part, bits) == of).all()


def test_counts_are_exact_whatever_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK_BYTES", 300)
    texts = [" ".join(f"w{(i * j) % 7}" for j in range(12)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = near_dup.distinct_texts(docs).cache()
    shared = near_dup.shared_shingles(made, 5, 6)
    rows = {bytes(r["node"]): np.frombuffer(r["counts"], np.uint32).tolist() for r in near_dup.signatures(made, shared, made.count(), 5, 6).collect()}
    sets = {words_of(t): shingles(words_of(t)) for t in texts}
    counts = collections.Counter(s for x in sets.values() for s in x)
    for r in made.collect():
        assert sorted(rows[bytes(r["node"])]) == sorted(counts[s] for s in sets[words_of(r["text"])])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_shuffles_of_texts_are_gone_when_samples_are_drawn(spark, monkeypatch):
    sent = lambda: {f.getName() for f in files() if "shuffle_" in f.getName()}
    files = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
    monkeypatch.setattr(near_dup, "signatures", lambda *a, drawn=near_dup.signatures: (left.append(sent() - before), drawn(*a))[1])
    left, before = [], sent()
    rows = [(i, f"{i} words of a text that is like others but for {i % 7}") for i in range(200)]
    near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    assert len({name.split("_")[1] for name in left[0]}) <= 1  # that of the count of texts
