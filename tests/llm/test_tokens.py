"""Operators 6, 7 and 10 against the tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import SF
from tokenizers import Tokenizer

from fathomline.llm import bpe_counts, packing, quality, queries, training_order
from fathomline.llm.textarrays import hashed
from fathomline.llm.tokens import Kept, WordIds

WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    return ["", None, "a \n b\n\n", "it's I'LL 'tis a'b1 5's", "<|endoftext|>x<|startoftext|>", "x y", "a\x1cb \x1c c", "x ́y", *("".join(draw.choice(" \n\t'sltdve.,!é aZ09<|>日 ") for _ in range(60)) for _ in range(500))]


def ids_of(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_are_the_librarys(texts):
    assert bpe_counts.TokenCounter(BYTES).lengths(pa.array(texts))[1].tolist() == [len(x) for x in ids_of(BYTES, texts)]


def test_ids_are_the_librarys(texts):
    got = [x.tolist() for _, ids, lengths in WordIds(WORDS).batches(pa.array(texts)) for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == ids_of(WORDS, texts)


def thue_morse(n, blocks=("a", "b")):
    """Two words of n blocks whose sums modulo a power of two agree, or may."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join(blocks[x] for x in ones), "".join(blocks[1 - x] for x in ones)]


@pytest.mark.parametrize("words", [*(thue_morse(n) for n in (64, 128, 200, 256, 1 << 10, 1 << 12)), *(thue_morse(n, ("efefffee", "fefeeeff")) for n in (8, 16, 25, 32, 512))], ids=lambda w: f"{w[0][:2]}{len(w[0])}")
def test_regular_words(words):
    counter, ids_by = bpe_counts.TokenCounter(BYTES), WordIds(WORDS)
    # together in one batch, and then one after the other
    for texts in ([f"{w} end" for w in words], words, [words[1] + "!"], [words[0] + "!"]):
        assert counter.lengths(pa.array(texts))[1].tolist() == [len(x) for x in ids_of(BYTES, texts)]
        got = [x.tolist() for _, ids, lengths in ids_by.batches(pa.array(texts)) for x in np.split(ids, np.cumsum(lengths)[:-1])]
        assert got == ids_of(WORDS, texts)
    data = "\n".join([*words, words[0]]).encode()
    found = quality.slice_statistics(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert found[quality.STATISTICS.index("n_dup_lines")].tolist() == [1]


@pytest.mark.parametrize("same", [1, 7], ids=["all", "many"])
def test_units_whose_hashes_are_equal(same):
    """Whatever the hash says, a unit has its own values."""
    kept = Kept(np.int64)
    make = lambda units: (np.array([int.from_bytes(u[-7:], "big") for u in units], np.int64), np.ones(len(units), np.int64))
    weak = lambda data, start, end: (end - start).astype(np.uint64) * np.uint64(same > 1)
    draw = random.Random(3)
    for _ in range(20):
        units = sorted({bytes(draw.choice(b"abc0123") for _ in range(draw.randrange(1, 7))) for _ in range(40)})
        numbers = kept.find(pa.array(units, pa.large_binary()), make, weak)
        assert kept.values[kept.bounds[numbers]].tolist() == [int.from_bytes(u, "big") for u in units]


def test_hashes_depend_on_the_bytes_of_a_span_alone():
    draw = random.Random(8)
    units = sorted({bytes(draw.choice(b"ef") for _ in range(draw.randrange(1, 90))) for _ in range(5000)} | {w.encode() for n in (64, 128, 200, 256) for w in thue_morse(n)})

    def of(order, gap):
        data = gap.join(order) + gap
        ends = np.cumsum([len(u) + len(gap) for u in order]) - len(gap)
        return hashed(np.frombuffer(data, np.uint8), ends - [len(u) for u in order], ends)

    a, b = of(units, b" "), of(units[::-1], b"efe")[::-1]
    assert (a == b).all() and len(set(a.tolist())) == len(units)


def test_workers_forget(monkeypatch, texts):
    monkeypatch.setattr("fathomline.llm.tokens.KEPT_UNITS", 3)
    counter = bpe_counts.TokenCounter(BYTES)
    for _ in range(3):
        assert counter.lengths(pa.array(texts))[1].tolist() == [len(x) for x in ids_of(BYTES, texts)]


def test_count_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d["doc_id"]: (len((d["text"] or "").encode()), len(i)) for d, i in zip(docs, ids_of(BYTES, [d["text"] for d in docs]), strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in queries.op10_token_counts(spark, SF).collect()} == want


def test_count_edges(odd, none):
    rows = bpe_counts.count_tokens(odd, BYTES).collect()
    assert len(rows) == odd.count() and bpe_counts.count_tokens(none, BYTES).count() == 0
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)} == {0}


def whole(pieces, ids):
    """Every document's ids once, sequences without gaps and within the width."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[doc][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[doc])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert set(by_doc) == set(ids)
    return padding / sum(map(len, ids.values()))


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {d["doc_id"]: [*i, 2] for d, i in zip(docs, ids_of(WORDS, [d["text"] for d in docs]), strict=True)}
    assert whole([r.asDict() for r in queries.op6_packing(spark, SF).collect()], ids) < 0.03


def test_packing_edges(odd, none):
    rows = packing.pack_documents(odd, WORDS).collect()
    assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in ids_of(WORDS, [r["text"] for r in odd.collect()]))
    assert [r["length"] for r in rows if r["doc_id"] == 4] == [1]
    assert packing.pack_documents(none, WORDS).count() == 0


def test_short_sequences_dont_grow_with_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for parts in (4, 64):
        used = packing.pack_documents(docs.repartition(parts, "doc_id"), WORDS).groupBy("sequence_id").sum("length").collect()
        assert sum(r[1] <= 64 for r in used) == 0


def test_last_cuts_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(packing, "LEAST_POWER", 4)
    draw, width = random.Random(6), 16
    for _ in range(60):
        n = draw.randint(1, 11)
        penalty = [draw.choice([0, 1, 5]) for _ in range(n)]
        padding = lambda k: 0 if k >= 4 and k & (k - 1) == 0 else width - k
        price = lambda chosen: sum(padding(b - a) for a, b in zip([0, *chosen], chosen)) + sum(penalty[c - 1] for c in chosen[:-1])  # noqa: B023, E731
        every = [price([i + 1 for i in range(n) if i == n - 1 or mask >> i & 1]) for mask in range(1 << (n - 1))]
        assert price(packing.last_cuts(np.array(penalty), width)) == min(every)


def test_smallest_id_is_an_id(spark):
    docs = spark.createDataFrame([(-(2**63), "a b"), (None, "c")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in packing.pack_documents(docs, WORDS).collect()} == {-(2**63), None}
    assert {r["doc_id"] for r in training_order.training_order(docs, WORDS, key=1).collect()} == {-(2**63), None}


def test_other_rows_than_counted_fail(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(4)], "doc_id bigint, text string").coalesce(1)
    for counted in ({0: (0, 3)}, {0: (0, 5)}, {}):
        with pytest.raises(Exception, match="other rows"):
            training_order.slotted_windows(docs, WORDS, counted, 5, key=1).collect()


def test_cuts_are_the_cheapest():
    draw = random.Random(3)
    for _ in range(200):
        width, ends = 12, []
        for _ in range(draw.randint(1, 9)):
            ends.append((ends[-1] if ends else 0) + draw.randint(1, 12))
        penalties = [draw.choice([0, 1, 3, 9]) for _ in ends]
        cuts = packing.best_cuts(np.array(ends), np.array(penalties), width)
        price = lambda chosen: sum(width - (b - a) for a, b in zip([0, *chosen], chosen)) + sum(penalties[ends.index(c)] for c in chosen)  # noqa: B023, E731
        every = []
        for mask in range(1 << (len(ends) - 1)):
            chosen = [e for i, e in enumerate(ends) if i == len(ends) - 1 or mask >> i & 1]
            if all(b - a <= width for a, b in zip([0, *chosen], chosen)):
                every.append(price(chosen))
        assert price(cuts) == min(every)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000])
def test_feistel_is_a_permutation(size):
    assert sorted(training_order.feistel(np.arange(size), size, 7)) == list(range(size))


def test_training_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {d["doc_id"]: i for d, i in zip(docs, ids_of(WORDS, [d["text"] for d in docs]), strict=True)}
    rows = queries.op7_training_order(spark, SF).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    got = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in rows}
    want = {(d, s): (len(i[s : s + 256]), zlib.crc32(np.array(i[s : s + 256], "<u4").tobytes())) for d, i in ids.items() for s in range(0, len(i), 256)}
    assert got == want
    # one input task here: numbers follow the rows, slots follow the permutation
    numbers = {(d["doc_id"], s): None for d in docs for s in range(0, len(ids[d["doc_id"]]), 256)}
    slots = training_order.feistel(np.arange(len(numbers)), len(numbers), queries.KEY)
    assert {(r["doc_id"], r["start"]): r["slot"] for r in rows} == dict(zip(numbers, slots.tolist(), strict=True))


def test_training_order_edges_and_resume(odd, none, spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    n = training_order.write_training_order(odd, WORDS, folder, key=3, window=16, per_shard=100)
    read = training_order.read_training_order(spark, folder, window=16, per_shard=100)
    assert read.count() == n
    late = training_order.read_training_order(spark, folder, window=16, per_shard=100, from_slot=250)
    assert sorted(r["slot"] for r in late.collect()) == list(range(250, n))
    assert training_order.training_order(none, WORDS, key=3).count() == 0
