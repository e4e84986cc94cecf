"""Operator 11: near-duplicate classes by SimHash fingerprints and pigeonring filtering.

A fingerprint's 64 bits are eight segments on a ring.  If two fingerprints
differ in at most t bits, then from some segment on every chain of l
consecutive segments differs in at most l * t / 8 bits: the first segments of
that chain are equal, and the next ones, up to the second whole bit of budget,
differ in one bit at most.  So each fingerprint is filed once for every first
segment and every place of that one bit, under all other bits of the chain.
Two fingerprints that link share a file; a file leaves only the place of the
bit and the segments behind the chain open, so it has at most 2^16
fingerprints at t = 2, whatever the corpus.  In a file partners are tested on
the chain's budgets and then on all 64 bits, and a file's links are
reduced to one per fingerprint before they leave its task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hotkeys import hot_keys, spread_join
from .scratch import written
from .textarrays import LOWER, WHITE, per_row, runs, slices

WORDS, SEED, MAX_BITS = 3, 42, 2
SEGMENTS, WIDTH = 8, 8
#: Hashes whose bits are added at once, and rows of files that are compared at once: they change no result.
HASHES, FILED = 1 << 15, 1 << 17
_U = np.uint64


# --- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of a slice of texts, and the row of each."""
    data = LOWER[data]
    inside = ~WHITE[data]
    start, end = runs(inside, offsets)
    counts, bounds = per_row(start, offsets)
    ends = np.cumsum(end - start + 1)  # words with one space behind each
    joined = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    letters = np.ones(len(joined), bool)
    letters[ends - 1] = False
    joined[letters] = data[inside]
    first = np.arange(len(start))
    row = np.repeat(np.arange(len(counts)), counts)
    full = bounds[1:][row] - first >= words
    short = (counts[row] < words) & (first == bounds[:-1][row])
    first, row = first[full | short], row[full | short]
    last = np.minimum(first + words, bounds[1:][row]) - 1
    raw, begins = memoryview(joined), ends - (end - start + 1)
    spans = zip(begins[first].tolist(), (ends[last] - 1).tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in spans), _U, len(first)), row


def majority(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the bits that more than half of its hashes have; 0 without hashes."""
    total, size = np.zeros((n, 64), np.int64), np.bincount(row, minlength=n)
    for at in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[at : at + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = row[at : at + HASHES]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        total[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * total > size[:, None], axis=1).view(">u8").ravel().astype(_U)


def fingerprints(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (bigint) of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, _U)
            for row, end, data, offsets in slices(batch.column(1)):
                out[row:end] = majority(*shingle_hashes(data, offsets, words), end - row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fingerprint bigint")


# --- pigeonring -----------------------------------------------------------------------------------


def chain(max_bits: int) -> tuple[int, int]:
    """How many segments of a chain must be equal, and how many may differ in one bit at most together."""
    equal = -(-SEGMENTS // max_bits) - 1
    return equal, min(SEGMENTS, -(-2 * SEGMENTS // max_bits) - 1)


def _segments_mask(which) -> int:
    """Bits of these segments; segment 0 has the highest ones."""
    return sum(((1 << WIDTH) - 1) << WIDTH * (SEGMENTS - 1 - s) for s in which)


def files(max_bits: int) -> list[tuple[int, int]]:
    """(first segment, place of the open segment in the chain) of every file that a fingerprint is in."""
    equal, length = chain(max_bits)
    return [(i, j) for i in range(SEGMENTS) for j in range(equal, length)]


def turned(x, by: int):
    """``x`` with segment ``by`` first, for columns and for numpy arrays."""
    bits = WIDTH * by
    if isinstance(x, Column):
        return x if not bits else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))
    return x if not bits else x << _U(bits) | x >> _U(64 - bits)


def file_key(x: Column, number: int, first: int, open_at: int, max_bits: int) -> Column:
    """The chain's bits without its open segment; the last segment, always open, has the file's number."""
    mask = _segments_mask(s for s in range(chain(max_bits)[1]) if s != open_at)
    signed = mask - (1 << 64) if mask >> 63 else mask
    return turned(x, first).bitwiseAND(F.lit(signed)).bitwiseOR(F.lit(number).cast("long"))


def within_budget(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Of differences turned to their chain's start: is every beginning of the chain within its share of the budget?"""
    ok, spent = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for s in range(chain(max_bits)[1]):
        spent += np.bitwise_count(x & _U(_segments_mask([s])))
        ok &= spent * SEGMENTS <= (s + 1) * max_bits
    return ok


def flips(open_at: int, max_bits: int) -> np.ndarray:
    """All differences, turned, that members of one file can have and link."""
    of = lambda mask, n: [sum(c) for c in itertools.combinations([1 << b for b in range(64) if mask >> b & 1], n)]
    behind = _segments_mask(range(chain(max_bits)[1], SEGMENTS))
    inner = _segments_mask([open_at])
    found = [a | b for n in (0, 1) for a in of(inner, n) for k in range(max_bits - n + 1) for b in of(behind, k)]
    x = np.array(sorted(set(found) - {0}), _U)
    return x[within_budget(x, max_bits) & (np.bitwise_count(x) <= max_bits)]


def smallest_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def linked(key: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of whole files, sorted by key and fingerprint: each fingerprint that links and the smallest one it reaches in its file."""
    numbered = files(max_bits)
    low = _U((1 << WIDTH) - 1)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    possible = {j: flips(j, max_bits) for j in {j for _, j in numbered}}
    limit = max(map(len, possible.values()))
    left, right = [], []
    # small files: each with the next, the one after it, and so on
    last = np.repeat(np.where(size <= limit, edge + size, 0), size)
    at, step = np.flatnonzero(last - np.arange(len(key)) > 1), 1
    first = np.array([i for i, _ in numbered], _U)
    while len(at):
        x = prints[at] ^ prints[at + step]
        by = first[(key[at] & low).astype(np.int64)] * _U(WIDTH)
        x = np.where(by == 0, x, x << by | x >> (_U(64) - by) % _U(64))
        ok = within_budget(x, max_bits)
        ok[ok] = np.bitwise_count(x[ok]) <= max_bits
        left.append(at[ok])
        right.append(at[ok] + step)
        step += 1
        at = at[last[at] - at > step]
    # large ones: every possible partner is looked up
    for begin, n in zip(edge[size > limit].tolist(), size[size > limit].tolist(), strict=True):
        own = prints[begin : begin + n]
        i, j = numbered[int(key[begin] & low)]
        for x in turned(possible[j], (SEGMENTS - i) % SEGMENTS):
            wanted = own ^ x
            place = np.minimum(np.searchsorted(own, wanted), n - 1)
            ok = np.flatnonzero((own[place] == wanted) & (wanted > own))
            left.append(begin + ok)
            right.append(begin + place[ok])
    if not left:
        return prints[:0], prints[:0]
    label = smallest_of(len(key), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(len(key)))
    return prints[moved], prints[label[moved]]


def links(prints: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) of distinct fingerprints: as many links as join all that differ in ``max_bits`` bits or fewer."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    keys = [file_key(F.col("fingerprint"), n, i, j, max_bits) for n, (i, j) in enumerate(files(max_bits))]
    filed = prints.select("fingerprint", F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def ready(upto_end: bool) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
            n = len(rows) if upto_end or not len(rows) else int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last file may go on
            held[:] = [rows[n:]]
            key, own = rows[:n, 0].copy().view(_U), rows[:n, 1].copy().view(_U)
            order = np.lexsort((own, key))  # unsigned order inside files
            a, b = linked(key[order], own[order], max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(1).to_numpy(), batch.column(0).to_numpy()], axis=1))
            if sum(map(len, held)) >= FILED:
                yield from ready(False)
        yield from ready(True)

    return filed.mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_duplicates(docs: DataFrame, *, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (bigint) and component_id of every row of ``docs``.

    A component is what links of ``max_bits`` or fewer differing bits join;
    its id is the smallest doc_id in it, null if none of its rows has one.
    A text of fewer than ``words`` words has one shingle, its whole sequence;
    null texts and those without words have fingerprint 0 and are linked like
    any other.  Rows that repeat a doc_id are linked by their own texts.
    Extra columns are ignored, an empty table gives no rows.
    """
    rows = written(fingerprints(docs, words=words))
    prints = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    n_rows, n_prints = prints.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    classes = components(written(links(prints.select("fingerprint"), max_bits=max_bits)))
    joined = written(prints.join(classes.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")))
    found = written(joined.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size")))
    by_print = spread_join(joined, found, ["component"], hot_keys(found, ["component"], "size", n_prints), "fingerprint").select("fingerprint", "component_id")
    return spread_join(rows, by_print, ["fingerprint"], hot_keys(prints, ["fingerprint"], "n", n_rows), "doc_id").select("doc_id", "fingerprint", "component_id")
