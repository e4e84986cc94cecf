"""Operator 1: near-duplicate classes by consistent weighted sampling.

Texts with the same words in the same order are one text from the start.
Shingles of five words are weighted by TF-IDF, with exact document counts over
all distinct texts: chunks of texts send each range of shingle hashes what they
have, and get the counts of those that other texts share back.  Improved
consistent weighted sampling draws 30 samples per text, so that two texts agree
in a sample with the probability of their weighted Jaccard similarity.  Samples
are banded in threes; texts that share a band are candidates, and candidates
are verified by the exact weighted Jaccard similarity of their whole texts.

In a band's bucket every member is compared with the central one, never with
all others.  Links join texts to classes, and a bucket whose members are all of
one class is settled.  In an open bucket those outside its largest class are
compared with all members of other classes, tile by tile: the shingles of two
tiles are two matrices, whose product has all their similarities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import components, merged
from .names import free_name
from .scratch import released
from .textarrays import ALNUM, LOWER, hashed, mix, per_row, ragged_take, row_sums, runs, slices, windows

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
#: Texts of a chunk, and of a range of shingle hashes, in bytes: they change no result.
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Texts of a tile in bytes, and of the tiles that a call of Python gets at once: they change no result.
TILE_BYTES, CALL_BYTES = 2 << 20, 8 << 20
#: Columns of a matrix that are multiplied at once.
COLUMNS = 4096
_U = np.uint64


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at (i + 1/2) / n, by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_GAMMA = _gamma_quantiles(1 << 16).astype(np.float32)
_LOG_GAMMA = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))


class Words:
    """Words of a slice of texts, in lower case, as hashes; two sums over them name each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        start, end = runs(ALNUM[data], offsets)
        self.hashes = hashed(data, start, end)
        self.counts, self.bounds = per_row(start, offsets)

    def nodes(self) -> pa.Array:
        """16 bytes that name the words of each text in their order; null without words."""
        place = (np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], self.counts)).astype(np.uint64)
        halves = [row_sums(mix(self.hashes * _U(c) + place * _U(0xD6E8FEB86659FD93)).view(np.int64), self.bounds) for c in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
        return pa.compute.if_else(pa.array(self.counts == 0), pa.scalar(None, pa.binary()), _blobs(np.stack(halves, axis=1).ravel(), np.full(len(self.counts), 2)))


class Shingles:
    """Distinct shingles of a slice of texts and how often each text has them, ordered by row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        words = Words(data, offsets)
        hashes, row = windows(words.hashes, words.counts, words.bounds, size)
        key = mix(hashes ^ (row.astype(np.uint64) + _U(1)) * _U(0x9FB21C651E98DF25))
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        order = np.argsort(first, kind="stable")
        self.hashes, self.row, self.times = hashes[first[order]], row[first[order]], times[order]


def _blobs(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value per entry of ``lengths``: so many of ``values``."""
    where = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(values))])


def _ragged(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary arrays one after the other, and how many each has."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    where = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[where[0] : where[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(where) // np.dtype(kind).itemsize


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits after the first ``bits`` of each hash, as six bytes each."""
    return ((hashes << _U(bits)) >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def _long(short: np.ndarray, part: int, bits: int) -> np.ndarray:
    """Hashes of the range ``part`` from six bytes each; see ``_mask``."""
    out = np.zeros((len(short) // 6, 8), np.uint8)
    out[:, :6] = short.reshape(-1, 6)
    return (out.view("<u8").ravel() << _U(16)) >> _U(bits) | _U(part << (64 - bits))


def _mask(bits: int) -> np.uint64:
    """Of hashes that are dealt by their first ``bits``: the bits that are compared, 48 more or all."""
    return _U((1 << 64) - (1 << max(0, 16 - bits)))


def range_bits(n_bytes: int) -> int:
    return min(24, max(4, (n_bytes // RANGE_BYTES).bit_length()))


def idf_weights(counts: np.ndarray, n_texts: int) -> np.ndarray:
    """From 1 for a shingle of one text to 1/2 for one of all texts, falling with the logarithm of the count."""
    widest = np.log((1 + n_texts) / 2)
    share = np.log((1 + n_texts) / (1 + counts)) / widest if widest > 0 else np.ones(len(counts))
    return ((1 + share) / 2).astype(np.float32)


def named(docs: DataFrame, node: str) -> DataFrame:
    """``docs`` with the column ``node``: 16 bytes that name a text's words, null without words."""
    place = docs.columns.index("text")
    schema = StructType([*docs.schema.fields]).add(node, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(place)):
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, Words(data, offsets).nodes()], schema.names)

    return docs.mapInArrow(run, schema)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """node, text, size (bytes), chunk of all distinct texts with a word; copies meet in the tasks that read them first."""
    texts = named(docs, "node").where("node IS NOT NULL").groupBy("node").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = pa.compute.binary_length(batch.column(1)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            chunk = base + (before + np.cumsum(size)) // CHUNK_BYTES
            before += int(size.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(chunk)], ["node", "text", "size", "chunk"])

    return texts.mapInArrow(run, "node binary, text string, size bigint, chunk bigint")


def shared_shingles(texts: DataFrame, size: int, bits: int) -> DataFrame:
    """chunk, shingles, counts: in how many texts each shingle is that more than one text has.

    A chunk sends one sorted array of distinct hashes, with counts, to every
    range of hashes (those with the same first ``bits``).  A shingle has one
    entry per chunk at most, however many texts have it, so a range holds what
    its share of all shingles is.
    """
    mask = _mask(bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                hashes = np.concatenate([Shingles(data, offsets, size).hashes for _, _, data, offsets in slices(batch.column(1).slice(a, b - a))])
                values, times = np.unique(hashes & mask, return_counts=True)
                which, first = np.unique(values >> _U(64 - bits), return_index=True)
                n = np.diff(np.append(first, len(values)))
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.full(len(which), chunk[a])), _blobs(_short(values, bits), 6 * n), _blobs(times.astype(np.uint32), n)], ["part", "chunk", "shingles", "counts"])

    def count(table: pa.Table) -> pa.Table:
        short, lengths = _ragged(table.column("shingles"), np.uint8)
        hashes, lengths = _long(short, table.column("part")[0].as_py(), bits), lengths // 6
        values, inverse = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, inverse, _ragged(table.column("counts"), np.uint32)[0])
        total = total[inverse]
        more = total > 1
        n = row_sums(more.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]))
        return pa.table([table.column("chunk").combine_chunks(), _blobs(hashes[more], n), _blobs(np.minimum(total[more], 2**32 - 1).astype(np.uint32), n)], ["chunk", "shingles", "counts"]).filter(pa.array(n > 0))

    sent = texts.select("chunk", "text").mapInArrow(send, "part int, chunk bigint, shingles binary, counts binary")
    return sent.groupBy("part").applyInArrow(count, "chunk bigint, shingles binary, counts binary")


def draw(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Samples of sets that begin at ``first``: one 32-bit number per set and seed."""
    log_weight = np.log(weights, dtype=np.float32)
    out = np.empty((len(first), len(_SEEDS)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        z = mix(hashes + seed)
        r = _GAMMA[(z & _U(0xFFFF)).astype(np.int32)]
        beta = ((z >> _U(32)) & _U(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(log_weight / r + beta)
        log_a = _LOG_GAMMA[(z >> _U(16) & _U(0xFFFF)).astype(np.int32)] - r * (t - beta + np.float32(1))
        raw = log_a.view(np.uint32)
        ordered = np.where(raw >> np.uint32(31), ~raw, raw | np.uint32(0x80000000)).astype(np.uint64)
        name = (z ^ t.astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15)) * _U(0xD1342543DE82EF95) >> _U(32)
        out[:, k] = np.minimum.reduceat(ordered << _U(32) | name, first) & _U(0xFFFFFFFF)
    return out


def signatures(texts: DataFrame, shared: DataFrame, n_texts: int, size: int, bits: int) -> DataFrame:
    """node, size, counts (of texts with each distinct shingle of the text, in its order), bands (each names its samples)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, _ = _ragged(right.column("shingles"), np.uint64)
        times, _ = _ragged(right.column("counts"), np.uint32)
        order = np.argsort(known)
        known, times = known[order], times[order]
        bands, counts = [], []
        for row, end, data, offsets in slices(left.column("text")):
            s = Shingles(data, offsets, size)
            n_docs = np.ones(len(s.hashes), np.uint32)
            if len(known):
                hashes = s.hashes & _mask(bits)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                met = known[at] == hashes
                n_docs[met] = times[at[met]]
            first = np.flatnonzero(np.diff(s.row, prepend=-1))
            drawn = draw(s.hashes, s.times * idf_weights(n_docs, n_texts), first)
            named = np.zeros((end - row, BANDS), np.uint64)
            for j in range(ROWS):
                named = mix(named * _U(0xE7037ED1A0B428DB) + drawn[:, j::ROWS] + _U(1))
            bands.append(named.view(np.int64).ravel())
            counts.append(_blobs(n_docs, np.bincount(s.row, minlength=end - row)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(left.num_rows + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([*bands, np.zeros(0, np.int64)])))
        return pa.table([left.column("node"), left.column("size"), pa.chunked_array(counts, pa.binary()), lists], ["node", "size", "counts", "bands"])

    return texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(run, "node binary, size bigint, counts binary, bands array<bigint>")


class Weighed:
    """Sets of weighted elements of rows: what a text has twice is two elements."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, counts: pa.ChunkedArray | pa.Array, n_texts: int, size: int):
        n_docs, _ = _ragged(counts, np.uint32)
        parts = [(s.hashes, s.row + row, s.times) for row, _, data, offsets in slices(texts) for s in [Shingles(data, offsets, size)]]
        hashes, row, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        which = np.repeat(np.arange(len(hashes)), times)
        copy = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        self.elements = mix(hashes[which] + copy.astype(np.uint64) * _U(0xA24BAED4963EE407))
        self.weights = idf_weights(n_docs, n_texts)[which]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(row[which], minlength=len(texts)))])
        self.totals = np.bincount(row[which], self.weights, len(texts))

    def similarities(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of each row of ``left`` with each of ``right``."""
        sides, both = [], None
        for rows in (left, right):
            elements, lengths = ragged_take(self.elements, self.bounds, rows)
            sides.append((elements, np.repeat(np.arange(len(rows)), lengths)))
        weights, _ = ragged_take(self.weights, self.bounds, left)
        columns, first = np.unique(sides[0][0], return_index=True)
        columns, at, _ = np.intersect1d(columns, np.unique(sides[1][0]), assume_unique=True, return_indices=True)
        weights = weights[first[at]]
        both = np.zeros((len(left), len(right)), np.float64)
        places = []
        for elements, row in sides:
            where = np.minimum(np.searchsorted(columns, elements), max(len(columns) - 1, 0))
            met = columns[where] == elements if len(columns) else np.zeros(len(elements), bool)
            places.append((where[met], row[met]))
        for begin in range(0, len(columns), COLUMNS):
            n = min(COLUMNS, len(columns) - begin)
            tables = []
            for (where, row), rows in zip(places, (left, right), strict=True):
                inside = (where >= begin) & (where < begin + n)
                table = np.zeros((len(rows), n), np.float32)
                table[row[inside], where[inside] - begin] = 1
                tables.append(table)
            both += (tables[0] * weights[begin : begin + n]) @ tables[1].T
        return both / np.maximum(self.totals[left][:, None] + self.totals[right] - both, 1e-9)


def _stars(similar: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``similar`` (left by right) joins: each label with the least one of its part."""
    labels, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = np.nonzero(similar)
    a, b = inverse[a], inverse[len(left) + b]
    least = np.arange(len(labels))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    far = np.flatnonzero(least != np.arange(len(labels)))
    return labels[least[far]], labels[far]


def links_of(sided: DataFrame, features: DataFrame, n_texts: int, size: int, similarity: float) -> DataFrame:
    """a, b: links between the labels of similar texts.

    ``sided`` has tile, own (whether the text is of the tile's first side),
    node, label, size.  Each text of the first side is compared with each one
    of the second.  Tiles are small by their making; several go to Python at
    once.
    """
    n_bytes = sided.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    calls = max(1, n_bytes // CALL_BYTES)

    def run(table: pa.Table) -> pa.Table:
        w = Weighed(table.column("text"), table.column("counts"), n_texts, size)
        tile, own = table.column("tile").to_numpy(), table.column("own").to_numpy()
        label = np.array(table.column("label").to_pylist(), object)
        order = np.argsort(tile, kind="stable")
        found = ([], [])
        for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            left, right = rows[own[rows]], rows[~own[rows]]
            like = w.similarities(left, right) >= similarity - 1e-6
            for side, ends in zip(found, _stars(like, label[left], label[right]), strict=True):
                side.extend(ends)
        return pa.table([pa.array(x, pa.binary()) for x in found], ["a", "b"])

    full = sided.join(features, "node").select("tile", "own", "label", "text", "counts")
    return full.groupBy(F.pmod("tile", F.lit(calls))).applyInArrow(run, "a binary, b binary")


def _tiles(size: str) -> Column:
    return F.ceil(F.col(size) / TILE_BYTES).cast("int")


def _part(tiles: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(tiles)).cast("int")


def _every(tiles: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))


def with_leaders(members: DataFrame) -> DataFrame:
    """Each bucket's central member against every other one (see ``links_of``); a leader of many meets them in tiles."""
    # the original of many copies shares buckets with most of them
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = members.join(central, "node")
    leaders = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("first")).select("bucket", F.col("first.node").alias("leader"))
    pairs = released(members.join(leaders, "bucket").where("node <> leader").select("leader", "node", "size").distinct())
    tiles = pairs.groupBy("leader").agg(F.sum("size").alias("all")).select("leader", _tiles("all").alias("tiles"))
    second = pairs.join(tiles, "leader").select(F.xxhash64("leader", _part("tiles", 1)).alias("tile"), F.lit(False).alias("own"), "node", F.col("node").alias("label"), "size")
    sizes = members.select(F.col("node").alias("leader"), "size").distinct()
    first = tiles.join(sizes, "leader").select("leader", "size", _every("tiles").alias("part"))
    return second.union(first.select(F.xxhash64("leader", "part"), F.lit(True), "leader", "leader", "size"))


def with_others(members: DataFrame, classes: DataFrame) -> DataFrame:
    """In each bucket of several classes the members outside its largest class against all others (see ``links_of``)."""
    placed = released(members.join(classes, "node", "left").select("bucket", "node", "size", "n", F.coalesce("component", "node").alias("label")))
    by_class = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"))
    largest = F.max(F.struct("members", "label", "bytes")).alias("largest")
    # the leader has met all: a bucket of two is compared in full
    opened = by_class.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("members").alias("n"), F.sum("bytes").alias("all"), largest).where("classes > 1 AND n > 2")
    tiled = opened.select("bucket", "largest.label", "all", (F.col("all") - F.col("largest.bytes")).alias("few"))
    tiled = tiled.select("bucket", F.col("label").alias("most"), _tiles("few").alias("tiles"), _tiles("all").alias("others"))
    rows = placed.drop("n").join(tiled, "bucket")
    first = rows.where("label <> most").select("bucket", _part("tiles", 1).alias("i"), _every("others").alias("j"), F.lit(True).alias("own"), "node", "label", "size")
    second = rows.select("bucket", _every("tiles").alias("i"), _part("others", 2).alias("j"), F.lit(False), "node", "label", "size")
    return first.union(second).select(F.xxhash64("bucket", "i", "j").alias("tile"), "own", "node", "label", "size")


def node_classes(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """node, component of all texts that are similar to another one; a component is named by its smallest node."""
    texts = released(distinct_texts(docs))
    n_texts, n_bytes = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = range_bits(n_bytes)
    # written by themselves: what the ranges were sent goes before texts are shuffled
    shared_counts = released(shared_shingles(texts, words, bits))
    drawn = released(signatures(texts, shared_counts, n_texts, words, bits))
    bucketed = drawn.select("node", "size", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node", "size")
    shared = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = released(bucketed.join(shared, "bucket"))
    candidates = members.select("node").distinct()
    features = released(texts.select("node", "text").join(candidates, "node").join(drawn.select("node", "counts"), "node"))
    find = lambda sided: released(links_of(released(sided), features, n_texts, words, similarity).distinct())
    classes = components(find(with_leaders(members)))
    return merged(classes, find(with_others(members, classes)))


def near_duplicates(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every row of ``docs``.

    A class is a connected component of the links between similar texts; its
    id is the smallest doc_id in it.  Texts with the same words in the same
    order, whatever their case and punctuation, are copies of one another and
    count as one text in the document counts.  A text of fewer than ``words``
    words has one shingle.  Null texts and those without words are classes of
    their own.  Rows without doc_id get the id of their class, null if no row
    of it has one.  Rows that repeat a doc_id are judged by their own texts.
    Extra columns are ignored, an empty table gives no rows.
    """
    rows = released(named(_read(docs), "node").select("doc_id", "node"))
    classes = node_classes(_read(docs), words=words, similarity=similarity)
    first = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    placed = released(first.join(classes, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("class_id"))
    by_node = placed.join(smallest, "component").select("node", "class_id")
    return rows.join(by_node, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def representatives(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` of each class (see ``near_duplicates``), its columns unchanged.

    That of the smallest doc_id stays, a row without one only if its whole
    class has none; of rows equal in doc_id and words any one.  Null texts and
    those without words all stay.
    """
    node = free_name(docs, "node")
    rows = named(docs.withColumn("text", F.col("text").cast("string")), node)
    classes = node_classes(_read(docs), words=words, similarity=similarity)
    ids = named(_read(docs), "node").where("node IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = ids.groupBy("node").agg(F.min(place).alias("place")).join(classes, "node", "left")
    chosen = first.groupBy(F.coalesce("component", "node")).agg(F.min("place").alias("place")).select(F.col("place.doc_id").alias("_id"), F.col("place.node").alias("_node"))
    same = rows[node].eqNullSafe(chosen["_node"]) & F.col("doc_id").cast("long").eqNullSafe(chosen["_id"])
    kept = rows.where(rows[node].isNotNull()).join(chosen, same, "left_semi").dropDuplicates(["doc_id", node])
    return kept.unionByName(rows.where(rows[node].isNull())).select(*docs.columns)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
