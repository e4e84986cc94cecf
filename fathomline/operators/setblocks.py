"""Sets of words within others: sets are kept in blocks, and each block meets each other one of its scope in a task of its own."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import released

#: Words that are kept in two bytes instead of eight, over all scopes; words of all sets of a block, about, and texts of which one is counted for that: they change no result.
COMMON, BLOCK, SIZED = 1 << 16, 1 << 21, 64
#: Pairs of sets, and words of these, that a call holds at once.
PAIRS = 1 << 19
#: Blocks that one block meets in a task; a row of two blocks is a batch of its own.
MET, ONE = 8, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
#: What a block has of its sets: their words are numbers, those from ``COMMON`` on are places in the block's list of other words.
SETS = pa.schema([("set_id", pa.binary(32)), ("sign_0", pa.uint64()), ("sign_1", pa.uint64()), ("words", pa.list_(pa.int32()))])
ENCODED = "scope string, share int, set_id binary, common binary, other binary"


def code(seed: int, scope: Column, word: Column) -> Column:
    """64 bits for a word of a scope."""
    return F.xxhash64(F.lit(seed), scope, word)


def counted(rows: DataFrame) -> DataFrame:
    """scope, word, n of all words of rows (scope, words)."""
    # of explode() Spark would ask for rows that have words first, and so read all texts twice
    each = rows.select("scope", F.explode_outer("words").alias("word")).where(F.col("word").isNotNull())
    return released(each.groupBy("scope", "word").agg(F.count(F.lit(1)).alias("n")))


def coded(words: DataFrame) -> tuple[int, np.ndarray]:
    """A seed with which ``code`` tells all words (scope, word, n) of all scopes apart, and the sorted codes of the most frequent ones, ``COMMON`` at most."""
    for seed in itertools.count():
        codes = released(words.groupBy(code(seed, F.col("scope"), F.col("word")).alias("code")).agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")))
        if codes.where("words > 1").isEmpty():
            # no more rows than COMMON go to the driver
            top = codes.orderBy(F.desc("n"), "code").limit(COMMON).select("code").toArrow().column("code")
            return seed, np.sort(top.to_numpy().view(np.uint64))


def shares(rows: DataFrame, words: DataFrame) -> DataFrame:
    """scope, shares: into how many blocks each scope goes, by the words of one in ``SIZED`` of its distinct texts."""
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SIZED)) == 0).select("scope", "text", F.size(F.array_distinct("words")).alias("n")).distinct()
    n = some.groupBy("scope").agg((F.sum("n") * SIZED).alias("n"))
    # a row per scope
    return released(words.select("scope").distinct().join(n, "scope", "left").select("scope", F.greatest(F.ceil(F.coalesce("n", F.lit(0)) / BLOCK), F.lit(1)).alias("shares")))


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of lists one after the other, and where each list begins and ends."""
    lengths = pa.compute.list_value_length(column).to_numpy().astype(np.int64)
    return pa.compute.list_flatten(column).to_numpy(), np.concatenate([[0], np.cumsum(lengths)])


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ``n`` places from ``first`` on: rows and places."""
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + first[rows]


def batches(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose ``n`` sum to ``most`` at most, or of one row."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def _found(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` among the sorted ``known``, and whether they are there."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def _bytes(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """``values`` as one binary for each row, which has ``n`` of them."""
    ends = np.concatenate([[0], np.cumsum(n)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What ``_bytes`` has made: all values, and how many each row has."""
    n = pa.compute.binary_length(column).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), n


def encoder(common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows scope, share, set_id, codes: each set once per batch, with the places of common words and the codes of others."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            table = pa.table(part.columns, part.schema.names).append_column("i", pa.array(np.arange(part.num_rows)))
            table = table.filter(pa.compute.greater(pa.compute.list_value_length(table["codes"]), 0))
            once = table.group_by(["scope", "set_id"]).aggregate([("i", "min")])["i_min"]
            table = pa.table(part.columns, part.schema.names).take(once)
            codes, bounds = flat(table["codes"])
            at, here = _found(common, codes.view(np.uint64))
            rows = np.repeat(np.arange(table.num_rows), np.diff(bounds))
            n = np.bincount(rows[here], minlength=table.num_rows)
            few, other = _bytes(at[here].astype(np.uint16), n), _bytes(codes[~here], np.diff(bounds) - n)
            yield from pa.table([table["scope"], table["share"], table["set_id"], few, other], ["scope", "share", "set_id", "common", "other"]).to_batches()

    return run


def signs(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two times 64 bits for each (non-empty) set, in which each of its words sets one bit."""
    bit = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    return [np.bitwise_or.reduceat(np.where(bit >> np.uint64(6) == half, one, np.uint64(0)), bounds[:-1]) for half in (0, 1)]


def block(sets: pa.Table) -> pa.Table:
    """One row scope, share, sets, others from a block's rows of ``ENCODED``: the sets, the longest first and then by set_id, and the sorted codes of words that are not common."""
    (common, n_common), (other, n_other) = _joined(sets["common"], np.uint16), _joined(sets["other"], np.uint64)
    ids = np.frombuffer(b"".join(sets["set_id"].to_pylist()), ">u8").reshape(-1, 4)
    size = n_common + n_other
    order = np.lexsort((*ids.T[::-1].astype(np.uint64), -size))
    known, places = np.unique(other, return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(size[order])])
    words, sign = np.empty(bounds[-1], np.int32), np.empty((2, len(order)), np.uint64)
    at_common, at_other = np.cumsum(n_common) - n_common, np.cumsum(n_other) - n_other
    for part in batches(size[order], PAIRS):
        some, begin = order[part], bounds[part.start]
        codes = np.empty(bounds[part.stop] - begin, np.uint64)
        for first, n, at, number, value in ((bounds[part] - begin, n_common, at_common, common, common), (bounds[part] - begin + n_common[some], n_other, at_other, COMMON + places, other)):
            to, source = spread(first, n[some])[1], spread(at[some], n[some])[1]
            words[begin + to], codes[to] = number[source], value[source]
        sign[:, part] = signs(codes, bounds[part.start : part.stop + 1] - begin)
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words))
    kept = pa.table([sets["set_id"].take(pa.array(order)).combine_chunks().cast(pa.binary(32)), *sign, lists], schema=SETS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SETS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(kept)
    return sets.slice(0, 1).select(["scope", "share"]).append_column("sets", pa.array([sink.getvalue().to_pybytes()])).append_column("others", pa.array([known.tobytes()]))


class Block:
    """A block's sets in their order."""

    def __init__(self, sets: bytes, others: bytes):
        table = pa.ipc.open_stream(sets).read_all()
        self.ids, self.others = table["set_id"], np.frombuffer(others, np.uint64)
        self.signs = [table["sign_0"].to_numpy(), table["sign_1"].to_numpy()]
        self.words, self.bounds = flat(table["words"])
        self.sizes = np.diff(self.bounds)


class Containers(Block):
    """A block's sets by their words."""

    def __init__(self, sets: bytes, others: bytes):
        super().__init__(sets, others)
        n, known = np.int64(len(self.sizes)), COMMON + len(self.others)
        self.keys = self.words * n
        self.keys += np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        self.keys.sort()
        self.df = np.diff(np.searchsorted(self.keys, np.arange(known + 1) * n))
        del self.words, self.bounds
        self.lacks = [~s for s in self.signs]

    def numbers(self, other: Block) -> np.ndarray:
        """For each word of another block its number here, or -1."""
        at, here = _found(self.others, other.others)
        return np.concatenate([np.arange(COMMON), np.where(here, COMMON + at, -1)]).astype(np.int64)

    def of(self, few: Block) -> pa.Table:
        """Of each set of ``few`` that lies within longer ones of this block: set_id, how many, size and set_id of the first."""
        n = np.int64(len(self.sizes))
        number = self.numbers(few)
        df = np.where(number < 0, 0, self.df[number])
        # a set is looked up under that of its words which is rarest in this block, unless one is in none of its sets
        rank, rarest = df << 32 | np.maximum(number, 0), np.empty(len(few.sizes), np.int64)
        for part in batches(few.sizes, PAIRS):
            begin, end = few.bounds[part.start], few.bounds[part.stop]
            rarest[part] = np.minimum.reduceat(rank[few.words[begin:end]], few.bounds[part] - begin)
        longer = np.searchsorted(-self.sizes, -few.sizes)  # those longer than a set come first
        rows = np.flatnonzero((rarest >> 32 > 0) & (longer > 0))
        key = (rarest[rows] & 0xFFFFFFFF) * n
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key + longer[rows])
        out = []
        for part in batches(high - low, PAIRS):
            x, y = spread(low[part], (high - low)[part])
            y = (self.keys[y] - key[part][x]).astype(np.int32)
            for sign, lack in zip(few.signs, self.lacks, strict=True):
                maybe = np.flatnonzero((sign[rows[part]][x] & lack[y]) == 0)
                x, y = x[maybe], y[maybe]
            right = self._have(few, number, rows[part][x], y, key[part][x] // n)
            x, y = rows[part][x[right]], y[right]
            first = np.flatnonzero(np.diff(x, prepend=-1))
            if len(first):
                # rows of this block stand in the order in which they are wanted
                out.append((x[first], np.diff(np.append(first, len(x))), y[first]))
        x, count, y = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table([few.ids.take(pa.array(x)), count, self.sizes[y], self.ids.take(pa.array(y))], ["set_id", "n_longer", "n", "longest"])


    def _have(self, few: Block, number: np.ndarray, x: np.ndarray, y: np.ndarray, met: np.ndarray) -> np.ndarray:
        """Whether row y of this block has all words of row x of ``few``; it has the word with number ``met``."""
        right, left, k = np.ones(len(x), bool), np.arange(len(x)), 0
        # a word after the other: pairs of a set stand together, so that their keys rise
        while len(left := left[few.sizes[x[left]] > k]):
            asked = number[few.words[few.bounds[x[left]] + k]]
            here = asked == met[left]
            here[~here] = _found(self.keys, asked[~here] * len(self.sizes) + y[left[~here]])[1]
            right[left[~here]] = False
            left, k = left[here], k + 1
        return right


def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``Containers.of`` for each row of two blocks."""
    last, many = None, None
    for part in parts:
        for row in range(part.num_rows):
            scope, share = (part.column(c)[row].as_py() for c in ("scope", "b_share"))
            sets, others, b_sets, b_others = (part.column(c)[row].as_buffer() for c in ("sets", "others", "b_sets", "b_others"))
            if last != (scope, share):
                last, many = (scope, share), None
                many = Containers(b_sets, b_others)
            found = many.of(Block(sets, others))
            yield from found.add_column(0, "scope", pa.array([scope] * found.num_rows, pa.string())).cast(_FOUND).to_batches()


_FOUND = pa.schema([("scope", pa.string()), ("set_id", pa.binary()), ("n_longer", pa.int64()), ("n", pa.int64()), ("longest", pa.binary())])


def blocks(rows: DataFrame) -> DataFrame:
    """scope, share, sets, others: all distinct non-empty sets of rows (see ``longer_sets``) in blocks, each set in one."""
    words = counted(rows)
    seed, common = coded(words)
    sets = rows.select("scope", F.sort_array(F.array_distinct("words")).alias("words")).join(F.broadcast(shares(rows, words)), "scope")
    each = sets.select("scope", F.pmod(F.xxhash64("words"), F.col("shares")).cast("int").alias("share"), F.unhex(F.sha2(F.array_join("words", " "), 256)).alias("set_id"), F.transform("words", lambda w: code(seed, F.col("scope"), w)).alias("codes"))
    # sets that come again meet in their block's partition, before it is gathered
    once = each.mapInArrow(encoder(common), ENCODED).repartition("scope", "share").distinct()
    return released(once.groupBy("scope", "share").applyInArrow(block, "scope string, share int, sets binary, others binary"), maxRecordsPerFile=1)


def met(kept: DataFrame) -> DataFrame:
    """scope, set_id, n_longer, longest of the sets of blocks that lie within longer ones of their scope."""
    other = kept.select("scope", *(F.col(c).alias(f"b_{c}") for c in ("share", "sets", "others")))
    few = kept.drop("share").coalesce(-(-kept.count() // MET) or 1)
    # not by a join that gathers a scope's blocks; the left side is the outer one of its task
    found = other.join(few.hint("shuffle_replicate_nl"), "scope").mapInArrow(cells, "scope string, set_id binary, n_longer bigint, n bigint, longest binary")
    first = F.min(F.struct((-F.col("n")).alias("n"), "longest"))["longest"]
    return found.groupBy("scope", "set_id").agg(F.sum("n_longer").alias("n_longer"), F.lower(F.hex(first)).alias("longest")).withColumn("set_id", F.lower(F.hex("set_id")))


def longer_sets(rows: DataFrame) -> DataFrame:
    """``scope``, set_id, n_longer, longest of the sets of words of rows (scope, text, words) that all stand in a longer set of their scope: in how many, and the first of the longest.

    Rows and words of a row may come again; rows of equal texts have equal words.
    Sets are shuffled once, to their blocks.  Then each block meets each other
    one of its scope in a task that reads both: nothing is shuffled or written
    for a pair of blocks but what it has found.
    """
    return released(met(blocks(rows)), ONE)
