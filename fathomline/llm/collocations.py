"""Operator 12: phrase collocations of each language, counted over all documents.

Texts are cut into pieces, identical pieces become one with a multiplicity.
Chunks of distinct pieces number their words and count their n-grams as pairs
of numbers; what a chunk has of a hash bucket travels as one compressed block,
so a frequent n-gram sends a row per chunk and not per place.  Each bucket is
summed out of core by duckdb.  Words and pairs of words are counted first, and
each bucket answers every chunk which of its pairs are frequent: longer phrases
are counted only where all their pairs are, as none is more frequent than its
parts.  Phrases then ask the buckets of their parts for their counts by a
shuffled join, and answers meet at the phrase.
"""

from __future__ import annotations

import math
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hotkeys import hot_keys, spread_join
from .scratch import written
from .textarrays import LOWER, give_back, hashed, mix, numbered, per_row, runs, slices, spans, strings

WORDS, LEAST, TOP, COVERED = 4, 30, 2000, 80
#: Bytes of pieces that are counted at once, bytes that go into duckdb at once, and its memory: they change no result.
CHUNK_BYTES, INSERT_BYTES, MEMORY = 4 << 20, 8 << 20, "128MB"
#: Buckets grow with the square root of the corpus: one for all up to so many bytes.
BUCKET_UNIT = 64 << 10
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLOCK = pa.schema([("lang", pa.string()), ("words", pa.int8()), ("phrase", pa.binary()), ("f", pa.int64())])
SUMS = "lang string, words tinyint, phrase binary, f bigint, chunk bigint, bucket int, places binary"


# --- pieces ---------------------------------------------------------------------------------------


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of a slice of texts that have words, one space between two, and the row of each."""
    data = LOWER[data]
    ends = _ENDS[data]
    inside = ~(ends | (data == 32) | (data == 9))
    start, end = runs(inside, offsets)
    if not len(start):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    counts, _ = per_row(start, offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    passed = np.cumsum(ends)[start]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (passed[1:] != passed[:-1])])
    last = np.append(new[1:], True)
    upto = np.cumsum(end - start + ~last)  # each word with the space behind it, if one stands there
    joined = np.full(int(upto[-1]), 32, np.uint8)
    letters = np.ones(len(joined), bool)
    letters[upto[~last] - 1] = False
    joined[letters] = data[inside]
    return strings(joined, upto[last]), row[new]


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, m: the distinct pieces of each language and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in slices(batch.column(1)):
                found, own = pieces_of(data, offsets)
                if len(found):
                    # counted in the slice already: a line that repeats is one row
                    table = pa.table({"lang": batch.column(0).take(pa.array(row + own)), "piece": found}).group_by(["lang", "piece"], use_threads=False).aggregate([([], "count_all")])
                    yield from table.rename_columns(["lang", "piece", "m"]).cast(pa.schema([("lang", pa.string()), ("piece", pa.binary()), ("m", pa.int64())])).combine_chunks().to_batches()
            give_back()

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "lang string, piece binary, m bigint").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


# --- counts ---------------------------------------------------------------------------------------


def _numbered(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key's number among the distinct ones, a place of each distinct one and the sum of its weights."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(keys))))
    return number, order[edge], np.add.reduceat(weights[order], edge) if len(edge) else weights[:0]


class Grams:
    """The n-grams of a chunk of distinct pieces."""

    def __init__(self, rows: pa.Table, buckets: int):
        rows = rows.combine_chunks()
        self.lang, piece, m = rows["lang"].chunk(0), rows["piece"].chunk(0).cast(pa.large_binary()), rows["m"].to_numpy()
        _, offs, buffer = piece.buffers()
        offsets = np.frombuffer(offs, np.int64)[piece.offset : piece.offset + len(piece) + 1]
        self.data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.start, self.end = runs(self.data != 32, offsets)
        counts, bounds = per_row(self.start, offsets)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.left = bounds[1:][self.row] - np.arange(len(self.start))  # words from here to the end of the piece
        self.m, self.buckets = m[self.row], buckets
        unit, units = numbered(self.data, self.start, self.end)
        # numbers in the order of words, so that like phrases stand together and pack well
        place = np.argsort(np.argsort(np.array(units.to_pylist(), object), kind="stable"), kind="stable") if len(units) else np.zeros(0, np.int64)
        self.word = self.lang.dictionary_encode().indices.to_numpy().astype(np.int64)[self.row] * len(units) + place[unit]
        self.named, self.mixed = hashed(self.data, self.start, self.end), np.zeros(len(self.start), np.uint64)
        self.number: dict[int, np.ndarray] = {}

    def level(self, n: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the n-grams that begin at the words ``at``, each distinct one: bucket, words, a place of it, its count.

        Levels come one after the other, and a word that is not in one is in no later one.
        """
        if n == 1:
            keys = self.word
        else:  # the phrase without its last two words, or last one, and those: both have a number of their own
            tail = 2 if n > 2 and n % 2 == 0 else 1
            keys = self.number[n - tail][at] * len(self.start) + self.number[tail][at + n - tail]
        own, first, f = _numbered(keys, self.m[at])
        self.number[n] = np.zeros(len(self.start), np.int64)
        self.number[n][at] = own
        self.mixed[at] = mix(self.mixed[at] * np.uint64(0x9E3779B97F4A7C15) + self.named[at + n - 1])
        first = at[first]
        return (self.mixed[first] % np.uint64(self.buckets)).astype(np.int64), np.full(len(first), n, np.int8), first, f

    def short(self) -> list[np.ndarray]:
        """All words and pairs of words: bucket, words, place, count; in an order that depends on the chunk alone."""
        return [np.concatenate(x) for x in zip(self.level(1, np.arange(len(self.start))), self.level(2, np.flatnonzero(self.left >= 2)), strict=True)]

    def long(self, words: int, answers: dict[int, np.ndarray]) -> list[np.ndarray]:
        """Longer phrases of frequent pairs only; ``answers``: by bucket the places of these in the chunk's block."""
        bucket, n_words, _, _ = self.short()
        order = np.argsort(bucket, kind="stable")
        frequent = np.zeros(len(bucket), bool)
        for b, places in answers.items():
            frequent[order[np.searchsorted(bucket[order], b) + places]] = True
        pairs = frequent[n_words == 2]
        good = np.zeros(len(self.start) + words, bool)
        at = np.flatnonzero(self.left >= 2)
        good[at] = pairs[self.number[2][at]]
        parts, whole = [], good[: len(self.start)].copy()
        for n in range(3, words + 1):
            whole &= good[n - 2 : len(self.start) + n - 2]
            parts.append(self.level(n, np.flatnonzero(whole & (self.left >= n))))
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def blocks(self, grams: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed rows lang, words, phrase, f) of ``grams``, each bucket's in their order."""
        order = np.argsort(grams[0], kind="stable")
        bucket, n_words, first, f = (x[order] for x in grams)
        edge = np.flatnonzero(np.diff(bucket, prepend=-1))
        for begin, size in zip(edge.tolist(), np.diff(np.append(edge, len(bucket))).tolist(), strict=True):
            part = slice(begin, begin + size)
            phrase = spans(self.data, self.start[first[part]], self.end[first[part] + n_words[part] - 1]).cast(pa.binary())
            yield int(bucket[begin]), _packed(pa.record_batch([self.lang.take(pa.array(self.row[first[part]])).cast(pa.string()), pa.array(n_words[part]), phrase, pa.array(f[part])], schema=_BLOCK))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def chunked(found: DataFrame) -> DataFrame:
    """chunk, rows: distinct pieces packed in chunks of ``CHUNK_BYTES``, a longer piece in one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held, size, n = [], 0, 0

        def full() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([_packed(rows)], pa.binary())], ["chunk", "rows"])

        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                done = int(sizes[begin - 1]) if begin else 0
                upto = min(batch.num_rows, max(begin + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES - size, "right"))))
                held.append(batch.slice(begin, upto - begin))
                size += int(sizes[upto - 1]) - done
                begin = upto
                if size >= CHUNK_BYTES or begin < batch.num_rows:
                    yield full()
                    held, size, n = [], 0, n + 1
        if held:
            yield full()
        give_back()

    return found.mapInArrow(run, "chunk bigint, rows binary")


def blocks(chunks: DataFrame, buckets: int, words: int | None = None) -> DataFrame:
    """bucket, chunk, block: what each chunk has of each bucket.

    Words and pairs; or, where ``words`` is given, phrases of three to as many words for ``chunks`` with answers (bucket, places).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams = Grams(_unpacked(batch.column("rows")[i]), buckets)
                if words is None:
                    found = grams.short()
                else:
                    answers = batch.column("answers")[i].as_py() or []
                    found = grams.long(words, {x["bucket"]: np.frombuffer(x["places"], np.int32) for x in answers})
                for bucket, block in grams.blocks(found):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([batch.column("chunk")[i].as_py()]), pa.array([block], pa.binary())], ["bucket", "chunk", "block"])
                del grams, found
                give_back()

    return chunks.mapInArrow(run, "bucket int, chunk bigint, block binary")


def bucket_sums(batches: Iterator[pa.RecordBatch], least: int, answer: bool) -> Iterator[pa.RecordBatch]:
    """Of whole buckets: the n-grams of ``least`` and more occurrences; for each language a row of 0 words with all its words here; the answers.

    An answer names a chunk, a bucket and the places of frequent pairs in the
    block that came from there.  duckdb works beyond its memory in a folder
    that only this task reads and that goes with it.
    """
    import duckdb

    folder = tempfile.mkdtemp(prefix="fathomline-duckdb-")
    try:
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
        con.execute("CREATE TABLE grams (lang VARCHAR, words TINYINT, phrase BLOB, f BIGINT, chunk BIGINT, bucket INTEGER, place INTEGER)")

        def insert(tables: list[pa.Table]) -> None:
            arrived = pa.concat_tables(tables)  # noqa: F841  read by name below
            con.execute("INSERT INTO grams SELECT * FROM arrived")

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _unpacked(batch.column(2)[i])
                n = rows.num_rows
                sent = {"chunk": pa.array(np.full(n, batch.column(1)[i].as_py(), np.int64)), "bucket": pa.array(np.full(n, batch.column(0)[i].as_py(), np.int32)), "place": pa.array(np.arange(n, dtype=np.int32))}
                for name, column in sent.items():
                    rows = rows.append_column(name, column)
                held.append(rows)
                size += rows.nbytes
                if size >= INSERT_BYTES:
                    insert(held)
                    held, size = [], 0
        if held:
            insert(held)
        con.execute(f"CREATE TABLE kept AS SELECT lang, words, phrase, sum(f)::BIGINT AS f FROM grams GROUP BY ALL HAVING sum(f) >= {least}")
        none = "NULL::BIGINT AS chunk, NULL::INTEGER AS bucket, NULL::BLOB AS places"
        for query in (f"SELECT *, {none} FROM kept", f"SELECT lang, 0::TINYINT AS words, ''::BLOB AS phrase, sum(f)::BIGINT AS f, {none} FROM grams WHERE words = 1 GROUP BY 1"):
            for rows in con.sql(query).to_arrow_reader(100_000):
                yield rows.cast(pa.schema([*_BLOCK, ("chunk", pa.int64()), ("bucket", pa.int32()), ("places", pa.binary())]))
        if answer:
            pairs = "SELECT chunk, bucket, list(place) AS places FROM grams SEMI JOIN (SELECT * FROM kept WHERE words = 2) k ON k.lang = grams.lang AND k.phrase = grams.phrase AND grams.words = 2 GROUP BY 1, 2"
            for rows in con.sql(pairs).to_arrow_reader(10_000):
                places = [x.values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes() for x in rows.column(2)]
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int8()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), rows.column(0), rows.column(1), pa.array(places, pa.binary())], ["lang", "words", "phrase", "f", "chunk", "bucket", "places"])
        con.close()
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        give_back()


def frequent(docs: DataFrame, *, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f of all n-grams that occur ``least`` times or more, and rows of 0 words whose f add up to a language's words."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    buckets = max(1, math.isqrt(n_bytes // BUCKET_UNIT))

    def summed(sent: DataFrame, answer: bool) -> DataFrame:
        return written(sent.repartition(buckets, "bucket").mapInArrow(lambda batches: bucket_sums(batches, least, answer), SUMS))

    chunks = written(chunked(pieces(docs)))
    short = summed(blocks(chunks, buckets), True)
    # a chunk gets at most one answer from each bucket
    answers = short.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "places")).alias("answers"))
    long = summed(blocks(chunks.join(answers, "chunk"), buckets, words), False) if words > 2 else short.limit(0)
    counts = short.where("chunk IS NULL").unionByName(long)
    return written(counts.select("lang", F.col("words").cast("int").alias("words"), F.col("phrase").cast("string").alias("phrase"), "f"))


# --- phrases --------------------------------------------------------------------------------------


def part(begin, size):
    """The phrase of ``size`` words of ``w`` from its word ``begin`` on."""
    return F.array_join(F.slice("w", begin, size), " ")


def cuts(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, k, l, r, score: the lowest-scoring cut of every phrase of two words and more."""
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    at = phrases.withColumn("w", F.split("phrase", " ")).select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    request = lambda first, words: F.struct(F.lit(first).alias("first"), words.alias("part"))
    both = F.array(request(True, part(F.lit(1), F.col("k"))), request(False, part(F.col("k") + 1, F.col("words") - F.col("k"))))
    asked = written(at.select("lang", "phrase", "words", "a", "k", F.explode(both).alias("x")).select("lang", "phrase", "words", "a", "k", "x.*"))
    known = counts.where("words >= 1").select("lang", F.col("phrase").alias("part"), "f")
    per_part = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    answered = spread_join(asked, known, ["lang", "part"], hot_keys(per_part, ["lang", "part"], "n", asked.count()), "phrase")
    side = lambda first: F.max(F.when(F.col("first") == first, F.col("f")))
    whole = answered.groupBy("lang", "phrase", "words", "a", "k").agg(side(True).alias("l"), side(False).alias("r"))
    score = F.expr("(2000000BD * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    lowest = whole.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.*")


def covers(counts: DataFrame) -> DataFrame:
    """lang, phrase, longest: of phrases inside longer ones, the count of the most frequent longer one."""
    longer = counts.where("words >= 3").select("lang", "words", "f", F.split("phrase", " ").alias("w"))
    sized = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    placed = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("begin"))
    return placed.groupBy("lang", part(F.col("begin"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, *, words: int = WORDS, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts a phrase, ``l`` and ``r`` the parts of its lowest-scoring cut,
    ``n`` all words of the language.  A phrase within a longer one that has
    ``covered`` percent of its occurrences is left out.  A null text is empty,
    a null lang is ``und``; doc_id and extra columns are ignored, repeated
    rows count as often as they occur, an empty table gives no rows.
    """
    counts = frequent(docs, words=words, least=least)
    scored = cuts(counts).join(covers(counts), ["lang", "phrase"], "left")
    free = scored.where(F.coalesce(100 * F.col("longest").cast("decimal(20, 0)") < covered * F.col("a").cast("decimal(20, 0)"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f, string_split(phrase, ' ') AS w FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, 2000000 * c.f // (l.f + r.f) AS score FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[b:b + s - 1], ' ') AS phrase, max(f) AS longest FROM (SELECT *, unnest(range(1, size - s + 2)) AS b FROM (SELECT *, unnest(range(2, size)) AS s FROM f WHERE size > 2)) GROUP BY ALL),
k AS (SELECT m.* FROM m LEFT JOIN i USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 80 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= 2000"""
