"""Operator 7: token sequences in training order, as fixed-stride binary shards.

Every sequence gets a dense number, a keyed Feistel permutation with cycle
walking turns numbers into global slots, and slots are dealt to shards by
range.  A shard is a file of records of one size in the order of their slots,
so slot ``s`` stands at byte ``(s % per_shard) * stride`` of shard
``s // per_shard``: a reader that stopped goes on from a slot number alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_folder
from .textarrays import mix
from .tokens import word_ids

WINDOW = 256
PER_SHARD = 8192
ROUNDS = 6
READ = "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, start bigint, length bigint, ids_le binary"


def record_type(window: int) -> np.dtype:
    """A record: document, whether it has no id, its ids before the sequence, ids in it, the ids, a line feed."""
    return np.dtype([("doc_id", "<i8"), ("nameless", "u1"), ("start", "<u8"), ("length", "<u4"), ("ids", "<u2", (window,)), ("end", "u1")])


def feistel(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of 0 .. size - 1: balanced Feistel rounds on the next even number of bits, walked until inside."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _window_counts(lengths: np.ndarray, window: int) -> np.ndarray:
    return -(-lengths // window)


def count_windows(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """part (the task), n: how many sequences of at most ``window`` ids each run of documents has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, n = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            n += sum(int(_window_counts(lengths, window).sum()) for _, _, lengths in words.batches(batch.column(0), only_lengths=True))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n])], ["part", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "part int, n bigint")


def slotted_windows(docs: DataFrame, tokenizer_path: str, before: dict[int, tuple[int, int]], total: int, *, key: int, window: int = WINDOW) -> DataFrame:
    """slot, record of every sequence; ``before`` has how many sequences the tasks before each one have, and it itself.

    A task whose rows give another number than that fails, so that no slot is
    lost or dealt twice.
    """
    kind = record_type(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, (number, own) = word_ids(tokenizer_path), before.get(part, (0, 0))
        end = number + own
        for batch in batches:
            doc, nameless = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for row, ids, lengths in words.batches(batch.column(1)):
                per_doc = _window_counts(lengths, window)
                owner = np.repeat(np.arange(len(lengths)), per_doc)
                first = np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                out = np.zeros(len(owner), kind)
                out["doc_id"], out["nameless"], out["start"], out["end"] = doc[row + owner], nameless[row + owner], first * window, 10
                taken = np.minimum(lengths[owner] - first * window, window)
                out["length"] = taken
                flat = np.repeat((np.cumsum(lengths) - lengths)[owner] + first * window, taken)
                within = np.arange(len(flat)) - np.repeat(np.cumsum(taken) - taken, taken)
                out["ids"][np.repeat(np.arange(len(owner)), taken), within] = ids[flat + within]
                where = pa.array(np.arange(len(out) + 1) * kind.itemsize, pa.int32())
                records = pa.BinaryArray.from_buffers(pa.binary(), len(out), [None, where.buffers()[1], pa.py_buffer(out.tobytes())])
                number += len(out)
                if number > end:
                    raise ValueError(f"task {part} has other rows than when its sequences were counted")
                yield pa.RecordBatch.from_arrays([pa.array(feistel(np.arange(number - len(out), number), total, key)), records], ["slot", "record"])
        if number != end:
            raise ValueError(f"task {part} has other rows than when its sequences were counted")

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "slot bigint, record binary")


def write_training_order(docs: DataFrame, tokenizer_path: str, folder: str, *, key: int, window: int = WINDOW, per_shard: int = PER_SHARD) -> int:
    """Write the documents' token windows as shards under ``folder``; returns how many sequences there are.

    Sequences are numbered in the order of the tasks and their rows: a first
    pass counts each task's sequences, a second one writes them.  ``docs``
    must give the same rows in the same tasks both times, as a scan of a table
    does, so a lost task is redone with the same numbers; a task that has
    another number of sequences fails.  An empty table writes no shard.
    """
    spark = docs.sparkSession
    # one row for each task
    total, before = 0, {}
    for part, n in sorted((r["part"], r["n"]) for r in count_windows(docs, tokenizer_path, window).collect()):
        before[part] = total, n
        total += n
    if not total:
        return 0
    placed = slotted_windows(docs, tokenizer_path, before, total, key=key, window=window).withColumn("shard", F.expr(f"slot div {per_shard}"))
    shards = -(-total // per_shard)
    # ranges of slots, whole shards each; records hold arbitrary bytes, each ends in the writer's line feed
    ranges = min(shards, max(len(before), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    (
        placed.repartitionById(ranges, F.expr(f"cast(shard * {ranges} div {shards} as int)"))
        .sortWithinPartitions("shard", "slot")
        .select("shard", F.expr("cast(substring(record, 1, length(record) - 1) as string)").alias("value"))
        .write.partitionBy("shard")
        .text(folder, lineSep="\n")
    )
    return total


def read_training_order(spark: SparkSession, folder: str, *, window: int = WINDOW, per_shard: int = PER_SHARD, from_slot: int = 0) -> DataFrame:
    """Records from ``from_slot`` on, with the slot that each one's place means."""
    kind = record_type(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(content.as_buffer(), kind)
                slots = shard * per_shard + np.arange(len(rows))
                rows, slots = rows[slots >= from_slot], slots[slots >= from_slot]
                lengths = rows["length"].astype(np.int64)
                inside = np.arange(window) < lengths[:, None]
                raw = rows["ids"][inside].astype("<u4")
                where = pa.array(np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int32))
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, where.buffers()[1], pa.py_buffer(raw.tobytes())])
                doc = rows["doc_id"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(np.full(len(rows), shard, np.int64)), pa.array((slots % per_shard) * kind.itemsize), pa.array(doc, mask=rows["nameless"] == 1), pa.array(rows["start"].astype(np.int64)), pa.array(lengths), ids],
                    ["slot", "shard", "byte_offset", "doc_id", "start", "length", "ids_le"],
                )

    files = spark.read.format("binaryFile").load(folder).select(F.col("shard").cast("long"), "content")
    return files.where(F.col("shard") >= from_slot // per_shard).mapInArrow(run, READ)


def training_order(docs: DataFrame, tokenizer_path: str, *, key: int, window: int = WINDOW, per_shard: int = PER_SHARD) -> DataFrame:
    """Materialise the documents' token windows in training order and read the shards back.

    Per sequence: slot (global place in training order, 0 to n - 1 without
    gaps), shard, byte_offset in its shard, doc_id, start, length, ids_le
    (unsigned little-endian 32-bit ids).  Null and empty texts have no
    sequence, a null doc_id stays null, repeated rows are written repeatedly,
    other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    if not write_training_order(docs, tokenizer_path, folder, key=key, window=window, per_shard=per_shard):
        return spark.createDataFrame([], READ)
    return read_training_order(spark, folder, window=window, per_shard=per_shard)
