"""Operator 6: packing documents into token sequences.

The tokens of a partition form one stream in the order of its rows.  Possible
cuts are document ends, sentence ends and, where two of those lie further
apart than an eighth of a sequence, every sixteenth token between them.  With
``P`` the tokens before a cut, the least cost up to cut ``i`` is

    cost[i] = penalty[i] + min(cost[j] + width - (P[i] - P[j]))   over P[i] - P[j] <= width

so ``cost[j] + P[j]`` in a monotone queue gives the minimum in constant time.
A stream is handled in blocks; what lies after a block's last cut but one
goes into the next block, so memory doesn't grow with the partition.  In a
stream's last window a sequence may also have a power of two of tokens, which
needs no padding, at the same penalties for where it is cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import word_ids

WIDTH = 4096
END_ID = 2
SENTENCE_PENALTY = 8
TOKEN_PENALTY = 512
#: Of the powers of two that need no padding, the least that is cut on purpose.
LEAST_POWER = 256
BLOCK_TOKENS = 1 << 20

PIECES = "doc_id bigint, start bigint, length bigint, ids_le binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def best_cuts(ends: np.ndarray, penalties: np.ndarray, width: int) -> list[int]:
    """The cheapest cuts of a stream of ``ends[-1]`` tokens; the last is its end.

    ``ends`` are the possible cuts, rising, never more than ``width`` apart.
    """
    place, extra = ends.tolist(), penalties.tolist()
    # entries of the queue: (cost + P, P, index), the smallest first
    queue: deque = deque([(0, 0, -1)])
    before = [0] * len(place)
    for i, p in enumerate(place):
        while p - queue[0][1] > width:
            queue.popleft()
        low, _, before[i] = queue[0]
        value = low + width + extra[i]  # the cost here plus p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, i))
    cuts, i = [], len(place) - 1
    while i >= 0:
        cuts.append(place[i])
        i = before[i]
    return cuts[::-1]


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts and their penalties: 0 at document ends, more inside documents."""
    n = len(ids)
    kind = np.zeros(n + 1, np.int8)
    kind[1:][sentence_end[ids]] = 1
    kind[doc_ends] = 2
    kind[n] = 2
    kind[0] = 2
    at = np.flatnonzero(kind)
    wide = np.flatnonzero(np.diff(at) > width // 8)
    if len(wide):
        step = max(1, width // 256)
        grid = np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in wide.tolist()])
        at = np.union1d(at, grid)
    at = at[at > 0]
    return at, np.array([TOKEN_PENALTY, SENTENCE_PENALTY, 0])[kind[at]]


def last_cuts(kind_of_cut: np.ndarray, width: int) -> list[int]:
    """The cheapest cuts of a stream's last window of ``len(kind_of_cut)`` tokens, ``width`` at most.

    ``kind_of_cut`` has the penalty of a cut after each token.  A sequence
    costs its padding, or nothing where it has a power of two of tokens, from
    ``LEAST_POWER`` on.
    """
    n, extra = len(kind_of_cut), kind_of_cut.tolist()
    extra[-1] = 0
    powers = [1 << k for k in range(LEAST_POWER.bit_length() - 1, width.bit_length())]
    cost, before, low = [0] * (n + 1), [0] * (n + 1), (0, 0)  # low: the least cost + place, and the place
    for i in range(1, n + 1):
        best = (low[0] + width - i, low[1])
        for p in powers:
            if p <= i:
                best = min(best, (cost[i - p], i - p))
        cost[i], before[i] = best[0] + extra[i - 1], best[1]
        low = min(low, (cost[i] + i, i))
    cuts, i = [], n
    while i:
        cuts.append(i)
        i = before[i]
    return cuts[::-1]


class Stream:
    """The open part of one partition's stream."""

    def __init__(self, sentence_end: np.ndarray, width: int):
        self.sentence_end, self.width = sentence_end, width
        self.sequence = TaskContext.get().partitionId() << 32
        self.ids = np.zeros(0, np.uint16)
        # per document in the open part: its id, whether it has none, its tokens before the open part, its tokens, its end here
        self.doc = self.before = self.tokens = self.ends = np.zeros(0, np.int64)
        self.nameless = np.zeros(0, bool)

    def add(self, doc: np.ndarray, nameless: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc, self.nameless = np.concatenate([self.doc, doc]), np.concatenate([self.nameless, nameless])
        self.before = np.concatenate([self.before, np.zeros(len(doc), np.int64)])
        self.tokens = np.concatenate([self.tokens, lengths])
        self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])

    def cut(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of what can be packed now; everything if ``last``."""
        if not len(self.ids):
            return None
        at, penalties = possible_cuts(self.ids, self.ends, self.sentence_end, self.width)
        cuts = best_cuts(at, penalties, self.width)
        if last:
            begin = cuts[-2] if len(cuts) > 1 else 0
            penalty = np.where(self.sentence_end[self.ids[begin:]], SENTENCE_PENALTY, TOKEN_PENALTY)
            penalty[self.ends[self.ends > begin] - begin - 1] = 0
            cuts = [*cuts[:-1], *(begin + c for c in last_cuts(penalty, self.width))]
        else:
            cuts = cuts[:-1]
            if not cuts:
                return None
        done, cuts = cuts[-1], np.array(cuts)
        edges = np.union1d(cuts, self.ends[self.ends <= done])
        begins = np.concatenate([[0], edges[:-1]])
        piece_doc = np.searchsorted(self.ends, begins, "right")
        piece_seq = np.searchsorted(cuts, begins, "right")
        doc_begin = np.concatenate([[0], self.ends[:-1]])
        seq_begin = np.concatenate([[0], cuts[:-1]])
        raw = self.ids[:done].astype("<u4")
        where = pa.array(np.concatenate([begins, edges[-1:]]).astype(np.int64) * 4, pa.int64())
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, where.buffers()[1], pa.py_buffer(raw)])
        ids = pa.array(self.doc[piece_doc], mask=self.nameless[piece_doc])
        out = pa.RecordBatch.from_arrays(
            [ids, pa.array(self.before[piece_doc] + begins - doc_begin[piece_doc]), pa.array(edges - begins), blobs.cast(pa.binary()), pa.array(self.tokens[piece_doc]), pa.array(self.sequence + piece_seq), pa.array(begins - seq_begin[piece_seq])],
            ["doc_id", "start", "length", "ids_le", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(cuts)
        keep = self.ends > done
        self.before = (self.before + np.maximum(done - doc_begin, 0))[keep]
        self.doc, self.nameless, self.tokens, self.ends, self.ids = self.doc[keep], self.nameless[keep], self.tokens[keep], self.ends[keep] - done, self.ids[done:]
        return out


def sentence_ends(tokenizer) -> np.ndarray:
    """Which ids are punctuation that ends a sentence."""
    out = np.zeros(1 << 16, bool)
    for token, i in tokenizer.get_vocab().items():
        bare = token.removesuffix("</w>")
        if bare and bare[-1] in ".!?" and not any(c.isalnum() for c in bare):
            out[i] = True
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of at most ``width`` tokens.

    One row per piece: doc_id, start (the document's ids before it), length,
    ids_le (ids as unsigned little-endian 32-bit numbers), doc_tokens,
    sequence_id, offset in the sequence.  Every id lies in one piece; a
    sequence has no gaps.  Order is that of the rows in each partition, and a
    sequence never spans partitions, so a lost task is redone on its own.

    A null text has the end id alone.  A null doc_id stays null.  Rows that
    repeat a doc_id are packed each for itself.  Other columns are ignored;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        stream = Stream(sentence_ends(words.tokenizer), width)
        for batch in batches:
            doc, nameless = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for row, ids, lengths in words.batches(batch.column(1)):
                ends, rows = np.cumsum(lengths), slice(row, row + len(lengths))
                stream.add(doc[rows], nameless[rows], np.insert(ids, ends, end_id), lengths + 1)
                if len(stream.ids) >= BLOCK_TOKENS and (out := stream.cut(False)) is not None:
                    yield out
        if (out := stream.cut(True)) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
