"""Operator 3: quality rules and an isolation forest on their statistics.

Rule statistics of whole texts are counted with numpy, one pass over the
texts, and kept.  Trees are grown from a bounded sample of labelled rows of
good quality; a document's score is 2 to the power of minus its mean path
length over the expected one.  The threshold comes from a histogram of the
scores of all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textarrays import WHITE, numbered, per_row, row_sums, runs, slices

TREES, SUBSAMPLE, DEPTH = 100, 256, 8
#: Labelled rows that the trees may be grown from.
MAX_LABELLED = 20_000
#: Of labelled good documents at most this share may lie over the threshold.
MAX_LOST = 0.001
BINS = 2000
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_letters", "n_distinct_words"]
FEATURES = ["mean_word", "symbols", "dup_lines", "repeats", "digits", "upper", "letters", "distinct"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(numbers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit, whether its row has it twice or more, and whether it had it before."""
    key = row * (numbers.max(initial=0) + 1) + numbers
    _, first, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return times[inverse] > 1, again


def slice_statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ``STATISTICS`` of each row of a slice."""
    n = len(offsets) - 1
    start, end = runs(~WHITE[data], offsets)
    (words, distinct), (n_words, bounds) = numbered(data, start, end), per_row(start, offsets)
    row = np.repeat(np.arange(n), n_words)
    by_byte = lambda mask: row_sums(mask, offsets)
    word_chars = by_byte(~WHITE[data] & ((data & 0xC0) != 0x80))
    covered = np.zeros(len(words) + 3, bool)
    # three-word windows of rows with three words at least
    place = np.arange(len(words)) - bounds[:-1][row]
    whole = np.flatnonzero(place + 3 <= n_words[row])
    if len(whole):
        _, two = np.unique(words[whole] * len(distinct) + words[whole + 1], return_inverse=True)
        _, three = np.unique(two * len(distinct) + words[whole + 2], return_inverse=True)
        twice, _ = _repeated(three, row[whole])
        for j in range(3):
            covered[whole[twice] + j] = True
    n_repeat = row_sums(covered[: len(words)], bounds)
    _, seen_word = _repeated(words, row)
    # lines: spans between line feeds, each row's last one included
    feeds = np.flatnonzero(data == 10)
    line_start = np.union1d(feeds + 1, offsets[:-1])
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    closed = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
    n_lines, line_bounds = per_row(line_start, offsets)
    line_row = np.repeat(np.arange(n), n_lines)
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    lines, _ = numbered(data, line_start[full], (line_end - closed)[full])
    _, again = _repeated(lines, line_row[full])
    dup = np.zeros(len(line_start), bool)
    dup[np.flatnonzero(full)[again]] = True
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = upper | (data >= 97) & (data <= 122) | (data >= 0xC0)
    return [n_words, word_chars, by_byte(_SYMBOL[data]), row_sums(dup, line_bounds), n_repeat, row_sums(full, line_bounds), by_byte(digit), by_byte(upper), by_byte(letter), n_words - row_sums(seen_word, bounds)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the ``STATISTICS`` of every row; a null text has 0 of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(1)):
                found = slice_statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *(pa.array(x.astype(np.int64)) for x in found)], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{x} bigint" for x in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """Ratios, so that a text's length is no anomaly."""
    words, chars = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    ratio = {
        "mean_word": F.log1p(F.col("word_chars") / words),
        "symbols": F.log1p(F.col("n_symbols") / words),
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "digits": F.col("n_digits") / chars,
        "upper": F.col("n_upper") / chars,
        "letters": F.col("n_letters") / chars,
        "distinct": F.col("n_distinct_words") / words,
    }
    return [ratio[x].cast("double").alias(x) for x in FEATURES]


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees of random splits as arrays in heap order.

    A node splits its box, not the range of its rows: the root's box spans
    all labelled rows, ``low`` to ``high``, and a split halves it at random.
    So a statistic that is constant among good rows still parts bad ones off.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int):
        random = np.random.default_rng(seed)
        size = (1 << DEPTH + 1) - 1
        self.feature = np.full((TREES, size), -1, np.int8)
        self.split = np.zeros((TREES, size))
        self.length = np.zeros((TREES, size))
        take = min(SUBSAMPLE, len(rows))
        self.scale = max(float(_expected(np.array(take))), 1e-9)
        wide = np.flatnonzero(high > low)
        for t in range(TREES):
            todo = [(0, 0, rows[random.choice(len(rows), take, replace=False)], low, high)]
            while todo:
                at, depth, part, a, b = todo.pop()
                if depth == DEPTH or len(part) <= 1 or not len(wide):
                    self.length[t, at] = depth + float(_expected(np.array(len(part))))
                    continue
                f = random.choice(wide)
                s = random.uniform(a[f], b[f])
                self.feature[t, at], self.split[t, at] = f, s
                under = part[:, f] < s
                left_high, right_low = b.copy(), a.copy()
                left_high[f] = right_low[f] = s
                todo += [(2 * at + 1, depth + 1, part[under], a, left_high), (2 * at + 2, depth + 1, part[~under], right_low, b)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths, the higher."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for t in range(TREES):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                f = self.feature[t, at]
                inner = f >= 0
                right = rows[every, np.maximum(f, 0)] >= self.split[t, at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += self.length[t, at]
        return 2 ** (-total / TREES / self.scale)


def judge(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_lost: float = MAX_LOST, seed: int = 7) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept of every row of ``docs``.

    ``labels`` has doc_id and quality (1 good, 0 bad; others and nulls are
    left out, of several labels of a document the lowest holds).  Trees are
    grown from at most ``max_labelled`` good rows, those of the smallest
    hashes.  The threshold is the lowest score that at most ``max_lost`` of
    the good rows lie over and that parts good from bad best; without bad rows
    or good rows nothing is anomalous.  Rows that fail a base rule are not
    kept.  Null ids and repeated rows are judged like any other.
    """
    stats = written(statistics(docs).withColumn("base_failed", base_failed()))
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    labelled = stats.where("NOT base_failed").join(marks, "doc_id")
    # a bound on the hash, from the number of rows, keeps what tasks send small; the sample is cut to size here
    good = labelled.where("quality = 1").select(*features(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"))
    share = min(1.0, 1.2 * max_labelled / max(good.count(), 1))
    near = good.where(F.col("h") < F.lit(int(share * (1 << 40)))).toPandas()
    rows = near.sort_values(["h", *FEATURES]).head(max_labelled).drop(columns="h").to_numpy(float)
    box = labelled.select(*features()).agg(*[f(x) for f in (F.min, F.max) for x in FEATURES]).first()
    if not len(rows):
        return stats.withColumn("score", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    forest = Forest(rows, np.array(box[: len(FEATURES)], float), np.array(box[len(FEATURES) :], float), seed)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([c.to_numpy(float) for c in columns])))

    bins = labelled.select("quality", F.floor(score(*features()) * BINS).alias("bin")).groupBy("quality", "bin").count().toPandas()
    scored = stats.withColumn("score", score(*features()))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(threshold(bins, max_lost))))


def threshold(bins: pd.DataFrame, max_lost: float) -> float:
    """From counts of scores by quality and bin (see ``judge``)."""
    count = {q: np.bincount(b["bin"].astype(int), b["count"], BINS + 2) for q, b in bins.groupby("quality")}
    good, bad = (count.get(q, np.zeros(BINS + 2)) for q in (1, 0))
    if not good.sum() or not bad.sum():
        return 2.0
    over = lambda x: np.cumsum(x[::-1])[::-1] / x.sum()
    lost, caught = over(good), over(bad)
    gain = np.where(lost <= max_lost, caught - lost, -1)
    return float(np.argmax(gain)) / BINS if gain.max() > 0 else 2.0
