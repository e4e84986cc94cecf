"""Operator 9: language identification by Kneser-Ney character models.

Counts of character n-grams are gathered over a bounded sample of labelled
texts for each language.  The models of all languages share sorted arrays of
n-gram hashes, one array for each order, with the interpolated probability
and the back-off weight of every n-gram in every language.  A text gets the
language of the lowest cross-entropy per character; it is rejected if that
entropy is beyond what labelled texts of the language have.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textarrays import mix

ORDER = 4
DISCOUNT = 0.75
#: Labelled texts of each language that counts, and that the rejection, come from.
MAX_TEXTS, MAX_CALIBRATION = 2000, 1000
#: Characters of the texts of each language that counts come from.
MAX_CHARACTERS = 8_000_000
#: A text is rejected beyond this quantile of the entropies of labelled texts, plus so many nats.
QUANTILE, SLACK = 0.995, 0.75
#: Letters of a text depend on each other: they count as so many independent ones at most in the score.
EVIDENCE = 100
NO_LANGUAGE = "und"
PART = 1 << 19
_U = np.uint64
_SALT = mix(np.arange(1, ORDER + 2, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case letter that each code point stands for; 32 if it's no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with single spaces between words and around each text; where each text begins."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    mapped = _letters()[codes]
    ends = np.cumsum([len(t) for t in texts])
    # a space before each text, so that a text's first n-gram sees a border
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    mapped = np.insert(mapped, starts, 32)
    begin = starts + np.arange(len(texts))
    keep = np.ones(len(mapped), bool)
    keep[1:] = (mapped[1:] != 32) | (mapped[:-1] != 32)
    keep[begin] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return mapped[keep], np.append(total[begin], total[-1])


def gram_hashes(letters: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each order n from 1 on: hashes of the n letters that end at each place; 0 where a text is too short."""
    place = np.arange(len(letters)) - np.repeat(bounds[:-1], np.diff(bounds))
    code = letters.astype(np.uint64) + _U(1)
    out, total = [], np.zeros(len(letters), np.uint64)
    for n in range(1, ORDER + 1):
        part = code * _U(pow(0x2545F4914F6CDD1D, n, 1 << 64))
        total = total.copy()
        total[n - 1 :] += part[: len(part) - n + 1] if n > 1 else part
        h = mix(total ^ _SALT[n])
        out.append(np.where(place >= n - 1, h | _U(1), _U(0)))
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    texts, first, size = [], 0, 0
    for i, t in enumerate(column):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= PART:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def sample_texts(docs: DataFrame, lang: Column, salt: int, most: int) -> DataFrame:
    """lang, text of at most ``most`` rows of each language, those of the smallest hashes.

    The hash bound of each language comes from its count of rows, so no texts
    are sorted; ``most`` bounds the expected number and is cut back exactly.
    """
    rows = docs.where(lang.isNotNull() & F.col("text").isNotNull()).select(lang.alias("lang"), "text", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 40)).alias("h"))
    sizes = rows.groupBy("lang").count().where(F.col("count") > 0)
    share = sizes.select("lang", (F.least(F.lit(1.0), F.lit(1.2 * most) / F.col("count")) * (1 << 40)).alias("below"))
    near = rows.join(F.broadcast(share), "lang").where("h < below").drop("below")  # a row for each language
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    return placed.where(F.col("place") <= most).select("lang", "text", "h")


def within(texts: DataFrame, most: int) -> DataFrame:
    """The first texts of each language by hash that together have ``most`` characters at most, and the first one in any case."""
    by_hash = Window.partitionBy("lang").orderBy("h", "text")
    before = F.coalesce(F.sum(F.char_length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = texts.withColumn("end", before + F.char_length("text")).withColumn("first", F.row_number().over(by_hash) == 1)
    return sized.where((F.col("end") <= most) | F.col("first")).select("lang", "text")


def gram_counts(texts: DataFrame) -> pd.DataFrame:
    """lang, n, gram, head (its first n - 1 letters), tail (its last n - 1), times: over a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                for _, some in _texts(pa.array(part["text"])):
                    letters, bounds = letters_of(some)
                    hashes = gram_hashes(letters, bounds)
                    for n, h in enumerate(hashes, 1):
                        met = h != 0
                        gram, first, times = np.unique(h[met], return_index=True, return_counts=True)
                        where = np.flatnonzero(met)[first]
                        head = hashes[n - 2][where - 1] if n > 1 else np.zeros(len(gram), np.uint64)
                        tail = hashes[n - 2][where] if n > 1 else np.zeros(len(gram), np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(np.full(len(gram), n, np.int32)), *(pa.array(x.view(np.int64)) for x in (gram, head, tail)), pa.array(times)], ["lang", "n", "gram", "head", "tail", "times"])

    made = texts.mapInArrow(run, "lang string, n int, gram bigint, head bigint, tail bigint, times bigint")
    return made.groupBy("lang", "n", "gram", "head", "tail").agg(F.sum("times").alias("times")).toPandas()


class Models:
    """Interpolated Kneser-Ney models of all languages over shared sorted arrays."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique())
        self.keys, self.log_p, self.log_back = [], [], []
        number = {x: i for i, x in enumerate(self.languages)}
        lang = counts["lang"].map(number).to_numpy()
        columns = {c: counts[c].to_numpy().view(np.uint64) if c in ("gram", "head", "tail") else counts[c].to_numpy() for c in ("n", "gram", "head", "tail", "times")}
        width = len(self.languages)
        lower = None
        for n in range(1, ORDER + 1):
            at = columns["n"] == n
            gram, first, inverse = np.unique(columns["gram"][at], return_index=True, return_inverse=True)
            head, tail = columns["head"][at][first], columns["tail"][at][first]
            if n == ORDER:
                weight = np.zeros((len(gram), width))
                weight[inverse, lang[at]] = columns["times"][at]
            else:  # in how many contexts the n-gram stands, for each language
                up = columns["n"] == n + 1
                weight = np.zeros((len(gram), width))
                there = np.searchsorted(gram, columns["tail"][up])
                ok = (there < len(gram)) & (gram[np.minimum(there, len(gram) - 1)] == columns["tail"][up])
                np.add.at(weight, (there[ok], lang[up][ok]), 1)
            if n == 1:
                total, kinds = weight.sum(axis=0), (weight > 0).sum(axis=0)
                uniform = 1.0 / (len(gram) + 1)
                left = DISCOUNT * kinds / np.maximum(total, 1)
                left[total == 0] = 1.0
                p = np.maximum(weight - DISCOUNT, 0) / np.maximum(total, 1) + left * uniform
                self.unseen = np.log(left * uniform).astype(np.float32)
            else:
                own = np.searchsorted(self.keys[-1], head)  # every head is an n-gram of the order below
                total, kinds = np.zeros((len(self.keys[-1]), width)), np.zeros((len(self.keys[-1]), width))
                np.add.at(total, own, weight)
                np.add.at(kinds, own, weight > 0)
                left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                below = np.searchsorted(self.keys[-1], tail)
                p = np.maximum(weight - DISCOUNT, 0) / np.maximum(total[own], 1) + left[own] * lower[below]
                self.log_back.append(np.log(left).astype(np.float32))
            self.keys.append(gram)
            self.log_p.append(np.log(p).astype(np.float32))
            lower = p
        self.cut = None

    def _find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n - 1]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy per character in each language (nats), and its letters."""
        letters, bounds = letters_of(texts)
        hashes = gram_hashes(letters, bounds)
        total = np.zeros((len(letters), len(self.languages)), np.float32)
        todo = np.arange(len(letters))
        for n in range(ORDER, 0, -1):
            h = hashes[n - 1][todo]
            fits = h != 0
            at, met = self._find(n, h)
            met &= fits
            total[todo[met]] += self.log_p[n - 1][at[met]]
            todo, fits = todo[~met], fits[~met]
            if n > 1 and len(todo):
                # back off: the weight of the context, the n - 1 letters before
                context = hashes[n - 2][todo[fits] - 1]
                at, met = self._find(n - 1, context)
                total[todo[fits][met]] += self.log_back[n - 2][at[met]]
        total[todo] += self.unseen
        letter = letters != 32
        sums = np.add.reduceat(np.vstack([total, np.zeros((1, total.shape[1]), np.float32)]), bounds[:-1], axis=0, dtype=np.float64) if len(letters) else np.zeros((len(texts), len(self.languages)))
        n_letters = np.concatenate([[0], np.cumsum(letter)])
        n_letters = n_letters[bounds[1:]] - n_letters[bounds[:-1]]
        return -sums / np.maximum(np.diff(bounds), 1)[:, None], n_letters

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: number of the language (-1 without letters), score, entropy."""
        entropy, n_letters = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy.min(axis=1)
        # odds against the other languages: the entropy gap times the independent letters
        gap = (entropy - low[:, None]) * np.minimum(n_letters, EVIDENCE)[:, None]
        score = 1 / np.exp(-gap).sum(axis=1)
        none = n_letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, np.inf, low)


def fit(labelled: DataFrame, *, lang: str = "lang", max_texts: int = MAX_TEXTS, max_calibration: int = MAX_CALIBRATION, max_characters: int = MAX_CHARACTERS) -> Models | None:
    """Models from ``labelled`` (doc_id, text, language); None if no row has a language and a text.

    At most ``max_texts`` texts of each language, with ``max_characters`` in
    all (and one text in any case), are counted; their n-grams are summed by
    Spark, and what reaches the driver has that bound.  At most
    ``max_calibration`` others fix, for each language, the entropy beyond
    which a text is rejected: the ``QUANTILE`` among them plus ``SLACK``.
    """
    counted = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) != 0
    counts = gram_counts(within(sample_texts(labelled.where(counted), F.col(lang), 2, max_texts), max_characters))
    if not len(counts):
        return None
    models = Models(counts)
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(models)  # bounded by max_texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _texts(batch.column(1)):
                which, _, low = shared.value.predict(texts)
                met = which >= 0
                yield pa.RecordBatch.from_arrays([pa.array(which[met]), pa.array(low[met])], ["which", "entropy"])

    rest = sample_texts(labelled.where(~counted), F.col(lang), 3, max_calibration).select("lang", "text")
    highest = rest.mapInArrow(run, "which bigint, entropy double").groupBy("which").agg(F.percentile("entropy", QUANTILE).alias("entropy")).collect()  # a row for each language
    models.cut = np.full(len(models.languages), np.inf)
    for r in highest:
        models.cut[r["which"]] = r["entropy"] + SLACK
    return models


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced.

    lang_pred is a learned language, or ``und`` with score 0 and rejected
    where the text is null or has no letter, or nothing was learned.  score is
    the odds of the language among those learned, from 0 to 1, a text counting
    as ``EVIDENCE`` independent letters at most.  rejected says that the text
    is less like its language than nearly all labelled ones.  Only the text is looked at;
    null ids and repeated rows are judged like any other.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    if models is None:
        return docs.withColumns({"lang_pred": F.lit(NO_LANGUAGE), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [x for x in docs.columns]
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels = np.array([*m.languages, NO_LANGUAGE], object)
        place = names.index("text")
        for batch in batches:
            for first, texts in _texts(batch.column(place)):
                which, score, low = m.predict(texts)
                rejected = (which < 0) | (low > m.cut[np.maximum(which, 0)])
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels[which], pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)
