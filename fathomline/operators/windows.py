"""Token windows of documents for embedding: a budget with the header, overlap, ends at sentences."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import load

#: Tokens of a window with its header, tokens that two windows share, and the last part of a window in which a sentence may end it.
TOKENS, OVERLAP, TAIL = 420, 60, 0.35
#: Texts are encoded so many at a time.
BATCH = 64


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def sentence_ends(text: str, ends: np.ndarray) -> np.ndarray:
    """Numbers of the tokens that end a sentence: at a line feed, or at ., ! or ? before white space or the end."""
    out = []
    for i, e in enumerate(ends.tolist()):
        last = text[e - 1] if e else ""
        if last == "\n" or (last in ".!?" and (e == len(text) or text[e].isspace())):
            out.append(i)
    return np.array(out, np.int64)


def cuts(n: int, budget: int, overlap: int, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of windows over ``n`` tokens; ``ends`` are tokens that end a sentence."""
    at = 0
    while at < n:
        end = min(at + budget, n)
        if end < n:
            i = np.searchsorted(ends, end - 1, "right") - 1
            if i >= 0 and ends[i] + 1 >= at + budget * (1 - TAIL) and ends[i] + 1 > at:
                end = int(ends[i]) + 1
        yield at, end
        if end == n:
            return
        at = max(end - overlap, at + 1)


def token_windows(docs: DataFrame, path: str, *, tokens: int = TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_id, first_token, n_tokens, at, until of the windows of docs (doc_id, header, text).

    A window has ``tokens`` tokens with its header at most, but one of its own
    at least, and begins ``overlap`` tokens before the last one ended.  A
    window that isn't the last ends at the last sentence end of its last 35
    percent, if there is one.  ``at`` and ``until`` are characters.  A null or
    empty text has no window.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(path)
        for frame in frames:
            for begin in range(0, len(frame), BATCH):
                part = frame.iloc[begin : begin + BATCH]
                texts, heads = part["text"].fillna("").tolist(), part["header"].fillna("").tolist()
                found = encoder.encode_batch(texts, add_special_tokens=False)
                sizes = [len(e.ids) for e in encoder.encode_batch_fast(heads, add_special_tokens=False)]
                out = []
                for doc, text, e, size in zip(part["doc_id"], texts, found, sizes, strict=True):
                    spans = np.array(e.offsets, np.int64).reshape(-1, 2)
                    ends = sentence_ends(text, spans[:, 1])
                    for i, (a, b) in enumerate(cuts(len(spans), max(1, tokens - size), overlap, ends), 1):
                        out.append((doc, f"{'' if pd.isna(doc) else int(doc)}__e{i:03d}", a, b - a, int(spans[a, 0]), int(spans[b - 1, 1])))
                yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "first_token", "n_tokens", "at", "until"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("header").cast("string").alias("header"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, chunk_id string, first_token bigint, n_tokens bigint, at bigint, until bigint")


def embedding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all documents under a header of their source and language."""
    import public_tokenizers

    header = F.concat(F.lit("source: "), F.coalesce("source", F.lit("none")), F.lit("\nlanguage: "), F.coalesce("lang", F.lit("none")), F.lit("\n"))
    return token_windows(load(spark, sf_dir, "documents").select("doc_id", header.alias("header"), "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"embedding_windows": embedding_windows}
ORACLES: dict[str, str] = {}
