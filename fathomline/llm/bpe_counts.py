"""Operator 10: token counts by rank-synchronous merging of arrays.

Distinct pre-tokens of a batch are held as one ragged array of symbols.  In
every step each sequence applies its lowest-ranked pair, at all places that
don't overlap, and all sequences do so at once; what is left when no pair has
a rank are the tokens.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import give_back, numbered, slices
from .tokens import _KIND, Kept

#: Fixed: how the byte-level vocabulary cuts texts into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that begin a non-ASCII white-space character.
_ODD_SPACE = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
NONE = np.iinfo(np.int64).max


def byte_symbols(vocab: dict[str, int]) -> np.ndarray:
    """Ids of single bytes: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return np.array([vocab[names[b]] for b in range(256)], np.int64)


class RankedPairs:
    """The merges of a byte-level vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.bytes = byte_symbols(vocab)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self.special = [t["content"] for t in data["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; every sequence has a symbol at least."""
        out = lengths.copy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        while len(symbols) > 1:
            pair = np.full(len(symbols), NONE)
            same = owner[1:] == owner[:-1]
            pair[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(pair, first)
            parts = np.diff(np.append(first, len(symbols)))
            live = np.repeat(low != NONE, parts)  # a sequence without a ranked pair is done
            here = (pair == np.repeat(low, parts)) & live
            if not here.any():
                break
            # of pairs that overlap (equal symbols in a run) every second one, from the left
            spot = np.flatnonzero(here)
            new_run = np.concatenate([[True], np.diff(spot) > 1])
            begin = np.flatnonzero(new_run)
            spot = spot[(np.arange(len(spot)) - np.repeat(begin, np.diff(np.append(begin, len(spot))))) % 2 == 0]
            symbols[spot] = self.made[pair[spot]]
            gone = np.zeros(len(symbols), bool)
            gone[spot + 1] = True
            np.subtract.at(out, owner[spot], 1)
            keep = live & ~gone
            symbols, owner = symbols[keep], owner[keep]
        return out


class TokenCounter:
    def __init__(self, path: str):
        self.pairs = RankedPairs(path)
        self.kept = Kept(np.int64)
        self.cut = regex.compile(PRE_TOKENS)
        self.special = regex.compile("|".join(map(regex.escape, self.pairs.special)))

    def _counts(self, units: list[bytes]) -> np.ndarray:
        """Tokens of each unit, a unit being whole pre-tokens."""
        pieces: dict[str, int] = {}
        numbers, parts = [], np.zeros(len(units), np.int64)
        for i, unit in enumerate(units):
            found = [unit.decode()] if unit.isalpha() else self.cut.findall(unit.decode())
            parts[i] = len(found)
            numbers.extend(pieces.setdefault(x, len(pieces)) for x in found)
        raw = [x.encode() for x in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        per_piece = self.pairs.count(self.pairs.bytes[np.frombuffer(b"".join(raw), np.uint8)], lengths) if raw else lengths
        total = np.concatenate([[0], np.cumsum(per_piece[np.array(numbers, np.int64)])])
        ends = np.cumsum(parts)
        return total[ends] - total[ends - parts]

    def _make(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._counts(units), np.ones(len(units), np.int64)

    def _whole(self, text: str) -> int:
        """A text with special strings or unusual white space."""
        found = len(self.special.findall(text))
        return found + int(self._counts([x.encode() for x in self.special.split(text) if x]).sum())

    def lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of every text; null is empty."""
        n_bytes, n_tokens = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        special = [x.encode() for x in self.pairs.special]
        for row, end, data, offsets in slices(column):
            n_bytes[row:end] = np.diff(offsets)
            if not len(data):
                continue
            raw = data.tobytes()
            kind = _KIND[data]
            cut = np.zeros(len(data), bool)
            a, b = kind[:-1], kind[1:]
            # a change between ASCII kinds; before white space; inside or after white space see below
            cut[1:] = (a != b) & (a > 1) & (b > 1) | (a != 1) & (b == 1)
            after = np.flatnonzero((a == 1) & (b != 1)) + 1  # the first character after white space
            after = after[~np.isin(after, offsets)]
            one = data[after - 1] == 32
            cut[after[~one]] = True  # it stands alone
            cut[after - 1] = True  # the last white-space character leaves the others, with what follows or by itself
            cut[offsets[offsets < len(data)]] = True
            start = np.flatnonzero(cut)
            unit, units = numbered(data, start, np.append(start[1:], len(data)))
            number = self.kept.find(units, self._make)[unit]
            total = np.concatenate([[0], np.cumsum(self.kept.values[number].astype(np.int64))])
            bounds = np.searchsorted(start, offsets, "left")
            n_tokens[row:end] = total[bounds[1:]] - total[bounds[:-1]]
            lead = (data == 0xC2) | (data >= 0xE1) & (data <= 0xE3) | (data >= 28) & (data < 32)
            if any(x in raw for x in special) or lead.any() and _ODD_SPACE.search(raw):
                for i in range(end - row):
                    text = raw[offsets[i] : offsets[i + 1]]
                    if any(x in text for x in special) or _ODD_SPACE.search(text):
                        n_tokens[row + i] = self._whole(text.decode())
        give_back()
        return n_bytes, n_tokens


@functools.cache
def token_counter(path: str) -> TokenCounter:
    """The counter of this worker: tasks that run in it one after the other share what it has met."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and n_tokens; columns of these names are replaced.

    A null or empty text has 0 of both.  Special strings inside texts count
    as one token, as the tokenizer does by default.  Rows stay where they
    are: nothing is shuffled, and a lost task is redone alone.  Only doc_id
    and text are read; repeated rows stay repeated and null ids stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocabulary_path)
        for batch in batches:
            n_bytes, n_tokens = counter.lengths(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
