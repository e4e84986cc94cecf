"""Token ids and token counts of whole texts, batch by batch.

Texts are cut where no token can cross (white space, changes between ASCII
letters, digits and punctuation), each distinct unit is tokenised once per
worker and the results are gathered with numpy.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa

from .textarrays import LOWER, give_back, hashed, numbered, ragged_take, slices

#: A worker forgets its units beyond so many: that changes no result.
KEPT_UNITS = 2_000_000
_KIND = np.zeros(256, np.uint8)  # 0: joins whatever stands beside it
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 3
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 4
_KIND[39] = 0  # an apostrophe may begin a contraction


def _starts(row_offsets: np.ndarray, n: int, cut: np.ndarray) -> np.ndarray:
    cut[row_offsets[row_offsets < n]] = True
    return np.flatnonzero(cut)


class Kept:
    """What is known of units: found by hash, confirmed by their bytes, with a ragged array of values."""

    def __init__(self, kind: type = np.uint16) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.where = np.zeros(0, np.int32)
        self.bounds, self.values = np.zeros(1, np.int64), np.zeros(0, self.kind)
        self.ends, self.letters = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def _same(self, numbers: np.ndarray, data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Have the units ``which`` of ``data`` the bytes of those known by ``numbers``?"""
        same = self.ends[numbers + 1] - self.ends[numbers] == offsets[which + 1] - offsets[which]
        mine, sizes = ragged_take(data, offsets, which[same])
        theirs, _ = ragged_take(self.letters, self.ends, numbers[same])
        wrong = np.flatnonzero(mine != theirs)
        same[np.flatnonzero(same)[np.searchsorted(np.cumsum(sizes), wrong, "right")]] = False
        return same

    def find(self, units: pa.Array, make, hashed=hashed) -> np.ndarray:
        """Numbers of distinct units, none of them empty; ``make(list of bytes)`` gives values and lengths of those not met before."""
        if len(self.hashes) > KEPT_UNITS:
            self.clear()
        found = np.full(len(units), -1, np.int64)
        offsets = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(units.buffers()[2], np.uint8) if len(units) else np.zeros(0, np.uint8)
        hashes = hashed(data, offsets[:-1], offsets[1:])
        order, at = np.argsort(hashes), np.zeros(len(hashes), np.int64)
        at[order] = np.searchsorted(self.hashes, hashes[order])
        met = np.flatnonzero(at < len(self.hashes))
        met = met[self.hashes[at[met]] == hashes[met]]
        numbers = self.where[at[met]].astype(np.int64)
        same = self._same(numbers, data, offsets, met)
        found[met[same]] = numbers[same]
        new = np.flatnonzero(found < 0)
        if len(new):
            values, lengths = make(units.take(pa.array(new)).to_pylist())
            found[new] = np.arange(len(new)) + len(self.bounds) - 1
            fresh, sizes = ragged_take(data, offsets, new)
            self.values = np.concatenate([self.values, values.astype(self.kind)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
            self.letters = np.concatenate([self.letters, fresh])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            # of several units with one hash only the first is found again; the others are made anew each time
            _, first = np.unique(hashes[new], return_index=True)
            first = first[~np.isin(new[first], met)]
            self.where = np.insert(self.where, at[new[first]], found[new[first]].astype(np.int32))
            self.hashes = np.insert(self.hashes, at[new[first]], hashes[new[first]])
        return found


class WordIds:
    """Ids of a tokenizer that drops white space and lower-cases (``word_bpe_49k.json``).

    Ids are kept in 16 bits, here and in what is written: a larger vocabulary is an error.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids of more than 16 bits")
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.closes = np.zeros(1 << 16, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.kept = Kept()

    def _make(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [u.decode() for u in units]
        # a unit of Latin letters is one pre-token, which one word-end token closes: such units go in as one text
        simple = np.fromiter((x.isalpha() and max(x) < "\u0250" for x in texts), bool, len(texts))
        which = np.flatnonzero(simple)
        if len(which) < 2:
            return self._each(texts)
        joined = "\n".join([texts[i] for i in which.tolist()])
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(which) or ends[-1] != len(ids):
            return self._each(texts)
        lengths = np.zeros(len(texts), np.int64)
        lengths[which] = np.diff(ends, prepend=0)
        rest = np.flatnonzero(~simple)
        other, lengths[rest] = self._each([texts[i] for i in rest.tolist()])
        out = np.zeros(int(lengths.sum()), np.uint16)
        out[np.repeat(simple, lengths)] = ids
        out[np.repeat(~simple, lengths)] = other
        return out, lengths

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [e.ids for e in found]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint16, int(lengths.sum())), lengths

    def batches(self, column: pa.Array, only_lengths: bool = False):
        """(first row, ids of the slice as uint16, length of each row) per slice of rows; ids may be left out."""
        for row, end, data, offsets in slices(column):
            raw = data.tobytes()
            if self.special.search(raw):  # such texts are few: the library takes them whole
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ids, lengths = self._each([x.decode() for x in texts])
                yield row, ids, lengths
                continue
            data = LOWER[data]
            kind = _KIND[data]
            cut = np.zeros(len(data), bool)
            cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) | (kind[1:] == 1) | (kind[:-1] == 1)
            start = _starts(offsets, len(data), cut)
            finish = np.append(start[1:], len(data))
            words = kind[start] != 1
            start, finish = start[words], finish[words]
            unit, units = numbered(data, start, finish)
            number = self.kept.find(units, self._make)[unit]
            if only_lengths:
                ids, lengths = None, (self.kept.bounds[1:] - self.kept.bounds[:-1])[number]
            else:
                ids, lengths = ragged_take(self.kept.values, self.kept.bounds, number)
            bounds = np.searchsorted(start, offsets, "left")
            total = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=total[1:])
            yield row, ids, total[bounds[1:]] - total[bounds[:-1]]
        give_back()


@functools.cache
def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker: tasks that run in it one after the other share what it has met."""
    return WordIds(path)
