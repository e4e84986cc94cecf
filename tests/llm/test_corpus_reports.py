"""Fingerprints, collocations and the filter audit against plain Python."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import collocations, filter_audit, simhash

VOCABULARY = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "rt", "")]


def near_copies(n, seed=5):
    """A long text, copies of it with a few changed words, and texts of their own."""
    draw = random.Random(seed)
    base = [draw.choice(VOCABULARY) for _ in range(300)]
    out = []
    for i in range(n):
        words = list(base) if i % 3 else [draw.choice(VOCABULARY) for _ in range(40)]
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = draw.choice(VOCABULARY)
        out.append(" ".join(words) if i % 5 else ("\t ".join(words)).upper())
    return out


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, bits):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            label[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(prints)):
        groups[root(i)].append(i)
    low = {r: min((ids[i] for i in g if ids[i] is not None), default=None) for r, g in groups.items()}
    return [low[root(i)] for i in range(len(prints))]


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_simhash_against_all_pairs(spark, odd, bits):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(near_copies(240))], "doc_id bigint, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True).where("doc_id <> 8 OR doc_id IS NULL")
    rows = docs.collect()
    prints, ids = [plain_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows]
    expected = sorted(zip(ids, prints, plain_components(prints, ids, bits), strict=True), key=str)
    got = simhash.simhash_duplicates(docs, max_bits=bits).collect()
    assert sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got), key=str) == expected
    assert len(set(ids)) > len({c for _, _, c in expected}) + 50


def test_fingerprint_of_a_long_text(odd):
    row = odd.where("doc_id = 8").first()
    assert simhash.fingerprints(odd.where("doc_id = 8")).first()["fingerprint"] % (1 << 64) == plain_fingerprint(row["text"])


def test_files_of_one_ball():
    """Thousands of fingerprints in one file: partners are looked up, and every link is kept."""
    draw = np.random.default_rng(1)
    base = int(draw.integers(0, 2**63))
    found = {base}
    # the open segment of the file below, and the one behind its chain
    places = [*range(24, 32), *range(56, 64)]
    for _ in range(700):
        x = base
        for b in draw.choice(places, 4):
            x ^= 1 << int(b)
        found.add(x)
    prints = np.array(sorted(found), np.uint64)
    number, (first, open_at) = next((n, f) for n, f in enumerate(simhash.files(2)) if f[0] == 1)
    mask = simhash._segments_mask(s for s in range(simhash.chain(2)[1]) if s != open_at)
    keys = simhash.turned(prints, first) & np.uint64(mask) | np.uint64(number)
    assert len(set(keys.tolist())) == 1 and len(prints) > 400
    order = np.lexsort((prints, keys))
    a, b = simhash.linked(keys[order], prints[order], 2)
    reached = simhash.smallest_of(len(prints), np.searchsorted(prints, a), np.searchsorted(prints, b))
    expected = []
    for i, j in itertools.combinations(range(len(prints)), 2):
        turned = simhash.turned(prints[[i]] ^ prints[[j]], first)
        if keys[i] == keys[j] and int(prints[i] ^ prints[j]).bit_count() <= 2 and simhash.within_budget(turned, 2)[0]:
            expected.append((i, j))
    ends = np.array(expected)
    assert (reached == simhash.smallest_of(len(prints), ends[:, 0], ends[:, 1])).all()


def test_no_documents(spark, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert simhash.simhash_duplicates(none).count() == 0
    assert collocations.collocations(none).count() == 0
    assert filter_audit.audit(none, labels).count() == 0


def plain_collocations(rows, least, top):
    found = []
    by_lang = collections.defaultdict(list)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            by_lang["und" if lang is None else lang].append(re.findall(r"[^\x20\x09]+", piece))
    for lang, pieces in by_lang.items():
        f = collections.Counter(tuple(w[i : i + n]) for w in pieces for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
        total = sum(map(len, pieces))
        kept = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            inside = [q for q in f if len(q) > len(phrase) and f[q] >= least and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))]
            if any(100 * f[q] >= 80 * a for q in inside):
                continue
            score, _, l, r = min((2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
            kept.append((-score, -a, " ".join(phrase).encode(), a, l, r, total, score))
        found += [(lang, i, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(kept)[:top], 1)]
    return sorted(found)


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_collocations_against_plain_counts(spark, odd, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(collocations, "BUCKET_UNIT", 64)
    draw = random.Random(2)
    texts = [("x" if i % 7 else None, " ".join(draw.choice(["Big", "big", "red\t", "ship,", "of", "it.", "né", "a\x00b", "[x]", "ship", "oil"]) for _ in range(draw.randrange(1, 60)))) for i in range(60)]
    extra = spark.createDataFrame([(100 + i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id bigint, text string, lang string")
    docs = odd.where("doc_id <> 8 OR doc_id IS NULL").select("doc_id", "text", "lang", "node").unionByName(extra, allowMissingColumns=True)
    expected = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], 3, 20)
    got = collocations.collocations(docs, least=3, top=20).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == expected
    assert len(expected) > 20


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    rows = [("x", 1, "a", big), ("x", 1, "b", big + 1), ("x", 2, "a b", big - 1)]
    cut = collocations.cuts(spark.createDataFrame(rows, "lang string, words int, phrase string, f bigint")).first()
    assert (cut["score"], cut["l"], cut["r"]) == (2_000_000 * (big - 1) // (2 * big + 1), big, big + 1)


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    failed = []
    for d in docs:
        text, words = d["text"] or "", re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        earlier = d["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < d["doc_id"] and (o["text"] or "") == text for o in docs)
        tests = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), earlier]
        failed.append((d["lang"] or "", {f for f, t in zip("ABCDE", tests, strict=True) if t}, d["doc_id"]))
    out = {}
    for part in {p for p, _, _ in failed}:
        own = [(f, i) for p, f, i in failed if p == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [i for x, i in own if f in x and not x & before]
                shapley[f] += len(removed)
                out[part, order, step] = [
                    sum(not x & (before | {f}) for x, _ in own), len(removed), sum(f in x and bool(x & before) for x, _ in own), sum(x == {f} for x, _ in own),
                    sum(i in good for i in removed), sum(i in toxic for i in removed), f,
                ]
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return out


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda block: F.lit(1).cast("bigint")], ids=["hashes", "all collide"])
def test_filter_audit_against_brute_force(spark, odd, hashed, monkeypatch):
    draw = random.Random(4)
    long = " ".join(f"w{i}" for i in range(1500))
    rows = [(200 + i, draw.choice([long, long[:-1] + "X", long[:-1] + "Y", "ABC def", "AB# def", "", None]), draw.choice(["en", None, "de"])) for i in range(60)]
    docs = odd.select("doc_id", "text", "lang", "node").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), allowMissingColumns=True)
    marks = [(1, 1, 0), (2, 0, 1), (210, 1, 1), (211, None, 1), (211, 1, None), (212, 1, 0), (213, 1, 0), (9, 1, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "masks", lambda d, f=filter_audit.masks: f(d, hashed))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(docs, labels).collect()}
    assert got == plain_audit(docs.collect(), [m for m in marks if m[0] is not None])
