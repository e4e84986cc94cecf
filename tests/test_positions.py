"""Phrases, nearness, claims and clauses against plain Python on texts with odd characters."""

import random
import re

from pyspark.sql import functions as F

from fathomline.operators import positions

VOCABULARY = ["not", "is", "sea", "a", "the", "no", "ship", "must"]


def texts(spark, n=80):
    draw = random.Random(9)
    gaps = [" ", ", ", "\n", " é ", "--", " 日本 "]
    rows = [(i, None if i == 3 else "" if i == 4 else "!!" if i == 5 else "".join(draw.choice(VOCABULARY).upper() + draw.choice(gaps) for _ in range(draw.randrange(1, 60)))) for i in range(n)]
    # a long text, and one that is a third of all words
    rows += [(500, " ".join(["sea", "the"] * 4000) + " not"), (501, "ship")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def spans(text):
    return [(m.group(), m.start(), m.end()) for m in re.finditer("[a-z0-9]+", (text or "").lower())]


def test_places_of_words(spark):
    df = texts(spark)
    expected = {(r["doc_id"], i, *s) for r in df.collect() for i, s in enumerate(spans(r["text"]))}
    got = positions.word_positions(df).collect()
    assert {(r["doc_id"], r["pos"], r["word"], r["at"], r["until"]) for r in got} == expected and len(got) == len(expected)


def test_phrases_of_any_length(spark):
    df = texts(spark)
    asked = {"one": ["ship"], "twice": ["sea", "sea"], "three": ["the", "sea", "the"], "six": ["sea", "the"] * 3, "none": ["whale", "sea"], "empty": [], "again": ["a", "a", "a"]}
    expected = set()
    for r in df.collect():
        found = spans(r["text"])
        for name, words in asked.items():
            for i in range(len(found) - len(words) + 1):
                if words and [w for w, _, _ in found[i : i + len(words)]] == words:
                    expected.add((r["doc_id"], name, i, found[i][1], found[i + len(words) - 1][2]))
    phrases = spark.createDataFrame(list(asked.items()), "phrase_id string, words array<string>")
    got = positions.phrase_hits(positions.word_positions(df), phrases).collect()
    assert {(r["doc_id"], r["phrase_id"], r["pos"], r["at"], r["until"]) for r in got} == expected and len(got) == len(expected)


def test_what_is_within_reach(spark):
    df = texts(spark)
    p = positions.word_positions(df)
    got = positions.within_reach(p.where("word IN ('is', 'must')").select("doc_id", "at", "until"), p.where("word IN ('not', 'no')"), 11).collect()
    expected = set()
    for r in df.collect():
        found = spans(r["text"])
        denials = [(a, b) for w, a, b in found if w in ("not", "no")]
        for w, a, b in found:
            if w in ("is", "must"):
                expected.add((r["doc_id"], a, any(x < b + 11 and y > a - 11 for x, y in denials)))
    assert {(r["doc_id"], r["at"], r["near"]) for r in got} == expected and len(got) == len(expected)
    assert {n for _, _, n in expected} == {True, False}


def test_forbidden_claims(spark):
    pad = "x" * 30
    answers = [
        (1, "The engine is new."), (2, f"It is not true, {pad}that the Engine is new."), (3, f"not {'x' * 33}the engine is new"), (4, f"not {'x' * 32}the engine is new"),
        (5, f"the engine is new{'y' * 30} never"), (6, f"the engine is new{'y' * 32} never"), (7, None), (8, "the engine is new. " * 2 + "not"), (9, ""),
    ]
    claims = [(i, c) for i in range(1, 10) for c in (" The engine is new ", "whale", "", None)]

    def violated(text):
        said, needle = text.lower(), "the engine is new"
        at = said.find(needle)
        return None if at < 0 else not any(m in said[max(0, at - 36) : at + len(needle) + 36] for m in positions.MARKERS)

    expected = {i: violated(t or "") for i, t in answers if violated(t or "") is not None}
    got = positions.forbidden_claims(spark.createDataFrame(answers, "answer_id bigint, text string"), spark.createDataFrame(claims, "answer_id bigint, claim string")).collect()
    assert {r["answer_id"]: r["violated"] for r in got} == expected and len(got) == len(expected) == 7
    assert set(expected.values()) == {True, False}


def test_modality(spark):
    said = {"Ships must not enter": "prohibited", "It shall be and may be": "mandatory", "You should go": "recommended", "one CAN": "permitted", "mustard": "none", None: "none", "This cannot be": "prohibited"}
    rows = spark.createDataFrame([(k,) for k in said], "c string").select("c", positions.modality(F.col("c")).alias("m")).collect()
    assert {r["c"]: r["m"] for r in rows} == said
