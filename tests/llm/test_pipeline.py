"""The pipeline's stages, each on its own input and one after the other."""

import random
import re

import corpus_pipeline
import pytest
from oracle import SF
from pyspark.sql import functions as F
from test_near_dup import classes_of
from test_tokens import WORDS, ids_of

from fathomline.llm import decontaminate, language, pii
from fathomline.llm.scratch import written

STAGES = dict(corpus_pipeline.STAGES)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert n * 0.97 <= sizes[0] <= n and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2]
    assert not decontaminate.hit_report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    packed = STAGES["packing"](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


@pytest.fixture(scope="module")
def wide(odd):
    """Odd rows with columns whose names stages use themselves."""
    names = ["words", "hits", "hit", "found", "_id", "_node", "place", "rejected", "n_entities", "id", "name", "met"]
    return odd.withColumn("source", F.lit("src0")).select("*", *[F.lit(n).alias(n) for n in names])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, wide, name):
    out = STAGES[name](spark, wide, SF)
    rows = out.collect()
    if name != "packing":
        assert out.columns == wide.columns
    if name in ("decontamination", "personal data"):
        assert len(rows) == wide.count()
    if name == "near duplicates":
        assert sum(r["text"] is None for r in rows) == 2 and len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
    if name == "language":
        assert not {4, 5, 6, 11} & {r["doc_id"] for r in rows}
    if name == "packing":
        assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in ids_of(WORDS, [r["text"] for r in wide.collect()]))
    assert STAGES[name](spark, wide.where("false"), SF).count() == 0


def test_language_stage_against_its_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = language.fit(docs)
    kept = {r["doc_id"] for r in STAGES["language"](spark, docs, SF).collect()}
    for r in docs.collect():
        which, _, low = models.predict([r["text"] or ""])
        assert (r["doc_id"] in kept) == bool(which[0] >= 0 and low[0] <= models.cut[which[0]])


def test_dedup_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in STAGES["near duplicates"](spark, docs, SF).collect()} == set(classes_of(texts).values())


def without(text, windows):
    """``text`` without the words of any window, each with what follows it up to the next word; None if no word is left."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]) for a, b in spans]
    hit = {j for i in range(len(words)) for w in windows if tuple(words[i : i + len(w)]) == w for j in range(i, i + len(w))}
    if not hit:
        return text
    ends = [a for a, _ in spans[1:]] + [len(text)]
    left = [text[a:e] for i, ((a, _), e) in enumerate(zip(spans, ends, strict=True)) if i not in hit]
    return text[: spans[0][0]] + "".join(left) if left else None


def test_decontamination_stage_against_brute_force(spark):
    lower = lambda t: tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(WORD, t or ""))
    windows = {w[i : i + 10] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [lower(r["text"])] if w for i in range(max(1, len(w) - 9))}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    got = {r["doc_id"]: r["text"] for r in STAGES["decontamination"](spark, docs, SF).collect()}
    want = {r["doc_id"]: without(r["text"], windows) for r in docs.collect()}
    assert got == {i: t for i, t in want.items() if t is not None}


def test_personal_data_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: {e["mention"] for e in r["e"] if e["kind"] != "none"} for r in docs.select("doc_id", pii.described(pii.entities_of(F.col("text"))).alias("e")).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sum(map(bool, found.values())) > 5
    for r in STAGES["personal data"](spark, docs, SF).collect():
        own = found[r["doc_id"]]
        assert (r["text"] == texts[r["doc_id"]]) == (not own) and not any(m in r["text"] for m in own)


def test_the_whole_against_brute_force(spark, tmp_path):
    """A small corpus in which every stage has something to do; texts are followed by their ids in the sequences."""
    draw = random.Random(3)
    prose = lambda n: " ".join(draw.choice("the cat sat on a mat and ran to her old house near our blue river".split()) for _ in range(n))
    texts = {i: prose(60 + i % 7) for i in range(120)}
    leak = " ".join(f"leak{'abcdefghijkl'[j]}" for j in range(12))
    texts |= {200: texts[3], 201: texts[4].upper(), 202: prose(40) + " " + leak + " " + prose(30), 203: leak, 204: "12 34 !", 205: prose(50) + " call me at ann.lee@example.org"}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert {200, 201, 203, 204} & set(got) == set() and set(range(120)) | {202, 205} == set(got)
    cut = without(texts[202], {tuple(leak.split()[i : i + 10]) for i in range(3)})
    changed = {**texts, 202: cut}
    for i, pieces in got.items():
        if i != 205:
            assert sum(n for _, n, _ in pieces) == pieces[0][2] == len(ids_of(WORDS, [changed[i]])[0]) + 1
