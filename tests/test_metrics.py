"""Retrieval metrics against plain loops, with nulls, repeats and questions without hits."""

import random

from fathomline.operators import metrics


def test_scores_against_loops(spark):
    draw = random.Random(11)
    some = lambda values: draw.choice([None, *values])
    # a third of all gold rows are one question's
    gold = [(0 if i % 3 == 0 else draw.randrange(1, 9), draw.randrange(30), some(range(8)), some("xyz"), some(["en", "de"])) for i in range(60)]
    gold += [gold[0], (77, 1, 1, "x", "en")]
    hits = [(q, draw.randrange(30), draw.randrange(8), some("xyz"), some(["en", "de"]), rank) for q in range(8) for rank in range(1, 15)]
    shape = "question_id bigint, doc_id bigint, page bigint, source string, topic string"
    got = {r["question_id"]: r for r in metrics.scored(spark.createDataFrame(gold, shape), spark.createDataFrame(hits, f"{shape}, rank bigint")).collect()}
    assert set(got) == {g[0] for g in gold}
    for q, r in got.items():
        own, near = [g for g in gold if g[0] == q], [h for h in hits if h[0] == q and h[5] <= 10]
        docs = {g[1] for g in own}
        ranks = [h[5] for h in near if h[1] in docs]
        found = {h[1] for h in near} & docs
        pages, seen = {g[2] for g in own} - {None}, {h[2] for h in near}
        assert (r["wanted"], r["found"], r["rank"], r["any_doc"], r["all_docs"]) == (len(docs), len(found), min(ranks, default=None), bool(found), found == docs)
        assert r["reciprocal"] == (round(1 / min(ranks), 6) if ranks else 0.0)
        assert (r["page_hit"], r["page_recall"]) == (bool(pages & seen), round(len(pages & seen) / len(pages), 6) if pages else 0.0)
        assert r["boundary_error"] == (not pages & seen and bool(pages & {p + s for p in seen for s in (-1, 1)}))
        assert r["source_hit"] == bool(({g[3] for g in own} & {h[3] for h in near}) - {None})
        assert r["topic_hit"] == bool(({g[4] for g in own} & {h[4] for h in near}) - {None})
    assert got[77]["found"] == 0 and got[77]["rank"] is None


def test_words_and_negatives(spark):
    words = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "a")], "question_id bigint, term string")
    held = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (3, "a")], "question_id bigint, term string")
    assert {tuple(r) for r in metrics.word_coverage(words, held).collect()} == {(1, 0.333333), (2, 0.0)}
    negatives = spark.createDataFrame([(1, 5), (1, 6), (1, 5), (2, 9)], "question_id bigint, doc_id bigint")
    hits = spark.createDataFrame([(1, 5, 3), (1, 6, 2), (1, 7, 1), (2, 9, 11)], "question_id bigint, doc_id bigint, rank bigint")
    assert [tuple(r) for r in metrics.negative_ranks(negatives, hits).collect()] == [(1, 2, 2)]
