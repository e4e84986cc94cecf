"""What text queries shuffle: asked postings by document, not pairs of items and documents, and no whole documents."""

from oracle import SF

from fathomline import registry
from fathomline.model import load
from fathomline.operators import inverted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_summed_where_a_document_is(spark):
    text = plan(inverted.okapi(inverted.text_index(spark, SF), load(spark, SF, "benchmark")))
    assert "hashpartitioning(doc_id" in text and "hashpartitioning(item_id" not in text


def test_words_are_counted_in_their_row(spark):
    rows = [(1, "b a b é a-b aa"), (2, ""), (3, None), (4, "zz"), (5, "zz yy zz")]
    got = inverted.posting_rows(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert "Exchange" not in plan(got)
    assert {tuple(r) for r in got.select("term", "doc_id", "len", "tf").collect()} == {("aa", 1, 1, 1), ("zz", 4, 1, 1), ("yy", 5, 3, 1), ("zz", 5, 3, 2)}


def test_documents_are_not_shuffled_for_a_few_hits(spark):
    for name in ("tier_boosts", "retrieval_confidence", "exact_literals"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert "hashpartitioning(doc_id" not in text and "hashpartitioning(literal" not in text, name


def test_words_of_documents_are_not_shuffled_for_phrases(spark):
    text = plan(registry.QUERIES["phrase_positions"](spark, SF))
    assert "Window" not in text and "hashpartitioning(doc_id" not in text
