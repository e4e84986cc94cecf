"""Retrieval measured against gold: documents, pages, sources, topics and words, and hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TOKENS_SQL, load, r6, tokens
from .hybrid import _pool_sql, sparse_pool
from .inverted import text_index
from .positions import PHRASE_SQL, phrase_positions

#: Hits that are judged, and those whose words count.
DEPTH, READ = 10, 5
#: Documents to a page.
PAGE = 10


def scored(gold: DataFrame, hits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per question of ``gold`` (question_id, doc_id, page, source, topic): how ``hits`` (the same and rank) meet it.

    ``rank`` is that of the first gold document, null if none is among
    ``depth``; ``any_doc`` and ``all_docs`` say whether some or all of them are;
    ``page_recall`` is the share of gold pages that were hit and
    ``boundary_error`` whether only a page beside a gold one was.  A question
    without hits has zeros; one without gold isn't judged.
    """
    near = hits.where(F.col("rank") <= depth)
    docs = gold.select("question_id", "doc_id").distinct().join(near.groupBy("question_id", "doc_id").agg(F.min("rank").alias("rank")), ["question_id", "doc_id"], "left")
    by_doc = docs.groupBy("question_id").agg(F.min("rank").alias("rank"), F.count("rank").alias("found"), F.count(F.lit(1)).alias("wanted"))

    def met(column: str, shift: int = 0) -> DataFrame:
        """question_id, hit (how many values of the column were met), of (how many there are)."""
        want = gold.where(F.col(column).isNotNull()).select("question_id", F.col(column).alias("v")).distinct()
        got = near.where(F.col(column).isNotNull()).select("question_id", (F.explode(F.array(F.col(column) - 1, F.col(column) + 1)) if shift else F.col(column)).alias("v"), F.lit(1).alias("hit")).distinct()
        return want.join(got, ["question_id", "v"], "left").groupBy("question_id").agg(F.count("hit").alias(f"{column}_hit{shift}"), F.count(F.lit(1)).alias(f"{column}_of{shift}"))

    out = by_doc
    for part in (met("page"), met("page", 1), met("source"), met("topic")):
        out = out.join(part, "question_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "question_id", "wanted", "found", F.col("rank").cast("long").alias("rank"), (F.col("found") > 0).alias("any_doc"), (F.col("found") == F.col("wanted")).alias("all_docs"), r6(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("reciprocal"),
        (zero("page_hit0") > 0).alias("page_hit"), r6(F.coalesce(F.col("page_hit0") / F.col("page_of0"), F.lit(0.0))).alias("page_recall"), ((zero("page_hit0") == 0) & (zero("page_hit1") > 0)).alias("boundary_error"),
        (zero("source_hit0") > 0).alias("source_hit"), (zero("topic_hit0") > 0).alias("topic_hit"),
    )


def word_coverage(words: DataFrame, held: DataFrame) -> DataFrame:
    """question_id, coverage: the share of a question's words (question_id, term) that some document read for it has (held: the same)."""
    got = words.select("question_id", "term").distinct().join(held.select("question_id", "term", F.lit(1).alias("hit")).distinct(), ["question_id", "term"], "left")
    return got.groupBy("question_id").agg(r6(F.count("hit") / F.count(F.lit(1))).alias("coverage"))


def negative_ranks(negatives: DataFrame, hits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """question_id, n_negative, worst: hard negatives (question_id, doc_id) among the hits, and the rank of the first."""
    met = negatives.select("question_id", "doc_id").distinct().join(hits.where(F.col("rank") <= depth), ["question_id", "doc_id"])
    return met.groupBy("question_id").agg(F.countDistinct("doc_id").alias("n_negative"), F.min("rank").cast("long").alias("worst"))


def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's ten hits for each benchmark item that stands in documents, against these; documents labelled toxic are hard negatives."""
    place = lambda d: d.select("doc_id", F.expr(f"doc_id div {PAGE}").alias("page"), "source", F.col("lang").alias("topic"))
    docs, index = load(spark, sf_dir, "documents"), text_index(spark, sf_dir)
    gold = phrase_positions(spark, sf_dir).select(F.col("item_id").alias("question_id"), "doc_id").join(place(docs), "doc_id")
    hits = sparse_pool(spark, sf_dir, DEPTH).select(F.col("item_id").alias("question_id"), "doc_id", "rank").join(place(docs), "doc_id")
    words = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    held = index.postings(words).join(hits.where(F.col("rank") <= READ).select("question_id", "doc_id"), "doc_id")
    toxic = load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    negatives = hits.select("question_id", "doc_id").join(toxic, "doc_id", "left_semi")
    out = scored(gold, hits).join(word_coverage(words, held), "question_id").join(negative_ranks(negatives, hits), "question_id", "left")
    return out.withColumn("n_negative", F.coalesce("n_negative", F.lit(0)))


SCORES_SQL = f"""WITH {_pool_sql(DEPTH)}, g AS (SELECT DISTINCT item_id, doc_id, doc_id // {PAGE} AS page, source, lang AS topic FROM (SELECT item_id, doc_id FROM ({PHRASE_SQL})) JOIN documents USING (doc_id)),
h AS (SELECT item_id, doc_id, rank, doc_id // {PAGE} AS page, source, lang AS topic FROM p),
d AS (SELECT g.item_id, min(rank) AS rank, count(rank) AS found, count(*) AS wanted FROM g LEFT JOIN h ON h.item_id = g.item_id AND h.doc_id = g.doc_id GROUP BY 1),
pa AS (SELECT item_id, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.item_id = x.item_id AND h.page = x.page)) AS hit, count(*) AS "of", count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.item_id = x.item_id AND abs(h.page - x.page) = 1)) AS beside FROM (SELECT DISTINCT item_id, page FROM g) x GROUP BY 1),
so AS (SELECT item_id, bool_or(EXISTS (SELECT 1 FROM h WHERE h.item_id = g.item_id AND h.source = g.source)) AS s, bool_or(EXISTS (SELECT 1 FROM h WHERE h.item_id = g.item_id AND h.topic = g.topic)) AS t FROM g GROUP BY 1),
w AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark),
c AS (SELECT item_id, round(count(*) FILTER (EXISTS (SELECT 1 FROM h JOIN tf ON tf.doc_id = h.doc_id WHERE h.item_id = w.item_id AND h.rank <= {READ} AND tf.term = w.term))::DOUBLE / count(*), 6) AS coverage FROM w GROUP BY 1),
ne AS (SELECT item_id, count(DISTINCT doc_id) AS n_negative, min(rank) AS worst FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1)
SELECT d.item_id AS question_id, wanted, found, rank, found > 0 AS any_doc, found = wanted AS all_docs, round(coalesce(1::DOUBLE / rank, 0), 6) AS reciprocal, hit > 0 AS page_hit, round(hit::DOUBLE / "of", 6) AS page_recall, hit = 0 AND beside > 0 AS boundary_error,
  coalesce(s, false) AS source_hit, coalesce(t, false) AS topic_hit, coverage, coalesce(n_negative, 0) AS n_negative, worst FROM d JOIN pa USING (item_id) JOIN so USING (item_id) JOIN c USING (item_id) LEFT JOIN ne USING (item_id)"""

QUERIES = {"retrieval_scores": retrieval_scores}
ORACLES = {"retrieval_scores": SCORES_SQL}
