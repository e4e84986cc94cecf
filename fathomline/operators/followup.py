"""Follow-up retrieval: a second set of questions that depends on what the first one missed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import TOKENS_SQL, load, tokens
from .inverted import TextIndex, okapi, text_index
from .scratch import written
from .texts import OKAPI, top_ranked

#: Follow-up questions and context documents at most. First hits, and hits of a follow-up.
FACETS, CONTEXT = 4, 8
FIRST, EACH = 5, 3


def missing_facets(index: TextIndex, items: DataFrame, first: DataFrame) -> DataFrame:
    """item_id, nth, facet: the item's words that none of its first hits (item_id, doc_id) has, in their order, ``FACETS`` at most."""
    words = items.select("item_id", F.posexplode(F.array_distinct(tokens(F.col("text")))).alias("at", "term"))
    held = index.postings(words).join(first.select("item_id", "doc_id"), "doc_id").select("item_id", "term").distinct()
    lacking = words.join(held, ["item_id", "term"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("at"))
    return lacking.withColumn("nth", nth).where(F.col("nth") <= FACETS).select("item_id", "nth", F.col("term").alias("facet"))


def follow_up(index: TextIndex, items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, place, doc_id, kind: first hits, follow-up hits in turn, and context.

    Each missing facet is asked in one batch with all others; its best hits
    come in turn with those of the other facets, a document once.  Context are
    the neighbours by id of the same source (docs: doc_id, source) of all
    these, in the order of what they stand beside.
    """
    first = written(top_ranked(okapi(index, items), "item_id", "doc_id", FIRST).select("item_id", "doc_id", F.col("rank").alias("order")))
    facets = written(missing_facets(index, items, first))
    asked = facets.select((F.col("item_id") * FACETS + F.col("nth") - 1).alias("item_id"), F.col("facet").alias("text"))
    hits = top_ranked(okapi(index, asked), "item_id", "doc_id", EACH)
    told = hits.select(F.floor(F.col("item_id") / FACETS).cast("long").alias("item_id"), "doc_id", (F.col("rank") * FACETS + F.pmod("item_id", F.lit(FACETS))).alias("turn"))
    fresh = told.groupBy("item_id", "doc_id").agg(F.min("turn").alias("turn")).join(first, ["item_id", "doc_id"], "left_anti")
    after = fresh.select("item_id", "doc_id", (FIRST + F.row_number().over(Window.partitionBy("item_id").orderBy("turn"))).cast("long").alias("order"), F.lit("follow").alias("kind"))
    main = written(first.withColumn("kind", F.lit("first")).unionByName(after))
    known = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    sides = main.join(known, "doc_id").select("item_id", "source", "order", F.explode(F.array(F.struct((F.col("doc_id") - 1).alias("doc_id"), F.lit(0).alias("side")), F.struct((F.col("doc_id") + 1).alias("doc_id"), F.lit(1).alias("side")))).alias("x"))
    beside = sides.select("item_id", "source", "order", "x.*").join(known, ["doc_id", "source"]).groupBy("item_id", "doc_id").agg(F.min(F.struct("order", "side")).alias("by")).join(main, ["item_id", "doc_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("by", "doc_id"))
    context = beside.withColumn("nth", nth).where(F.col("nth") <= CONTEXT).select("item_id", "doc_id", (F.lit(1000) + F.col("nth")).cast("long").alias("order"), F.lit("context").alias("kind"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("order")).cast("long")
    return main.unionByName(context).select("item_id", place.alias("place"), "doc_id", "kind")


def followup_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits, follow-ups on missing words and context for every benchmark item."""
    return follow_up(text_index(spark, sf_dir), load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents"))


FOLLOW_SQL = f"""WITH {OKAPI}, fi AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS "order" FROM sc QUALIFY "order" <= {FIRST}),
wo AS (SELECT item_id, term, min(pos) AS pos FROM (SELECT item_id, unnest({TOKENS_SQL}) AS term, unnest(range(0, len({TOKENS_SQL}))) AS pos FROM benchmark) GROUP BY 1, 2),
fa AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS nth FROM wo WHERE NOT EXISTS (SELECT 1 FROM fi JOIN tf ON tf.doc_id = fi.doc_id WHERE fi.item_id = wo.item_id AND tf.term = wo.term) QUALIFY nth <= {FACETS}),
fs AS (SELECT item_id, nth, tf.doc_id, round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)), 6) AS score FROM fa JOIN tf ON tf.term = fa.term JOIN idf ON idf.term = fa.term JOIN dl ON dl.doc_id = tf.doc_id, n WHERE score > 0),
fh AS (SELECT item_id, nth, doc_id, row_number() OVER (PARTITION BY item_id, nth ORDER BY score DESC, doc_id) AS rank FROM fs QUALIFY rank <= {EACH}),
fr AS (SELECT item_id, doc_id, min(rank * {FACETS} + nth - 1) AS turn FROM fh WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.item_id = fh.item_id AND fi.doc_id = fh.doc_id) GROUP BY 1, 2),
ma AS (SELECT item_id, doc_id, "order", 'first' AS kind FROM fi UNION ALL SELECT item_id, doc_id, {FIRST} + row_number() OVER (PARTITION BY item_id ORDER BY turn), 'follow' FROM fr),
be AS (SELECT item_id, b.doc_id, min("order" * 2 + CASE WHEN b.doc_id > a.doc_id THEN 1 ELSE 0 END) AS beside FROM ma JOIN documents a ON a.doc_id = ma.doc_id JOIN documents b ON b.doc_id IN (a.doc_id - 1, a.doc_id + 1) AND coalesce(b.source, '') = coalesce(a.source, '')
  WHERE NOT EXISTS (SELECT 1 FROM ma m WHERE m.item_id = ma.item_id AND m.doc_id = b.doc_id) GROUP BY 1, 2),
al AS (SELECT * FROM ma UNION ALL SELECT item_id, doc_id, 1000 + row_number() OVER (PARTITION BY item_id ORDER BY beside, doc_id) AS o, 'context' FROM be QUALIFY o <= 1000 + {CONTEXT})
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY "order") AS place, doc_id, kind FROM al"""

QUERIES = {"followup_retrieval": followup_retrieval}
ORACLES = {"followup_retrieval": FOLLOW_SQL}
