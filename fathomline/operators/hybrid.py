"""Fused dense and sparse retrieval, source rules, and selection from a pool.

Benchmark item ``i`` is asked with vector ``20 * i``; documents and vectors
share their ids.  Everything is ranked per item over a bounded pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import TOKENS_SQL, load, r6, tokens
from .inverted import okapi, text_index
from .scratch import written
from .texts import OKAPI, top_ranked
from .vectors import _lane_sql, lane

POOL, PROTECTED, UNION = 80, 24, 120
#: Boosts by the rank of a hit's source among the routed ones.
ROUTE_BOOSTS = [0.20, 0.13, 0.08, 0.04, 0.02, 0.01]


def _n(w) -> Column:
    return F.row_number().over(w).cast("long")


def sparse_pool(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    """item_id, doc_id, score, rank, source, lang: each item's best documents by BM25."""
    docs = load(spark, sf_dir, "documents")
    # written, the pool is known to be small: joins with whole documents needn't shuffle these
    top = written(top_ranked(okapi(text_index(spark, sf_dir), load(spark, sf_dir, "benchmark")), "item_id", "doc_id", depth))
    return written(top.join(docs.select("doc_id", "source", "lang"), "doc_id"))


def _pool_sql(depth: int) -> str:
    return f"{OKAPI}, p AS (SELECT item_id, doc_id, score, rank, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {depth}) JOIN documents USING (doc_id))"


def both_lanes(spark: SparkSession, sf_dir: str, depth: int = POOL) -> DataFrame:
    """Full outer join of the dense and the sparse lane: item_id, doc_id, dense_rank, sparse_rank, rrf."""
    items = load(spark, sf_dir, "benchmark").select("item_id")
    dense = lane(spark, sf_dir, depth=depth, asked=items.select((F.col("item_id") * 20).alias("vec_id"))).select((F.col("query_id") / 20).cast("long").alias("item_id"), F.col("vec_id").alias("doc_id"), F.col("rank").alias("dense_rank"))
    sparse = sparse_pool(spark, sf_dir, depth).select("item_id", "doc_id", F.col("rank").alias("sparse_rank"))
    met = dense.join(sparse, ["item_id", "doc_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (60 + F.col(r)), F.lit(0.0))
    return met.withColumn("rrf", F.round(part("dense_rank") + part("sparse_rank"), 8))


BOTH = f"""{_pool_sql(POOL)}, {_lane_sql("d", None, POOL)}, b AS (SELECT coalesce(d.item_id, s.item_id) AS item_id, coalesce(d.doc_id, s.doc_id) AS doc_id, dense_rank, sparse_rank,
  round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 8) AS rrf
  FROM (SELECT query_id // 20 AS item_id, vec_id AS doc_id, rank AS dense_rank FROM d WHERE query_id // 20 IN (SELECT item_id FROM benchmark)) d
  FULL JOIN (SELECT item_id, doc_id, rank AS sparse_rank FROM p) s ON d.item_id = s.item_id AND d.doc_id = s.doc_id)"""


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected union: the first 24 dense hits keep their places, then the best 80 by reciprocal ranks, then the other dense hits; 120 in all."""
    fused = Window.partitionBy("item_id").orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    b = both_lanes(spark, sf_dir).withColumn("fused_rank", _n(fused))
    place = F.when(F.col("dense_rank") <= PROTECTED, 0).when(F.col("fused_rank") <= POOL, 1).when(F.col("dense_rank").isNotNull(), 2).cast("long")
    b = b.withColumn("lane", place).where("lane IS NOT NULL")
    w = Window.partitionBy("item_id").orderBy("lane", F.when(F.col("lane") == 1, F.col("fused_rank")).otherwise(F.col("dense_rank")))
    return b.withColumn("place", _n(w)).where(F.col("place") <= UNION).select("item_id", "doc_id", "dense_rank", "sparse_rank", "rrf", "lane", "place")


HYBRID_SQL = f"""WITH {BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS fused_rank FROM b),
l AS (SELECT *, CASE WHEN dense_rank <= {PROTECTED} THEN 0 WHEN fused_rank <= {POOL} THEN 1 WHEN dense_rank IS NOT NULL THEN 2 END::BIGINT AS lane FROM r)
SELECT item_id, doc_id, dense_rank, sparse_rank, rrf, lane, row_number() OVER (PARTITION BY item_id ORDER BY lane, CASE WHEN lane = 1 THEN fused_rank ELSE dense_rank END) AS place FROM l WHERE lane IS NOT NULL QUALIFY place <= {UNION}"""


def rule_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks, a boost for what both lanes have, and the priority of the item's own source; 30 of each item."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    own = F.concat(F.lit("src"), F.col("item_id") % 20)
    priority = F.when(F.col("source") == own, 0.25).when(F.col("source").contains(own), 0.18).when(F.col("source").rlike("^src[0-9]+$"), -0.2).otherwise(0.0)
    boost = F.when(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull(), 0.05).otherwise(0.0)
    s = both_lanes(spark, sf_dir).join(docs, "doc_id", "left").withColumn("final", F.round(F.col("rrf") + boost + F.coalesce(priority, F.lit(0.0)), 8))
    return s.withColumn("place", _n(Window.partitionBy("item_id").orderBy(F.desc("final"), "doc_id"))).where("place <= 30").select("item_id", "doc_id", "source", "final", "place")


RULE_SQL = f"""WITH {BOTH}, s AS (SELECT item_id, b.doc_id, source, round(rrf + CASE WHEN dense_rank IS NOT NULL AND sparse_rank IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END
  + CASE WHEN source = 'src' || (item_id % 20) THEN 0.25::DOUBLE WHEN contains(source, 'src' || (item_id % 20)) THEN 0.18::DOUBLE WHEN regexp_matches(source, '^src[0-9]+$') THEN -0.2::DOUBLE ELSE 0 END, 8) AS final FROM b LEFT JOIN documents USING (doc_id))
SELECT item_id, doc_id, source, final, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS place FROM s QUALIFY place <= 30"""


def _constraints(items: DataFrame) -> DataFrame:
    """item_id, society, allowed, excluded: item ``i`` asks for source ``i % 20``, allows none (any) or four, and denies one."""
    src = lambda c: F.concat(F.lit("src"), c % 20)
    i = F.col("item_id")
    allowed = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(src(i), src(i + 1), src(i + 2), F.lit("SRC0")))
    return items.select("item_id", src(i).alias("society"), allowed.alias("allowed"), F.array(src(i + 1), F.upper(src(i + 7))).alias("excluded"))


def source_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool rows under four rules: a hard source that never falls back, a soft one that does below three hits, and lists where deny wins and an empty allow means all."""
    p = sparse_pool(spark, sf_dir, 40).join(_constraints(load(spark, sf_dir, "benchmark")), "item_id")
    up = F.upper(F.coalesce("source", F.lit("")))
    upper = lambda c: F.transform(c, lambda x: F.upper(x))
    hard = up == F.upper("society")
    fits = F.count(F.when(hard, 1)).over(Window.partitionBy("item_id"))
    allow = (F.size("allowed") == 0) | F.array_contains(upper("allowed"), up)
    return p.select("item_id", "doc_id", "source", "rank", hard.alias("hard"), (hard | (fits < 3)).alias("soft"), (allow & ~F.array_contains(upper("excluded"), up)).alias("constrained"))


CONSTRAINT_SQL = f"""WITH {_pool_sql(40)}, k AS (SELECT *, upper(coalesce(source, '')) AS u, 'SRC' || (item_id % 20) AS own FROM p)
SELECT item_id, doc_id, source, rank, u = own AS hard, u = own OR count(*) FILTER (u = own) OVER (PARTITION BY item_id) < 3 AS soft,
  (item_id % 3 = 0 OR u IN (own, 'SRC' || ((item_id + 1) % 20), 'SRC' || ((item_id + 2) % 20), 'SRC0')) AND u NOT IN ('SRC' || ((item_id + 1) % 20), 'SRC' || ((item_id + 7) % 20)) AS constrained FROM k"""


def exact_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold any three consecutive words of an item literally: 1.8 in the heading (first line), 1.0 elsewhere; at most twelve for each item."""

    def windows(df: DataFrame, key: str, text: Column) -> DataFrame:
        words = df.select(key, tokens(text).alias("w")).where(F.size("w") > 2)
        last = F.size("w") - 2
        return words.select(key, F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("literal"))

    docs = load(spark, sf_dir, "documents")
    # written, its size is known: the windows of documents needn't be shuffled, and only those that are met are told apart
    wanted = written(windows(load(spark, sf_dir, "benchmark"), "item_id", F.col("text")).distinct())
    anywhere = windows(docs, "doc_id", F.col("text")).join(wanted, "literal").select("item_id", "doc_id", F.lit(1.0).alias("score"))
    heading = windows(docs, "doc_id", F.get(F.split("text", "\n"), F.lit(0))).join(wanted, "literal").select("item_id", "doc_id", F.lit(1.8).alias("score"))
    best = anywhere.union(heading).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best.select("item_id", "doc_id", "score", F.when(F.col("score") > 1, 0.08).otherwise(0.22).alias("distance"), _n(w).alias("place")).where("place <= 12")


_W3 = "unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])"
LITERAL_SQL = f"""WITH q AS (SELECT DISTINCT item_id, {_W3} AS literal FROM (SELECT item_id, {TOKENS_SQL} AS w FROM benchmark) WHERE len(w) > 2),
a AS (SELECT doc_id, {_W3} AS literal, 1.0::DOUBLE AS score FROM (SELECT doc_id, {TOKENS_SQL} AS w FROM documents) WHERE len(w) > 2),
h AS (SELECT doc_id, {_W3} AS literal, 1.8::DOUBLE AS score FROM (SELECT doc_id, {TOKENS_SQL.replace("coalesce(text, '')", "coalesce(split_part(text, chr(10), 1), '')")} AS w FROM documents) WHERE len(w) > 2),
s AS (SELECT item_id, doc_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM h) JOIN q USING (literal) GROUP BY 1, 2)
SELECT item_id, doc_id, score, CASE WHEN score > 1 THEN 0.08::DOUBLE ELSE 0.22::DOUBLE END AS distance, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s QUALIFY place <= 12"""


def final_text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance less a boost for the place of a hit's source among the routed ones, an exact literal and the share of the best score; two of a source at most."""
    p = sparse_pool(spark, sf_dir, 40).join(exact_literals(spark, sf_dir).select("item_id", "doc_id", F.col("score").alias("literal")), ["item_id", "doc_id"], "left")
    item = Window.partitionBy("item_id")
    p = p.withColumn("first", F.min("rank").over(Window.partitionBy("item_id", "source"))).withColumn("route", F.dense_rank().over(item.orderBy("first")))
    boost = F.coalesce(F.get(F.array(*map(F.lit, ROUTE_BOOSTS)), F.col("route") - 1), F.lit(0.0))
    ratio = F.col("score") / F.max("score").over(item)
    final = 1 - F.col("score") / (10 + F.col("score")) - boost - F.least(F.lit(0.9), 0.38 * F.coalesce("literal", F.lit(0.0))) - 0.32 * ratio
    s = p.select("item_id", "doc_id", "source", F.col("route").cast("long").alias("route"), r6(final).alias("distance"))
    s = s.withColumn("nth", _n(Window.partitionBy("item_id", "source").orderBy("distance", "doc_id"))).where("nth <= 2")
    return s.withColumn("place", _n(item.orderBy("distance", "doc_id"))).where("place <= 18")


FINAL_SQL = f"""WITH {_pool_sql(40)}, li AS ({LITERAL_SQL}), f AS (SELECT p.*, li.score AS literal, min(p.rank) OVER (PARTITION BY p.item_id, source) AS first FROM p LEFT JOIN li ON li.item_id = p.item_id AND li.doc_id = p.doc_id),
g AS (SELECT *, dense_rank() OVER (PARTITION BY item_id ORDER BY first) AS route FROM f),
s AS (SELECT item_id, doc_id, source, route, round(1 - score / (10 + score) - CASE route {" ".join(f"WHEN {i} THEN {b}::DOUBLE" for i, b in enumerate(ROUTE_BOOSTS, 1))} ELSE 0 END - least(0.9::DOUBLE, 0.38::DOUBLE * coalesce(literal, 0)) - 0.32::DOUBLE * score / max(score) OVER (PARTITION BY item_id), 6) AS distance FROM g),
nt AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY distance, doc_id) AS nth FROM s QUALIFY nth <= 2)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS place FROM nt QUALIFY place <= 18"""

SLOTS = ["de", "en", "es", "fr"]


def slot_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's slots (languages) with their two best hits of the pool; a slot without a hit has one row that says so."""
    items = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*map(F.lit, SLOTS))).alias("slot"))
    hits = sparse_pool(spark, sf_dir, 40).withColumn("nth", _n(Window.partitionBy("item_id", "lang").orderBy("rank"))).where("nth <= 2")
    met = items.join(hits.select("item_id", F.col("lang").alias("slot"), "nth", "doc_id", "score"), ["item_id", "slot"], "left")
    return met.select("item_id", "slot", "nth", "doc_id", "score", F.col("doc_id").isNull().alias("missing"))


SLOT_SQL = f"""WITH {_pool_sql(40)}, i AS (SELECT item_id, unnest({SLOTS}) AS slot FROM benchmark), h AS (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY rank) AS nth FROM p QUALIFY nth <= 2)
SELECT i.item_id, slot, nth, doc_id, score, doc_id IS NULL AS missing FROM i LEFT JOIN h ON h.item_id = i.item_id AND lang = slot"""


def reserved_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven best sources get a place each, the first two one more, the first yet another, then the pool's order; twelve in all."""
    item = Window.partitionBy("item_id")
    p = sparse_pool(spark, sf_dir, 40).withColumn("first", F.min("rank").over(Window.partitionBy("item_id", "source")))
    p = p.withColumn("route", F.dense_rank().over(item.orderBy("first"))).withColumn("nth", _n(Window.partitionBy("item_id", "source").orderBy("rank")))
    quota = (F.col("route") <= 7).cast("int") + (F.col("route") <= 2).cast("int") + (F.col("route") <= 1).cast("int")
    p = p.withColumn("reserved", F.col("nth") <= quota)
    return p.withColumn("place", _n(item.orderBy(F.desc("reserved"), "rank"))).where("place <= 12").select("item_id", "doc_id", "source", "reserved", "place")


RESERVED_SQL = f"""WITH {_pool_sql(40)}, f AS (SELECT *, min(rank) OVER (PARTITION BY item_id, source) AS first, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS nth FROM p),
g AS (SELECT *, dense_rank() OVER (PARTITION BY item_id ORDER BY first) AS route FROM f), r AS (SELECT *, nth <= (route <= 7)::INT + (route <= 2)::INT + (route <= 1)::INT AS reserved FROM g)
SELECT item_id, doc_id, source, reserved, row_number() OVER (PARTITION BY item_id ORDER BY reserved DESC, rank) AS place FROM r QUALIFY place <= 12"""


def refine_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an item's first eight hits the thin ones (under 140 characters) go; up to six come back from the pool: full ones of the item's source first, then full ones, then thin ones."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.char_length(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " ")).alias("size"))
    p = sparse_pool(spark, sf_dir, 40).join(docs, "doc_id")
    thin, own = F.col("size") < 140, F.coalesce(F.col("source") == F.concat(F.lit("src"), F.col("item_id") % 20), F.lit(False))
    p = p.withColumn("kept", (F.col("rank") <= 8) & ~thin).withColumn("thin", thin).withColumn("other", ~own)
    n = F.count(F.when(F.col("kept"), 1)).over(Window.partitionBy("item_id"))
    w = Window.partitionBy("item_id").orderBy(F.desc("kept"), F.when(F.col("kept"), F.col("rank")), "thin", "other", "rank")
    return p.withColumn("n", n).withColumn("place", _n(w)).where(F.col("place") <= F.greatest("n", F.lit(6))).select("item_id", "doc_id", "kept", "thin", "place")


REFINE_SQL = rf"""WITH {_pool_sql(40)}, z AS (SELECT p.*, length(regexp_replace(trim(coalesce(text, '')), '\s+', ' ', 'g')) < 140 AS thin, NOT coalesce(p.source = 'src' || (item_id % 20), false) AS other FROM p JOIN documents USING (doc_id)),
k AS (SELECT *, rank <= 8 AND NOT thin AS kept FROM z)
SELECT item_id, doc_id, kept, thin, row_number() OVER (PARTITION BY item_id ORDER BY kept DESC, CASE WHEN kept THEN rank END, thin, other, rank) AS place FROM k QUALIFY place <= greatest(count(*) FILTER (kept) OVER (PARTITION BY item_id), 6)"""

PRIORITY, CAPS = ["fr", "de"], {"en": 3}


def topic_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight hits of each item: the best of each topic (language), the named topics first, then the pool's order; English at most three times."""
    item = Window.partitionBy("item_id")
    p = sparse_pool(spark, sf_dir, 40).withColumn("topic", F.coalesce("lang", F.lit("none"))).withColumn("nth", _n(Window.partitionBy("item_id", "topic").orderBy("rank")))
    cap = F.coalesce(*[F.when(F.col("topic") == t, F.lit(n)) for t, n in CAPS.items()], F.lit(999))
    named = F.coalesce(*[F.when(F.col("topic") == t, F.lit(i)) for i, t in enumerate(PRIORITY)], F.lit(len(PRIORITY)))
    p = p.where(F.col("nth") <= cap).withColumn("best", F.col("nth") == 1)
    w = item.orderBy(F.desc("best"), F.when(F.col("best"), named), "rank")
    return p.withColumn("place", _n(w)).where("place <= 8").select("item_id", "doc_id", "topic", "best", "place")


TOPIC_SQL = f"""WITH {_pool_sql(40)}, tp AS (SELECT *, coalesce(lang, 'none') AS topic, row_number() OVER (PARTITION BY item_id, coalesce(lang, 'none') ORDER BY rank) AS nth FROM p),
b AS (SELECT *, nth = 1 AS best FROM tp WHERE nth <= CASE topic WHEN 'en' THEN 3 ELSE 999 END)
SELECT item_id, doc_id, topic, best, row_number() OVER (PARTITION BY item_id ORDER BY best DESC, CASE WHEN best THEN CASE topic WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END END, rank) AS place FROM b QUALIFY place <= 8"""


def point_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item over its pool of forty: share of its answer points with evidence in it, documents found, and toxic hard negatives.

    Item ``i`` has the good labelled documents of ids ``i`` modulo 40 as
    evidence, those of one language being one point, and the toxic ones as
    hard negatives.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    gold = docs.join(load(spark, sf_dir, "labels"), "doc_id").select((F.col("doc_id") % 40).alias("item_id"), "doc_id", F.coalesce("lang", F.lit("none")).alias("point"), "quality", "toxic")
    gold = gold.join(load(spark, sf_dir, "benchmark").select("item_id"), "item_id", "left_semi")
    met = gold.join(sparse_pool(spark, sf_dir, 40).select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left")
    good, found = F.col("quality") == 1, F.col("rank").isNotNull()
    points = met.where(good).groupBy("item_id", "point").agg(F.bool_or(found).alias("hit"))
    recall = points.groupBy("item_id").agg(r6(F.avg(F.col("hit").cast("double"))).alias("point_recall"))
    whole = met.groupBy("item_id").agg(
        F.bool_or(good & found).alias("doc_any"), F.min(F.when(good, found)).alias("doc_all"), r6(F.avg(F.when(good, found.cast("double")))).alias("doc_recall"),
        F.min(F.when(good, F.col("rank"))).alias("first_gold"), F.count(F.when((F.col("toxic") == 1) & found, 1)).alias("hard_negatives"), F.min(F.when(F.col("toxic") == 1, F.col("rank"))).alias("first_hard_negative"),
    )
    return whole.join(recall, "item_id", "left")


RECALL_SQL = f"""WITH {_pool_sql(40)}, g AS (SELECT doc_id % 40 AS item_id, doc_id, coalesce(lang, 'none') AS point, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE doc_id % 40 IN (SELECT item_id FROM benchmark)),
m AS (SELECT g.*, rank FROM g LEFT JOIN p ON p.item_id = g.item_id AND p.doc_id = g.doc_id),
r AS (SELECT item_id, round(avg(hit::INT), 6) AS point_recall FROM (SELECT item_id, point, bool_or(rank IS NOT NULL) AS hit FROM m WHERE quality = 1 GROUP BY 1, 2) GROUP BY 1)
SELECT m.item_id, bool_or(quality = 1 AND rank IS NOT NULL) AS doc_any, bool_and(rank IS NOT NULL) FILTER (quality = 1) AS doc_all, round(avg((rank IS NOT NULL)::INT) FILTER (quality = 1), 6) AS doc_recall,
  min(rank) FILTER (quality = 1) AS first_gold, count(*) FILTER (toxic = 1 AND rank IS NOT NULL) AS hard_negatives, min(rank) FILTER (toxic = 1) AS first_hard_negative, any_value(point_recall) AS point_recall
FROM m LEFT JOIN r USING (item_id) GROUP BY 1"""

QUERIES = {f.__name__: f for f in (hybrid_fusion, rule_fusion, source_constraints, exact_literals, final_text_rank, slot_completion, reserved_slots, refine_backfill, topic_pick, point_recall)}
ORACLES = {
    "hybrid_fusion": HYBRID_SQL, "rule_fusion": RULE_SQL, "source_constraints": CONSTRAINT_SQL, "exact_literals": LITERAL_SQL, "final_text_rank": FINAL_SQL,
    "slot_completion": SLOT_SQL, "reserved_slots": RESERVED_SQL, "refine_backfill": REFINE_SQL, "topic_pick": TOPIC_SQL, "point_recall": RECALL_SQL,
}
