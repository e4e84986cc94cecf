"""Merges, fallbacks, exports, nearest joins, confidences and small renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import DEFAULT_DWT, SENSOR_SQL, load, r6, sensor, tokens
from .evidence import CUE_SQL, cue_scores
from .layout import boxes
from .inverted import okapi, text_index
from .scratch import written
from .texts import OKAPI, top_ranked


def dimension_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessels with the deadweight of their record, where that is positive, else the configured one; those only one side has stay."""
    have = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vessel"), F.col("c_acctbal").alias("dwt"))
    seen = sensor(spark, sf_dir).select("vessel").distinct().withColumn("in_log", F.lit(True))
    both = have.join(seen, "vessel", "full_outer")
    good = F.col("dwt") > 0
    return both.select("vessel", F.when(good, F.col("dwt")).otherwise(DEFAULT_DWT).alias("dwt"), F.when(good, "record").otherwise("config").alias("origin"), F.coalesce("in_log", F.lit(False)).alias("in_log"))


DIMENSION_SQL = f"""SELECT coalesce(c_custkey, vessel) AS vessel, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE {DEFAULT_DWT}::DOUBLE END AS dwt, CASE WHEN c_acctbal > 0 THEN 'record' ELSE 'config' END AS origin, vessel IS NOT NULL AS in_log
FROM customer FULL JOIN (SELECT DISTINCT vessel FROM ({SENSOR_SQL})) ON c_custkey = vessel"""


def sensor_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of the log: its last 5000 rows (the sheet's size) and one summary row."""
    log = sensor(spark, sf_dir).select("vessel", "ts", "event_id", "sog")
    last = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).withColumn("sheet", F.lit("rows"))
    total = log.agg(F.count(F.lit(1)).alias("vessel"), F.max("ts").alias("ts"), F.max("event_id").alias("event_id"), r6(F.avg("sog")).alias("sog")).withColumn("sheet", F.lit("summary"))
    return last.unionByName(total)


EXPORT_SQL = f"""(SELECT vessel, ts, event_id, sog, 'rows' AS sheet FROM ({SENSOR_SQL}) ORDER BY ts DESC, event_id DESC LIMIT 5000)
UNION ALL SELECT count(*), max(ts), max(event_id), round(avg(sog), 6), 'summary' FROM ({SENSOR_SQL})"""


def condition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last urgent order; its last order of any kind where none is urgent."""
    o = load(spark, sf_dir, "orders").withColumn("fits", F.lower("o_orderpriority").contains("urgent"))
    best = o.groupBy("o_custkey").agg(F.max(F.struct("fits", "o_orderdate", "o_orderkey")).alias("r"))
    return best.select("o_custkey", "r.fits", "r.o_orderdate", "r.o_orderkey")


CONDITION_SQL = "SELECT o_custkey, contains(lower(o_orderpriority), 'urgent') AS fits, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY fits DESC, o_orderdate DESC, o_orderkey DESC) = 1"

TOP20 = "tops AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20)"


def _top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    top = written(top_ranked(okapi(text_index(spark, sf_dir), load(spark, sf_dir, "benchmark")), "item_id", "doc_id", 20)).join(docs.select("doc_id", "source", "lang"), "doc_id")
    return written(top)


def soft_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's hits in English where there are three or more, else all of them with a warning."""
    w = Window.partitionBy("item_id")
    t = _top20(spark, sf_dir).withColumn("fits", F.col("lang") == "en").withColumn("n", F.count(F.when(F.col("fits"), 1)).over(w))
    return t.where(F.col("fits") | (F.col("n") < 3)).select("item_id", "doc_id", "lang", "rank", (F.col("n") < 3).alias("warning"))


SOFT_SQL = f"""WITH {OKAPI}, {TOP20}, f AS (SELECT item_id, doc_id, lang, rank, count(*) FILTER (lang = 'en') OVER (PARTITION BY item_id) AS n FROM tops JOIN documents USING (doc_id))
SELECT item_id, doc_id, lang, rank, n < 3 AS warning FROM f WHERE lang = 'en' OR n < 3"""


def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a retrieval is, from its hits, their sources and what words of the item none of them has."""
    t = _top20(spark, sf_dir)
    terms = load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    texts = t.select("item_id", "doc_id").join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    met = texts.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    missing = terms.join(met, ["item_id", "term"], "left_anti").groupBy("item_id").agg(F.count(F.lit(1)).alias("missing"))
    g = t.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("k")).join(missing, "item_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))
    raw = 0.25 + F.least(F.lit(0.35), 0.035 * F.col("n")) + F.least(F.lit(0.15), 0.03 * F.col("k")) - F.least(F.lit(0.45), 0.15 * F.col("missing"))
    score = r6(F.greatest(F.lit(0.0), F.when(F.col("missing") > 0, F.least(F.lit(0.69), raw)).otherwise(raw)))
    return g.select("item_id", "n", "k", "missing", score.alias("score")).withColumn("level", F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.5, "medium").otherwise("low"))


_T = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) > 1)"
CONFIDENCE_SQL = f"""WITH {OKAPI}, {TOP20}, te AS (SELECT DISTINCT item_id, unnest({_T}) AS term FROM benchmark), wo AS (SELECT DISTINCT doc_id, unnest({_T}) AS term FROM documents),
me AS (SELECT DISTINCT item_id, term FROM tops JOIN wo USING (doc_id)), mi AS (SELECT item_id, count(*) AS missing FROM te WHERE NOT EXISTS (SELECT 1 FROM me WHERE me.item_id = te.item_id AND me.term = te.term) GROUP BY 1),
g AS (SELECT item_id, count(*) AS n, count(DISTINCT source) AS k FROM tops JOIN documents USING (doc_id) GROUP BY 1),
r AS (SELECT item_id, n, k, coalesce(missing, 0) AS missing, 0.25::DOUBLE + least(0.35::DOUBLE, 0.035::DOUBLE * n) + least(0.15::DOUBLE, 0.03::DOUBLE * k) - least(0.45::DOUBLE, 0.15::DOUBLE * coalesce(missing, 0)) AS raw FROM g LEFT JOIN mi USING (item_id)),
s AS (SELECT item_id, n, k, missing, round(greatest(0::DOUBLE, CASE WHEN missing > 0 THEN least(0.69::DOUBLE, raw) ELSE raw END), 6) AS score FROM r)
SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM s"""


def caption_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure (each fifth key) with the nearest caption below it on its page that overlaps it sideways."""
    b = boxes(load(spark, sf_dir, "part"))
    fig, cap = b.where("block % 5 = 0"), b.where("block % 5 = 1").select("page", F.col("block").alias("caption"), F.col("x0").alias("c0"), F.col("x1").alias("c1"), F.col("y0").alias("top"))
    met = fig.join(cap, "page").withColumn("gap", F.col("top") - F.col("y1")).where("gap >= 0 AND gap <= 400 AND least(x1, c1) > greatest(x0, c0)")
    return met.groupBy("page", "block").agg(F.min(F.struct("gap", "caption")).alias("r")).select("page", "block", "r.gap", "r.caption")


CAPTION_SQL = """WITH b AS (SELECT p_partkey // 100 AS page, p_partkey AS block, (p_partkey % 3 * 200)::DOUBLE AS x0, (p_partkey % 3 * 200 + 150)::DOUBLE AS x1, (p_partkey % 97 * 10)::DOUBLE AS y0, (p_partkey % 97 * 10 + 8)::DOUBLE AS y1 FROM part)
SELECT f.page, f.block, c.y0 - f.y1 AS gap, c.block AS caption FROM b f JOIN b c ON f.page = c.page AND f.block % 5 = 0 AND c.block % 5 = 1 AND c.y0 - f.y1 BETWEEN 0 AND 400 AND least(f.x1, c.x1) > greatest(f.x0, c.x0)
QUALIFY row_number() OVER (PARTITION BY f.block ORDER BY gap, caption) = 1"""


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the value of the user's last purchase up to it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.last(bought, ignorenulls=True).over(w).alias("last_purchase"))


FILL_SQL = "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events"


def emission_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission, work, intensity and allowance costs per order, quantities being tonnes of fuel."""
    li = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("fuel_t"), F.count(F.lit(1)).alias("legs"))
    co2 = F.col("fuel_t") * 3.114
    return li.select("l_orderkey", r6(co2).alias("co2_t"), (F.col("legs") * 1000.0 * 81200.0).alias("work"), r6(co2 * 1e6 / (F.col("legs") * 1000.0 * 81200.0)).alias("cii"), r6(co2 * 0.7).alias("covered_t"), r6(co2 * 0.7 * 80.0).alias("cost_eur"))


EMISSION_SQL = """SELECT l_orderkey, round(f * 3.114::DOUBLE, 6) AS co2_t, n * 1000.0::DOUBLE * 81200.0::DOUBLE AS work, round(f * 3.114::DOUBLE * 1e6::DOUBLE / (n * 1000.0::DOUBLE * 81200.0::DOUBLE), 6) AS cii,
  round(f * 3.114::DOUBLE * 0.7::DOUBLE, 6) AS covered_t, round(f * 3.114::DOUBLE * 0.7::DOUBLE * 80.0::DOUBLE, 6) AS cost_eur FROM (SELECT l_orderkey, sum(l_quantity) AS f, count(*) AS n FROM lineitem GROUP BY 1)"""

ROUTES = ["ambiguous", "chat", "hybrid", "ops", "rag"]


def route_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the turns by who spoke, as a matrix."""
    r = cue_scores(spark, sf_dir).join(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return r.groupBy("role").pivot("route", ROUTES).agg(F.count(F.lit(1))).na.fill(0)


CONFUSION_SQL = "SELECT role, " + ", ".join(f"count(*) FILTER (route = '{x}') AS {x}" for x in ROUTES) + f" FROM ({CUE_SQL}) JOIN conversations USING (conv_id, turn) GROUP BY 1"


def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the 24 best sentences (the list's size) of 25 letters and more, each text once."""
    s = load(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split(F.coalesce("text", F.lit("")), "[.!?\n]")).alias("claim")).withColumn("claim", F.trim("claim")).where(F.length("claim") >= 25)
    score = F.regexp_count(F.lower("claim"), F.lit("tion|ment|ung")) + F.when(F.col("claim").rlike("[0-9]"), 2).otherwise(0)
    once = s.groupBy("source", "claim").agg(F.min("doc_id").alias("doc_id")).withColumn("score", score.cast("long"))
    w = Window.partitionBy("source").orderBy(F.desc("score"), F.md5("claim"))
    return once.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 24").select("source", "rank", "doc_id", "score", F.md5("claim").alias("claim_md5"))


CANDIDATE_SQL = """WITH s AS (SELECT doc_id, source, trim(unnest(regexp_split_to_array(coalesce(text, ''), '[.!?\n]'))) AS claim FROM documents), o AS (SELECT source, claim, min(doc_id) AS doc_id FROM s WHERE length(claim) >= 25 GROUP BY 1, 2),
r AS (SELECT source, doc_id, md5(claim) AS claim_md5, len(regexp_extract_all(lower(claim), 'tion|ment|ung')) + CASE WHEN regexp_matches(claim, '[0-9]') THEN 2 ELSE 0 END AS score FROM o)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, claim_md5) AS rank, doc_id, score, claim_md5 FROM r QUALIFY rank <= 24"""


def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a markdown table, pipes escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("p_name", "p_brand", "p_type", "p_size")]), F.lit(" |")).alias("line"))


MARKDOWN_SQL = r"SELECT p_partkey, '| ' || concat_ws(' | ', " + ", ".join(rf"replace(coalesce({c}::VARCHAR, ''), '|', '\|')" for c in ("p_name", "p_brand", "p_type", "p_size")) + ") || ' |' AS line FROM part"


def numeric_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers of any length and the word after each, over all documents; the largest as a double, null beyond 38 digits."""
    hits = F.explode(F.regexp_extract_all("text", F.lit("[0-9]+ [a-z]{2,}"), F.lit(0)))
    number = F.expr("cast(try_cast(split_part(hit, ' ', 1) AS decimal(38, 0)) AS double)")
    t = load(spark, sf_dir, "documents").select("doc_id", hits.alias("hit")).select("doc_id", number.alias("number"), F.split_part("hit", F.lit(" "), F.lit(2)).alias("unit"))
    return t.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.max("number").alias("most"))


NUMERIC_SQL = "SELECT split_part(hit, ' ', 2) AS unit, count(*) AS n, count(DISTINCT doc_id) AS n_docs, max(TRY_CAST(split_part(hit, ' ', 1) AS DECIMAL(38, 0))::DOUBLE) AS most FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+ [a-z]{2,}')) AS hit FROM documents) GROUP BY 1"


def bullet_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines (the budget) of every assistant turn, without repeats."""
    c = load(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).where(F.length("line") > 0)
    first = c.groupBy("conv_id", "turn", "line").agg(F.min("i").alias("i"))
    w = Window.partitionBy("conv_id", "turn").orderBy("i")
    return first.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("conv_id", "turn", "place", F.md5("line").alias("line_md5"))


BUDGET_SQL = """WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, turn, line, min(i) AS i FROM l WHERE length(line) > 0 GROUP BY 1, 2, 3) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS place, md5(line) AS line_md5 FROM f QUALIFY place <= 3"""

QUERIES = {f.__name__: f for f in (dimension_sync, sensor_export, condition_lookup, soft_language_filter, retrieval_confidence, caption_nearest, forward_fill, emission_costs, route_confusion, claim_candidates, markdown_rows, numeric_terms, bullet_budget)}
ORACLES = {
    "dimension_sync": DIMENSION_SQL, "sensor_export": EXPORT_SQL, "condition_lookup": CONDITION_SQL, "soft_language_filter": SOFT_SQL, "retrieval_confidence": CONFIDENCE_SQL, "caption_nearest": CAPTION_SQL, "forward_fill": FILL_SQL,
    "emission_costs": EMISSION_SQL, "route_confusion": CONFUSION_SQL, "claim_candidates": CANDIDATE_SQL, "markdown_rows": MARKDOWN_SQL, "numeric_terms": NUMERIC_SQL, "bullet_budget": BUDGET_SQL,
}
