"""Joins that complete hits, boosts and merges of ranked lists, and records of what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import SENSOR_SQL, TOKENS_SQL, ascii_bounds, load, r6, sensor, tokens
from .hybrid import _pool_sql, sparse_pool
from .layout import boxes
from .tables import STAGE2, stage2

#: Other words for a word of the parts' names.
ALIASES = {"widget": ["gadget", "device"], "bolt": ["screw"], "ring": ["washer", "gasket"], "gear": ["cog"]}
#: Terms and what they are called.
TERMS = {"ECONOMY": "economy class", "STANDARD": "standard class", "SMALL": "small class"}


def _n(w) -> Column:
    return F.row_number().over(w).cast("long")


def full_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits of each item with the whole text behind them and the label's score; hits without a label score 0."""
    hits = sparse_pool(spark, sf_dir, 5).select("item_id", "doc_id", "rank")
    texts = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scores = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    met = hits.join(texts, "doc_id").join(scores, "doc_id", "left")
    return met.select("item_id", "doc_id", "rank", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.coalesce("quality", F.lit(0)).cast("long").alias("score"))


FULL_SQL = f"""WITH {_pool_sql(5)}, l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)
SELECT item_id, p.doc_id, rank, length(coalesce(text, '')) AS n_chars, sha256(coalesce(text, '')) AS text_sha256, coalesce(quality, 0)::BIGINT AS score FROM p JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN l ON l.doc_id = p.doc_id"""


def related_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one base (brand and name) as revisions by size: each with the one before it and how many there are."""
    base = Window.partitionBy("p_brand", "p_name")
    order = base.orderBy("p_size", "p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", _n(order).alias("revision"), F.lag("p_partkey").over(order).alias("supersedes"), F.count(F.lit(1)).over(base).alias("n"))


REVISION_SQL = "SELECT p_partkey, row_number() OVER w AS revision, lag(p_partkey) OVER w AS supersedes, count(*) OVER (PARTITION BY p_brand, p_name) AS n FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_size, p_partkey)"


def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts found by any other word for a word of their name: the asked word, the part's word, and how many parts of the brand it finds."""
    table = spark.createDataFrame([(word, alias) for word, aliases in ALIASES.items() for alias in [word, *aliases]], "word string, asked string")
    words = load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.explode(F.array_distinct(tokens(F.col("p_name")))).alias("word"))
    return words.join(table, "word").groupBy("p_brand", "asked", "word").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"))


ALIAS_SQL = f"""WITH a AS (SELECT * FROM (VALUES {", ".join(f"('{w}', '{x}')" for w, xs in ALIASES.items() for x in [w, *xs])}) t(word, asked)),
w AS (SELECT p_brand, p_partkey, unnest(list_distinct({TOKENS_SQL.replace("text", "p_name")})) AS word FROM part)
SELECT p_brand, asked, a.word, count(*) AS n, min(p_partkey) AS first_id FROM w JOIN a ON a.word = w.word GROUP BY 1, 2, 3"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page of a hundred parts: names in reading order, a line to each column's block."""
    b = boxes(load(spark, sf_dir, "part")).join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("block"), F.coalesce("p_name", F.lit("")).alias("name")), "block")
    rows = b.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "block", "name"))).alias("rows"), F.count(F.lit(1)).alias("n"))  # a hundred to a page
    text = F.array_join(F.transform("rows", lambda r: r["name"]), "\n")
    return rows.select("page", "n", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


PAGE_SQL = """WITH b AS (SELECT p_partkey // 100 AS page, p_partkey AS block, (p_partkey % 3 * 200)::DOUBLE AS x0, (p_partkey % 97 * 10)::DOUBLE AS y0, coalesce(p_name, '') AS name FROM part),
t AS (SELECT page, count(*) AS n, string_agg(name, chr(10) ORDER BY x0, y0, block) AS text FROM b GROUP BY 1) SELECT page, n, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t"""


def tier_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with a boost for their tier (by length), what words they share with the item (0.4 at most), and a penalty for other languages; ranked anew."""
    first = load(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    texts = load(spark, sf_dir, "documents").select("doc_id", "n_chars", F.array_distinct(tokens(F.col("text"))).alias("words"))
    p = sparse_pool(spark, sf_dir, 40).join(texts, "doc_id").join(first, "item_id")
    tier = F.when(F.col("n_chars") >= 4000, 0.35).when(F.col("n_chars") >= 1500, 0.18).when(F.col("n_chars") >= 400, -0.08).otherwise(-0.22)
    impact = F.least(F.lit(0.4), 0.06 * F.size(F.array_intersect("asked", "words")))
    score = 1 / (60 + F.col("rank")) + tier + impact - F.when(F.coalesce("lang", F.lit("")) != "en", 0.1).otherwise(0.0)
    s = p.select("item_id", "doc_id", r6(score).alias("score"))
    return s.withColumn("place", _n(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where("place <= 20")


TIER_SQL = f"""WITH {_pool_sql(40)}, a AS (SELECT item_id, list_distinct({TOKENS_SQL}) AS asked FROM benchmark),
s AS (SELECT p.item_id, p.doc_id, round(1.0::DOUBLE / (60 + rank) + CASE WHEN n_chars >= 4000 THEN 0.35::DOUBLE WHEN n_chars >= 1500 THEN 0.18::DOUBLE WHEN n_chars >= 400 THEN -0.08::DOUBLE ELSE -0.22::DOUBLE END
  + least(0.4::DOUBLE, 0.06::DOUBLE * len(list_intersect(asked, list_distinct({TOKENS_SQL})))) - CASE WHEN coalesce(p.lang, '') <> 'en' THEN 0.1::DOUBLE ELSE 0 END, 6) AS score FROM p JOIN documents d ON d.doc_id = p.doc_id JOIN a ON a.item_id = p.item_id)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s QUALIFY place <= 20"""


def table_aware_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text hits and table rows of one question in one list: rows get 0.2 more, six texts and eight rows at most, an id once; question ``20 * i`` goes with item ``i``."""
    t = sparse_pool(spark, sf_dir, 6).select("item_id", F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.round(1 / (60 + F.col("rank")), 6).alias("score"))
    rows = stage2(spark, sf_dir).where("place <= 8").select((F.col("question_id") / 20).cast("long").alias("item_id"), F.lit("row").alias("kind"), F.col("row_id").alias("id"), F.round(1 / (60 + F.col("place")) + 0.2, 6).alias("score"))
    both = t.unionByName(rows).groupBy("item_id", "kind", "id").agg(F.max("score").alias("score"))
    return both.withColumn("place", _n(Window.partitionBy("item_id").orderBy(F.desc("score"), "kind", "id"))).where("place <= 10")


def _merge_sql() -> str:
    text = _pool_sql(6).replace("WITH ", "")
    tables = STAGE2
    return f"""WITH tx AS (WITH {text} SELECT item_id, 'text' AS kind, doc_id AS id, round(1.0::DOUBLE / (60 + rank), 6) AS score FROM p),
rw AS (WITH {tables} SELECT question_id // 20 AS item_id, 'row' AS kind, row_id AS id, round(1.0::DOUBLE / (60 + place) + 0.2::DOUBLE, 6) AS score FROM st WHERE place <= 8)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, kind, id) AS place FROM (SELECT item_id, kind, id, max(score) AS score FROM (SELECT * FROM tx UNION ALL SELECT * FROM rw) GROUP BY 1, 2, 3) QUALIFY place <= 10"""


def coverage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each item's retrieval as JSON: hits, sources, languages, and which of four languages are missing."""
    p = sparse_pool(spark, sf_dir, 20).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.array_sort(F.collect_set("lang")).alias("langs"))  # 20 rows to an item
    missing = F.array_except(F.array(*map(F.lit, ["de", "en", "es", "fr"])), F.col("langs"))
    record = F.struct("n", "n_sources", F.array_join("langs", ",").alias("langs"), F.array_join(missing, ",").alias("missing"))
    return p.select("item_id", F.to_json(record).alias("record"))


COVERAGE_SQL = f"""WITH {_pool_sql(20)}, r AS (SELECT item_id, count(*) AS n, count(DISTINCT source) AS n_sources, list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)) AS langs FROM p GROUP BY 1)
SELECT item_id, '{{"n":' || n || ',"n_sources":' || n_sources || ',"langs":"' || array_to_string(langs, ',') || '","missing":"' || array_to_string(list_filter(['de', 'en', 'es', 'fr'], lambda x: NOT list_contains(langs, x)), ',') || '"}}' AS record FROM r"""


def question_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by what they ask for: a list, a number, a comparison, a name or a text, the first that fits, with clamped depths of search."""
    t = F.coalesce("text", F.lit(""))
    category = F.when(t.rlike(r"\n.*\n"), "list").when(t.rlike("[0-9]"), "number").when(F.lower(t).rlike(ascii_bounds(r"\b(than|rather)\b")), "comparison").when(F.size(tokens(t)) < 25, "name").otherwise("text")
    n = F.size(tokens(t))
    return load(spark, sf_dir, "benchmark").select("item_id", category.alias("category"), F.least(F.greatest(n, F.lit(6)), F.lit(20)).cast("long").alias("top_k"), F.least(F.greatest(4 * n, F.lit(40)), F.lit(120)).cast("long").alias("fetch_k"))


CATEGORY_SQL = rf"""WITH t AS (SELECT item_id, coalesce(text, '') AS t, len({TOKENS_SQL}) AS n FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(t, '\n.*\n') THEN 'list' WHEN regexp_matches(t, '[0-9]') THEN 'number' WHEN regexp_matches(lower(t), '\b(than|rather)\b') THEN 'comparison' WHEN n < 25 THEN 'name' ELSE 'text' END AS category,
  least(greatest(n, 6), 20) AS top_k, least(greatest(4 * n, 40), 120) AS fetch_k FROM t"""


def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation what the user and the assistant said first in one text, a placeholder where one is missing, with terms spelled out."""
    c = load(spark, sf_dir, "conversations")
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("turn", F.coalesce("text", F.lit("")).alias("said"))))["said"]
    m = c.groupBy("conv_id").agg(first("user").alias("asked"), first("assistant").alias("answered"))
    text = F.concat(F.coalesce("asked", F.lit("(no question)")), F.lit("\n\n"), F.coalesce("answered", F.lit("(no answer)")))
    for term, name in TERMS.items():
        text = F.replace(text, F.lit(term), F.lit(name))
    return m.select("conv_id", F.sha2(text, 256).alias("text_sha256"), (F.col("asked").isNotNull() & F.col("answered").isNotNull()).alias("whole"))


_MERGED = "coalesce(asked, '(no question)') || chr(10) || chr(10) || coalesce(answered, '(no answer)')"
for _term, _name in TERMS.items():
    _MERGED = f"replace({_MERGED}, '{_term}', '{_name}')"
MERGED_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, coalesce(text, '')) AS k FROM conversations),
m AS (SELECT c.conv_id, max(coalesce(text, '')) FILTER (role = 'user' AND k = 1) AS asked, max(coalesce(text, '')) FILTER (role = 'assistant' AND k = 1) AS answered FROM r c GROUP BY 1)
SELECT conv_id, sha256({_MERGED}) AS text_sha256, asked IS NOT NULL AND answered IS NOT NULL AS whole FROM m"""


def vessel_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vessel's known positions in order, with its number and the hours since the one before."""
    w = Window.partitionBy("vessel").orderBy("ts", "event_id")
    t = sensor(spark, sf_dir).where("lat <> 0 AND lon <> 0").select("vessel", "ts", "event_id", "lat", "lon").withColumn("number", _n(w))
    return t.select("vessel", "number", "ts", "lat", "lon", r6(F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) / 3600).alias("hours"))


TRACK_SQL = f"""WITH t AS (SELECT vessel, ts, event_id, lat, lon, row_number() OVER (PARTITION BY vessel ORDER BY ts, event_id) AS number FROM ({SENSOR_SQL}) WHERE lat <> 0 AND lon <> 0)
SELECT vessel, number, ts, lat, lon, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY vessel ORDER BY ts, event_id))) // 1000000 / 3600::DOUBLE, 6) AS hours FROM t"""

QUERIES = {f.__name__: f for f in (full_text_lookup, related_revisions, alias_expansion, page_texts, tier_boosts, table_aware_merge, coverage_records, question_category, merged_answers, vessel_track)}
ORACLES = {
    "full_text_lookup": FULL_SQL, "related_revisions": REVISION_SQL, "alias_expansion": ALIAS_SQL, "page_texts": PAGE_SQL, "tier_boosts": TIER_SQL, "table_aware_merge": _merge_sql(), "coverage_records": COVERAGE_SQL,
    "question_category": CATEGORY_SQL, "merged_answers": MERGED_SQL, "vessel_track": TRACK_SQL,
}
