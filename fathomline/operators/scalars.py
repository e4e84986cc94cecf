"""Row-wise rules on names and clauses, and lookups by a spoken argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import load, r6, sensor
from .intervals import with_cover
from .ranks import with_next
from .voyages import SCHEDULE_SQL, SEGMENTS, schedule_open_end, segments

#: Clause numbers at the beginning of a text, the form of a voyage's id, and words for a condition and a period.
ARTICLE, SUBCLAUSE = r"^\s*([0-9]{3,})\.\s*\S", r"^\s*([0-9]+(?:-[0-9]+)?)\.\s*\S"
VOYAGE_ID, CONDITION = r"(?i)^[A-Za-z0-9]+_V[0-9]+", r"(?i)\b(Laden|Ballast)\b"
PREVIOUS, CURRENT, TO_DATE = "(?i)previous", "(?i)current", "(?i)ytd"


def _clauses(parts: DataFrame) -> DataFrame:
    """Texts with clauses: a part's name under an article, a subclause or none, and three parts of it."""
    i = F.col("p_partkey")
    head = F.when(i % 4 == 0, F.concat((900 + i % 90).cast("string"), F.lit(". "))).when(i % 4 == 1, F.concat((i % 9 + 1).cast("string"), F.lit("-2. "))).when(i % 4 == 2, F.lit("7. ")).otherwise("")
    text = F.concat(F.lit("\n  "), head, "p_name", F.lit("\n2-1. "), "p_type", F.lit("\n 2-3. "), "p_brand", F.lit(" 4.5 m"))
    return parts.select("p_partkey", text.alias("text"))


CLAUSES = r"""ct AS (SELECT p_partkey, chr(10) || '  ' || CASE p_partkey % 4 WHEN 0 THEN (900 + p_partkey % 90) || '. ' WHEN 1 THEN (p_partkey % 9 + 1) || '-2. ' WHEN 2 THEN '7. ' ELSE '' END || p_name || chr(10) || '2-1. ' || p_type || chr(10) || ' 2-3. ' || p_brand || ' 4.5 m' AS text FROM part)"""


def clause_number(text: Column) -> Column:
    """An article's number (three digits and more) before that of a subclause or item, by the first line with text; null without one."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(found(ARTICLE), found(SUBCLAUSE))


def subclauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut before every clause number at a line's beginning: piece, its id with a suffix, its clause number, and the whole's."""
    t = _clauses(load(spark, sf_dir, "part"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pieces = t.select("p_partkey", clause_number(bare("text")).alias("whole"), F.posexplode(F.split(bare("text"), r"(?=\n\s*[0-9]+(?:-[0-9]+)?\.\s*\S)")).alias("i", "cut"))
    piece = bare("cut")
    return pieces.select("p_partkey", F.format_string("%d_s%02d", "p_partkey", "i").alias("chunk_id"), piece.alias("piece"), clause_number(piece).alias("clause"), "whole")


SUBCLAUSE_SQL = rf"""WITH {CLAUSES}, sp AS (SELECT p_partkey, trim(text, chr(10) || ' ') AS whole, string_split(regexp_replace(trim(text, chr(10) || ' '), '(\n\s*[0-9]+(?:-[0-9]+)?\.\s*\S)', chr(1) || '\1', 'g'), chr(1)) AS p FROM ct),
e AS (SELECT p_partkey, whole, trim(unnest(p), chr(10) || ' ') AS piece, unnest(range(0, len(p))) AS i FROM sp)
SELECT p_partkey, printf('%d_s%02d', p_partkey, i) AS chunk_id, piece, coalesce(nullif(regexp_extract(piece, '{ARTICLE}', 1), ''), nullif(regexp_extract(piece, '{SUBCLAUSE}', 1), '')) AS clause,
  coalesce(nullif(regexp_extract(whole, '{ARTICLE}', 1), ''), nullif(regexp_extract(whole, '{SUBCLAUSE}', 1), '')) AS whole FROM e"""


def char_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each part's name to the next one's of its brand: twice the common grams over all, 0.72 and more where one holds the other."""
    p = load(spark, sf_dir, "part")
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    pairs = with_next(p.select("p_partkey", "p_brand", "p_name"), ["p_brand"], ["p_partkey"], "p_name", "after")
    t = pairs.select("p_partkey", clean(F.col("p_name")).alias("a"), clean(F.col("after")).alias("b"))
    low, high = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    n = F.when(low < 6, 2).otherwise(3)
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, n)))
    ratio = low / high
    holds = F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))
    dice = 2.0 * F.size(F.array_intersect(grams("a"), grams("b"))) / F.greatest(F.lit(1), F.size(grams("a")) + F.size(grams("b")))
    score = F.when(low == 0, 0.0).when(holds, F.when(low >= 3, F.least(F.lit(1.0), 0.72 + ratio * 0.28)).otherwise(ratio)).otherwise(dice)
    return t.select("p_partkey", r6(score).alias("similarity"))


_GR = "list_distinct([{0}[i:i + n - 1] FOR i IN range(1, greatest(2, length({0}) - n + 2))])"
CHAR_SQL = rf"""WITH t AS (SELECT p_partkey, regexp_replace(lower(coalesce(p_name, '')), '\s+', '', 'g') AS a, regexp_replace(lower(coalesce(lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey), '')), '\s+', '', 'g') AS b FROM part),
m AS (SELECT *, least(length(a), length(b)) AS low, greatest(length(a), length(b)) AS high, CASE WHEN least(length(a), length(b)) < 6 THEN 2 ELSE 3 END AS n FROM t)
SELECT p_partkey, round(CASE WHEN low = 0 THEN 0 WHEN contains(a, b) OR contains(b, a) THEN CASE WHEN low >= 3 THEN least(1.0::DOUBLE, 0.72::DOUBLE + low::DOUBLE / high * 0.28::DOUBLE) ELSE low::DOUBLE / high END
  ELSE 2.0::DOUBLE * len(list_intersect({_GR.format("a")}, {_GR.format("b")})) / greatest(1, len({_GR.format("a")}) + len({_GR.format("b")})) END, 6) AS similarity FROM m"""


def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a part's entities (words of its name, its type) that its brand's next part has, compared in upper case without white space."""
    compact = lambda a: F.filter(F.array_distinct(F.transform(a, lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))), lambda x: x != "")
    e = load(spark, sf_dir, "part").select("p_partkey", "p_brand", compact(F.concat(F.split(F.coalesce("p_name", F.lit("")), " "), F.array(F.coalesce("p_type", F.lit(""))))).alias("own"))
    n = with_next(e, ["p_brand"], ["p_partkey"], "own", "other")
    hits = F.size(F.filter("own", lambda q: F.exists(F.coalesce("other", F.array().cast("array<string>")), lambda t: t.contains(q) | q.contains(t))))
    return n.select("p_partkey", F.when(F.size("own") == 0, 0.0).otherwise(r6(hits / F.size("own"))).alias("overlap"))


ENTITY_SQL = r"""WITH e AS (SELECT p_partkey, p_brand, list_filter(list_distinct([upper(regexp_replace(x, '\s+', '', 'g')) FOR x IN list_append(string_split(coalesce(p_name, ''), ' '), coalesce(p_type, ''))]), lambda x: x <> '') AS own FROM part),
n AS (SELECT *, coalesce(lead(own) OVER (PARTITION BY p_brand ORDER BY p_partkey), []) AS other FROM e)
SELECT p_partkey, CASE WHEN len(own) = 0 THEN 0 ELSE round(len(list_filter(own, lambda q: len(list_filter(other, lambda t: contains(t, q) OR contains(q, t))) > 0))::DOUBLE / len(own), 6) END AS overlap FROM n"""


def voyage_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spoken argument of each order resolved to a voyage's id, a period and a condition."""
    i = F.col("o_orderkey")
    said = F.when(i % 6 == 0, F.concat(F.lit("H"), F.col("o_custkey").cast("string"), F.lit("_V03_Laden"))).when(i % 6 == 1, "the previous laden leg").when(i % 6 == 2, "YTD").when(i % 6 == 3, "Ballast").when(i % 6 == 4, "current").otherwise("")
    o = load(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    word = F.lower(F.regexp_extract("said", CONDITION, 1))
    condition = F.when(word == "laden", "Laden").when(word == "ballast", "Ballast").otherwise("")
    is_id = F.col("said").rlike(VOYAGE_ID)
    period = F.when(is_id, "current").when(F.col("said").rlike(PREVIOUS), "previous").when(F.col("said").rlike(TO_DATE), "ytd").when(F.col("said").rlike(CURRENT), "current").when(condition != "", "previous").otherwise("current")
    return o.select("o_orderkey", F.when(is_id, F.col("said")).otherwise("").alias("voyage_id"), period.alias("period"), condition.alias("condition"))


ARGUMENT_SQL = r"""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'H' || o_custkey || '_V03_Laden' WHEN 1 THEN 'the previous laden leg' WHEN 2 THEN 'YTD' WHEN 3 THEN 'Ballast' WHEN 4 THEN 'current' ELSE '' END AS said FROM orders),
c AS (SELECT *, CASE lower(regexp_extract(said, '(?i)\b(Laden|Ballast)\b', 1)) WHEN 'laden' THEN 'Laden' WHEN 'ballast' THEN 'Ballast' ELSE '' END AS condition, regexp_matches(said, '(?i)^[A-Za-z0-9]+_V[0-9]+') AS is_id FROM o)
SELECT o_orderkey, CASE WHEN is_id THEN said ELSE '' END AS voyage_id, CASE WHEN is_id THEN 'current' WHEN regexp_matches(said, '(?i)previous') THEN 'previous' WHEN regexp_matches(said, '(?i)ytd') THEN 'ytd' WHEN regexp_matches(said, '(?i)current') THEN 'current' WHEN condition <> '' THEN 'previous' ELSE 'current' END AS period, condition FROM c"""


def voyage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's current and previous voyage in a condition: the last order that fits, the last of all where none does; before it, the last but one."""
    o = load(spark, sf_dir, "orders")
    by_end = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    fits = F.lower("o_orderpriority").contains("urgent") | F.col("o_orderkey").cast("string").contains("77")
    n = o.select("o_custkey", "o_orderkey", fits.alias("fits"), F.row_number().over(by_end).alias("nth"))
    pick = lambda rows: F.min(F.when(rows, F.struct((~F.col("fits")).alias("other"), "nth", "o_orderkey")))
    return n.groupBy("o_custkey").agg(pick(F.lit(True))["o_orderkey"].alias("current"), pick(F.col("nth") > 1)["o_orderkey"].alias("previous"))


LOOKUP_SQL = """WITH n AS (SELECT o_custkey, o_orderkey, contains(lower(o_orderpriority), 'urgent') OR contains(o_orderkey::VARCHAR, '77') AS fits, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders)
SELECT o_custkey, arg_min(o_orderkey, nth + CASE WHEN fits THEN 0 ELSE 1000000000 END) AS current, arg_min(o_orderkey, nth + CASE WHEN fits THEN 0 ELSE 1000000000 END) FILTER (nth > 1) AS previous FROM n GROUP BY 1"""


def voyage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled voyages, and those of the log that begin inside none of their vessel's schedule."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("vessel"))
    planned = schedule_open_end(spark, sf_dir).join(orders, "o_orderkey").select("vessel", "start_ts", "end_ts", F.lit("scheduled").alias("kind"))
    found = segments(sensor(spark, sf_dir)).select("vessel", "voyage", "start_ts", "end_ts")
    spans = planned.select("vessel", F.col("start_ts").alias("s"), F.col("end_ts").alias("e"))
    detected = with_cover(found, spans, ["vessel"], "start_ts", "s", "e", "inside").where("NOT inside").select("vessel", "start_ts", "end_ts", F.lit("detected").alias("kind"))
    return planned.unionByName(detected)


UNION_SQL = f"""WITH {SEGMENTS}, pl AS (SELECT o_custkey AS vessel, start_ts, end_ts FROM ({SCHEDULE_SQL}) JOIN orders USING (o_orderkey))
SELECT vessel, start_ts, end_ts, 'scheduled' AS kind FROM pl UNION ALL
SELECT vessel, start_ts, end_ts, 'detected' FROM v WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.vessel = v.vessel AND v.start_ts BETWEEN pl.start_ts AND pl.end_ts)"""


def corpus_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that match a pattern, with their numbers and a preview of eighty characters."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    m = d.where(F.col("said").rlike(r"[0-9]{2,}"))
    return m.select("doc_id", F.col("line").cast("long").alias("line"), F.when(F.char_length("said") > 80, F.concat(F.substring("said", 1, 80), F.lit("..."))).otherwise(F.col("said")).alias("preview"))


GREP_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS said, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents)
SELECT doc_id, line, CASE WHEN length(said) > 80 THEN left(said, 80) || '...' ELSE said END AS preview FROM l WHERE regexp_matches(said, '[0-9]{2,}')"""


def corpus_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source still to be labelled, in falling order of length within it, and whether their first line occurs before."""
    d = load(spark, sf_dir, "documents")
    rest = d.join(load(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_anti")
    head = F.sha1(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)))
    r = rest.select("doc_id", "source", head.alias("head"))
    first = r.groupBy("head").agg(F.min("doc_id").alias("first_id"))
    return r.join(first, "head").select("doc_id", "source", (F.col("doc_id") != F.col("first_id")).alias("repeated"))


PREPARATION_SQL = """SELECT doc_id, source, doc_id <> min(doc_id) OVER (PARTITION BY sha1(split_part(coalesce(text, ''), chr(10), 1))) AS repeated FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""


def year_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years from what was typed: whole and broken numbers count, anything else is null; counted by result."""
    i = F.col("o_orderkey")
    typed = F.when(i % 4 == 0, F.year("o_orderdate").cast("string")).when(i % 4 == 1, F.concat(F.year("o_orderdate").cast("string"), F.lit(".0"))).when(i % 4 == 2, "unknown")
    y = load(spark, sf_dir, "orders").select(typed.try_cast("double").try_cast("int").alias("year"))
    return y.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


YEAR_SQL = "SELECT TRY_CAST(TRY_CAST(t AS DOUBLE) AS INT) AS year, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate)::VARCHAR WHEN 1 THEN year(o_orderdate) || '.0' WHEN 2 THEN 'unknown' END AS t FROM orders) GROUP BY 1"

QUERIES = {f.__name__: f for f in (subclauses, char_similarity, entity_overlap, voyage_arguments, voyage_lookup, voyage_union, corpus_grep, corpus_preparation, year_coercion)}
ORACLES = {
    "subclauses": SUBCLAUSE_SQL, "char_similarity": CHAR_SQL, "entity_overlap": ENTITY_SQL, "voyage_arguments": ARGUMENT_SQL, "voyage_lookup": LOOKUP_SQL,
    "voyage_union": UNION_SQL, "corpus_grep": GREP_SQL, "corpus_preparation": PREPARATION_SQL, "year_coercion": YEAR_SQL,
}
