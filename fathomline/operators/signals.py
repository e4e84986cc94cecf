"""What a question asks for, as columns: codes, quantities, sources, features, facets; which lanes it takes; and what is chosen from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ascii_bounds, load, r6, tokens
from .hybrid import LITERAL_SQL, _pool_sql, exact_literals, sparse_pool

#: How codes, clauses, quantities and sessions are written.
CODE = r"\b[A-Z][A-Za-z]*[-#/][0-9]{1,6}(?:[-/.][0-9]+)*\b"
CLAUSE = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){1,4}\b"
QUANTITY = r"\b[0-9]+(?:[./][0-9]+)* ?(?:(?:kV|V|bar|kPa|MPa|mm|cm|m|kg|t)\b|%)"
SESSION = r"(?i)\b(MEPC|MSC|CCC|SDC|SSE|III|NCSR|PPR|HTW|LEG|FAL)[ -]?([0-9]{1,3})\b"
ONLY, EXCEPT = r"(?i)\bonly (?:in |from |by )?([A-Za-z]+#?[0-9]*)", r"(?i)\b(?:without|except|excluding|not in) ([A-Za-z]+#?[0-9]*)"
#: At most so many features of a question; words that say nothing.
FEATURES = 18
STOP = ["the", "of", "in", "and", "for", "only", "without", "except", "from", "by", "what", "which", "is", "are", "to", "not"]
#: Facets and the words that call for them, in this order.
FACETS = [("numbers", r"(?i)how many|how much|[0-9]+ ?(?:mm|kg|%)|\bsize\b"), ("list", r"(?i)\blist\b|\ball\b|which"), ("comparison", r"(?i)compare|than|difference"), ("date", r"(?i)when|date|since|until"), ("scope", r"(?i)only|except|without")]


def found(text: Column, pattern: str) -> Column:
    """The distinct matches in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def code_variants(code: Column) -> Column:
    """A code as it stands, with its separators as blanks, and with none, all in lower case."""
    low = F.lower(code)
    return F.array(low, F.regexp_replace(low, "[-#/]", " "), F.regexp_replace(low, "[-#/]", ""))


def signals(questions: DataFrame) -> DataFrame:
    """question_id and the signals of questions (question_id, question): codes, clauses, quantities, sessions, only, excluded, features, facets.

    ``only`` leaves out what is ``excluded``, where both name a source denial
    wins.  Features are variants of codes and clauses and quantities, then
    words in order without stop words, each once, ``FEATURES`` at most.
    Null questions have none of anything.
    """
    q = F.col("question")
    upper = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(q, F.lit("")), F.lit(pattern), F.lit(1)), lambda x: F.upper(x)))
    base = questions.select(
        "question_id", "question", found(q, CODE).alias("codes"), found(q, CLAUSE).alias("clauses"), F.transform(found(q, QUANTITY), lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("")))).alias("quantities"),
        F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(q, F.lit("")), F.lit(SESSION), F.lit(0)), lambda x: F.upper(F.regexp_replace(x, "[ -]", "")))).alias("sessions"),
        upper(EXCEPT).alias("excluded"), upper(ONLY).alias("_only"),
    )
    words = F.filter(tokens(q), lambda w: ~w.isin(STOP))
    exact = F.flatten(F.transform(F.concat("codes", "clauses"), code_variants))
    features = F.slice(F.array_distinct(F.concat(exact, "quantities", words)), 1, FEATURES)
    facets = F.array_compact(F.array(*[F.when(q.rlike(p), F.lit(n)) for n, p in FACETS]))
    return base.select("question_id", "codes", "clauses", "quantities", "sessions", F.array_except("_only", "excluded").alias("only"), "excluded", features.alias("features"), facets.alias("facets"))


#: Lanes in the order in which they are asked.
LANES = ["literal", "table", "scoped", "sparse"]


def lanes(known: DataFrame) -> DataFrame:
    """question_id, lane, priority: a literal lane for codes and clauses, a table lane for numbers, a scoped one for named sources, and the sparse one where fewer than two others apply."""
    wants = {"literal": (F.size("codes") + F.size("clauses")) > 0, "table": (F.size("quantities") > 0) | F.array_contains("facets", "numbers"), "scoped": (F.size("only") + F.size("sessions")) > 0}
    taken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in wants.items()]))
    every = F.when(F.size(taken) < 2, F.concat(taken, F.array(F.lit("sparse")))).otherwise(taken)
    return known.select("question_id", F.posexplode(every).alias("priority", "lane")).select("question_id", "lane", (F.col("priority") + 1).cast("long").alias("priority"))


def dispatched(chosen: DataFrame, hits: dict[str, DataFrame], depth: int) -> DataFrame:
    """question_id, place, id, lane: the union of the lane tables (question_id, id, rank) that each question takes.

    Lanes come by priority in turns, an id once, ``depth`` in all; a lane that a question
    doesn't take gives it nothing, whatever it has.
    """
    tables = [df.select("question_id", "id", "rank").withColumn("lane", F.lit(name)) for name, df in hits.items()]
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    met = rows.where(F.col("rank") <= depth).join(chosen, ["question_id", "lane"])
    once = met.groupBy("question_id", "id").agg(F.min(F.struct("rank", "priority", "lane")).alias("b")).select("question_id", "id", "b.*")
    w = Window.partitionBy("question_id").orderBy("rank", "priority", "id")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= depth).select("question_id", F.col("place").cast("long").alias("place"), "id", "lane")


# --- what is chosen from a pool ---------------------------------------------------------------------


def rule_pool(pool: DataFrame) -> DataFrame:
    """Rows (text) that are no catalogue: one that names a document code and a title, or three codes or more, is left out; null texts stay."""
    t = F.coalesce("text", F.lit(""))
    catalogue = (F.lower(t).contains("document code") & F.lower(t).contains("title")) | (F.size(found(t, CODE)) >= 3)
    return pool.where(~catalogue)


def eligible(pool: DataFrame) -> DataFrame:
    """Rows (kind, score) of tier 2 at most and a score of 0 or more after their tier's penalty, with both; an unknown kind is tier 3."""
    kind = F.lower(F.coalesce("kind", F.lit("")))
    tier = F.when(kind == "report", 0).when(kind.isin("resolution", "decision"), 1).when(kind.isin("agenda", "summary"), 2).otherwise(3)
    scored = pool.withColumn("tier", tier).withColumn("final", r6(F.col("score") - 0.1 * F.col("tier")))
    return scored.where((F.col("tier") < 3) & (F.col("final") >= 0))


def forced_merge(pool: DataFrame, depth: int, least: int) -> DataFrame:
    """group_id, id, place of a pool (group_id, id, distance, literal, outcome): the ``depth`` nearest, of which literal hits come first and ``least`` are outcomes where there are so many.

    Outcomes that the nearest lack push out the farthest that are neither
    literal nor outcome.  Ties by id.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = pool.select("group_id", "id", "distance", flag("literal").alias("literal"), flag("outcome").alias("outcome"))
    near = Window.partitionBy("group_id").orderBy(F.desc("literal"), F.asc_nulls_last("distance"), "id")
    nth = Window.partitionBy("group_id", "outcome").orderBy(F.desc("literal"), F.asc_nulls_last("distance"), "id")
    ranked = rows.withColumn("near", F.row_number().over(near)).withColumn("nth", F.row_number().over(nth))
    must = F.col("literal") | (F.col("outcome") & (F.col("nth") <= least))
    order = Window.partitionBy("group_id").orderBy(F.desc("must"), "near")
    taken = ranked.withColumn("must", must).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= depth)
    return taken.withColumn("place", F.row_number().over(near).cast("long")).select("group_id", "id", "literal", "outcome", "place")


def slots_by_type(pool: DataFrame, slots: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    """group_id, kind, slot, id, place: for each group's type (kind) the best row (score, ties by id) of each of its slots, in their order; a row fills the first slot that it fits."""
    rule = F.lit(None).cast("int")
    names = F.lit(None).cast("string")
    for kind, own in slots.items():
        for i, (name, test) in reversed(list(enumerate(own))):
            fits = (F.col("kind") == kind) & F.coalesce(test, F.lit(False))
            rule, names = F.when(fits, F.lit(i)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(names)
    told = pool.withColumn("_slot", rule).withColumn("slot", names).where("_slot IS NOT NULL")
    best = Window.partitionBy("group_id", "kind", "_slot").orderBy(F.desc("score"), "id")
    first = told.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("group_id", "kind").orderBy("_slot")).cast("long")
    return first.withColumn("place", place).select("group_id", "kind", "slot", "id", "place")


def key_clauses(clauses: DataFrame, questions: DataFrame, limit: int = 12) -> DataFrame:
    """question_id, clause_id, score, place: clauses by 2 * overlap + 0.35 * min(signals, 5) + authority, ties by position.

    ``clauses``: question_id, clause_id, pos, text, authority; the overlap is
    the share of the question's words in the clause, signals are its codes,
    clauses, quantities and modal words.
    """
    asked = questions.select("question_id", F.array_distinct(F.filter(tokens(F.col("question")), lambda w: ~w.isin(STOP))).alias("asked"))
    t = F.coalesce("text", F.lit(""))
    n_of = lambda pattern: F.size(F.regexp_extract_all(t, F.lit(ascii_bounds(pattern)), F.lit(0)))
    n = n_of(CODE) + n_of(CLAUSE) + n_of(QUANTITY) + n_of(r"(?i)\b(?:shall|must|should|may)\b")
    met = clauses.join(asked, "question_id").select("question_id", "clause_id", "pos", "authority", "asked", tokens(t).alias("w"), n.alias("n"))
    overlap = F.when(F.size("asked") == 0, 0.0).otherwise(F.size(F.array_intersect("asked", "w")) / F.size("asked"))
    scored = met.withColumn("score", r6(2 * overlap + 0.35 * F.least("n", F.lit(5)) + F.coalesce("authority", F.lit(0.0))))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "pos", "clause_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("question_id", "clause_id", "score", F.col("place").cast("long").alias("place"))


# --- queries ----------------------------------------------------------------------------------------

_TEXT = """CASE p_partkey % 4 WHEN 0 THEN 'List all ' || p_type || ' only ' || p_brand || ' without Brand#' || (10 + p_partkey % 50) || ', clause ' || (p_size % 9) || '.' || (p_size % 7) || ', ' || p_size || ' mm'
  WHEN 1 THEN 'What is the size of ' || p_name || ' in ' || p_brand || ' except Brand#11 at ' || p_size || ' %' WHEN 2 THEN p_name || ' and ' || p_type || ' in MEPC ' || (60 + p_size % 20) || ' or msc-' || p_size ELSE p_name END"""


def part_questions(parts: DataFrame) -> DataFrame:
    """A question for every part, in four forms."""
    return parts.select(F.col("p_partkey").alias("question_id"), F.expr(_TEXT).alias("question"))


def question_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = signals(part_questions(load(spark, sf_dir, "part")))
    lists = [c for c in known.columns if c != "question_id"]
    return known.select("question_id", *[F.array_join(c, ";").alias(c) for c in lists])


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_LOW = f"[lower(replace(x, ' ', '')) FOR x IN regexp_extract_all(q, '{QUANTITY}')]"
_VARIANTS = "flatten([[lower(x), regexp_replace(lower(x), '[-#/]', ' ', 'g'), regexp_replace(lower(x), '[-#/]', '', 'g')] FOR x IN list_concat(codes, clauses)])"
_STOPS = ", ".join(f"'{w}'" for w in STOP)
_WORDS = f"list_filter(list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda t: length(t) > 1), lambda t: t NOT IN ({_STOPS}))"
_FACETS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{n}' END" for n, p in FACETS) + "], lambda x: x IS NOT NULL)"
_SIGNALS = f"""qs AS (SELECT p_partkey AS question_id, {_TEXT} AS q FROM part),
r0 AS (SELECT question_id, coalesce(q, '') AS q FROM qs),
r1 AS (SELECT question_id, q, regexp_extract_all(q, '{CODE}') AS c0, regexp_extract_all(q, '{CLAUSE}') AS l0, {_LOW} AS q0, [upper(regexp_replace(x, '[ -]', '', 'g')) FOR x IN regexp_extract_all(q, '{SESSION}')] AS s0,
  [upper(x) FOR x IN regexp_extract_all(q, '{ONLY}', 1)] AS o0, [upper(x) FOR x IN regexp_extract_all(q, '{EXCEPT}', 1)] AS e0 FROM r0),
r2 AS (SELECT question_id, q, {_DISTINCT.format('c0')} AS codes, {_DISTINCT.format('l0')} AS clauses, {_DISTINCT.format('q0')} AS quantities, {_DISTINCT.format('s0')} AS sessions, list_filter({_DISTINCT.format('o0')}, lambda x: NOT list_contains(e0, x)) AS "only", {_DISTINCT.format('e0')} AS excluded, {_FACETS} AS facets FROM r1),
r3 AS (SELECT *, list_concat(list_concat({_VARIANTS}, quantities), {_WORDS}) AS f0 FROM r2),
si AS (SELECT * EXCLUDE (f0), ({_DISTINCT.format('f0')})[1:{FEATURES}] AS features FROM r3)"""
SIGNAL_SQL = f"""WITH {_SIGNALS} SELECT question_id, {', '.join(f'array_to_string("{c}", chr(59)) AS "{c}"' for c in ("codes", "clauses", "quantities", "sessions", "only", "excluded", "features", "facets"))} FROM si"""


def question_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lanes of every question by priority."""
    return lanes(signals(part_questions(load(spark, sf_dir, "part"))))


LANE_SQL = f"""WITH {_SIGNALS}, t AS (SELECT question_id, list_filter([CASE WHEN len(codes) + len(clauses) > 0 THEN 'literal' END, CASE WHEN len(quantities) > 0 OR list_contains(facets, 'numbers') THEN 'table' END, CASE WHEN len("only") + len(sessions) > 0 THEN 'scoped' END], lambda x: x IS NOT NULL) AS l FROM si),
u AS (SELECT question_id, CASE WHEN len(l) < 2 THEN list_append(l, 'sparse') ELSE l END AS l FROM t)
SELECT question_id, unnest(l) AS lane, unnest(range(1, len(l) + 1)) AS priority FROM u"""


def eligible_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item's pool what may be summarised; a document's kind follows from its language."""
    lang = F.col("lang")
    kind = F.when(lang == "en", "report").when(lang == "de", "Decision").when(lang == "es", "summary")
    p = sparse_pool(spark, sf_dir, 40).select("item_id", "doc_id", kind.alias("kind"), (1 / F.col("rank")).alias("score"))
    return eligible(p).select("item_id", "doc_id", F.col("tier").cast("long").alias("tier"), "final")


ELIGIBLE_SQL = f"""WITH {_pool_sql(40)}, el AS (SELECT item_id, doc_id, rank, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END::BIGINT AS tier FROM p)
SELECT item_id, doc_id, tier, round(1.0::DOUBLE / rank - 0.1::DOUBLE * tier, 6) AS final FROM el WHERE tier < 3 AND round(1.0::DOUBLE / rank - 0.1::DOUBLE * tier, 6) >= 0"""

OUTCOMES = 3


def forced_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of each item's pool: documents with words of the item in a row first, and three of the largest at least."""
    exact = exact_literals(spark, sf_dir).select("item_id", "doc_id", F.lit(True).alias("literal"))
    sizes = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 3000).alias("outcome"))
    p = sparse_pool(spark, sf_dir, 40).join(exact, ["item_id", "doc_id"], "left").join(sizes, "doc_id")
    got = forced_merge(p.select(F.col("item_id").alias("group_id"), F.col("doc_id").alias("id"), (F.col("rank") / 100).alias("distance"), "literal", "outcome"), 10, OUTCOMES)
    return got.select(F.col("group_id").alias("item_id"), F.col("id").alias("doc_id"), "literal", "outcome", "place")


FORCED_SQL = f"""WITH {_pool_sql(40)}, x AS (SELECT item_id, doc_id FROM ({LITERAL_SQL})), m AS (SELECT p.item_id, p.doc_id, rank, x.doc_id IS NOT NULL AS literal, coalesce(n_chars >= 3000, false) AS outcome FROM p JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN x ON x.item_id = p.item_id AND x.doc_id = p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY literal DESC, rank, doc_id) AS near, row_number() OVER (PARTITION BY item_id, outcome ORDER BY literal DESC, rank, doc_id) AS nth FROM m),
ft AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY (literal OR (outcome AND nth <= {OUTCOMES})) DESC, near) <= 10)
SELECT item_id, doc_id, literal, outcome, row_number() OVER (PARTITION BY item_id ORDER BY near) AS place FROM ft"""


def typed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each item's pool by its type: item ``i`` is of type table, rule or general as ``i % 3`` says."""
    kind = F.element_at(F.array(*map(F.lit, ["table", "rule", "general"])), (F.col("item_id") % 3 + 1).cast("int"))
    p = sparse_pool(spark, sf_dir, 40).join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = p.select(F.col("item_id").alias("group_id"), kind.alias("kind"), F.col("doc_id").alias("id"), "score", "lang", "n_chars")
    long, small = F.col("n_chars") >= 2000, F.col("n_chars") < 400
    slots = {"table": [("rows", small), ("caption", F.col("lang") == "en"), ("text", F.lit(True))], "rule": [("clause", F.col("lang") == "de"), ("scope", long)], "general": [("long", long), ("any", F.lit(True))]}
    return slots_by_type(rows, slots).select(F.col("group_id").alias("item_id"), "kind", "slot", F.col("id").alias("doc_id"), "place")


SLOT_SQL = f"""WITH {_pool_sql(40)}, k AS (SELECT p.item_id, p.doc_id, score, p.lang, n_chars, ['table', 'rule', 'general'][p.item_id % 3 + 1] AS kind FROM p JOIN documents d ON d.doc_id = p.doc_id),
s AS (SELECT *, CASE kind WHEN 'table' THEN CASE WHEN n_chars < 400 THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END WHEN 'rule' THEN CASE WHEN lang = 'de' THEN 0 WHEN n_chars >= 2000 THEN 1 END ELSE CASE WHEN n_chars >= 2000 THEN 0 ELSE 1 END END AS i FROM k),
b AS (SELECT * FROM s WHERE i IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id, i ORDER BY score DESC, doc_id) = 1)
SELECT item_id, kind, CASE kind WHEN 'table' THEN ['rows', 'caption', 'text'][i + 1] WHEN 'rule' THEN ['clause', 'scope'][i + 1] ELSE ['long', 'any'][i + 1] END AS slot, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY i) AS place FROM b"""


def key_clause_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve lines of each item's five best documents by overlap, signals and authority (0.5 for English, 0.2 for German)."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    top = sparse_pool(spark, sf_dir, 5).select(F.col("item_id").alias("question_id"), "doc_id", "rank", "lang")
    texts = load(spark, sf_dir, "documents").select("doc_id", "text")
    lines = top.join(texts, "doc_id").select("question_id", "doc_id", "rank", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    authority = F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "de", 0.2)
    clauses = lines.select("question_id", F.format_string("%d:%d", "doc_id", "line").alias("clause_id"), (F.col("rank") * 100000 + F.col("line")).alias("pos"), "text", authority.alias("authority"))
    return key_clauses(clauses, items)


_TOK = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda t: length(t) > 1)"
_COUNTED = " + ".join(f"len(regexp_extract_all(line, '{x}'))" for x in (CODE, CLAUSE, QUANTITY, r"(?i)\b(?:shall|must|should|may)\b"))
KEY_SQL = f"""WITH {_pool_sql(5)}, l AS (SELECT item_id, p.doc_id, rank, p.lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM p JOIN documents d ON d.doc_id = p.doc_id),
a AS (SELECT item_id, list_distinct(list_filter({_TOK.format("text")}, lambda t: t NOT IN ({_STOPS}))) AS asked FROM benchmark),
s AS (SELECT item_id AS question_id, doc_id || ':' || i AS clause_id, rank * 100000 + i AS pos, round(2::DOUBLE * CASE WHEN len(asked) = 0 THEN 0 ELSE len(list_intersect(asked, list_distinct({_TOK.format("line")})))::DOUBLE / len(asked) END + 0.35::DOUBLE * least({_COUNTED}, 5) + CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.2::DOUBLE ELSE 0 END, 6) AS score FROM l JOIN a USING (item_id))
SELECT question_id, clause_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos, clause_id) AS place FROM s QUALIFY place <= 12"""

QUERIES = {f.__name__: f for f in (question_signals, question_lanes, eligible_pool, forced_hits, typed_slots, key_clause_pick)}
ORACLES = {"question_signals": SIGNAL_SQL, "question_lanes": LANE_SQL, "eligible_pool": ELIGIBLE_SQL, "forced_hits": FORCED_SQL, "typed_slots": SLOT_SQL, "key_clause_pick": KEY_SQL}
