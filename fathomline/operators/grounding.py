"""Claims and their citations, on the conversations: an assistant's line is a claim, earlier turns are its sources.

Line ``i`` of turn ``t`` cites the turns ``i % (t + 2)`` and the one after, so
some citations are out of range; every fifth line cites nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import TOKENS_SQL, load, r6, tokens


def _n(w) -> Column:
    return F.row_number().over(w).cast("long")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, line, claim (with its citations in square brackets) of the assistant's lines."""
    c = load(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    # repeated rows of a turn are one answer
    lines = c.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    first = F.col("line") % (F.col("turn") + 2)
    cited = F.concat(F.lit(" ["), first.cast("string"), F.lit(", "), (first + 1).cast("string"), F.lit("]"))
    return lines.select("conv_id", "turn", F.col("line").cast("long").alias("line"), F.concat("said", F.when(F.col("line") % 5 == 4, "").otherwise(cited)).alias("claim"))


CLAIMS = """an AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
ln AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS said, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM an),
cl AS (SELECT conv_id, turn, line, said || CASE WHEN line % 5 = 4 THEN '' ELSE ' [' || (line % (turn + 2)) || ', ' || (line % (turn + 2) + 1) || ']' END AS claim FROM ln)"""


def normalised(claim: Column) -> Column:
    """``[1, 11]`` becomes ``[1][11]``."""
    return F.regexp_replace(claim, r"(?<=[0-9]), ?(?=[0-9]+(?:, ?[0-9]+)*\])", "][")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, cited (a turn's number from 1), words of each turn."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return c.select("conv_id", (F.col("turn") + 1).alias("cited"), F.array_distinct(tokens(F.col("text"))).alias("words"))


SOURCES = f"so AS (SELECT conv_id, turn + 1 AS cited, list_distinct({TOKENS_SQL}) AS words FROM (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY 1, 2))"


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, line, cited, n_shared: every citation of every claim with the words that claim and source share; null where there is no such source before the claim."""
    a = answers(spark, sf_dir).withColumn("claim", normalised(F.col("claim")))
    ids = F.array_distinct(F.regexp_extract_all("claim", F.lit(r"\[([0-9]+)\]"), F.lit(1)))
    bare = F.regexp_replace("claim", r"\[[0-9]+\]", "")
    c = a.select("conv_id", "turn", "line", F.array_distinct(tokens(bare)).alias("said"), F.explode(ids).alias("id")).withColumn("cited", F.col("id").cast("long"))
    met = c.join(sources(spark, sf_dir), ["conv_id", "cited"], "left")
    shared = F.when(F.col("words").isNotNull() & F.col("cited").between(1, F.col("turn")), F.size(F.array_intersect("said", "words")))
    return met.select("conv_id", "turn", "line", "cited", shared.cast("long").alias("n_shared"))


_SAID = TOKENS_SQL.replace("coalesce(text, '')", r"regexp_replace(claim, '\[[0-9]+\]', '', 'g')")
CITATIONS = rf"""{CLAIMS}, {SOURCES}, nc AS (SELECT conv_id, turn, line, regexp_replace(claim, '\[([0-9]+), ([0-9]+)\]$', '[\1][\2]') AS claim FROM cl),
ex AS (SELECT conv_id, turn, line, list_distinct({_SAID}) AS said, CAST(unnest(list_distinct(regexp_extract_all(claim, '\[([0-9]+)\]', 1))) AS BIGINT) AS cited FROM nc),
ci AS (SELECT ex.conv_id, turn, line, ex.cited, CASE WHEN words IS NOT NULL AND ex.cited BETWEEN 1 AND turn THEN len(list_intersect(said, words)) END AS n_shared FROM ex LEFT JOIN so ON so.conv_id = ex.conv_id AND so.cited = ex.cited)"""


def citation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations(spark, sf_dir)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim's reason: missing (no citation), out_of_range (one names no earlier turn), unsupported (no shared word), ok."""
    by_line = citations(spark, sf_dir).groupBy("conv_id", "turn", "line").agg(F.count(F.lit(1)).alias("n"), F.count("n_shared").alias("n_known"), F.max("n_shared").alias("most"))
    a = answers(spark, sf_dir).join(by_line, ["conv_id", "turn", "line"], "left")
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("n_known") < F.col("n"), "out_of_range").when(F.col("most") == 0, "unsupported").otherwise("ok")
    return a.select("conv_id", "turn", "line", "claim", reason.alias("reason"))


JUDGED = f"""{CITATIONS}, bl AS (SELECT conv_id, turn, line, count(*) AS n, count(n_shared) AS n_known, max(n_shared) AS most FROM ci GROUP BY 1, 2, 3),
ju AS (SELECT cl.conv_id, cl.turn, cl.line, claim, CASE WHEN n IS NULL THEN 'missing' WHEN n_known < n THEN 'out_of_range' WHEN most = 0 THEN 'unsupported' ELSE 'ok' END AS reason FROM cl LEFT JOIN bl ON bl.conv_id = cl.conv_id AND bl.turn = cl.turn AND bl.line = cl.line)"""


def claim_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("conv_id", "turn", "line", "reason")


def supported_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put together again from their supported claims, in order, with what was left out."""
    ok = F.col("reason") == "ok"
    kept = F.array_sort(F.collect_list(F.when(ok, F.struct("line", "claim"))))
    text = F.array_join(F.transform(kept, lambda x: x["claim"]), "\n")
    return judged(spark, sf_dir).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_claims"), F.count(F.when(ok, 1)).alias("n_kept"), F.sha2(text, 256).alias("answer_sha256"), *[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in ("missing", "out_of_range", "unsupported")])


ANSWERS = f"""WITH {JUDGED} SELECT conv_id, turn, count(*) AS n_claims, count(*) FILTER (reason = 'ok') AS n_kept, sha256(coalesce(string_agg(claim, chr(10) ORDER BY line) FILTER (reason = 'ok'), '')) AS answer_sha256,
  count(*) FILTER (reason = 'missing') AS missing, count(*) FILTER (reason = 'out_of_range') AS out_of_range, count(*) FILTER (reason = 'unsupported') AS unsupported FROM ju GROUP BY 1, 2"""


def citation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every claim that isn't supported, the earlier turn that shares most words with it, the first of equals; null where none shares any."""
    bad = judged(spark, sf_dir).where("reason <> 'ok'").select("conv_id", "turn", "line", "reason", F.array_distinct(tokens(F.regexp_replace("claim", r"\[[0-9, ]+\]", ""))).alias("said"))
    words = bad.select("conv_id", "turn", "line", F.explode("said").alias("word"))
    near = sources(spark, sf_dir).select("conv_id", "cited", F.explode("words").alias("word"))
    met = words.join(near, ["conv_id", "word"]).where(F.col("cited") <= F.col("turn")).groupBy("conv_id", "turn", "line", "cited").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("conv_id", "turn", "line").agg(F.max(F.struct("n", (-F.col("cited")).alias("c"))).alias("b")).select("conv_id", "turn", "line", (-F.col("b.c")).alias("repaired"), F.col("b.n").alias("n_shared"))
    return bad.drop("said").join(best, ["conv_id", "turn", "line"], "left")


_BARE = TOKENS_SQL.replace("coalesce(text, '')", r"regexp_replace(claim, '\[[0-9, ]+\]', '', 'g')")
REPAIR_SQL = f"""WITH {JUDGED}, ba AS (SELECT conv_id, turn, line, reason, list_distinct({_BARE}) AS said FROM ju WHERE reason <> 'ok'),
me AS (SELECT ba.conv_id, turn, line, cited, len(list_intersect(said, words)) AS n FROM ba JOIN so ON so.conv_id = ba.conv_id AND cited <= turn WHERE len(list_intersect(said, words)) > 0),
be AS (SELECT conv_id, turn, line, cited AS repaired, n AS n_shared FROM me QUALIFY row_number() OVER (PARTITION BY conv_id, turn, line ORDER BY n DESC, cited) = 1)
SELECT ba.conv_id, ba.turn, ba.line, reason, repaired, n_shared FROM ba LEFT JOIN be ON be.conv_id = ba.conv_id AND be.turn = ba.turn AND be.line = ba.line"""


def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each conversation's turns by the share of the first question's words they hold, four or more words long; three of each conversation."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    asked = c.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("q")).select("conv_id", F.array_distinct(tokens(F.col("q.text"))).alias("asked"))
    s = c.select("conv_id", "turn", F.posexplode(F.split("text", r"[.!?\n]+")).alias("place", "unit")).withColumn("words", F.array_distinct(tokens(F.col("unit")))).where(F.size("words") >= 4)
    score = F.when(F.size("asked") == 0, 0.0).otherwise(F.size(F.array_intersect("asked", "words")) / F.size("asked"))
    met = s.join(asked, "conv_id").select("conv_id", "turn", F.col("place").cast("long").alias("place"), r6(score).alias("score"))
    return met.withColumn("rank", _n(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn", "place"))).where("rank <= 3")


_UNIT = f"list_distinct({TOKENS_SQL.replace('text', 'unit')})"
UNITS_SQL = rf"""WITH tu AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY 1, 2), qs AS (SELECT conv_id, list_distinct({TOKENS_SQL}) AS asked FROM tu QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
su AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS unit, unnest(range(0, len(regexp_split_to_array(text, '[.!?\n]+')))) AS place FROM tu),
sw AS (SELECT su.conv_id, turn, place, asked, {_UNIT} AS words FROM su JOIN qs USING (conv_id)),
sc AS (SELECT conv_id, turn, place, round(CASE WHEN len(asked) = 0 THEN 0 ELSE len(list_intersect(asked, words))::DOUBLE / len(asked) END, 6) AS score FROM sw WHERE len(words) >= 4)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, place) AS rank FROM sc QUALIFY rank <= 3"""


def dialogue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State before each user turn: its number among the user's, the last question of some length, and the roles seen so far."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    long_question = F.when((F.col("role") == "user") & (F.char_length("text") >= 60), F.col("turn"))
    s = c.select("conv_id", "turn", "role", F.last(long_question, ignorenulls=True).over(before).alias("last_question"), F.count(F.when(F.col("role") == "user", 1)).over(before).alias("n_asked"), F.count(F.when(F.col("role") == "assistant", 1)).over(before).alias("n_answered"))
    return s.where("role = 'user'").drop("role")


STATE_SQL = """WITH c AS (SELECT conv_id, turn, min(role) AS role, min(coalesce(text, '')) AS text FROM conversations GROUP BY 1, 2),
s AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' AND length(text) >= 60 THEN turn END IGNORE NULLS) OVER w AS last_question, count(*) FILTER (role = 'user') OVER w AS n_asked, count(*) FILTER (role = 'assistant') OVER w AS n_answered
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn, last_question, n_asked, n_answered FROM s WHERE role = 'user'"""


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five gates of every benchmark item (text, length, words, one of its kind, letters) and whether it passes all."""
    t = F.coalesce("text", F.lit(""))
    key = F.regexp_replace(F.lower(t), r"\s+", "")
    same = F.count(F.lit(1)).over(Window.partitionBy("key"))
    g = load(spark, sf_dir, "benchmark").withColumn("key", key).select(
        "item_id", F.col("text").isNotNull().alias("has_text"), F.char_length(t).between(40, 4000).alias("fits"), (F.size(F.array_distinct(tokens(F.col("text")))) >= 8).alias("varied"), (same == 1).alias("unique"), t.rlike("^[A-Z]").alias("begins")
    )
    return g.withColumn("passed", F.col("has_text") & F.col("fits") & F.col("varied") & F.col("unique") & F.col("begins"))


GATES_SQL = rf"""WITH g AS (SELECT item_id, text IS NOT NULL AS has_text, length(coalesce(text, '')) BETWEEN 40 AND 4000 AS fits, len(list_distinct({TOKENS_SQL})) >= 8 AS varied,
  count(*) OVER (PARTITION BY regexp_replace(lower(coalesce(text, '')), '\s+', '', 'g')) = 1 AS "unique", regexp_matches(coalesce(text, ''), '^[A-Z]') AS begins FROM benchmark) SELECT *, has_text AND fits AND varied AND "unique" AND begins AS passed FROM g"""

QUERIES = {f.__name__: f for f in (citation_spans, claim_citations, supported_answers, citation_repair, evidence_units, dialogue_state, quality_gates)}
ORACLES = {
    "citation_spans": f"WITH {CITATIONS} SELECT * FROM ci", "claim_citations": f"WITH {JUDGED} SELECT conv_id, turn, line, reason FROM ju", "supported_answers": ANSWERS,
    "citation_repair": REPAIR_SQL, "evidence_units": UNITS_SQL, "dialogue_state": STATE_SQL, "quality_gates": GATES_SQL,
}
