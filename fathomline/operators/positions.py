"""Words with their places: phrases of any length, words near others, forbidden claims and their negation, modality of clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ascii_bounds, load
from .scratch import written

#: Fixed value: a negation counts for a claim within so many characters before or behind it.
REACH = 36
#: Words that forbid, oblige, advise and allow, the first that fits a clause; and words that deny.
MODALITY = [("prohibited", r"\b(shall|must|may|should|can) not\b|\bcannot\b|\bprohibited\b"), ("mandatory", r"\b(shall|must|required)\b"), ("recommended", r"\b(should|recommended)\b"), ("permitted", r"\b(may|can|could|permitted)\b")]
VERBS = ["is", "are", "was", "be", "must", "shall", "should", "may", "can", "will", "ist", "sind", "soll", "muss", "kann", "es", "son", "puede", "debe", "est", "sont", "peut", "doit"]
DENIALS = ["not", "no", "never", "without", "kein", "keine", "nicht", "sin", "nunca", "sans", "jamais", "pas", "ne"]
MARKERS = ["not ", "no ", "cannot", "never", "without", "nicht", "kein", "sans", "jamais"]
_WORD = "[a-z0-9]+"


def word_positions(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word, at, until of every word of the lower-case texts (doc_id, text), ``at`` and ``until`` in characters; ids are taken to be unique.

    Places are sums over the words and gaps before: no text is searched again.
    """
    t = F.lower(F.coalesce("text", F.lit("")))
    pairs = docs.select("doc_id", F.posexplode(F.arrays_zip(F.split(t, _WORD).alias("gap"), F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)).alias("word"))).alias("pos", "p"))
    upto = F.sum(F.char_length("p.gap") + F.coalesce(F.char_length("p.word"), F.lit(0))).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    placed = pairs.select("doc_id", "pos", F.col("p.word").alias("word"), upto.alias("until")).where("word IS NOT NULL")
    return placed.select("doc_id", F.col("pos").cast("long").alias("pos"), "word", (F.col("until") - F.char_length("word")).alias("at"), "until")


def phrase_hits(positions: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, phrase_id, pos, at, until of every occurrence of ``phrases`` (phrase_id, words), of any length, overlaps included.

    A phrase is looked for at its rarest word only; where that stands, its
    other words are asked for by document and place.  ``positions`` is read
    several times: write it first where it is costly.
    """
    asked = phrases.where(F.size("words") > 0).select("phrase_id", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    counts = positions.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("cf"))
    rarest = asked.join(counts, "word", "left").groupBy("phrase_id", "n").agg(F.min(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "i", "word")).alias("a"))
    anchors = rarest.where("a.cf > 0").select("phrase_id", "n", F.col("a.i").alias("i"), F.col("a.word").alias("word"))
    starts = positions.join(anchors, "word").select("doc_id", "phrase_id", "n", (F.col("pos") - F.col("i")).alias("start")).where("start >= 0")
    wanted = starts.join(asked.select("phrase_id", "i", "word"), "phrase_id").select("doc_id", "phrase_id", "n", "start", (F.col("start") + F.col("i")).alias("pos"), "word")
    stands = wanted.join(positions, ["doc_id", "pos", "word"]).groupBy("doc_id", "phrase_id", "n", F.col("start").alias("pos")).agg(F.count(F.lit(1)).alias("k"), F.min("at").alias("at"), F.max("until").alias("until"))
    return stands.where("k = n").select("doc_id", "phrase_id", "pos", "at", "until")


def within_reach(first: DataFrame, second: DataFrame, reach: int = REACH) -> DataFrame:
    """``first`` (doc_id, at, until, ...) with ``near``: does something of ``second`` (doc_id, at, until) begin or end within ``reach`` characters of it?

    Both are dealt to stretches of the text as long as the reach, so that only
    neighbours meet, however long a text is.
    """
    key = F.struct("doc_id", "at", "until")
    spread = first.select("doc_id", "at", "until").distinct().select("*", F.explode(F.sequence(F.floor((F.col("at") - reach) / reach), F.floor((F.col("until") + reach) / reach))).alias("stretch"))
    other = second.select("doc_id", F.col("at").alias("b_at"), F.col("until").alias("b_until")).withColumn("stretch", F.explode(F.sequence(F.floor(F.col("b_at") / reach), F.floor((F.col("b_until") - 1) / reach))))
    met = spread.join(other, ["doc_id", "stretch"]).where((F.col("b_at") < F.col("until") + reach) & (F.col("b_until") > F.col("at") - reach) & ((F.col("b_until") <= F.col("at")) | (F.col("b_at") >= F.col("until"))))
    found = met.select(key.alias("k")).distinct().select("k.*", F.lit(True).alias("near"))
    return first.join(found, ["doc_id", "at", "until"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def forbidden_claims(answers: DataFrame, claims: DataFrame, markers: list[str] = MARKERS) -> DataFrame:
    """answer_id, claim, violated of claims (answer_id, claim) that stand in their answer (answer_id, text), in any case.

    A claim is violated unless a marker of negation stands in its first place
    or within ``REACH`` characters of that.  Empty claims and nulls stand nowhere.
    """
    c = claims.select("answer_id", "claim", F.trim(F.lower("claim")).alias("needle")).where("needle <> ''").distinct()
    met = answers.select("answer_id", F.lower("text").alias("said")).join(c, "answer_id").withColumn("at", F.instr("said", F.col("needle"))).where("at > 0")
    begin = F.greatest(F.col("at") - REACH, F.lit(1))
    window = F.substring("said", begin, F.col("at") - begin + F.char_length("needle") + REACH)
    denied = F.lit(False)
    for m in markers:
        denied |= F.contains(window, F.lit(m))
    return met.select("answer_id", "claim", (~denied).alias("violated"))


def modality(clause: Column) -> Column:
    """What a clause says may be done: the first of ``MODALITY`` that fits, else none."""
    text, out = F.lower(clause), F.lit("none")
    for name, pattern in reversed(MODALITY):
        out = F.when(text.rlike(ascii_bounds(pattern)), name).otherwise(out)
    return out


def benchmark_phrases(items: DataFrame) -> DataFrame:
    """phrase_id, item_id, words: every four words of an item in a row."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0))
    w = items.select("item_id", words.alias("w")).where(F.size("w") >= 4)
    four = w.select("item_id", F.explode(F.sequence(F.lit(1), F.size("w") - 3)).alias("i"), "w").select("item_id", F.slice("w", F.col("i"), F.lit(4)).alias("words")).distinct()
    return four.select(F.array_join("words", " ").alias("phrase_id"), "item_id", "words")


def four_words(docs: DataFrame) -> DataFrame:
    """doc_id, pos, phrase_id of every four words in a row of the lower-case texts (doc_id, text); each text stays in its row."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0))
    w = docs.select("doc_id", F.explode(F.array(words)).alias("w")).where(F.size("w") >= 4)
    each = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))
    return w.select("doc_id", F.posexplode(each).alias("pos", "phrase_id")).select("doc_id", F.col("pos").cast("long").alias("pos"), "phrase_id")


def phrase_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where phrases of four words of the benchmark stand in documents: how often and first, per item and document."""
    phrases = written(benchmark_phrases(load(spark, sf_dir, "benchmark")).select("phrase_id", "item_id"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    met = four_words(docs).join(phrases, "phrase_id").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    met = written(met)
    # only texts with a phrase are looked at again, for the character at which the first one begins
    t = F.lower(F.coalesce("text", F.lit("")))
    size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    pos = F.col("first_pos").cast("int")
    at = size(F.split(t, _WORD), pos + 1) + size(F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)), pos)
    return docs.join(met, "doc_id").select("item_id", "doc_id", "n", "first_pos", at.alias("first_at"))


_POSITIONS = f"""pg AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{_WORD}')) AS gap, unnest(list_append(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}'), NULL)) AS word, unnest(range(0, len(regexp_split_to_array(lower(coalesce(text, '')), '{_WORD}')))) AS pos FROM documents),
po AS (SELECT doc_id, pos, word, (sum(length(gap) + coalesce(length(word), 0)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS until FROM pg QUALIFY word IS NOT NULL)"""
PHRASE_SQL = rf"""WITH {_POSITIONS}, b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM benchmark), q AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 3], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM b WHERE len(w) >= 4)),
f AS (SELECT doc_id, pos, until - length(word) AS at_, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w AS phrase FROM po WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT item_id, doc_id, count(*) AS n, min(pos) AS first_pos, min(at_) AS first_at FROM f JOIN q USING (phrase) GROUP BY 1, 2"""


def denied_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with forms of to be and modal verbs: how many, and how many with a denial within reach."""
    p = word_positions(load(spark, sf_dir, "documents").select("doc_id", "text"))
    modal = p.where(F.col("word").isin(*VERBS))
    near = within_reach(modal.select("doc_id", "at", "until"), p.where(F.col("word").isin(DENIALS)))
    return near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_verbs"), F.count(F.when(F.col("near"), 1)).alias("n_denied"))


_IN, _VERBS = (", ".join(f"'{w}'" for w in words) for words in (DENIALS, VERBS))
DENIED_SQL = f"""WITH {_POSITIONS}, m AS (SELECT doc_id, until - length(word) AS a, until AS u FROM po WHERE word IN ({_VERBS})),
d AS (SELECT doc_id, until - length(word) AS a, until AS u FROM po WHERE word IN ({_IN}))
SELECT m.doc_id, count(*) AS n_verbs, count(*) FILTER (EXISTS (SELECT 1 FROM d WHERE d.doc_id = m.doc_id AND d.a < m.u + {REACH} AND d.u > m.a - {REACH} AND (d.u <= m.a OR d.a >= m.u))) AS n_denied FROM m GROUP BY 1"""


def claim_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against the words of five letters and more of the user's turn before: which of them they say, and say undenied."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text")).withColumn("asked", F.lag("text").over(w)).where("role = 'assistant'")
    answers = c.select(F.format_string("%d/%d", "conv_id", "turn").alias("answer_id"), "text", "asked")
    claims = answers.select("answer_id", F.explode(F.regexp_extract_all(F.coalesce("asked", F.lit("")), F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("claim"))
    return forbidden_claims(answers, claims)


_DENIED = " OR ".join(f"contains(win, '{m}')" for m in MARKERS)
VIOLATION_SQL = f"""WITH c AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2), a AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM c),
q AS (SELECT DISTINCT conv_id || '/' || turn AS answer_id, lower(text) AS said, unnest(regexp_extract_all(coalesce(asked, ''), '[A-Za-z]{{5,}}')) AS claim FROM a WHERE role = 'assistant'),
s AS (SELECT *, strpos(said, lower(claim)) AS p FROM q), k AS (SELECT *, substr(said, greatest(p - {REACH}, 1)::BIGINT, (p - greatest(p - {REACH}, 1) + length(claim) + {REACH})::BIGINT) AS win FROM s WHERE p > 0)
SELECT answer_id, claim, NOT ({_DENIED}) AS violated FROM k"""


def clause_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of documents by source and modality, and in how many documents."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.explode(F.split(F.coalesce("text", F.lit("")), "[.;!?\n]+")).alias("clause")).where(F.trim("clause") != "")
    return d.groupBy("source", modality(F.col("clause")).alias("modality")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_MODAL = "CASE " + " ".join(f"WHEN regexp_matches(lower(clause), '{p}') THEN '{n}'" for n, p in MODALITY) + " ELSE 'none' END"
CLAUSE_SQL = rf"""SELECT source, {_MODAL} AS modality, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, coalesce(source, '') AS source, unnest(regexp_split_to_array(coalesce(text, ''), '[.;!?\n]+')) AS clause FROM documents) WHERE trim(clause, ' ') <> '' GROUP BY 1, 2"""

QUERIES = {f.__name__: f for f in (phrase_positions, denied_verbs, claim_violations, clause_modality)}
ORACLES = {"phrase_positions": PHRASE_SQL, "denied_verbs": DENIED_SQL, "claim_violations": VIOLATION_SQL, "clause_modality": CLAUSE_SQL}
