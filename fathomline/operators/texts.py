"""Sparse retrieval, text features, classifiers and chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import TOKENS_SQL, load, r6, tokens
from .inverted import EPSILON, K1, B, best_documents, okapi, text_index
from .scratch import written

TOP = 5


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term, qtf."""
    return items.select("item_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def top_ranked(scored: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The ``n`` best items of each group with their rank; ties by item."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), item)
    # a bare row number under a bound: each task sends its own best rows only
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return best.withColumn("rank", F.col("rank").cast("long"))


OKAPI = f"""
t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, count(*) AS df, ln(any_value(n.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {EPSILON} * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT item_id, tf.doc_id, round(sum(qtf * idf * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, n GROUP BY 1, 2 HAVING score > 0)
"""


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and occurrences of every term."""
    return text_index(spark, sf_dir).terms().select("term", "df", "cf", "max_tf")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for every benchmark item."""
    return top_ranked(okapi(text_index(spark, sf_dir), load(spark, sf_dir, "benchmark")), "item_id", "doc_id", TOP)


def bm25_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``bm25_topk``, reading only blocks of the index whose bound reaches the fifth best score of the most promising ones."""
    return top_ranked(best_documents(text_index(spark, sf_dir), load(spark, sf_dir, "benchmark"), TOP), "item_id", "doc_id", TOP)


def fts_phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any two neighbouring words of an item, by BM25 of these phrases with k1 = 1.2."""

    def pairs(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
        return words.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).alias("phrase"))

    docs = load(spark, sf_dir, "documents")
    q = pairs(load(spark, sf_dir, "benchmark"), "item_id").distinct()
    # only phrases of the items are counted
    tf = pairs(docs, "doc_id").join(q.select("phrase").distinct(), "phrase", "left_semi").groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("tf"))
    sizes = docs.select("doc_id", F.size(tokens(F.col("text"))).cast("double").alias("len"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    df = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(whole, F.lit(True), "left").select("phrase", "avgdl", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"))
    part = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avgdl")))
    scored = tf.join(idf, "phrase").join(sizes, "doc_id").join(q, "phrase").groupBy("item_id", "doc_id").agg(r6(F.sum(part)).alias("score"))
    return top_ranked(scored, "item_id", "doc_id", TOP)


_PAIRS = "unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
FTS_SQL = f"""WITH d AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents), b AS (SELECT item_id, {TOKENS_SQL} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, phrase FROM (SELECT item_id, {_PAIRS} AS phrase FROM b WHERE len(w) > 1)),
tf AS (SELECT doc_id, phrase, count(*) AS tf FROM (SELECT doc_id, {_PAIRS} AS phrase FROM d WHERE len(w) > 1) WHERE phrase IN (SELECT phrase FROM q) GROUP BY 1, 2),
n AS (SELECT count(*) AS n, avg(len(w)::DOUBLE) AS avgdl FROM d),
idf AS (SELECT phrase, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, n GROUP BY 1),
s AS (SELECT item_id, tf.doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * len(w) / avgdl))), 6) AS score FROM tf JOIN idf USING (phrase) JOIN d ON d.doc_id = tf.doc_id JOIN q USING (phrase), n GROUP BY 1, 2)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {TOP}"""


def scoped_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best document of each source per item: capped idf weights, with a bonus for words in the heading (the first line)."""
    docs, index = load(spark, sf_dir, "documents"), text_index(spark, sf_dir)
    heads = docs.select("doc_id", "source", tokens(F.get(F.split("text", "\n"), F.lit(0))).alias("head"))
    # tables of sources and asked words, known to be small once written
    sizes = written(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    q = written(index.weighted(load(spark, sf_dir, "benchmark")).select("item_id", "term"))
    of_items = index.postings(q).join(heads, "doc_id")
    df = written(index.postings(q).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "term").agg(F.count(F.lit(1)).alias("df")))
    met = of_items.join(df, ["source", "term"]).join(sizes, "source")
    weight = F.least(F.lit(2.8), 0.75 + 0.38 * F.log(1 + (F.col("n") + 1) / (F.col("df") + 1.0)))
    part = weight * F.when(F.array_contains("head", F.col("term")), 1.45).otherwise(1.0)
    scored = met.withColumn("part", part).join(q, "term").groupBy("item_id", "source", "doc_id").agg(F.sum("part").alias("s"), F.count(F.lit(1)).alias("hits"))
    scored = scored.withColumn("score", r6(F.col("s") + F.least(F.lit(0.8), 0.08 * F.col("hits"))))
    best = Window.partitionBy("item_id", "source").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("n", F.row_number().over(best)).where("n = 1").select("item_id", "source", "doc_id", "hits", "score")


SCOPED_SQL = f"""WITH h AS (SELECT doc_id, source, {TOKENS_SQL.replace("coalesce(text, '')", "coalesce(split_part(text, chr(10), 1), '')")} AS head FROM documents),
tf AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark),
m AS (SELECT tf.doc_id, tf.term, source, head, count(*) OVER (PARTITION BY source, tf.term) AS df FROM tf JOIN h ON h.doc_id = tf.doc_id WHERE tf.term IN (SELECT term FROM q)),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
s AS (SELECT item_id, m.source, doc_id, count(*) AS hits, sum(least(2.8::DOUBLE, 0.75::DOUBLE + 0.38::DOUBLE * ln(1 + (n + 1)::DOUBLE / (df + 1))) * CASE WHEN list_contains(head, term) THEN 1.45::DOUBLE ELSE 1 END) AS s FROM m JOIN n ON n.source = m.source JOIN q USING (term) GROUP BY 1, 2, 3)
SELECT item_id, source, doc_id, hits, round(s + least(0.8::DOUBLE, 0.08::DOUBLE * hits), 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) = 1"""


def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each item's words that its best documents hold (five of them)."""
    q = query_terms(load(spark, sf_dir, "benchmark"))
    p = text_index(spark, sf_dir).postings(q).select("doc_id", "term")
    total = q.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    met = p.join(q, "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("m")).join(total, "item_id")
    return top_ranked(met.select("item_id", "doc_id", r6(F.col("m") / F.col("n")).alias("score")), "item_id", "doc_id", TOP)


OVERLAP_SQL = f"""WITH q AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
p AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS term FROM documents), s AS (SELECT item_id, doc_id, round(count(*)::DOUBLE / any_value(n), 6) AS score FROM p JOIN q USING (term) JOIN n USING (item_id) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {TOP}"""


def char_grams(text: Column, n: int) -> Column:
    """Distinct n-grams of the lower-case text without white space."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


_G3 = "list_distinct([t[i:i + 2] FOR i IN range(1, greatest(length(t) - 1, 1))])"


def char3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's nearest other item by three-letter grams."""
    g = load(spark, sf_dir, "benchmark").select("item_id", F.explode(char_grams(F.col("text"), 3)).alias("g"))
    n = g.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    other = g.select(F.col("item_id").alias("peer"), "g")
    both = g.join(other, "g").where("item_id <> peer").groupBy("item_id", "peer").agg(F.count(F.lit(1)).alias("m"))
    s = both.join(n, "item_id").join(n.select(F.col("item_id").alias("peer"), F.col("n").alias("k")), "peer").withColumn("score", r6(F.col("m") / (F.col("n") + F.col("k") - F.col("m"))))
    return top_ranked(s.select("item_id", "peer", "score"), "item_id", "peer", 1)


JACCARD_SQL = rf"""WITH b AS (SELECT item_id, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM benchmark), g AS (SELECT item_id, unnest({_G3}) AS g FROM b WHERE length(t) > 2),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1), m AS (SELECT a.item_id, b.item_id AS peer, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.item_id <> b.item_id GROUP BY 1, 2),
s AS (SELECT m.item_id, peer, round(m::DOUBLE / (x.n + y.n - m), 6) AS score FROM m JOIN n x ON x.item_id = m.item_id JOIN n y ON y.item_id = peer)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, peer) AS rank FROM s QUALIFY rank <= 1"""

#: Prototypes of the vote below: a few words of each language.
PROTOTYPES = {"de": "die und der von mit den ist nicht", "en": "the and of that with this are from", "es": "que los las del por para una con", "fr": "les des que pour dans une qui sur"}


def ngram_cosine_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each conversation turn by the cosine of two-letter counts: best of 0.30 at least and 0.05 ahead, else none."""
    turns = load(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")

    def grams(text: Column) -> Column:
        t = F.lower(text)
        return F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))

    protos = spark.createDataFrame([(k, v) for k, v in PROTOTYPES.items()], "label string, text string")
    pc = protos.select("label", F.explode(grams(F.col("text"))).alias("g")).groupBy("label", "g").agg(F.count(F.lit(1)).alias("p"))
    pn = pc.groupBy("label").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("pn"))
    tc = turns.select("conv_id", "turn", F.explode(grams(F.col("text"))).alias("g")).groupBy("conv_id", "turn", "g").agg(F.count(F.lit(1)).alias("c"))
    tn = tc.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("tn"))
    cos = tc.join(pc, "g").groupBy("conv_id", "turn", "label").agg(F.sum(F.col("c") * F.col("p")).alias("dot")).join(tn, ["conv_id", "turn"]).join(pn, "label")
    cos = cos.withColumn("score", r6(F.col("dot") / (F.col("tn") * F.col("pn"))))
    w = Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "label")
    best = cos.withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("n", F.row_number().over(w)).where("n = 1")
    sure = (F.col("score") >= 0.3) & (F.round(F.col("score") - F.col("second"), 6) >= 0.05)
    return best.select("conv_id", "turn", F.when(sure, F.col("label")).otherwise("none").alias("label"), "score")


_G2 = "unnest([t[i:i + 1] FOR i IN range(1, length(t))])"
VOTE_SQL = f"""WITH p AS (SELECT label, {_G2} AS g FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in PROTOTYPES.items())}) x(label, t)), pc AS (SELECT label, g, count(*) AS p FROM p GROUP BY 1, 2),
pn AS (SELECT label, sqrt(sum(p * p)) AS pn FROM pc GROUP BY 1), t AS (SELECT conv_id, turn, {_G2} AS g FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations) WHERE length(t) > 1),
tc AS (SELECT conv_id, turn, g, count(*) AS c FROM t GROUP BY 1, 2, 3), tn AS (SELECT conv_id, turn, sqrt(sum(c * c)) AS tn FROM tc GROUP BY 1, 2),
s AS (SELECT conv_id, turn, label, round(sum(c * p) / (any_value(tn) * any_value(pn)), 6) AS score FROM tc JOIN pc USING (g) JOIN tn USING (conv_id, turn) JOIN pn USING (label) GROUP BY 1, 2, 3),
b AS (SELECT *, coalesce(lead(score) OVER (PARTITION BY conv_id, turn ORDER BY score DESC, label), 0) AS second, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, label) AS n FROM s)
SELECT conv_id, turn, CASE WHEN score >= 0.3 AND round(score - second, 6) >= 0.05 THEN label ELSE 'none' END AS label, score FROM b WHERE n = 1"""


def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substantive length, distinct words, thinness and boilerplate of every document."""
    d = load(spark, sf_dir, "documents")
    flat = F.length(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " "), "^ | $", ""))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda w: F.length(w) > 0)
    upper = F.size(F.filter("words", lambda w: w.rlike("[A-Z]") & ~w.rlike("[a-z]")))
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0))
    base = d.select("doc_id", flat.cast("long").alias("n_flat"), words.alias("words"), F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("n_distinct"), lines.cast("long").alias("n_lines"))
    thin = (F.col("n_flat") < 140) | ((F.col("n_lines") <= 2) & (F.col("n_flat") < 220))
    boiler = (F.size("words") >= 12) & (upper > 0.45 * F.size("words"))
    return base.select("doc_id", "n_flat", "n_distinct", "n_lines", thin.alias("is_thin"), boiler.alias("is_boilerplate"), ((F.col("n_flat") >= 90) & (F.col("n_distinct") >= 14) & ~boiler).alias("is_substantive"))


QUALITY_SQL = rf"""WITH d AS (SELECT doc_id, length(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'), '^ | $', '', 'g')) AS n_flat,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda w: length(w) > 0) AS words, len(list_distinct({TOKENS_SQL})) AS n_distinct,
  len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) > 0)) AS n_lines FROM documents),
b AS (SELECT *, len(words) >= 12 AND len(list_filter(words, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) > 0.45 * len(words) AS is_boilerplate FROM d)
SELECT doc_id, n_flat, n_distinct, n_lines, n_flat < 140 OR (n_lines <= 2 AND n_flat < 220) AS is_thin, is_boilerplate, n_flat >= 90 AND n_distinct >= 14 AND NOT is_boilerplate AS is_substantive FROM b"""


def index_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to index: long enough, and not on the skip list of bad or toxic labels."""
    skip = load(spark, sf_dir, "labels").where("quality = 0 OR toxic = 1").select("doc_id")
    return load(spark, sf_dir, "documents").where(F.length("text") >= 80).join(skip, "doc_id", "left_anti").select("doc_id", "source", "lang", "n_chars")


ELIGIBLE_SQL = "SELECT doc_id, source, lang, n_chars FROM documents WHERE length(text) >= 80 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE (quality = 0 OR toxic = 1) AND doc_id IS NOT NULL)"


def fixed_stride_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 420 words, 60 of them shared with the next window."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda w: F.length(w) > 0).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 61, F.lit(0)), F.lit(360))
    c = d.where(F.size("w") > 0).select("doc_id", "w", F.posexplode(starts).alias("i", "at"))
    part = F.slice("w", F.col("at") + 1, F.lit(420))
    return c.select("doc_id", F.format_string("%d__e%03d", "doc_id", F.col("i") + 1).alias("chunk_id"), F.col("at").cast("long").alias("first_word"), F.size(part).cast("long").alias("n_words"), F.sha2(F.array_join(part, " "), 256).alias("text_sha256"))


CHUNKS_SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda w: length(w) > 0) AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 60, 1), 360)) AS a FROM d WHERE len(w) > 0)
SELECT doc_id, printf('%d__e%03d', doc_id, CAST(a / 360 AS BIGINT) + 1) AS chunk_id, a AS first_word, len(w[a + 1:a + 420]) AS n_words, sha256(array_to_string(w[a + 1:a + 420], ' ')) AS text_sha256 FROM c"""


def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id"), F.min("lang").alias("first_lang"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.countDistinct("lang").alias("n_langs"), F.countDistinct("text").alias("n_texts"))


PROFILE_SQL = "SELECT source, count(*) AS n_docs, min(doc_id) AS first_id, min(lang) AS first_lang, min(n_chars) AS min_chars, max(n_chars) AS max_chars, count(DISTINCT lang) AS n_langs, count(DISTINCT text) AS n_texts FROM documents GROUP BY 1"


def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


def grouping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label means and medians overall, by language and by source."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return spark.sql("""SELECT lang, source, CAST(grouping_id() AS BIGINT) AS cut, count(*) AS n, count(quality) AS n_labelled, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, CAST(median(n_chars) AS DOUBLE) AS median_chars
      FROM {labelled} GROUP BY GROUPING SETS ((), (lang), (source))""", labelled=d)


GROUPING_SQL = """SELECT lang, source, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS cut, count(*) AS n, count(quality) AS n_labelled, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, CAST(median(n_chars) AS DOUBLE) AS median_chars
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))"""


def page_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 50 documents: how many, how many labelled good, and their languages."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    band = (F.expr("doc_id div 50") * 50 + 1).alias("band")
    return d.groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


BANDS_SQL = "SELECT doc_id // 50 * 50 + 1 AS band, count(*) AS n, count(hit) AS hits, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents LEFT JOIN (SELECT doc_id, 1 AS hit FROM labels WHERE quality = 1) USING (doc_id) GROUP BY 1"


def path_source_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, category and priority from a page's address."""
    p = load(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    category = F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1)
    site = F.regexp_extract(host, "([a-z0-9-]+[.][a-z]+)$", 1)
    return p.select("page_id", host.alias("host"), F.upper(F.regexp_replace(site, "[^A-Za-z0-9]+", "_")).alias("source"), F.when(category == "", "unknown").otherwise(category).alias("category"), F.when(F.col("url").startswith("https"), 1).otherwise(3).cast("long").alias("priority"))


PATH_SQL = """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, upper(regexp_replace(regexp_extract(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '([a-z0-9-]+[.][a-z]+)$', 1), '[^A-Za-z0-9]+', '_', 'g')) AS source,
  CASE WHEN regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) = '' THEN 'unknown' ELSE regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) END AS category, CASE WHEN starts_with(url, 'https') THEN 1 ELSE 3 END::BIGINT AS priority FROM pages"""


def sha1_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name from the address; where several pages share it, each gets a hash of its own row."""
    p = load(spark, sf_dir, "pages")
    stem = F.lower(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "[^A-Za-z0-9]+", "_"))
    named = p.select("page_id", "url", stem.alias("stem"))
    shared = named.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(shared, "stem", "left").select("page_id", F.when(F.col("n") > 1, F.concat("stem", F.lit("_"), F.substring(F.sha1(F.concat_ws("#", "url", "page_id")), 1, 8))).otherwise(F.col("stem")).alias("doc_key"))


SHA1_SQL = """SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN stem || '_' || substr(sha1(url || '#' || page_id), 1, 8) ELSE stem END AS doc_key
FROM (SELECT page_id, url, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^A-Za-z0-9]+', '_', 'g')) AS stem FROM pages)"""

#: The first pattern that fits names a document's role.
ROLES = [("licence", "licensed under|all rights reserved"), ("table", " [|] "), ("secret", "token *="), ("contact", "@[a-z0-9.]+[.]com"), ("list", "\n- ")]


def doc_role_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower(F.coalesce("text", F.lit("")))
    role = F.when(t == "", "empty")
    for name, pattern in ROLES:
        role = role.when(t.rlike(pattern), name)
    return load(spark, sf_dir, "documents").select("doc_id", role.otherwise("prose").alias("role"))


ROLE_SQL = "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in ROLES) + " ELSE 'prose' END AS role FROM documents"


def near_dup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose normalised texts begin with the same 70 letters (this key is the feature)."""
    key = F.substring(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""), 1, 70)
    k = load(spark, sf_dir, "documents").select("doc_id", key.alias("key")).where("key <> ''")
    return k.groupBy("key").agg(F.min("doc_id").alias("kept_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kept_id", "n", "key")


PREFIX_SQL = "SELECT min(doc_id) AS kept_id, count(*) AS n, substr(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 1, 70) AS key FROM documents WHERE text IS NOT NULL GROUP BY key HAVING n > 1 AND key <> ''"


def dup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("text").alias("n"), F.countDistinct("text").alias("k"))
    return d.select("source", "n", r6((F.col("n") - F.col("k")) / F.col("n")).alias("ratio"))


QUERIES = {f.__name__: f for f in (token_stats, bm25_topk, bm25_blocks, fts_phrase_topk, scoped_sparse, lexical_overlap, char3_jaccard, ngram_cosine_vote, chunk_quality, index_eligibility, fixed_stride_chunks, doc_profile, source_histogram, grouping_summary, page_bands, path_source_category, sha1_doc_id, doc_role_ladder, near_dup_prefix, dup_ratio)}
ORACLES = {
    "token_stats": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1",
    "bm25_topk": f"WITH {OKAPI} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {TOP}",
    "bm25_blocks": f"WITH {OKAPI} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {TOP}",
    "fts_phrase_topk": FTS_SQL,
    "scoped_sparse": SCOPED_SQL,
    "lexical_overlap": OVERLAP_SQL,
    "char3_jaccard": JACCARD_SQL,
    "ngram_cosine_vote": VOTE_SQL,
    "chunk_quality": QUALITY_SQL,
    "index_eligibility": ELIGIBLE_SQL,
    "fixed_stride_chunks": CHUNKS_SQL,
    "doc_profile": PROFILE_SQL,
    "source_histogram": "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2",
    "grouping_summary": GROUPING_SQL,
    "page_bands": BANDS_SQL,
    "path_source_category": PATH_SQL,
    "sha1_doc_id": SHA1_SQL,
    "doc_role_ladder": ROLE_SQL,
    "near_dup_prefix": PREFIX_SQL,
    "dup_ratio": "SELECT source, count(text) AS n, round((count(text) - count(DISTINCT text))::DOUBLE / count(text), 6) AS ratio FROM documents GROUP BY 1",
}
