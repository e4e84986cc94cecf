"""Corpus building: manifests, index rows, rendered texts, evaluation sets, and tables written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import TOKENS_SQL, load, r6, tokens
from ..sources.tables import scratch_folder
from .evidence import CUE_SQL, cue_scores
from .inverted import add_documents, build_index

CHUNK_WORDS, STRIDE, LEAST_CHARS = 60, 50, 40


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk, source, n_words, text of the chunks that belong in the index.

    Documents labelled toxic are quarantined and short ones left out; windows
    of 60 words begin every 50 words, the last one where the text ends.
    """
    bad = load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    d = load(spark, sf_dir, "documents").where(F.char_length("text") >= LEAST_CHARS).join(bad, "doc_id", "left_anti")
    words = d.select("doc_id", "source", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - CHUNK_WORDS) / STRIDE), F.lit(0)).cast("int"))
    chunks = words.select("doc_id", "source", "w", F.explode(starts).alias("chunk"))
    cut = F.slice("w", F.col("chunk") * STRIDE + 1, CHUNK_WORDS)
    return chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "source", F.size(cut).cast("long").alias("n_words"), F.array_join(cut, " ").alias("text"))


INDEX = rf"""dq AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE length(text) >= {LEAST_CHARS} AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
ix AS (SELECT doc_id, chunk, source, len(w[chunk * {STRIDE} + 1:chunk * {STRIDE} + {CHUNK_WORDS}]) AS n_words, array_to_string(w[chunk * {STRIDE} + 1:chunk * {STRIDE} + {CHUNK_WORDS}], ' ') AS text
  FROM (SELECT *, unnest(range(0, greatest(ceil((len(w) - {CHUNK_WORDS})::DOUBLE / {STRIDE}), 0)::BIGINT + 1)) AS chunk FROM dq WHERE len(w) > 0))"""


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's statistics for each source."""
    return index_rows(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.sum("n_words").alias("n_words"), F.max("chunk").alias("last_chunk"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would embed of each chunk: a role prefix, a header of its metadata, and the text; as a digest with its length."""
    head = F.concat_ws(" | ", F.concat(F.lit("source "), "source"), F.concat(F.lit("document "), F.col("doc_id").cast("string")), F.concat(F.lit("part "), F.col("chunk").cast("string")))
    text = F.concat(F.lit("passage: "), head, F.lit("\n"), "text")
    return index_rows(spark, sf_dir).select("doc_id", "chunk", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


_EMBED = "'passage: ' || concat_ws(' | ', 'source ' || source, 'document ' || doc_id, 'part ' || chunk) || chr(10) || text"
EMBED_SQL = f"WITH {INDEX} SELECT doc_id, chunk, length({_EMBED}) AS n_chars, sha256({_EMBED}) AS text_sha256 FROM ix"


def code_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as sparse terms: in lower case, with a space and without anything between name and number."""
    p = load(spark, sf_dir, "part").select("p_brand").distinct()
    name, number = F.lower(F.regexp_extract("p_brand", r"^([A-Za-z]+)\W*([0-9]+)$", 1)), F.regexp_extract("p_brand", r"^([A-Za-z]+)\W*([0-9]+)$", 2)
    forms = F.array_distinct(F.array(F.lower("p_brand"), F.concat(name, F.lit(" "), number), F.concat(name, number)))
    return p.select("p_brand", F.posexplode(forms).alias("place", "form")).select("p_brand", F.col("place").cast("long").alias("place"), "form")


VARIANT_SQL = r"""WITH b AS (SELECT DISTINCT p_brand, lower(regexp_extract(p_brand, '^([A-Za-z]+)\W*([0-9]+)$', 1)) AS n, regexp_extract(p_brand, '^([A-Za-z]+)\W*([0-9]+)$', 2) AS k FROM part)
SELECT p_brand, unnest([0, 1, 2])::BIGINT AS place, unnest([lower(p_brand), n || ' ' || k, n || k]) AS form FROM b"""


def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses as paths under a local root, and whether that changed them."""
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*", "/corpus"), r"/+", "/")
    return load(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", path.alias("path"), (path != F.col("url")).alias("rewritten"))


PATH_SQL = r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', '/corpus'), '/+', '/', 'g') AS path, regexp_replace(regexp_replace(url, '^https?://[^/]*', '/corpus'), '/+', '/', 'g') <> url AS rewritten FROM pages WHERE url IS NOT NULL"


def eval_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation set: each item as it is, in lower case, without punctuation, and its first eight words; equal ones once."""
    b = load(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    kinds = {"original": F.col("text"), "lower": F.lower("text"), "plain": F.regexp_replace("text", r"[^A-Za-z0-9\s]", ""), "short": F.array_join(F.slice(words, 1, 8), " ")}
    rows = b.select("item_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), v.alias("question")) for i, (k, v) in enumerate(kinds.items())])).alias("v"))
    first = rows.groupBy("item_id", "v.question").agg(F.min(F.struct("v.i", "v.kind")).alias("f"))
    return first.select("item_id", F.col("f.kind").alias("kind"), F.char_length("question").cast("long").alias("n_chars"), F.sha2("question", 256).alias("question_sha256"))


EVAL_SQL = r"""WITH v AS (SELECT item_id, unnest([0, 1, 2, 3]) AS i, unnest(['original', 'lower', 'plain', 'short']) AS kind, unnest([text, lower(text), regexp_replace(text, '[^A-Za-z0-9\s]', '', 'g'), array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:8], ' ')]) AS question FROM benchmark WHERE text IS NOT NULL)
SELECT item_id, kind, length(question) AS n_chars, sha256(question) AS question_sha256 FROM v QUALIFY row_number() OVER (PARTITION BY item_id, question ORDER BY i) = 1"""


def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's route with a confidence: more for a wide gap, little for an ambiguous one, and the conversation's last sure route where it isn't sure."""
    s = cue_scores(spark, sf_dir).groupBy("conv_id", "turn").agg(F.max(F.struct("ops", "rag", "route")).alias("s")).select("conv_id", "turn", "s.*")
    gap = F.abs(F.round(F.col("ops") - F.col("rag"), 6))
    confidence = F.when(F.col("route") == "ambiguous", 0.4).when(F.col("route") == "chat", 0.7).when(F.col("route") == "hybrid", 0.75).otherwise(F.least(F.lit(0.95), 0.6 + 0.1 * gap))
    c = s.withColumn("confidence", r6(confidence)).withColumn("sure", F.when(F.col("confidence") >= 0.65, F.col("route")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("conv_id", "turn", "route", "confidence", F.coalesce(F.last("sure", ignorenulls=True).over(before), "route").alias("decided"))


DECISION_SQL = f"""WITH q AS ({CUE_SQL}), s AS (SELECT conv_id, turn, ops, rag, route FROM q QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY ops DESC, rag DESC, route DESC) = 1),
c AS (SELECT *, round(CASE route WHEN 'ambiguous' THEN 0.4::DOUBLE WHEN 'chat' THEN 0.7::DOUBLE WHEN 'hybrid' THEN 0.75::DOUBLE ELSE least(0.95::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * abs(round(ops - rag, 6))) END, 6) AS confidence FROM s)
SELECT conv_id, turn, route, confidence, coalesce(last_value(CASE WHEN confidence >= 0.65 THEN route END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), route) AS decided FROM c"""


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents, to which the labelled ones are added once more: what is live afterwards, by a term's first letter, and the index's own counts."""
    docs, folder = load(spark, sf_dir, "documents").select("doc_id", "text"), scratch_folder(spark)
    build_index(docs, folder)
    index = add_documents(docs.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), folder)
    letter = F.substring("term", 1, 1).alias("letter")
    live = index.postings().groupBy(letter).agg(F.count(F.lit(1)).alias("n_postings"), F.countDistinct("term").alias("n_terms"), F.sum("tf").alias("n_words"))
    counted = index.terms().groupBy(letter).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return live.join(counted, "letter", "left").withColumn("n_docs", F.lit(index.n).cast("long"))


ROUNDTRIP_SQL = f"WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term[1] AS letter, count(*) AS n_postings, count(DISTINCT term) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_words, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, (SELECT count(*) FROM documents) AS n_docs FROM p GROUP BY 1"


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the documents as CSV with a declared schema, notes as JSON lines, both read back, joined, and resumed: what is noted as done is left out."""
    folder = scratch_folder(spark)
    d = load(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    d.select("doc_id", path.alias("path"), "n_chars").write.option("header", True).csv(f"{folder}/manifest")
    load(spark, sf_dir, "labels").select("doc_id", F.lit("done").alias("status")).distinct().write.json(f"{folder}/notes")
    manifest = spark.read.option("header", True).schema("doc_id bigint, path string, n_chars bigint").csv(f"{folder}/manifest")
    notes = spark.read.schema("doc_id bigint, status string").json(f"{folder}/notes")
    left = manifest.join(notes.where("status = 'done'"), "doc_id", "left_anti")
    return left.select("doc_id", F.split("path", "/")[0].alias("source"), F.split("path", "/")[1].alias("lang"), "n_chars")


MANIFEST_SQL = "SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

QUERIES = {f.__name__: f for f in (index_build, embedding_texts, code_variants, path_rewrite, eval_variants, route_decision, index_roundtrip, manifest_roundtrip)}
ORACLES = {
    "index_build": f"WITH {INDEX} SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, CAST(sum(n_words) AS BIGINT) AS n_words, max(chunk) AS last_chunk FROM ix GROUP BY 1",
    "embedding_texts": EMBED_SQL, "code_variants": VARIANT_SQL, "path_rewrite": PATH_SQL, "eval_variants": EVAL_SQL, "route_decision": DECISION_SQL, "index_roundtrip": ROUNDTRIP_SQL, "manifest_roundtrip": MANIFEST_SQL,
}
