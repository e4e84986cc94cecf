"""Operator 2: benchmark decontamination with DataFrame functions only.

Normalised windows of the benchmark go into a hash table, keyed by the word of
each window that the fewest other windows have.  A document looks up its words,
and only where a word is such an anchor is the window around it compared, word
by word.  Every document is handled in its own row: nothing is shuffled but the
benchmark.  A benchmark too large for such a table takes the other way, a join
on window hashes, whose hits are compared word by word as well.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashtable import bucket, buckets_for, lookup_table, once
from .names import free_name
from .scratch import written

SIZE = 10
TABLE_BYTES = 32 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HITS = "array<struct<start:int,n:int,items:array<bigint>>>"


def lowered(text: Column) -> Column:
    """A-Z in lower case and all else unchanged."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per distinct window: gram (its words), n, anchor, off (the anchor's place), items (sorted ids)."""
    items = once(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "words", words_of(F.col("text"))).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    grams = items.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.expr(f"slice(words, at + 1, {size})").alias("gram"))
    windows = written(grams.groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    places = windows.select("gram", F.posexplode("gram").alias("off", "word"))
    common = places.groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    rarest = F.min(F.struct("times", -F.length("word"), "off", "word")).alias("best")
    anchors = places.join(common, "word").groupBy("gram").agg(rarest).select("gram", F.col("best.off").alias("off"), F.col("best.word").alias("anchor"))
    return windows.join(anchors, "gram").select("gram", F.size("gram").alias("n"), "anchor", "off", "items")


def _hits_in_row(docs: DataFrame, words: Column, hits: str, windows: DataFrame, rows: int) -> DataFrame:
    buckets = buckets_for(rows)
    table = lookup_table(windows, "anchor", buckets)

    def entries(i: Column) -> Column:
        return F.element_at(table, bucket(F.get(words, i), buckets))

    def found(i: Column) -> Column:
        same = F.filter(
            entries(i),
            lambda e: (e["anchor"] == F.get(words, i)) & (i >= e["off"]) & (F.slice(words, F.greatest(i - e["off"], F.lit(0)) + 1, e["n"]) == e["gram"]),
        )
        return F.transform(same, lambda e: F.struct((i - e["off"]).alias("start"), e["n"].alias("n"), e["items"].alias("items")))

    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1))
    anchors = F.filter(places, lambda i: entries(i).isNotNull())
    return once(docs, hits, F.coalesce(F.flatten(F.transform(anchors, found)), F.array()).cast(HITS))


def _hits_by_join(docs: DataFrame, words: Column, hits: str, windows: DataFrame) -> DataFrame:
    """For benchmarks of any size: hashes of the documents' windows meet those of the benchmark in a shuffle.

    A document gets the windows whose hashes it met, and compares their words
    with its own.
    """

    def hashed(gram: Column) -> list[Column]:
        return [F.xxhash64(gram).alias("h"), F.hash(gram, F.lit(1)).alias("g")]

    sizes = [r["n"] for r in windows.select("n").distinct().collect()]  # ten at most

    def places_of(n: int) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n")))
        return F.when(F.size("w") >= n, starts).otherwise(F.array().cast("array<struct<start:int,n:int>>"))

    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("name"), words.alias("w"))
    spans = keyed.select("id", "name", "w", F.explode(F.flatten(F.array(*map(places_of, sizes)))).alias("p")).select("id", "name", "p.start", "p.n", F.expr("slice(w, p.start + 1, p.n)").alias("gram"))
    met = spans.select("id", "name", "start", "n", *hashed(F.col("gram"))).join(windows.select(*hashed(F.col("gram")), "n", "gram", "items"), ["h", "g", "n"])
    found = met.groupBy("id", "name").agg(F.collect_set(F.struct("start", "n", "gram", "items")).alias("met"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.id")) & (F.xxhash64("d.text") == F.col("m.name"))
    joined = docs.alias("d").join(found.alias("m"), same, "left")
    own = F.filter(F.coalesce("m.met", F.array()), lambda h: F.slice(words, h["start"] + 1, h["n"]) == h["gram"])
    return joined.select("d.*", F.transform(own, lambda h: F.struct(h["start"].alias("start"), h["n"].alias("n"), h["items"].alias("items"))).cast(HITS).alias(hits))


def with_hits(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE, table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: words (normalised) and hits (start, n, items of every window that occurs).

    Null and wordless texts have no words and no hits, wordless items no
    window; an item without id can be hit but is no item of ``items``.
    Repeated rows are each judged by their own text.  The new columns have
    names that ``docs`` hasn't.
    """
    windows = written(benchmark_windows(benchmark, size))
    n, n_bytes = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.array_join("gram", " ")) * 2 + 100 + 8 * F.size("items")), F.lit(0))).first()
    words, hits = free_name(docs, "words"), free_name(docs, "hits")
    docs = once(docs, words, words_of(F.col("text").cast("string")))
    if not n:
        return docs.withColumn(hits, F.array().cast(HITS)), words, hits
    found = _hits_in_row(docs, F.col(words), hits, windows, n) if n_bytes <= table_bytes else _hits_by_join(docs, F.col(words), hits, windows)
    return found, words, hits


def _covered(hits: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))


def hit_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurring window), items (ids as sorted strings), contaminated."""
    found, words, hits = with_hits(docs.select("doc_id", "text"), benchmark, **options)
    items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"]))), lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.when(F.size(hits) > 0, F.size(_covered(hits))).otherwise(0).cast("long").alias("n_hit"),
        items.alias("items"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "spans", **options) -> DataFrame:
    """``docs`` without benchmark text, its columns unchanged, whatever their names.

    remove="documents" drops hit documents.  remove="spans" takes the hit
    words, each with what separates it from the next word, out of the text
    and drops a document of which no word is left.  n_chars, if there, is set
    anew for changed texts.  Untouched documents are returned as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: {remove!r}")
    found, words, hits = with_hits(docs, benchmark, **options)
    clean = F.size(hits) == 0
    if remove == "documents":
        return found.where(clean).select(*docs.columns)
    hit = free_name(found, "hit")
    found = once(found, hit, F.when(~clean, _covered(hits))).where(clean | (F.size(hit) < F.size(words)))
    gaps = F.split("text", ANY_CASE_WORD, -1)
    said = F.regexp_extract_all("text", F.lit(ANY_CASE_WORD), F.lit(0))
    # which words stay, as an array of flags: one pass over the hit places
    stay = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.array_contains(F.col(hit), i))
    parts = F.zip_with(F.zip_with(said, F.slice(gaps, 2, F.size(words)), lambda w, g: F.concat(w, g)), stay, lambda t, s: F.when(s, t).otherwise(""))
    text = F.when(clean, F.col("text")).otherwise(F.concat(F.get(gaps, F.lit(0)), F.array_join(parts, "")))
    kept = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(*docs.columns)


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
SQL = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT item_id, least(len(w), {SIZE}) AS n, unnest([array_to_string(w[i:i + {SIZE - 1}], ' ') FOR i IN range(1, greatest(len(w) - {SIZE - 2}, 2))]) AS gram FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}'), []) AS w FROM documents),
s AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
o AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g ON array_to_string(s.w[s.i:s.i + s.n - 1], ' ') = g.gram AND s.n = g.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
