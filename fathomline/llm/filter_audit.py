"""Operator 13: what each filter removes alone, and what in company, for every order of the filters.

Every row gets a mask of the filters that it fails; counts per mask are all
that the orders need.  Repeated texts are found by refining a partition: rows
are split by their code points, then by the hashes of successive blocks, each
sixteen times as long as all before it, and rows left alone drop out after each
split.  Only the texts of the surviving classes are read and compared in full.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashtable import once
from .hotkeys import hot_keys, spread_join
from .scratch import written

FILTERS = "ABCDE"
#: Code points of the first block; block k ends at FIRST * GROWTH^k, so this many blocks hold any string.
FIRST, GROWTH, BLOCKS = 64, 16, 8


def block_hashes(text: Column, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """One hash for each block that the text has."""
    ends = [FIRST * GROWTH**k for k in range(BLOCKS)]
    starts = [0, *ends[:-1]]
    size = F.char_length(text)
    blocks = [F.when(size > a, hashed(F.substring(text, a + 1, min(b - a, 2**31 - 1)))) for a, b in zip(starts, ends, strict=True)]
    return F.filter(F.array(*blocks), lambda h: h.isNotNull())


def refined(part: Column, hashes: Column, k: int) -> Column:
    """The class of a row of class ``part`` after its block ``k``."""
    return F.when(F.size(hashes) > k, F.xxhash64(part, F.element_at(hashes, k + 1))).otherwise(part)


def final_class(length: Column, hashes: Column) -> Column:
    """The class of a row after all its blocks."""
    return F.aggregate(hashes, length.cast("long"), lambda part, h: F.xxhash64(part, h))


def surviving(rows: DataFrame) -> DataFrame:
    """class, n of the classes of two rows and more that the refinement leaves; ``rows``: doc_id, length, hashes."""
    alive = rows.select("doc_id", F.col("length").cast("long").alias("class"), "hashes")
    k, total, longest = 0, rows.count(), BLOCKS
    while True:
        counts = written(alive.groupBy("class").agg(F.count(F.lit(1)).alias("n")))
        if k >= longest:
            return counts.where("n > 1")
        hot = hot_keys(counts, ["class"], "n", total)
        stay = spread_join(alive, counts, ["class"], hot, "doc_id").where("n > 1")
        alive = written(stay.select("doc_id", refined(F.col("class"), F.col("hashes"), k).alias("class"), "hashes"))
        total, longest = alive.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("hashes")), F.lit(0))).first()
        k += 1


def classed(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """doc_id, part, text, length, hashes and class of every row; nothing is shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = once(base, "hashes", block_hashes(F.col("text"), hashed)).withColumn("length", F.char_length("text"))
    return base.withColumn("class", final_class(F.col("length"), F.col("hashes")))


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` of ``classed`` without their texts and with ``fails``, the bits of filters A to D."""
    base = once(rows, "words", F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""))
    n_words = F.size("words")
    conditions = [
        n_words < 100,
        100 * F.size(F.array_distinct("words")).cast("long") < 80 * n_words.cast("long"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.col("length").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    fails = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    return base.select("doc_id", "part", fails.alias("fails"), "length", "hashes", "class")


def masks(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, part and mask (bit i: the row fails filter i of ``FILTERS``) of every row of ``docs``.

    A null text is empty, a null lang the part ''.  E fails where a row of a
    smaller doc_id has the same text; a row without doc_id neither fails E nor
    makes another fail, and rows of one doc_id don't repeat each other.
    ``hashed`` names blocks; texts are compared in full whatever it does.
    """
    rows = written(measured(classed(docs, hashed)))
    classes = surviving(rows)
    hot = hot_keys(classes, ["class"], "n", rows.count())
    texts = classed(docs, hashed).select("doc_id", "class", "text")
    candidates = spread_join(texts, classes, ["class"], hot, "doc_id").where("n IS NOT NULL")
    # equal texts are compared as keys of a group; a task sends each of them once
    firsts = written(candidates.groupBy("class", "text").agg(F.min("doc_id").alias("first_id")))
    whole = written(firsts.groupBy("class").agg(F.count(F.lit(1)).alias("n_texts"), F.min("first_id").alias("first_id")))
    known = spread_join(rows, whole, ["class"], hot, "doc_id")
    out = known.where("n_texts IS NULL OR n_texts = 1").select("doc_id", "part", "fails", "first_id")
    mixed = whole.where("n_texts > 1").select("class")
    if not mixed.isEmpty():  # different texts with the same hashes: rows meet the first of their own text
        own = classed(docs, hashed).join(mixed, "class", "left_semi").join(firsts, ["class", "text"])
        fails = measured(own.select("doc_id", "part", "text", "length", "hashes", F.struct("class", "first_id").alias("class")))
        out = out.unionByName(fails.select("doc_id", "part", "fails", "class.first_id"))
    repeated = F.when(F.col("doc_id") > F.col("first_id"), 1 << 4).otherwise(0)
    return out.select("doc_id", "part", F.col("fails").bitwiseOR(repeated).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (lang), order of the filters and step, zeros included.

    ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost`` and ``shapley`` count rows of ``docs`` (see ``masks`` for
    nulls).  A doc_id is good, or toxic, if any of its labels says so; rows
    without doc_id have no label.  Extra columns are ignored, an empty table
    has no parts.
    """
    marked = written(masks(docs))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = said.agg(F.max(F.expr("coalesce(cast(quality AS int) = 1, false)")).alias("good"), F.max(F.expr("coalesce(cast(toxic AS int) = 1, false)")).alias("toxic"))
    named = marked.where("doc_id IS NOT NULL").join(known, "doc_id", "left").select("part", "mask", "good", "toxic")
    nameless = marked.where("doc_id IS NULL").select("part", "mask", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    cells = named.unionByName(nameless).select("part", "mask", *flags).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))

    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = F.array(*[F.lit(i) for i in range(1, len(FILTERS) + 1)])
    each = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(steps).alias("step"))
    place = [F.instr("filter_order", f) for f in FILTERS]
    before = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    own = sum((F.when(p == F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    each = each.select("*", own.alias("own"), F.col("mask").bitwiseAND(before).alias("earlier"), F.col("mask").bitwiseAND(own).alias("here"))
    removed = (F.col("here") > 0) & (F.col("earlier") == 0)
    counted = {
        "kept": (F.col("here") == 0) & (F.col("earlier") == 0),
        "removed": removed,
        "redundant": (F.col("here") > 0) & (F.col("earlier") > 0),
        "unique_fails": F.col("mask") == F.col("own"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in counted.items()]
    table = each.groupBy("part", "filter_order", "step", "own").agg(*sums)
    # a part has 600 rows
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))
    return table.select("part", "filter_order", "step", *counted, shapley.alias("shapley"))


SQL = r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \t-\r]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
m AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
x AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, good, toxic, n, fails[ascii(substr(filter_order, step, 1)) - 64] AS here,
    len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i, 1)) - 64])) > 0 AS earlier, len(list_filter(fails, lambda b: b)) = 1 AS single FROM d, s),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN here AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN here AND NOT earlier AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND NOT earlier AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r"""
