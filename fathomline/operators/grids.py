"""Tables from coordinates: grids with merged cells, headers of several levels, answers on their paths, formulas from glyphs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..model import load

#: Edges of one row or column lie at most so far apart.
SLACK = 3.0
#: How far from its line's baseline, in sizes of a glyph, a raised or lowered one stands; glyphs with another meaning than their code.
SHIFT = 0.2
GLYPHS = {0xE000: "alpha", 0xE001: "beta", 0xE002: "sum", 0xE003: "sqrt", 0x2212: "-", 0x00D7: "*"}


# --- grids ----------------------------------------------------------------------------------------


def edge_numbers(cells: DataFrame, slack: float = SLACK) -> DataFrame:
    """table_id, axis, at, number: every distinct edge (in tenths) with the number of the line it is on.

    Edges of a table in order form sessions: a gap of more than ``slack``
    begins the next line.  Only distinct edges meet in a table's window, so it
    is as large as the page is wide, however many cells there are.
    """
    edges = [F.struct(F.lit(a).alias("axis"), F.round(c, 1).alias("at")) for a, c in (("x", "x0"), ("x", "x1"), ("y", "y0"), ("y", "y1"))]
    distinct = cells.select("table_id", F.explode(F.array(*edges)).alias("e")).select("table_id", "e.*").distinct()
    w = Window.partitionBy("table_id", "axis").orderBy("at")
    begins = F.coalesce(F.col("at") - F.lag("at").over(w) > slack, F.lit(False)).cast("long")
    return distinct.withColumn("begins", begins).withColumn("number", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def grid(cells: DataFrame, slack: float = SLACK) -> DataFrame:
    """``cells`` (table_id, x0, y0, x1, y1, ...) with row, col, row_span, col_span by the lines that their edges are on.

    Cells with a null coordinate, or whose opposite edges are on one line, are left out.
    """
    fine = cells.where("table_id IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL")
    numbers = edge_numbers(fine, slack)
    out = fine
    for axis, edge, name in (("x", "x0", "col"), ("x", "x1", "_right"), ("y", "y0", "row"), ("y", "y1", "_bottom")):
        of = numbers.where(F.col("axis") == axis).select("table_id", F.col("at").alias(f"_{edge}"), F.col("number").alias(name))
        out = out.withColumn(f"_{edge}", F.round(edge, 1)).join(of, ["table_id", f"_{edge}"]).drop(f"_{edge}")
    spans = out.withColumn("row_span", F.col("_bottom") - F.col("row")).withColumn("col_span", F.col("_right") - F.col("col")).drop("_right", "_bottom")
    return spans.where("row_span > 0 AND col_span > 0")


def covered(placed: DataFrame) -> DataFrame:
    """Every slot of the grid with the cell over it: a merged cell is in all the slots that it spans."""
    rows = placed.select("*", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("_row"))
    both = rows.select("*", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("_col"))
    return both.drop("row", "col", "row_span", "col_span").withColumnsRenamed({"_row": "row", "_col": "col"})


def part_cells(parts: DataFrame) -> DataFrame:
    """Sixty parts to a table of ten rows and six columns, moved by up to two units; each row's third part spans two columns, and its fourth gives way."""
    k = F.col("p_partkey")
    slot, shake = k % 60, k * 7 % 5 / 2.0 - 1
    row, col = F.floor(slot / 6), slot % 6
    wide = F.when(col == 2, 2).otherwise(1)
    made = parts.select(F.floor(k / 60).alias("table_id"), k.alias("cell"), (col * 80 + shake).alias("x0"), ((col + wide) * 80 + shake).alias("x1"), (row * 20 + shake).alias("y0"), ((row + 1) * 20 + shake).alias("y1"), col.alias("_col"))
    return made.where("_col <> 3").drop("_col")


def coordinate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row, column and spans of every part's cell, from coordinates alone."""
    return grid(part_cells(load(spark, sf_dir, "part"))).select("table_id", "cell", "row", "col", "row_span", "col_span")


# lines are counted among those that a table has, so a table that isn't full begins at its first
GRID_SQL = """WITH c AS (SELECT p_partkey // 60 AS table_id, p_partkey AS cell, p_partkey % 60 // 6 AS r, p_partkey % 60 % 6 AS c, CASE WHEN p_partkey % 60 % 6 = 2 THEN 2 ELSE 1 END AS wide FROM part WHERE p_partkey % 60 % 6 <> 3),
x AS (SELECT table_id, e, dense_rank() OVER (PARTITION BY table_id ORDER BY e) - 1 AS n FROM (SELECT DISTINCT table_id, unnest([c, c + wide]) AS e FROM c)), y AS (SELECT table_id, e, dense_rank() OVER (PARTITION BY table_id ORDER BY e) - 1 AS n FROM (SELECT DISTINCT table_id, unnest([r, r + 1]) AS e FROM c))
SELECT c.table_id, cell, y0.n AS "row", x0.n AS col, y1.n - y0.n AS row_span, x1.n - x0.n AS col_span FROM c JOIN x x0 ON x0.table_id = c.table_id AND x0.e = c.c JOIN x x1 ON x1.table_id = c.table_id AND x1.e = c.c + wide
JOIN y y0 ON y0.table_id = c.table_id AND y0.e = r JOIN y y1 ON y1.table_id = c.table_id AND y1.e = r + 1"""


# --- headers --------------------------------------------------------------------------------------


def blank(c: str = "text") -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def header_depth(cells: DataFrame) -> DataFrame:
    """table_id, depth: how many rows stand before the first with a number in a column behind the first."""
    number = F.col("text").rlike(r"^\s*-?[0-9][0-9.,]*%?\s*$") & (F.col("col") > 0)
    return cells.groupBy("table_id").agg(F.coalesce(F.min(F.when(number, F.col("row"))), F.max("row") + 1).alias("depth"))


def header_paths(cells: DataFrame) -> DataFrame:
    """table_id, col, path of slots (table_id, row, col, text): the headers above each column, each level filled from the left.

    A blank header takes the one to its left on its level, only if the column
    of that one has no text of its own on a lower level that differs; levels
    that say the same as the one above are left out.
    """
    heads = cells.join(header_depth(cells), "table_id").where(F.col("row") < F.col("depth"))
    left = Window.partitionBy("table_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    # the last level names a column and is never taken from a neighbour
    fill = F.when(F.col("row") < F.col("depth") - 1, F.last(F.when(~blank(), F.trim("text")), ignorenulls=True).over(left)).otherwise(F.when(~blank(), F.trim("text")))
    filled = heads.where("col > 0").withColumn("head", fill).where("head IS NOT NULL")
    levels = filled.groupBy("table_id", "col").agg(F.array_sort(F.collect_list(F.struct("row", "head"))).alias("h"))  # a header's levels
    names = F.transform("h", lambda x: x["head"])
    again = F.filter(names, lambda x, i: (i == 0) | (x != F.get(names, i - 1)))
    return levels.select("table_id", "col", F.array_join(again, " / ").alias("path"))


def row_labels(cells: DataFrame) -> DataFrame:
    """table_id, row, label: the first cell of each row below the headers, filled from above where it is blank and a later cell of its row isn't."""
    body = cells.join(header_depth(cells), "table_id").where(F.col("row") >= F.col("depth"))
    rows = body.groupBy("table_id", "row").agg(F.max(F.when((F.col("col") == 0) & ~blank(), F.trim("text"))).alias("own"), F.max(F.when((F.col("col") > 0) & ~blank(), 1)).alias("later"))
    above = Window.partitionBy("table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    label = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("later").isNotNull(), F.last("own", ignorenulls=True).over(above))
    return rows.select("table_id", "row", label.alias("label"))


def facts(cells: DataFrame) -> DataFrame:
    """table_id, label, path, value of every filled slot under a header and beside a label."""
    values = cells.where((F.col("col") > 0) & ~blank())
    return values.join(row_labels(cells), ["table_id", "row"]).join(header_paths(cells), ["table_id", "col"]).where("label IS NOT NULL").select("table_id", "label", "path", F.trim("text").alias("value"))


def path_answers(known: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, status, value, n_tables of questions (question_id, label, path, table_id or null for any).

    A question asks for one label and path, in any case.  Its answer is the
    value if all that match agree, ``conflict`` where tables differ, ``ambiguous``
    where one table has several, and ``refused`` where nothing matches.
    """
    key = lambda c: F.lower(F.trim(c))
    f = known.select("table_id", key("label").alias("_label"), key("path").alias("_path"), "value")
    q = questions.select("question_id", key("label").alias("_label"), key("path").alias("_path"), F.col("table_id").alias("_scope"))
    met = q.join(f, (q["_label"] == f["_label"]) & (q["_path"] == f["_path"]) & (q["_scope"].isNull() | (q["_scope"] == f["table_id"])))
    per_table = met.groupBy("question_id", "table_id").agg(F.countDistinct("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    found = per_table.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_tables"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    out = questions.select("question_id").distinct().join(found, "question_id", "left")
    status = F.when(F.col("n_tables").isNull(), "refused").when(F.col("most") > 1, "ambiguous").when(F.col("low") != F.col("high"), "conflict").otherwise("answered")
    return out.select("question_id", status.alias("status"), F.when(status == "answered", F.col("low")).alias("value"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"))


def order_tables(orders: DataFrame) -> DataFrame:
    """A table of each year as slots: priorities down, statuses across with two columns each; the status stands over the first of them only."""
    cell = orders.where("o_orderdate IS NOT NULL").groupBy(F.year("o_orderdate").cast("long").alias("table_id"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("k"))
    place = lambda c, by: F.dense_rank().over(Window.partitionBy("table_id").orderBy(c)).cast("long") + by
    cell = cell.withColumn("row", place("p", 1)).withColumn("col", 2 * place("s", 0) - 1)
    slot = lambda r, c, t: F.struct(r.cast("long").alias("row"), c.cast("long").alias("col"), t.cast("string").alias("text"))
    r, c = F.col("row"), F.col("col")
    slots = F.array(
        slot(r, F.lit(0), F.col("p")), slot(r, c, F.col("n")), slot(r, c + 1, F.col("k")), slot(F.lit(0), c, F.col("s")), slot(F.lit(0), c + 1, F.lit("")),
        slot(F.lit(1), c, F.lit("orders")), slot(F.lit(1), c + 1, F.lit("customers")), slot(F.lit(0), F.lit(0), F.lit("")), slot(F.lit(1), F.lit(0), F.lit("priority")),
    )
    return cell.select("table_id", F.explode(slots).alias("x")).select("table_id", "x.*").distinct()


def header_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from the yearly tables to every priority, status and measure, in each year and in any; one label is unknown."""
    orders = load(spark, sf_dir, "orders")
    asked = orders.select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("s"), F.year("o_orderdate").cast("long").alias("y")).distinct()
    label = F.explode(F.array(F.col("label"), F.lit("6-NONE"))).alias("label")
    years = asked.select(label, "s", F.explode(F.array("y", F.lit(None).cast("long"))).alias("table_id")).distinct()
    q = years.select("label", F.explode(F.array(F.concat(F.upper("s"), F.lit(" / Orders")), F.concat(F.col("s"), F.lit(" / customers")))).alias("path"), "table_id")
    named = q.withColumn("question_id", F.concat_ws("|", "label", "path", F.coalesce(F.col("table_id").cast("string"), F.lit("any"))))
    return path_answers(facts(order_tables(orders)), named)


ANSWERS_SQL = """WITH f AS (SELECT year(o_orderdate) AS y, o_orderpriority AS label, o_orderstatus AS s, count(*)::VARCHAR AS orders, count(DISTINCT o_custkey)::VARCHAR AS customers FROM orders GROUP BY ALL),
d AS (SELECT DISTINCT unnest([label, '6-NONE']) AS label, s, unnest([y, NULL]) AS y FROM (SELECT label, s, y FROM f)), e AS (SELECT DISTINCT l AS label, s, y FROM (SELECT unnest([label, '6-NONE']) AS l, s, y FROM f) UNION SELECT DISTINCT l, s, NULL FROM (SELECT unnest([label, '6-NONE']) AS l, s FROM f)),
q AS (SELECT label, s, y, 'orders' AS m, upper(s) || ' / Orders' AS path FROM e UNION ALL SELECT label, s, y, 'customers', s || ' / customers' FROM e),
v AS (SELECT q.label || '|' || path || '|' || coalesce(q.y::VARCHAR, 'any') AS question_id, f.y, CASE m WHEN 'orders' THEN orders ELSE customers END AS value FROM q LEFT JOIN f ON f.label = q.label AND f.s = q.s AND (q.y IS NULL OR q.y = f.y))
SELECT question_id, CASE WHEN count(value) = 0 THEN 'refused' WHEN min(value) <> max(value) THEN 'conflict' ELSE 'answered' END AS status, CASE WHEN min(value) = max(value) THEN min(value) END AS value, count(value) AS n_tables FROM v GROUP BY 1"""


# --- quality --------------------------------------------------------------------------------------

#: Names of columns that name nothing, and what a table loses for what it lacks.
GENERIC = r"(?i)^(?:col(?:umn)?[_ ]?[0-9]+|content|value)$"
LOSSES = {"text": 0.22, "caption": 0.06, "single": 0.36, "empty": 0.8, "many": 0.12}
LONG_HEADER, MOST_COLUMNS, SPARSE = 90, 24, 0.34


@F.pandas_udf(StringType())
def clean_text(values: pd.Series) -> pd.Series:
    """Compatibility forms, no soft hyphens, single blanks; null is empty."""
    return values.map(lambda v: "" if v is None else " ".join(unicodedata.normalize("NFKC", v).replace("\u00ad", "").split()))


def private_use(text: Column) -> Column:
    """The share of characters without a meaning of their own (private use), 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(F.char_length(F.regexp_replace(t, r"[^\p{Co}]", "")) / F.nullif(F.char_length(t), F.lit(0)), F.lit(0.0))


def readable(text: Column, told: str = "[formula]") -> Column:
    """A text with each run of private-use characters told by a word."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Co}+", f" {told} "), r"\s+", " "))


def assess(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, n_columns, n_rows, density, generic, long_headers, private, score, status of tables (table_id, caption, strategy) with slots in ``cells``.

    A column is one under a header and a row one with a value below the
    headers.  A table without cells has neither.  ``pass`` needs 0.7, ``review``
    0.58 and hardly any private-use characters, both two columns and a row.
    """
    heads = header_paths(cells)
    columns = heads.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_columns"), F.count(F.when(F.col("path").rlike(GENERIC), 1)).alias("g"), F.count(F.when(F.char_length("path") > LONG_HEADER, 1)).alias("l"), F.sum(F.char_length("path")).alias("head_size"), F.sum(F.char_length("path") * private_use(F.col("path"))).alias("head_private"))
    body = cells.join(header_depth(cells), "table_id").where((F.col("row") >= F.col("depth")) & ~blank()).join(heads.select("table_id", "col"), ["table_id", "col"])
    rows = body.groupBy("table_id").agg(F.countDistinct("row").alias("n_rows"), F.count(F.lit(1)).alias("filled"), F.sum(F.char_length("text")).alias("body_size"), F.sum(F.char_length("text") * private_use(F.col("text"))).alias("body_private"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = tables.join(columns, "table_id", "left").join(rows, "table_id", "left").select(
        "table_id", "caption", "strategy", zero("n_columns").alias("n_columns"), zero("n_rows").alias("n_rows"),
        (zero("filled") / F.greatest(F.lit(1), zero("n_rows") * zero("n_columns"))).alias("density"), (zero("g") / F.greatest(F.lit(1), zero("n_columns"))).alias("generic"),
        (zero("l") / F.greatest(F.lit(1), zero("n_columns"))).alias("long_headers"), ((zero("head_private") + zero("body_private")) / F.greatest(F.lit(1), zero("head_size") + zero("body_size"))).alias("private"),
    )
    lost = lambda c, n: F.when(c, n).otherwise(0.0)
    pua = F.col("private")
    score = (
        1.0 - lost(F.col("strategy") == "text", LOSSES["text"]) - lost(F.coalesce(F.trim("caption"), F.lit("")) == "", LOSSES["caption"]) - lost(F.col("n_columns") < 2, LOSSES["single"]) - lost(F.col("n_rows") < 1, LOSSES["empty"])
        - F.least(F.lit(0.34), F.col("generic") * 0.38) - lost(F.col("density") < SPARSE, F.least(F.lit(0.3), (SPARSE - F.col("density")) * 1.2)) - F.least(F.lit(0.28), F.col("long_headers") * 0.35)
        - F.when(pua <= 0, 0.0).when(pua <= 0.06, F.least(F.lit(0.12), 0.04 + pua)).when(pua <= 0.2, 0.2).otherwise(0.28) - lost(F.col("n_columns") > MOST_COLUMNS, LOSSES["many"])
    )
    whole = (F.col("n_columns") >= 2) & (F.col("n_rows") >= 1)
    scored = t.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3))
    status = F.when((F.col("score") >= 0.7) & whole, "pass").when((F.col("score") >= 0.58) & whole & (pua < 0.01), "review").otherwise("reject")
    return scored.select("table_id", "n_columns", "n_rows", F.round("density", 4).alias("density"), F.round("generic", 4).alias("generic"), F.round("long_headers", 4).alias("long_headers"), F.round("private", 6).alias("private"), "score", status.alias("status"))


def grid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the yearly tables; those of even years have no caption, those of each third one come from text."""
    slots = order_tables(load(spark, sf_dir, "orders"))
    y = F.col("table_id")
    info = slots.select("table_id").distinct().select("table_id", F.when(y % 2 == 1, F.concat(F.lit("Orders of "), y.cast("string"))).alias("caption"), F.when(y % 3 == 0, "text").otherwise("lines").alias("strategy"))
    return assess(slots, info)


GRID_QUALITY_SQL = """WITH f AS (SELECT DISTINCT year(o_orderdate) AS y, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderdate IS NOT NULL), n AS (SELECT y, 2 * count(DISTINCT s) AS n_columns, count(DISTINCT p) AS n_rows, 2 * count(*) AS filled FROM f GROUP BY 1),
d AS (SELECT *, filled::DOUBLE / (n_columns * n_rows) AS density, round(1.0::DOUBLE - CASE WHEN y % 3 = 0 THEN 0.22::DOUBLE ELSE 0 END - CASE WHEN y % 2 = 0 THEN 0.06::DOUBLE ELSE 0 END - CASE WHEN filled::DOUBLE / (n_columns * n_rows) < 0.34 THEN least(0.3::DOUBLE, (0.34::DOUBLE - filled::DOUBLE / (n_columns * n_rows)) * 1.2::DOUBLE) ELSE 0 END, 3) AS score FROM n)
SELECT y AS table_id, n_columns, n_rows, round(density, 4) AS density, 0.0::DOUBLE AS generic, 0.0::DOUBLE AS long_headers, 0.0::DOUBLE AS private, score, CASE WHEN score >= 0.7 THEN 'pass' WHEN score >= 0.58 THEN 'review' ELSE 'reject' END AS status FROM d"""


def page_bodies(chunks: DataFrame, least: int = 60) -> DataFrame:
    """page, n, text of chunks (page, text): the distinct bodies of ``least`` characters and more of a page, the longest first, ties by text."""
    bodies = chunks.select("page", F.trim("text").alias("text")).where(F.char_length("text") >= least).distinct()
    # a page's bodies meet in one row, as its text is one value
    held = bodies.groupBy("page").agg(F.array_sort(F.collect_list(F.struct((-F.char_length("text")).alias("n"), "text"))).alias("b"))
    return held.select("page", F.size("b").cast("long").alias("n"), F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))


def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ten documents as the bodies of one page."""
    d = load(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("page"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    return page_bodies(d).select("page", "n", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


ASSEMBLY_SQL = """WITH l AS (SELECT DISTINCT page, trim(line, ' ') AS line FROM (SELECT doc_id // 10 AS page, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE length(trim(line, ' ')) >= 60),
t AS (SELECT page, count(*) AS n, string_agg(line, chr(10) || chr(10) ORDER BY length(line) DESC, line) AS text FROM l GROUP BY 1) SELECT page, n, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t"""


# --- formulas -------------------------------------------------------------------------------------


def formulas(glyphs: DataFrame) -> DataFrame:
    """line_id, text of glyphs (line_id, x, y, size, code): in order, runs of raised ones as ^{..}, of lowered ones as _{..}.

    A line's baseline is that of most of its glyphs (ties: the lowest on the
    page); y grows downwards.  Codes of a math font become their names.
    """
    tokens = F.create_map(*[F.lit(x) for pair in GLYPHS.items() for x in pair])
    told = F.coalesce(tokens[F.col("code").cast("int")], F.char("code"))
    known = glyphs.where("line_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND size > 0 AND code IS NOT NULL").select("line_id", "x", "y", "size", told.alias("told"))
    bases = known.groupBy("line_id", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("line_id").agg(F.max(F.struct("n", "y"))["y"].alias("base"))
    off = (F.col("base") - F.col("y")) / F.col("size")
    level = F.when(off > SHIFT, "^").when(off < -SHIFT, "_").otherwise("")
    # a row per line: the size check knows the table that glyphs come from, not how many lines they make, and would broadcast all of them
    placed = known.join(bases.hint("merge"), "line_id").withColumn("level", level)
    w = Window.partitionBy("line_id").orderBy("x", "y")
    begun = placed.withColumn("begins", F.coalesce(F.lag("level").over(w) != F.col("level"), F.lit(True)).cast("int"))
    runs = begun.withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = runs.groupBy("line_id", "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "told"))), lambda g: g["told"]), "").alias("said"))
    part = F.when(F.col("level") == "", F.col("said")).otherwise(F.concat("level", F.lit("{"), "said", F.lit("}")))
    return said.groupBy("line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", part.alias("p")))), lambda r: r["p"]), "").alias("text"))


def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands set as formulas, their digits raised and the type's first two letters lowered, read back from glyphs."""
    p = load(spark, sf_dir, "part")
    letters = F.concat(F.coalesce("p_brand", F.lit("")), F.substring(F.coalesce("p_type", F.lit("")), 1, 2))
    each = p.select(F.col("p_partkey").alias("line_id"), F.char_length(F.coalesce("p_brand", F.lit(""))).alias("n"), F.posexplode(F.split(letters, "")).alias("x", "c")).where("c <> ''")
    up = F.col("c").rlike("[0-9]") & (F.col("x") < F.col("n"))
    y = F.when(up, 95.0).when(F.col("x") >= F.col("n"), 104.0).otherwise(100.0)
    return formulas(each.select("line_id", (F.col("x") * 5.0).alias("x"), y.alias("y"), F.lit(10.0).alias("size"), F.ascii("c").alias("code")))


FORMULA_SQL = r"SELECT p_partkey AS line_id, regexp_replace(coalesce(p_brand, ''), '([0-9]+)', '^{\1}', 'g') || CASE WHEN coalesce(p_type, '') = '' THEN '' ELSE '_{' || left(p_type, 2) || '}' END AS text FROM part"

QUERIES = {f.__name__: f for f in (coordinate_grid, header_answers, formula_lines, grid_quality, page_assembly)}
ORACLES = {"coordinate_grid": GRID_SQL, "header_answers": ANSWERS_SQL, "formula_lines": FORMULA_SQL, "grid_quality": GRID_QUALITY_SQL, "page_assembly": ASSEMBLY_SQL}
