"""Grids, headers and formulas on tables that no generator of the queries makes."""

import random

from pyspark.sql import functions as F

from fathomline.operators import grids

SLOTS = "table_id bigint, row bigint, col bigint, text string"


def test_a_shifted_grid_with_merged_cells(spark):
    draw = random.Random(6)
    rows, truth = [], {}
    for table in (1, 2, None):
        xs, ys = [30.0, 91.0, 140.0, 260.0, 300.0], [500.0, 512.0, 540.0, 553.0]
        shake = lambda v: v + draw.choice([-1.4, -0.6, 0.0, 0.7, 1.3])
        cells = [(0, 0, 1, 4), (1, 0, 2, 1), (1, 1, 1, 2), (1, 3, 1, 1), (2, 1, 1, 1), (2, 2, 1, 2)]
        for i, (r, c, tall, wide) in enumerate(cells):
            rows.append((table, f"{table}-{i}", shake(xs[c]), shake(ys[r]), shake(xs[c + wide]), shake(ys[r + tall])))
            if table:
                truth[f"{table}-{i}"] = (r, c, tall, wide)
    # a cell thinner than the slack between lines, and one without a coordinate
    rows += [(1, "thin", 30.0, 500.0, 31.0, 512.0), (2, "none", None, 500.0, 91.0, 512.0)]
    df = spark.createDataFrame(rows, "table_id bigint, cell string, x0 double, y0 double, x1 double, y1 double")
    placed = grids.grid(df)
    assert {r["cell"]: (r["row"], r["col"], r["row_span"], r["col_span"]) for r in placed.collect()} == truth
    slots = {(r["table_id"], r["row"], r["col"]): r["cell"] for r in grids.covered(placed).collect()}
    assert len(slots) == 24 and slots[1, 0, 3] == "1-0" and slots[1, 2, 0] == "1-1" and slots[2, 2, 3] == "2-5"
    assert grids.grid(df.where("false")).count() == 0


def slots(spark, tables):
    rows = [(t, r, c, text) for t, lines in tables.items() for r, line in enumerate(lines) for c, text in enumerate(line)]
    return spark.createDataFrame(rows, SLOTS)


TWO_LEVELS = [
    [None, "Limit", "", "Date", " "],
    ["Ship", "min", "max", "from", "to"],
    ["Bulker", "1", "2", "2020", "2021"],
    ["", "3", None, "x", "y"],
    ["", "", "", "", ""],
    ["Tanker", "5", "6", "", "7"],
]


def test_paths_of_two_levels(spark):
    cells = slots(spark, {1: TWO_LEVELS, 2: [["k", "a"], ["r", "1"]], 3: [["only", "words"], ["no", "numbers"]], 4: [["", "T", "T"], ["", "T", "u"], ["r", "1", "2"]]})
    paths = {(r["table_id"], r["col"]): r["path"] for r in grids.header_paths(cells).collect()}
    assert paths == {
        (1, 1): "Limit / min", (1, 2): "Limit / max", (1, 3): "Date / from", (1, 4): "Date / to", (2, 1): "a", (3, 1): "words / numbers", (4, 1): "T", (4, 2): "T / u",
    }
    labels = {(r["table_id"], r["row"]): r["label"] for r in grids.row_labels(cells).collect()}
    # the blank row stays without a label; the one with later cells takes that above
    assert labels == {(1, 2): "Bulker", (1, 3): "Bulker", (1, 4): None, (1, 5): "Tanker", (2, 1): "r", (4, 2): "r"}


def test_answers_conflicts_and_refusals(spark):
    other = [row[:] for row in TWO_LEVELS]
    other[2][1], other[3][1] = "9", "9"
    cells = slots(spark, {1: TWO_LEVELS, 2: other, 3: TWO_LEVELS[:2] + [["Tanker", "5", "8", "1", "1"]]})
    asked = [
        (1, "Tanker", "Limit / min", None), (2, "tanker ", "LIMIT / MAX", None), (3, "Tanker", "Limit / max", 1), (4, "Bulker", "Limit / min", 1), (5, "Bulker", "Limit / min", 2),
        (6, "Ferry", "Limit / min", None), (7, "Tanker", "Date / from", 2), (8, None, "Limit / min", None), (9, "Bulker", "Limit / min", None),
    ]
    got = grids.path_answers(grids.facts(cells), spark.createDataFrame(asked, "question_id int, label string, path string, table_id bigint")).collect()
    assert {r["question_id"]: (r["status"], r["value"], r["n_tables"]) for r in got} == {
        1: ("answered", "5", 3), 2: ("conflict", None, 3), 3: ("answered", "6", 1), 4: ("ambiguous", None, 1), 5: ("answered", "9", 1), 6: ("refused", None, 0), 7: ("refused", None, 0), 8: ("refused", None, 0), 9: ("ambiguous", None, 2),
    }


def test_formulas(spark):
    def line(number, glyphs):
        return [(number, 6.0 * i, y, 10.0, code if isinstance(code, int) else ord(code)) for i, (code, y) in enumerate(glyphs)]

    rows = line(1, [("x", 50.0), ("2", 44.0), ("3", 44.0), ("+", 50.0), (0xE000, 50.0), ("i", 54.0), (0x2212, 50.0), ("1", 50.0)])
    rows += line(2, [("a", 50.0), ("b", 51.0)]) + [(3, None, 1.0, 10.0, 65), (3, 1.0, 1.0, 0.0, 65), (None, 1.0, 1.0, 10.0, 65)] + line(4, [(0xE002, 20.0)])
    draw = random.Random(1)
    draw.shuffle(rows)
    got = grids.formulas(spark.createDataFrame(rows, "line_id bigint, x double, y double, size double, code int")).collect()
    assert {r["line_id"]: r["text"] for r in got} == {1: "x^{23}+alpha_{i}-1", 2: "ab", 4: "sum"}


def test_quality_by_its_rule(spark):
    body = [["r1", "1", "2"], ["r2", "3", ""]]
    tables = {
        1: [["", "length", "width"], *body], 2: [["", "column_1", "Value"], *body], 3: [["", "x" * 91, "y"], *body], 4: [["", "only"], ["r", "1"]], 5: [["", "a", "b"]],
        6: [["", "a\ue000", "b"], ["r", "1", "2"]], 7: [["", *[f"c{i}x" for i in range(25)]], ["r", "1", *[""] * 24]],
    }
    info = [(i, "Table 1" if i != 1 else " ", "text" if i == 4 else "lines") for i in range(1, 9)]
    got = {r["table_id"]: r for r in grids.assess(slots(spark, tables), spark.createDataFrame(info, "table_id bigint, caption string, strategy string")).collect()}
    assert {i: (r["score"], r["status"]) for i, r in got.items()} == {
        1: (0.94, "pass"), 2: (0.66, "review"), 3: (0.825, "pass"), 4: (0.42, "reject"), 5: (0.0, "reject"), 6: (0.8, "pass"), 7: (0.58, "review"), 8: (0.0, "reject"),
    }
    assert (got[1]["density"], got[8]["n_columns"], got[6]["private"]) == (0.75, 0, 0.2)


def test_cleaning(spark):
    texts = ["\ufb01ne\u00ad print\u3000\uff21  b\n", None, "", "\ue000\ue001 x \ue002y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = df.select(grids.clean_text("t").alias("c"), grids.private_use(F.col("t")).alias("p"), grids.readable(F.col("t")).alias("r")).collect()
    assert [r["c"] for r in rows][:3] == ["fine print A b", "", ""]
    assert [round(r["p"], 3) for r in rows] == [0.0, 0.0, 0.0, 0.429] and rows[3]["r"] == "[formula] x [formula] y"


def test_bodies_of_a_page(spark):
    rows = [(1, "a" * 60), (1, " " + "a" * 60), (1, "b" * 70), (1, "c" * 70), (1, "short"), (2, None), (2, "d" * 59), (None, "e" * 61)]
    got = {r["page"]: r["text"] for r in grids.page_bodies(spark.createDataFrame(rows, "page bigint, text string")).collect()}
    assert got == {1: "\n\n".join(["b" * 70, "c" * 70, "a" * 60]), None: "e" * 61}
