"""Boxes on pages: overlaps by grid tiles, greedy suppression, nearest captions, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import load, r6
from .scratch import written

#: Side of a tile.
TILE = 100.0
#: Boxes that overlap so far are one; a caption may stand so many pages' heights below its figure.
SAME, CAPTION_GAP = 0.92, 0.1
PAGE_WIDTH, PAGE_HEIGHT = 700.0, 1000.0


def area(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{p}x1") - F.col(f"{p}x0")) * F.greatest(F.lit(0.0), F.col(f"{p}y1") - F.col(f"{p}y0"))


def common(a: str, b: str) -> Column:
    """The area that two boxes share."""
    side = lambda c: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{c}1"), F.col(f"{b}{c}1")) - F.greatest(F.col(f"{a}{c}0"), F.col(f"{b}{c}0")))
    return side("x") * side("y")


def iou(a: str, b: str) -> Column:
    """Shared area to the area of both; 0 where neither has any."""
    whole = area(a) + area(b) - common(a, b)
    return F.when(whole > 0, common(a, b) / whole).otherwise(0.0)


def clipped(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes cut to the page; one that lies off it has no area."""
    to = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(most)).alias(c)
    return boxes.select(*[to(c, width if c[0] == "x" else height) if c in ("x0", "x1", "y0", "y1") else c for c in boxes.columns])


def _tiles(boxes: DataFrame, tile: float) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / tile)
    across = boxes.select("*", F.explode(F.sequence(at("x0"), at("x1"))).alias("tx"))
    return across.select("*", F.explode(F.sequence(at("y0"), at("y1"))).alias("ty"))


def overlaps(boxes: DataFrame, least: float, *, tile: float = TILE) -> DataFrame:
    """page, a, b, iou of boxes (page, block, x0, y0, x1, y1) of one page with an IoU of ``least`` (above 0) or more, a before b.

    Boxes meet in the tiles that they touch, and a pair only in the one that
    has the upper left corner of what they share.  Boxes with a null or
    without area meet nothing.
    """
    fine = boxes.where("page IS NOT NULL AND block IS NOT NULL AND x1 > x0 AND y1 > y0").select("page", "block", "x0", "y0", "x1", "y1")
    dealt = _tiles(fine, tile)
    named = lambda p: dealt.select("page", "tx", "ty", *[F.col(c).alias(f"{p}{c}") for c in ("block", "x0", "y0", "x1", "y1")])
    corner = lambda c: F.floor(F.greatest(f"a{c}0", f"b{c}0") / tile)
    met = named("a").join(named("b"), ["page", "tx", "ty"]).where((F.col("ablock") < F.col("bblock")) & (F.col("tx") == corner("x")) & (F.col("ty") == corner("y")))
    return met.withColumn("iou", iou("a", "b")).where(F.col("iou") >= least).select("page", F.col("ablock").alias("a"), F.col("bblock").alias("b"), "iou")


def suppressed(boxes: DataFrame, least: float = SAME) -> DataFrame:
    """page, block of the boxes that go: those that a *kept* box of their page, surer or equally sure with a smaller block, overlaps by ``least``.

    Each step keeps the boxes that no undecided one precedes and drops what
    they overlap, so that what a dropped box overlaps stays free.  Steps are
    joins over the pairs that are left; there are as many as the longest chain
    of boxes is long.  A null score is below all others.
    """
    sure = boxes.select("page", "block", F.coalesce(F.col("sure").cast("double"), F.lit(float("-inf"))).alias("sure"))
    side = lambda c: sure.select("page", F.col("block").alias(c), F.col("sure").alias(f"{c}_sure"))
    pairs = overlaps(boxes, least).join(side("a"), ["page", "a"]).join(side("b"), ["page", "b"])
    a_first = F.col("a_sure") >= F.col("b_sure")
    edges = written(pairs.select("page", F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("high"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("low")))
    gone = None
    while not edges.isEmpty():
        lower = edges.select("page", F.col("low").alias("high")).distinct()
        kept = edges.select("page", "high").distinct().join(lower, ["page", "high"], "left_anti")
        dropped = written(edges.join(kept, ["page", "high"], "left_semi").select("page", F.col("low").alias("block")).distinct())
        gone = dropped if gone is None else gone.unionByName(dropped)
        as_side = lambda c: dropped.withColumnRenamed("block", c)  # noqa: B023, E731
        edges = written(edges.join(as_side("low"), ["page", "low"], "left_anti").join(as_side("high"), ["page", "high"], "left_anti"))
    return gone if gone is not None else boxes.select("page", "block").limit(0)


def nearest_below(figures: DataFrame, captions: DataFrame, most: float, *, tile: float = TILE) -> DataFrame:
    """page, block, gap, caption: for each figure the nearest caption that begins within ``most`` below it and overlaps it sideways; ties by caption.

    Both meet in the strips of the page that they touch, once: in that of the left end of what they share.
    """
    strips = lambda d: d.where("x1 > x0").select("*", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))).alias("tx"))
    below = strips(captions).select("page", "tx", F.col("block").alias("caption"), F.col("x0").alias("c0"), F.col("x1").alias("c1"), F.col("y0").alias("top"))
    met = strips(figures).join(below, ["page", "tx"]).withColumn("gap", F.col("top") - F.col("y1"))
    fits = F.col("gap").between(0, most) & (F.least("x1", "c1") > F.greatest("x0", "c0")) & (F.col("tx") == F.floor(F.greatest("x0", "c0") / tile))
    return met.where(fits).groupBy("page", "block").agg(F.min(F.struct("gap", "caption")).alias("r")).select("page", "block", "r.gap", "r.caption")


def shifted_boxes(parts: DataFrame) -> DataFrame:
    """Parts as boxes in chains: each is a little to the right of others of its column and row, price says how sure it is."""
    k = F.col("p_partkey")
    x0, y0 = (k % 3 * 230).cast("double") + (k % 25) * 2.5, (k % 2 * 40).cast("double")
    return parts.select(F.expr("p_partkey div 100").alias("page"), k.alias("block"), x0.alias("x0"), y0.alias("y0"), (x0 + 150).alias("x1"), (y0 + 30).alias("y1"), F.col("p_retailprice").cast("double").alias("sure"))


_SHIFTED = """b AS (SELECT p_partkey // 100 AS page, p_partkey AS block, (p_partkey % 3 * 230)::DOUBLE + (p_partkey % 25) * 2.5::DOUBLE AS x0, (p_partkey % 2 * 40)::DOUBLE AS y0, p_retailprice::DOUBLE AS sure FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY sure DESC, block) AS i FROM b)"""


def iou_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page without those that a surer kept one covers to 0.92 of their union."""
    b = shifted_boxes(load(spark, sf_dir, "part"))
    return b.join(suppressed(b), ["page", "block"], "left_anti").select("page", "block", r6("x0").alias("x0"), "y0", "sure")


# the rule itself, box by box: kept ones are carried in a list
IOU_SQL = f"""WITH RECURSIVE {_SHIFTED},
r AS (SELECT page, 0::BIGINT AS i, []::STRUCT(x DOUBLE, y DOUBLE, block BIGINT)[] AS kept FROM (SELECT DISTINCT page FROM n)
UNION ALL SELECT r.page, n.i, CASE WHEN len(list_filter(kept, lambda k: k.y = n.y0 AND greatest(0, 150 - abs(k.x - n.x0)) / (300 - greatest(0, 150 - abs(k.x - n.x0))) >= {SAME})) > 0 THEN kept ELSE list_append(kept, {{'x': n.x0, 'y': n.y0, 'block': n.block}}) END FROM r JOIN n ON n.page = r.page AND n.i = r.i + 1),
k AS (SELECT page, unnest(arg_max(kept, i)).block AS block FROM r GROUP BY page)
SELECT b.page, b.block, round(x0, 6) AS x0, y0, sure FROM b JOIN k ON k.page = b.page AND k.block = b.block"""


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of a page that overlap by half or more."""
    return overlaps(shifted_boxes(load(spark, sf_dir, "part")), 0.5).select("page", "a", "b", r6("iou").alias("iou"))


OVERLAP_SQL = f"""WITH {_SHIFTED} SELECT a.page, a.block AS a, b.block AS b, round((150 - abs(a.x0 - b.x0)) / (150 + abs(a.x0 - b.x0)), 6) AS iou
FROM b a JOIN b ON a.page = b.page AND a.block < b.block AND a.y0 = b.y0 AND abs(a.x0 - b.x0) < 150 WHERE (150 - abs(a.x0 - b.x0)) / (150 + abs(a.x0 - b.x0)) >= 0.5"""


def page_boxes(parts: DataFrame) -> DataFrame:
    """Parts as blocks all over a page, some of them beyond its edges; each fifth is a figure, and each fifth a caption."""
    k = F.col("p_partkey")
    x0, y0 = (k * 37 % 800 - 50).cast("double"), (k * 53 % 1100 - 50).cast("double")
    kind = F.when(k % 5 == 0, "figure").when(k % 5 == 1, "caption").otherwise("text")
    return parts.select(F.expr("p_partkey div 100").alias("page"), k.alias("block"), kind.alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + 60 + k % 7 * 20).alias("x1"), (y0 + 10 + k % 11 * 9).alias("y1"))


_PAGED = """b AS (SELECT p_partkey // 100 AS page, p_partkey AS block, CASE p_partkey % 5 WHEN 0 THEN 'figure' WHEN 1 THEN 'caption' ELSE 'text' END AS kind, (p_partkey * 37 % 800 - 50)::DOUBLE AS x0, (p_partkey * 53 % 1100 - 50)::DOUBLE AS y0,
  (p_partkey * 37 % 800 - 50 + 60 + p_partkey % 7 * 20)::DOUBLE AS x1, (p_partkey * 53 % 1100 - 50 + 10 + p_partkey % 11 * 9)::DOUBLE AS y1 FROM part)"""


def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure with its nearest caption within a tenth of the page's height below it."""
    b = page_boxes(load(spark, sf_dir, "part"))
    return nearest_below(b.where("kind = 'figure'"), b.where("kind = 'caption'"), CAPTION_GAP * PAGE_HEIGHT)


CAPTIONS_SQL = f"""WITH {_PAGED} SELECT f.page, f.block, c.y0 - f.y1 AS gap, c.block AS caption FROM b f JOIN b c ON f.page = c.page AND f.kind = 'figure' AND c.kind = 'caption' AND c.y0 - f.y1 BETWEEN 0 AND {CAPTION_GAP * PAGE_HEIGHT}
  AND least(f.x1, c.x1) > greatest(f.x0, c.x0) QUALIFY row_number() OVER (PARTITION BY f.page, f.block ORDER BY gap, caption) = 1"""


def crop_manifest(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """element_id, crop_path and the clipped box of figures that lie on their page at least in part."""
    cut = clipped(boxes.where("kind = 'figure'"), width, height).where("x1 > x0 AND y1 > y0")
    element = F.format_string("p%03d_e%d", "page", "block")
    return cut.select(element.alias("element_id"), F.concat(F.lit("crops/"), element, F.lit(".png")).alias("crop_path"), "x0", "y0", "x1", "y1")


def crop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crop of every element by its id, null where it has none, and the share of the element that is on it."""
    b = page_boxes(load(spark, sf_dir, "part"))
    crops = written(crop_manifest(b, PAGE_WIDTH, PAGE_HEIGHT)).select("element_id", "crop_path", area().alias("on_page"))
    elements = b.select(F.format_string("p%03d_e%d", "page", "block").alias("element_id"), "kind", area().alias("whole"))
    found = elements.join(crops.groupBy("element_id").agg(F.min("crop_path").alias("crop_path"), F.max("on_page").alias("on_page")), "element_id", "left")
    return found.select("element_id", "kind", "crop_path", r6(F.col("on_page") / F.col("whole")).alias("share"))


CROP_SQL = f"""WITH {_PAGED}, c AS (SELECT *, greatest(0, least(x1, {PAGE_WIDTH}) - greatest(x0, 0)) * greatest(0, least(y1, {PAGE_HEIGHT}) - greatest(y0, 0)) AS on_page, printf('p%03d_e%d', page, block) AS element_id FROM b)
SELECT element_id, kind, CASE WHEN kind = 'figure' AND on_page > 0 THEN 'crops/' || element_id || '.png' END AS crop_path, CASE WHEN kind = 'figure' AND on_page > 0 THEN round(on_page / ((x1 - x0) * (y1 - y0)), 6) END AS share FROM c"""


QUERIES = {f.__name__: f for f in (iou_dedupe, box_overlaps, figure_captions, crop_lookup)}
ORACLES = {"iou_dedupe": IOU_SQL, "box_overlaps": OVERLAP_SQL, "figure_captions": CAPTIONS_SQL, "crop_lookup": CROP_SQL}
