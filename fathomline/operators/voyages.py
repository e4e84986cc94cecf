"""Voyages from a log, their figures, ratings, reports and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import carbon
from ..model import DEFAULT_DWT, SAILING_KNOTS, SENSOR_SQL, load, r6, sensor
from .intervals import range_join

EARTH_NM = 3440.065


def segments(log: DataFrame) -> DataFrame:
    """vessel, voyage, start_ts, end_ts, n_rows: runs of rows under way (gaps and islands)."""
    w = Window.partitionBy("vessel").orderBy("ts", "event_id")
    sailing = F.col("sog") > SAILING_KNOTS
    marked = log.select("vessel", "ts", "event_id", sailing.alias("sailing"))
    begun = marked.withColumn("begins", (F.col("sailing") & ~F.coalesce(F.lag("sailing").over(w), F.lit(False))).cast("long"))
    numbered = begun.withColumn("voyage", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("sailing")
    return numbered.groupBy("vessel", "voyage").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_rows"))


SEGMENTS = f"""
s AS ({SENSOR_SQL}),
m AS (SELECT vessel, ts, event_id, sog > {SAILING_KNOTS} AS sailing, lag(sog > {SAILING_KNOTS}) OVER (PARTITION BY vessel ORDER BY ts, event_id) AS before FROM s),
n AS (SELECT *, sum(CASE WHEN sailing AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY vessel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS voyage FROM m),
v AS (SELECT vessel, CAST(voyage AS BIGINT) AS voyage, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM n WHERE sailing GROUP BY ALL)
"""


def voyage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(sensor(spark, sf_dir))


def _hop(w) -> Column:
    """Great-circle miles from the row before."""
    lat, lon = F.radians("lat"), F.radians("lon")
    lat0, lon0 = F.radians(F.lag("lat").over(w)), F.radians(F.lag("lon").over(w))
    a = F.pow(F.sin((lat - lat0) / 2), 2) + F.cos(lat0) * F.cos(lat) * F.pow(F.sin((lon - lon0) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))) * EARTH_NM


HOP = f"2 * asin(sqrt(least(greatest(pow(sin((radians(lat) - radians(lag(lat) OVER w)) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lag(lon) OVER w)) / 2), 2), 0), 1))) * {EARTH_NM}"


def voyage_figures(log: DataFrame) -> DataFrame:
    """Per voyage: hours (rows), tonnes, mean speed under way, miles (a row is an hour)."""
    return figures_of(range_join(log, segments(log).select("vessel", "voyage", "start_ts", "end_ts"), ["vessel"], "ts", "start_ts", "end_ts"))


def figures_of(joined: DataFrame) -> DataFrame:
    """The figures of voyages from rows of the log beside their voyage."""
    under_way = F.col("sog") > SAILING_KNOTS
    return joined.groupBy("vessel", "voyage").agg(
        F.count(F.lit(1)).alias("hours"),
        F.round(F.sum("oil") / 1000, 8).alias("oil_t"),
        F.round(F.sum("gas") / 1000, 8).alias("gas_t"),
        F.round(F.sum("co2") / 1000, 8).alias("co2_t"),
        r6(F.avg(F.when(under_way, F.col("sog")))).alias("mean_sog"),
        r6(F.sum(F.when(under_way, F.col("sog")).otherwise(0.0))).alias("miles"),
        F.min(F.year("start_ts")).cast("long").alias("year"),
    )


FIGURES = f"""
{SEGMENTS},
k AS (SELECT s.vessel, v.voyage, count(*) AS hours, round(sum(oil) / 1000, 8) AS oil_t, round(sum(gas) / 1000, 8) AS gas_t, round(sum(co2) / 1000, 8) AS co2_t,
  round(avg(CASE WHEN sog > {SAILING_KNOTS} THEN sog END), 6) AS mean_sog, round(sum(CASE WHEN sog > {SAILING_KNOTS} THEN sog ELSE 0 END), 6) AS miles, min(year(v.start_ts)) AS year
  FROM s JOIN v ON s.vessel = v.vessel AND s.ts BETWEEN v.start_ts AND v.end_ts GROUP BY s.vessel, v.voyage)
"""


def voyage_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voyage_figures(sensor(spark, sf_dir))


def carbon_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: log to voyages to figures to grades."""
    k = voyage_figures(sensor(spark, sf_dir)).withColumn("dwt", F.lit(DEFAULT_DWT))
    ok = k.withColumn("status", carbon.status(F.col("year"), F.col("dwt"), F.col("co2_t"), F.col("miles")))
    fine = F.col("status") == "ok"
    rated = ok.withColumn("required", F.when(fine, carbon.required(F.col("dwt"), F.col("year")))).withColumn("attained", F.when(fine, carbon.attained(F.col("co2_t"), F.col("dwt"), F.col("miles"))))
    return rated.select("vessel", "voyage", "hours", "co2_t", "miles", "status", r6("required").alias("required"), r6("attained").alias("attained"), carbon.grade(F.col("attained"), F.col("required")).alias("grade"))


_Z = " ".join(f"WHEN {y} THEN {z}::DOUBLE" for y, z in carbon.REDUCTION.items())
CARBON_SQL = f"""
WITH {FIGURES},
z AS (SELECT *, CASE year {_Z} END AS zp FROM k),
t AS (SELECT *, CASE WHEN zp IS NULL THEN 'year' WHEN co2_t < 0 THEN 'co2' WHEN miles <= 0 THEN 'distance' ELSE 'ok' END AS status FROM z),
a AS (SELECT *, CASE WHEN status = 'ok' THEN 4745.0::DOUBLE * pow({DEFAULT_DWT}::DOUBLE, -0.622::DOUBLE) * (100.0 - zp) / 100.0 END AS req, CASE WHEN status = 'ok' THEN co2_t * 1e6 / ({DEFAULT_DWT}::DOUBLE * miles) END AS att FROM t)
SELECT vessel, voyage, hours, co2_t, miles, status, round(req, 6) AS required, round(att, 6) AS attained,
  CASE WHEN att IS NULL THEN NULL WHEN att <= req * 0.86::DOUBLE THEN 'A' WHEN att <= req * 0.94::DOUBLE THEN 'B' WHEN att <= req * 1.06::DOUBLE THEN 'C' WHEN att <= req * 1.18::DOUBLE THEN 'D' ELSE 'E' END AS grade FROM a
"""


def ytd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vessel and year: sums over voyages; only the sums, not the miles, leave out rows that don't sail."""
    log = sensor(spark, sf_dir)
    j = range_join(log, segments(log).select("vessel", "voyage", "start_ts", "end_ts"), ["vessel"], "ts", "start_ts", "end_ts")
    sails = F.col("sog") > SAILING_KNOTS
    return j.groupBy("vessel", F.year("ts").cast("long").alias("year")).agg(
        F.countDistinct("voyage").alias("voyages"),
        F.count(F.when(sails, 1)).alias("sailing_rows"),
        F.round(F.sum(F.when(sails, F.col("co2")).otherwise(0.0)) / 1000, 8).alias("co2_t"),
        r6(F.sum("sog")).alias("miles"),
    )


YTD_SQL = f"""WITH {SEGMENTS}
SELECT s.vessel, year(s.ts) AS year, count(DISTINCT v.voyage) AS voyages, count(*) FILTER (sog > {SAILING_KNOTS}) AS sailing_rows,
  round(sum(CASE WHEN sog > {SAILING_KNOTS} THEN co2 ELSE 0 END) / 1000, 8) AS co2_t, round(sum(sog), 6) AS miles
FROM s JOIN v ON s.vessel = v.vessel AND s.ts BETWEEN v.start_ts AND v.end_ts GROUP BY ALL"""


def distance_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Miles per vessel by positions or by speed, whichever can be trusted."""
    log = sensor(spark, sf_dir)
    valid = (F.col("lat") != 0) & (F.col("lon") != 0)
    by_speed = log.groupBy("vessel").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(valid, 1)).alias("n_valid"), r6(F.sum(F.when(F.col("sog") > SAILING_KNOTS, F.col("sog")).otherwise(0.0))).alias("sog_nm")
    )
    w = Window.partitionBy("vessel").orderBy("ts", "event_id")
    by_place = log.where(valid).withColumn("hop", _hop(w)).groupBy("vessel").agg(F.round(F.sum("hop"), 3).alias("coord_nm"))
    both = by_speed.join(by_place, "vessel", "left").withColumn("coord_nm", F.coalesce("coord_nm", F.lit(0.0)))
    speed = (100.0 * F.col("n_valid") / F.col("n_rows") < 50) | (F.col("coord_nm") <= 0) | ((F.col("sog_nm") > 0) & (F.col("coord_nm") < 0.7 * F.col("sog_nm")))
    return both.withColumn("method", F.when(speed, "sog").otherwise("haversine")).withColumn("distance_nm", F.when(speed, F.col("sog_nm")).otherwise(F.col("coord_nm")))


DISTANCE_SQL = f"""WITH s AS ({SENSOR_SQL}),
a AS (SELECT vessel, count(*) AS n_rows, count(*) FILTER (lat <> 0 AND lon <> 0) AS n_valid, round(sum(CASE WHEN sog > {SAILING_KNOTS} THEN sog ELSE 0 END), 6) AS sog_nm FROM s GROUP BY 1),
h AS (SELECT vessel, {HOP} AS hop FROM s WHERE lat <> 0 AND lon <> 0 WINDOW w AS (PARTITION BY vessel ORDER BY ts, event_id)),
c AS (SELECT vessel, round(sum(hop), 3) AS coord_nm FROM h GROUP BY 1),
b AS (SELECT a.*, coalesce(coord_nm, 0) AS coord_nm FROM a LEFT JOIN c USING (vessel)),
d AS (SELECT *, CASE WHEN 100.0 * n_valid / n_rows < 50 OR coord_nm <= 0 OR (sog_nm > 0 AND coord_nm < 0.7::DOUBLE * sog_nm) THEN 'sog' ELSE 'haversine' END AS method FROM b)
SELECT *, CASE WHEN method = 'sog' THEN sog_nm ELSE coord_nm END AS distance_nm FROM d"""


def noon_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vessel and day: sums, first and last row, whether the day is whole, course made good."""
    log = sensor(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    valid = (F.col("lat") != 0) & (F.col("lon") != 0)
    at = F.struct("ts", "event_id", "lat", "lon")
    d = log.groupBy("vessel", "day").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum("oil") / 1000, 8).alias("oil_t"),
        F.round(F.sum("co2") / 1000, 8).alias("co2_t"),
        r6(F.avg(F.when(F.col("sog") > SAILING_KNOTS, F.col("sog")))).alias("mean_sog"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min(F.when(valid, at)).alias("a"),
        F.max(F.when(valid, at)).alias("b"),
    )
    north, east = F.col("b.lat") - F.col("a.lat"), F.col("b.lon") - F.col("a.lon")
    course = F.when((north != 0) | (east != 0), (F.degrees(F.atan2(east, north)) + F.lit(360.0)) % F.lit(360.0))
    whole = (F.hour("first_ts") == 0) & (F.hour("last_ts") >= 23) & (F.col("n_rows") >= 24)
    return d.select("vessel", "day", "n_rows", "oil_t", "co2_t", "mean_sog", "first_ts", "last_ts", (~whole).alias("is_partial"), r6(course).alias("course"))


NOON_SQL = f"""WITH s AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM ({SENSOR_SQL})),
d AS (SELECT vessel, day, count(*) AS n_rows, round(sum(oil) / 1000, 8) AS oil_t, round(sum(co2) / 1000, 8) AS co2_t, round(avg(CASE WHEN sog > {SAILING_KNOTS} THEN sog END), 6) AS mean_sog, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2),
p AS (SELECT vessel, day, lat, lon, row_number() OVER (PARTITION BY vessel, day ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY vessel, day ORDER BY ts DESC, event_id DESC) AS j FROM s WHERE lat <> 0 AND lon <> 0),
c AS (SELECT a.vessel, a.day, b.lat - a.lat AS north, b.lon - a.lon AS east FROM p a JOIN p b ON a.vessel = b.vessel AND a.day = b.day AND a.i = 1 AND b.j = 1)
SELECT d.vessel, d.day, n_rows, oil_t, co2_t, mean_sog, first_ts, last_ts, NOT (hour(first_ts) = 0 AND hour(last_ts) >= 23 AND n_rows >= 24) AS is_partial,
  CASE WHEN north <> 0 OR east <> 0 THEN round((degrees(atan2(east, north)) + 360.0::DOUBLE) % 360.0::DOUBLE, 6) END AS course
FROM d LEFT JOIN c ON d.vessel = c.vessel AND d.day = c.day"""


def latest_per_vessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row with a position or speed, else the last row of any kind."""
    best = F.max(F.struct(((F.col("lat") != 0) | (F.col("sog") > SAILING_KNOTS)).alias("useful"), "ts", "event_id", "lat", "lon", "sog")).alias("r")
    return sensor(spark, sf_dir).groupBy("vessel").agg(best).select("vessel", "r.useful", "r.ts", "r.event_id", "r.lat", "r.lon", "r.sog")


LATEST_SQL = f"""SELECT vessel, useful, ts, event_id, lat, lon, sog FROM (
  SELECT *, lat <> 0 OR sog > {SAILING_KNOTS} AS useful FROM ({SENSOR_SQL})) QUALIFY row_number() OVER (PARTITION BY vessel ORDER BY useful DESC, ts DESC, event_id DESC) = 1"""


def nth_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order but one."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return load(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n = 2").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


NTH_SQL = "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 2"


def uncovered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows that no voyage covers."""
    log = sensor(spark, sf_dir)
    return range_join(log.select("vessel", "ts", "event_id", "sog"), segments(log), ["vessel"], "ts", "start_ts", "end_ts", "left_anti")


UNCOVERED_SQL = f"WITH {SEGMENTS} SELECT vessel, ts, event_id, sog FROM s WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.vessel = s.vessel AND s.ts BETWEEN v.start_ts AND v.end_ts)"

ORDER_DAYS = 30


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("orderkey"), "o_custkey", F.col("o_orderdate").alias("start_ts"), F.expr(f"o_orderdate + INTERVAL {ORDER_DAYS} DAYS").alias("end_ts"))


def recent_left_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 last shipments (a report of that size) with the order interval they fall into, if any."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_shipdate", "l_quantity")
    recent = li.orderBy(F.desc("l_shipdate"), "orderkey", "l_linenumber").limit(500)
    return range_join(recent, order_intervals(spark, sf_dir), ["orderkey"], "l_shipdate", "start_ts", "end_ts", "left", by_day=False)


RECENT_SQL = f"""WITH r AS (SELECT l_orderkey AS orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem ORDER BY l_shipdate DESC, orderkey, l_linenumber LIMIT 500)
SELECT r.*, o_custkey, o_orderdate AS start_ts, CASE WHEN o_orderkey IS NOT NULL THEN o_orderdate + INTERVAL {ORDER_DAYS} DAY END AS end_ts
FROM r LEFT JOIN orders ON o_orderkey = orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL {ORDER_DAYS} DAY"""


def annual_voyages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer and year of start: order intervals and what was shipped inside them."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_shipdate", "l_quantity")
    per = range_join(li, order_intervals(spark, sf_dir), ["orderkey"], "l_shipdate", "start_ts", "end_ts", by_day=False).groupBy("orderkey", "o_custkey", "start_ts").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return per.groupBy("o_custkey", F.year("start_ts").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("intervals"), F.sum("n").alias("shipments"), r6(F.sum("q")).alias("quantity"), F.max("n").alias("most"))


ANNUAL_SQL = f"""WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate, count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL {ORDER_DAYS} DAY GROUP BY 1, 2, 3)
SELECT o_custkey, year(o_orderdate) AS year, count(*) AS intervals, CAST(sum(n) AS BIGINT) AS shipments, round(sum(q), 6) AS quantity, max(n) AS most FROM p GROUP BY 1, 2"""


def monitor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(F.to_date("ts")).alias("n_days"), F.countDistinct("vessel").alias("n_vessels"))


MONITOR_SQL = f"SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts::DATE) AS n_days, count(DISTINCT vessel) AS n_vessels FROM ({SENSOR_SQL})"


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vessel the voyage that holds its last row, if one does."""
    log = sensor(spark, sf_dir)
    last = log.groupBy("vessel").agg(F.max("ts").alias("ts"))
    j = range_join(last, segments(log), ["vessel"], "ts", "start_ts", "end_ts")
    w = Window.partitionBy("vessel").orderBy(F.desc("voyage"), F.desc("start_ts"))
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


POINT_SQL = f"""WITH {SEGMENTS}, l AS (SELECT vessel, max(ts) AS ts FROM s GROUP BY 1)
SELECT l.vessel, l.ts, v.voyage, v.start_ts, v.end_ts, v.n_rows FROM l JOIN v ON l.vessel = v.vessel AND l.ts BETWEEN v.start_ts AND v.end_ts QUALIFY row_number() OVER (PARTITION BY l.vessel ORDER BY v.voyage DESC, v.start_ts DESC) = 1"""


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel states by type: a first batch before the 15th, upserted with all later rows; the last writer holds."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")

    def state(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
        return last.select("user_id", "event_type", "r.ts", "r.event_id", "r.value")

    cut = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return upsert(state(e.where(cut)), state(e.where(~cut)), ["user_id", "event_type"])


UPSERT_SQL = "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"


def incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after each vessel's watermark (its last row before the 10th) that bring a new (minute, type)."""
    e = load(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    loaded = e.where(F.col("ts") < cut)
    marks = loaded.groupBy("user_id").agg(F.max("ts").alias("mark"))
    fresh = e.join(marks, "user_id", "left").where(F.col("mark").isNull() | (F.col("ts") > F.col("mark")))
    new = fresh.join(loaded.select("user_id", "minute", "event_type").distinct(), ["user_id", "minute", "event_type"], "left_anti")
    return new.groupBy("user_id", "minute", "event_type").agg(F.min("event_id").alias("event_id"))


INCREMENTAL_SQL = """WITH e AS (SELECT *, date_trunc('minute', ts) AS minute FROM events), l AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-10'),
m AS (SELECT user_id, max(ts) AS mark FROM l GROUP BY 1)
SELECT e.user_id, e.minute, e.event_type, min(e.event_id) AS event_id FROM e LEFT JOIN m ON e.user_id = m.user_id
WHERE (mark IS NULL OR e.ts > mark) AND NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = e.user_id AND l.minute = e.minute AND l.event_type = e.event_type) GROUP BY 1, 2, 3"""


def schedule_open_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules: an open order ends at the last date known; those that end before they begin are dropped."""
    o = load(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    end = F.when(F.col("o_orderstatus") == "O", F.col("last")).otherwise(F.expr("o_orderdate + INTERVAL 14 DAYS"))
    rows = o.join(last, F.lit(True), "left").withColumn("end_ts", end).where(F.col("end_ts") >= F.col("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    n = F.row_number().over(w)
    return rows.select("o_orderkey", F.format_string("%d_V%02d_%s", "o_custkey", n, "o_orderstatus").alias("voyage_id"), F.col("o_orderdate").alias("start_ts"), "end_ts")


SCHEDULE_SQL = """WITH r AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN max(o_orderdate) OVER () ELSE o_orderdate + INTERVAL 14 DAY END AS end_ts FROM orders)
SELECT o_orderkey, printf('%d_V%02d_%s', o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderstatus) AS voyage_id, o_orderdate AS start_ts, end_ts FROM r WHERE end_ts >= o_orderdate"""


def stage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between a user's events, and from the first to the last event of each kind."""
    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    d = e.withColumn("gap", us / 1e6)
    kinds = ["click", "error", "purchase", "signup", "view"]
    first = [F.min(F.when(F.col("event_type") == k, F.col("ts"))).alias(f"first_{k}") for k in kinds]
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), r6(F.max("gap")).alias("longest_gap"), r6(F.avg("gap")).alias("mean_gap"), *first)


STAGE_SQL = """WITH d AS (SELECT *, datediff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS gap FROM events)
SELECT user_id, count(*) AS n_events, round(max(gap), 6) AS longest_gap, round(avg(gap), 6) AS mean_gap,
""" + ", ".join(f"min(CASE WHEN event_type = '{k}' THEN ts END) AS first_{k}" for k in ["click", "error", "purchase", "signup", "view"]) + " FROM d GROUP BY 1"


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of the JSON column; what can't be read is null."""
    k = F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count(k).alias("n_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


PROPS_SQL = """SELECT event_type, count(*) AS n_rows, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"""

QUERIES = {f.__name__: f for f in (voyage_segments, voyage_kpi, carbon_rating, ytd_summary, distance_method, noon_daily, latest_per_vessel, nth_latest, uncovered_points, recent_left_interval, annual_voyages, monitor_stats, point_in_interval, upsert_last_wins, incremental_dedup, schedule_open_end, stage_deltas, props_json)}
ORACLES = {
    "voyage_segments": f"WITH {SEGMENTS} SELECT * FROM v",
    "voyage_kpi": f"WITH {FIGURES} SELECT * FROM k",
    "carbon_rating": CARBON_SQL,
    "ytd_summary": YTD_SQL,
    "distance_method": DISTANCE_SQL,
    "noon_daily": NOON_SQL,
    "latest_per_vessel": LATEST_SQL,
    "nth_latest": NTH_SQL,
    "uncovered_points": UNCOVERED_SQL,
    "recent_left_interval": RECENT_SQL,
    "annual_voyages": ANNUAL_SQL,
    "monitor_stats": MONITOR_SQL,
    "point_in_interval": POINT_SQL,
    "upsert_last_wins": UPSERT_SQL,
    "incremental_dedup": INCREMENTAL_SQL,
    "schedule_open_end": SCHEDULE_SQL,
    "stage_deltas": STAGE_SQL,
    "props_json": PROPS_SQL,
}
