"""Dense retrieval, rank fusion, routing and quotas.

Queries are all vectors whose id is divisible by 20, searched against all
others.  Splits of the vectors and groups of the queries meet in a grid, block
by block as matrix products, and only a cell's best rows go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import load, r6, tokens
from .scratch import written

VECTORS, QUERY_VECTORS = 2048, 512
#: Vectors of a split and queries of a group: they change no result.
SPLIT, GROUP = 1 << 16, 1 << 14
DEPTH = 20
COARSE = 16


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Unit vectors of a column of arrays of one length."""
    flat = pa.compute.list_flatten(column).to_numpy().astype(float)
    return _unit(flat.reshape(len(column), -1)[:, :dims]) if len(column) else np.zeros((0, 1))


class Best:
    """The best ``depth`` rows that queries have met so far, by score (six decimals), then by id."""

    def __init__(self, q_ids: np.ndarray, depth: int):
        self.q_ids, self.depth = q_ids, depth
        self.query, self.row, self.id, self.score = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(q_ids), -np.inf)

    def meet(self, queries: np.ndarray, ids: np.ndarray, raw: np.ndarray, base: int, wanted: np.ndarray | None = None) -> None:
        """``raw`` has the likeness of ``queries`` (places) to rows of ``ids``, the first of which is row ``base``; a query isn't its own hit."""
        if wanted is not None:
            raw = np.where(wanted, raw, -np.inf)
        least, k = self.least[queries], raw.shape[1] - self.depth - 1
        fresh = np.isneginf(least)
        if k > 0 and fresh.any():
            least[fresh] = np.partition(raw[fresh], k, axis=1)[:, k] - 2e-6
        q, v = np.nonzero((raw >= least[:, None]) & (raw > -np.inf))
        other = ids[v] != self.q_ids[queries[q]]
        q, v = q[other], v[other]
        query, score = np.concatenate([self.query, queries[q]]), np.concatenate([self.score, np.round(raw[q, v], 6)])
        row, ids = np.concatenate([self.row, base + v]), np.concatenate([self.id, ids[v]])
        order = np.lexsort((ids, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.depth
        order = order[kept]
        self.query, self.row, self.id, self.score = query[kept], row[order], ids[order], score[order]
        last = rank[kept] == self.depth - 1
        # scores are rounded: what is this little below may still be equal
        self.least[self.query[last]] = self.score[last] - 2e-6


def _nearest(many: pa.Table, asked: pa.Table, depth: int, dims: int | None) -> pa.Table:
    """Each query's best rows of a cell, block by block."""
    a, b = matrix(many.column("embedding"), dims), matrix(asked.column("q_embedding"), dims)
    ids, q_ids = many.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
    rows, queries, scores = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for begin in range(0, len(b), QUERY_VECTORS):
        some = np.arange(min(QUERY_VECTORS, len(b) - begin))
        best = Best(q_ids[begin : begin + QUERY_VECTORS], depth)
        for at in range(0, len(a), VECTORS):
            best.meet(some, ids[at : at + VECTORS], b[begin : begin + QUERY_VECTORS] @ a[at : at + VECTORS].T, at)
        rows.append(best.row)
        queries.append(begin + best.query)
        scores.append(best.score)
    row, query = pa.array(np.concatenate(rows)), pa.array(np.concatenate(queries))
    return pa.table([asked.column("query_id").take(query), asked.column("query_label").take(query), many.column("vec_id").take(row), many.column("label").take(row), pa.array(np.concatenate(scores))], ["query_id", "query_label", "vec_id", "label", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, depth: int, dims: int | None = None, by: str | None = None) -> DataFrame:
    """query_id, query_label, vec_id, label, score: the best ``depth`` rows or more for each query, of equal values of ``by``.

    Splits of the vectors meet groups of the queries in cells of a grid, each a
    call of its own of bounded size, which gives one list for each of its queries.
    """
    usable = "embedding IS NOT NULL AND vec_id IS NOT NULL"
    label, scope = F.col("label").cast("long"), F.lit(0) if by is None else F.col(by)
    v = vectors.where(usable).select(scope.cast("long").alias("scope"), "vec_id", label.alias("label"), "embedding")
    q = queries.where(usable).select(scope.cast("long").alias("scope"), F.col("vec_id").alias("query_id"), label.alias("query_label"), F.col("embedding").alias("q_embedding"))
    n = v.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("splits")).join(q.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")), "scope")
    sized = written(n)  # a row per value of ``by``
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    many = v.join(sized, "scope").select("scope", dealt("vec_id", "splits").alias("split"), every("groups").alias("group"), "vec_id", "label", "embedding")
    asked = q.join(sized, "scope").select(F.col("scope").alias("q_scope"), every("splits").alias("q_split"), dealt("query_id", "groups").alias("q_group"), "query_id", "query_label", "q_embedding")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(left, right, depth, dims)

    met = many.groupBy("scope", "split", "group").cogroup(asked.groupBy("q_scope", "q_split", "q_group"))
    return met.applyInArrow(run, "query_id bigint, query_label bigint, vec_id bigint, label bigint, score double")


def search(vectors: DataFrame, queries: DataFrame, depth: int, dims: int | None = None) -> DataFrame:
    """query_id, query_label, vec_id, label, score (cosine, six decimals), rank up to ``depth``; a query isn't its own hit."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return nearest(vectors, queries, depth, dims).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= depth)


def lane(spark: SparkSession, sf_dir: str, dims: int | None = None, depth: int = DEPTH, asked: DataFrame | None = None) -> DataFrame:
    """The hits of all queries, or of those in ``asked`` (vec_id)."""
    v = load(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 20 = 0")
    return search(v, queries if asked is None else queries.join(asked, "vec_id", "left_semi"), depth, dims)


def _lane_sql(name: str, dims: int | None, depth: int = DEPTH) -> str:
    cut = f"[1:{dims}]" if dims else ""
    return f"""{name} AS (SELECT query_id, query_label, vec_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, q.label::BIGINT AS query_label, v.vec_id, v.label::BIGINT AS label,
    round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
  FROM (SELECT vec_id, label, (embedding::DOUBLE[]){cut} AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, label, (embedding::DOUBLE[]){cut} AS e FROM embeddings) v WHERE q.vec_id <> v.vec_id) QUALIFY rank <= {depth})"""


LANES = f"{_lane_sql('d', None)}, {_lane_sql('c', COARSE)}"


def dense_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lane(spark, sf_dir, depth=10).select("query_id", "vec_id", "label", "score", "rank")


def multi_vector_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the ten rows nearest to any of its query vectors."""
    near = lane(spark, sf_dir).groupBy("query_label", "vec_id").agg(r6(F.min(1 - F.col("score"))).alias("distance"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_label").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10")


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of the dense and the coarse lane with reciprocal ranks."""
    d = lane(spark, sf_dir).select("query_id", "query_label", "vec_id", "label", F.col("score").alias("ds"), F.col("rank").alias("dr"))
    c = lane(spark, sf_dir, COARSE).select("query_id", F.col("query_label").alias("ql"), "vec_id", F.col("label").alias("l"), F.col("score").alias("cs"), F.col("rank").alias("cr"))
    both = d.join(c, ["query_id", "vec_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (60 + F.col(r)), F.lit(0.0))
    return both.select("query_id", "vec_id", F.coalesce("query_label", "ql").alias("query_label"), F.coalesce("label", "l").alias("label"), "ds", "cs", "dr", "cr", (part("dr") + part("cr")).alias("rrf"))


FUSED = f"""{LANES}, f AS (SELECT query_id, vec_id, coalesce(d.query_label, c.query_label) AS query_label, coalesce(d.label, c.label) AS label, d.score AS ds, c.score AS cs, d.rank AS dr, c.rank AS cr,
  coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + c.rank), 0) AS rrf FROM d FULL JOIN c USING (query_id, vec_id))"""


def _ranked(df: DataFrame, score: str, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(fused(spark, sf_dir).select("query_id", "vec_id", "dr", "cr", F.round("rrf", 9).alias("rrf")), "rrf", DEPTH)


def boosted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks with a boost for both lanes and a priority for the query's own label."""
    boost = F.when(F.col("dr").isNotNull() & F.col("cr").isNotNull(), 0.05).otherwise(0.0)
    own = F.when(F.col("label") == F.col("query_label"), 0.25).otherwise(-0.2)
    return _ranked(fused(spark, sf_dir).select("query_id", "vec_id", "label", F.round(F.col("rrf") + boost + own, 9).alias("final")), "final", 30)


def protected_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight dense hits keep their places, then fused order; 24 in all."""
    f = fused(spark, sf_dir).withColumn("rrf", F.round("rrf", 9)).withColumn("lane", F.when(F.col("dr") <= 8, 0).otherwise(1))
    w = Window.partitionBy("query_id").orderBy("lane", F.when(F.col("lane") == 0, F.col("dr")), F.desc("rrf"), "vec_id")
    return f.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 24").select("query_id", "vec_id", F.col("lane").cast("long").alias("lane"), "place")


def minmax_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.68 cosine, 0.20 scaled reciprocal ranks, 0.12 scaled coarse score; equal values scale to 1."""
    w = Window.partitionBy("query_id")

    def scaled(c):
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(low == high, 1.0).otherwise((c - low) / (high - low))

    f = fused(spark, sf_dir)
    score = 0.68 * F.coalesce("ds", F.lit(0.0)) + 0.2 * scaled(F.col("rrf")) + 0.12 * scaled(F.coalesce("cs", F.lit(0.0)))
    return _ranked(f.select("query_id", "vec_id", r6(score).alias("final")), "final", 18)


_MM = "CASE WHEN min({0}) OVER w = max({0}) OVER w THEN 1.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"
MINMAX_SQL = f"""WITH {FUSED}, s AS (SELECT query_id, vec_id, round(0.68::DOUBLE * coalesce(ds, 0) + 0.2::DOUBLE * {_MM.format("rrf")} + 0.12::DOUBLE * {_MM.format("coalesce(cs, 0)")}, 6) AS final FROM f WINDOW w AS (PARTITION BY query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, vec_id) AS rank FROM s QUALIFY rank <= 18"""


def routes(hits: DataFrame) -> DataFrame:
    """query_id, label, score (lower is better), route (rank), margin to the next."""
    g = hits.groupBy("query_id", "query_label", "label").agg(F.min(1 - F.col("score")).alias("best"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    score = F.col("best") - F.least(F.lit(0.1), F.log1p("n") * 0.025) - F.when(F.col("label") == F.col("query_label"), 0.22).otherwise(0.0)
    w = Window.partitionBy("query_id").orderBy("score", "label")
    s = g.withColumn("score", r6(score))
    return s.select("query_id", "label", "n", "first", "score", F.row_number().over(w).cast("long").alias("route"), r6(F.lead("score").over(w) - F.col("score")).alias("margin"))


def doc_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(lane(spark, sf_dir))


ROUTES = """g AS (SELECT query_id, label, count(*) AS n, min(rank) AS first, round(min(1 - score) - least(0.1::DOUBLE, ln(1 + count(*)) * 0.025::DOUBLE) - CASE WHEN label = any_value(query_label) THEN 0.22::DOUBLE ELSE 0 END, 6) AS score FROM d GROUP BY 1, 2),
ro AS (SELECT *, row_number() OVER w AS route, round(lead(score) OVER w - score, 6) AS margin FROM g WINDOW w AS (PARTITION BY query_id ORDER BY score, label))"""


def routed_stage2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second stage inside the two best labels of each query, with a boost by the label's place."""
    v = load(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 20 = 0")
    top = written(routes(search(v, queries, DEPTH)).where("route <= 2").select("query_id", F.col("label").alias("routed"), "route"))
    asked = queries.join(top, F.col("vec_id") == F.col("query_id"))
    # a label's vectors meet the queries routed to it; the place of the label is the same for all its rows of a query
    met = nearest(v.withColumn("routed", F.col("label").cast("long")), asked, 10, by="routed")
    found = met.join(top.withColumnRenamed("routed", "label"), ["query_id", "label"])
    final = 1 - F.col("score") - F.when(F.col("route") == 1, 0.2).otherwise(0.13)
    s = found.select("query_id", "vec_id", "label", r6(final).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return s.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10")


def per_doc_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two hits of a label for each query, ten in all."""
    own = Window.partitionBy("query_id", "label").orderBy("rank")
    s = lane(spark, sf_dir).withColumn("nth", F.row_number().over(own).cast("long")).where("nth <= 2")
    w = Window.partitionBy("query_id").orderBy("rank")
    return s.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10").select("query_id", "vec_id", "label", "rank", "nth", "place")


FLOOR, CEILING = 3, 12


def knee_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits stand before the largest gap between 3 and 12, if it is 0.01 and twice the median gap at least; null where there is none.

    Only the first 13 distances are looked at, and gaps under 0 don't count
    for the median.  With fewer than four hits or two gaps there is no knee.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    d = lane(spark, sf_dir).where(F.col("rank") <= CEILING + 1).withColumn("distance", F.round(1 - F.col("score"), 6))
    g = d.withColumn("gap", F.round(F.col("distance") - F.lag("distance").over(w), 6)).withColumn("cut", F.col("rank") - 1)
    m = g.groupBy("query_id").agg(F.median(F.when(F.col("gap") >= 0, F.col("gap"))).alias("mid"), F.count(F.when(F.col("gap") >= 0, 1)).alias("n_gaps"), F.count(F.lit(1)).alias("n"))
    fits = F.col("cut").between(FLOOR, CEILING) & (F.col("gap") >= F.greatest(F.lit(0.01), F.round(2 * F.col("mid"), 6))) & (F.col("n") > FLOOR) & (F.col("n_gaps") > 1)
    best = F.max(F.when(fits, F.struct("gap", (-F.col("cut")).alias("earlier"))))
    return g.join(m, "query_id").groupBy("query_id").agg((-best["earlier"]).alias("kept"))


KNEE_SQL = f"""WITH {_lane_sql("d", None)}, v AS (SELECT query_id, rank, round(1 - score, 6) AS distance FROM d WHERE rank <= {CEILING + 1}),
g AS (SELECT query_id, rank - 1 AS cut, round(distance - lag(distance) OVER (PARTITION BY query_id ORDER BY rank), 6) AS gap FROM v),
m AS (SELECT query_id, median(gap) FILTER (gap >= 0) AS mid, count(*) FILTER (gap >= 0) AS n_gaps, count(*) AS n FROM g GROUP BY 1),
f AS (SELECT g.query_id, cut, gap FROM g JOIN m USING (query_id) WHERE cut BETWEEN {FLOOR} AND {CEILING} AND gap >= greatest(0.01::DOUBLE, round(2 * mid, 6)) AND n > {FLOOR} AND n_gaps > 1)
SELECT query_id, (SELECT cut FROM f WHERE f.query_id = m.query_id ORDER BY gap DESC, cut LIMIT 1) AS kept FROM m"""


#: Weights of relevance and diversity, penalties of a document and a page that are there already.
RELEVANCE, DIVERSITY, DOC_REPEAT, PAGE_REPEAT = 0.72, 0.28, 0.06, 0.04
MOST_OF_DOC, MOST_OF_PAGE, MOST_DOCS, MMR_PICKS = 2, 1, 6, 8


def mmr_pick(frame: pd.DataFrame) -> pd.DataFrame:
    """Greedy choice from a pool of (query_id, vec_id, doc, page, distance, words): of each page the nearest hit, then by relevance, likeness to those chosen, and repeats."""
    frame = frame.sort_values(["distance", "vec_id"], ignore_index=True).drop_duplicates(["doc", "page"], ignore_index=True)
    words = [frozenset(w) for w in frame["words"]]
    like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    chosen: list[int] = []
    while len(chosen) < MMR_PICKS:
        docs, pages = frame["doc"][chosen].tolist(), list(zip(frame["doc"][chosen], frame["page"][chosen], strict=True))
        best, best_score = None, -np.inf
        for i in range(len(frame)):
            doc, page = frame["doc"][i], (frame["doc"][i], frame["page"][i])
            full = len(set(docs)) >= MOST_DOCS and doc not in docs
            if i in chosen or docs.count(doc) >= MOST_OF_DOC or pages.count(page) >= MOST_OF_PAGE or full:
                continue
            relevance = -frame["distance"][i]
            if chosen:
                relevance = RELEVANCE * relevance - DIVERSITY * max(like(words[i], words[j]) for j in chosen)
            score = relevance - DOC_REPEAT * docs.count(doc) - PAGE_REPEAT * pages.count(page)
            if score > best_score + 1e-12:
                best, best_score = i, score
        if best is None:
            break
        chosen.append(best)
    return pd.DataFrame({"query_id": frame["query_id"][0], "vec_id": frame["vec_id"][chosen].to_numpy(), "place": np.arange(1, len(chosen) + 1)})


def mmr_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vec_id, doc (label), page, distance, words of each query's 20 hits; a vector's words are those of the document of its id."""
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.array_distinct(tokens(F.col("text"))).alias("words"))
    hits = lane(spark, sf_dir).select("query_id", "vec_id", F.col("label").alias("doc"), (F.col("vec_id") % 5).alias("page"), F.round(1 - F.col("score"), 6).alias("distance"))
    return hits.join(texts, "vec_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight diverse hits of each query, chosen greedily from its 20 (a choice depends on all before it, so a group of 20 rows goes to Python)."""
    return mmr_pool(spark, sf_dir).groupBy("query_id").applyInPandas(mmr_pick, "query_id bigint, vec_id bigint, place bigint")


QUERIES = {f.__name__: f for f in (dense_knn, multi_vector_min, rrf_fuse, boosted_fusion, protected_union, minmax_rerank, doc_routing, routed_stage2, per_doc_quota, knee_cut, mmr_select)}
ORACLES = {
    "dense_knn": f"WITH {_lane_sql('d', None)} SELECT query_id, vec_id, label, score, rank FROM d WHERE rank <= 10",
    "multi_vector_min": f"WITH {_lane_sql('d', None)}, n AS (SELECT query_label, vec_id, round(min(1 - score), 6) AS distance, count(*) AS n FROM d GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY distance, vec_id) AS rank FROM n QUALIFY rank <= 10",
    "rrf_fuse": f"WITH {FUSED}, r AS (SELECT query_id, vec_id, dr, cr, round(rrf, 9) AS rrf FROM f) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vec_id) AS rank FROM r QUALIFY rank <= {DEPTH}",
    "boosted_fusion": f"WITH {FUSED}, r AS (SELECT query_id, vec_id, label, round(rrf + CASE WHEN dr IS NOT NULL AND cr IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN label = query_label THEN 0.25::DOUBLE ELSE -0.2::DOUBLE END, 9) AS final FROM f) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, vec_id) AS rank FROM r QUALIFY rank <= 30",
    "protected_union": f"WITH {FUSED}, r AS (SELECT *, CASE WHEN dr <= 8 THEN 0 ELSE 1 END::BIGINT AS lane, round(rrf, 9) AS x FROM f) SELECT query_id, vec_id, lane, row_number() OVER (PARTITION BY query_id ORDER BY lane, CASE WHEN lane = 0 THEN dr END, x DESC, vec_id) AS place FROM r QUALIFY place <= 24",
    "minmax_rerank": MINMAX_SQL,
    "doc_routing": f"WITH {_lane_sql('d', None)}, {ROUTES} SELECT query_id, label, n, first, score, route, margin FROM ro",
    "routed_stage2": f"""WITH {_lane_sql('d', None)}, {ROUTES}, x AS (SELECT ro.query_id, v.vec_id, v.label::BIGINT AS label, route, (q.embedding::DOUBLE[]) AS a, (v.embedding::DOUBLE[]) AS b
  FROM ro JOIN embeddings q ON q.vec_id = ro.query_id JOIN embeddings v ON v.label = ro.label AND v.vec_id <> ro.query_id WHERE route <= 2),
s AS (SELECT query_id, vec_id, label, round(1 - round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) - CASE route WHEN 1 THEN 0.2::DOUBLE ELSE 0.13::DOUBLE END, 6) AS distance FROM x)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM s QUALIFY place <= 10""",
    "per_doc_quota": f"WITH {_lane_sql('d', None)}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS nth FROM d QUALIFY nth <= 2) SELECT query_id, vec_id, label, rank, nth, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM s QUALIFY place <= 10",
    "knee_cut": KNEE_SQL,
}
