"""Phase 1: sampling, alignment, mapping repair, synced listings; queries over the test tables with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import basename, bgra_to_rgb, clean_depth, frame_name, raw_frame_name, signed, stem
from ..operators import align, series, warping
from ..sources.sinks import copy_manifest, mapping_object
from ..sources.tables import mapping_entries, positions
from ._common import table

#: Frames of the smoothing window; keys of a recording.
WINDOW, RUN = 1501, 500
_MAPPING = "SELECT o_orderkey + 1 AS sony_idx, o_orderkey + 1 + o_custkey % 30 AS zed_idx FROM orders"


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noisy frame mapping."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((key + 1).alias("sony_idx"), (key + 1 + F.col("o_custkey") % 30).alias("zed_idx"))


def savgol_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.savgol(mapping(spark, sf_dir), "sony_idx", "zed_idx", WINDOW).withColumn("smooth", F.round("smooth", 6))


def monotone_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.smooth_mapping(mapping(spark, sf_dir), WINDOW).select("sony_idx", "zed_idx", "zed_smooth")


def drift_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.drift(series.savgol(mapping(spark, sf_dir), "sony_idx", "zed_idx", WINDOW)).select("sony_idx", "raw_drift", F.round("smooth_drift", 6).alias("smooth_drift"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.compared(series.smooth_mapping(mapping(spark, sf_dir), WINDOW).select("sony_idx", "zed_idx", "zed_smooth"))


def mapping_comparison_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("sony_idx", "line")


def mapping_mismatch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.mismatches(compared(spark, sf_dir))


def mapping_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object for each run of 1000 frames, as for recordings."""
    m = mapping(spark, sf_dir).withColumn("dataset", F.floor((F.col("sony_idx") - 1) / 1000))
    return m.groupBy("dataset").agg(mapping_object("sony_idx", "zed_idx").alias("json"))


def json_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", mapping_entries(F.col("props")).alias("key", "value"))


def sample_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.every_nth(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 3)


def listing_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("camera"), F.col("c_name").alias("name"))
    return positions(c, ["camera"])


def _listing(spark: SparkSession, sf_dir: str, name: str, column: str, key: str) -> DataFrame:
    """A recording for each run of RUN keys, so a listing is bounded whatever the table's size."""
    return table(spark, sf_dir, name).select(F.floor(F.col(key) / RUN).alias("dataset"), F.col(column).alias("path"))


def _listings(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [_listing(spark, sf_dir, *x) for x in (("customer", "c_name", "c_custkey"), ("supplier", "s_name", "s_suppkey"), ("part", "p_name", "p_partkey"))]


def sync_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.floor(key / RUN).alias("dataset"), (key % RUN + 1).alias("sony_idx"), (F.floor(key % RUN / 2) + 1).alias("zed_idx"))
    return align.sync_manifest(c, *_listings(spark, sf_dir), ["dataset"])


def zip_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers, _ = _listings(spark, sf_dir)
    return align.zip_pairs(customers, suppliers, ["dataset"], "path")


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("turn", F.col("l_linenumber") * 10_000_000 + F.col("l_partkey"))
    return align.last_write(l, ["l_orderkey"], "l_partkey", "turn")


def features(spark: SparkSession, sf_dir: str, camera: int, to: str) -> DataFrame:
    """Labels 2k and 2k + 1 are the two cameras of a recording; there is one for each k and run of RUN vectors."""
    dataset = F.concat_ws("-", F.floor(F.col("label") / 2), F.floor(F.col("vec_id") / RUN))
    e = table(spark, sf_dir, "embeddings").where(F.col("label") % 2 == camera).select(dataset.alias("dataset"), "vec_id", F.col("embedding").alias("vec"))
    return series.numbered(e, "vec_id", to, 0, ("dataset",)).select("dataset", to, "vec")


def cosine_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = align.cost_rows(features(spark, sf_dir, 0, "i"), features(spark, sf_dir, 1, "j"), ["dataset"])
    return c.select("dataset", "i", "j", F.round("cost", 6).alias("cost"))


def cosine_cost_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = align.cost_rows(features(spark, sf_dir, 0, "i"), features(spark, sf_dir, 1, "j"), ["dataset"], radius=3)
    return c.select("dataset", "i", "j", F.round("cost", 6).alias("cost"))


def dtw_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_series(features(spark, sf_dir, 0, "i"), features(spark, sf_dir, 1, "j"), ["dataset"]).select("dataset", "i", "j", F.round("cost", 6).alias("cost"))


def dtw_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = align.align_series(features(spark, sf_dir, 0, "i"), features(spark, sf_dir, 1, "j"), ["dataset"])
    return align.frame_mapping(p, ["dataset"])


def dtw_fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = warping.fast_path(features(spark, sf_dir, 0, "i"), features(spark, sf_dir, 1, "j"), ["dataset"])
    return p.select("dataset", "i", "j", F.round("cost", 6).alias("cost"))


def dtw_euclidean_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = align.align_series(features(spark, sf_dir, 0, "i"), features(spark, sf_dir, 1, "j"), ["dataset"], "euclidean")
    return align.frame_mapping(p, ["dataset"])


def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") * 37
    return table(spark, sf_dir, "orders").select("o_orderkey", frame_name(key).alias("name"), raw_frame_name(F.lower("o_orderstatus"), key).alias("raw_name"), signed(F.col("o_totalprice")).alias("signed"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", basename(F.col("url")).alias("base"), stem(F.col("url")).alias("stem"))


def copy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return copy_manifest(p, F.col("url"), F.concat(F.lit("synced/"), frame_name(F.col("page_id"))))


def depth_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths from -1000 to 99000, every 7th lost."""
    depth = F.transform("embedding", lambda v, i: F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(v.cast("double") * 100000 - 1000))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(clean_depth(depth), F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), clean_depth(depth)[5].alias("sixth"))


def pixel_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.array((F.col("p_partkey") % 256).cast("int"), F.col("p_size"), F.lit(7), F.lit(255))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(bgra_to_rgb(p).cast("array<string>"), "-").alias("rgb"))


_M = WINDOW // 2
_Q2, _Q4 = 2 * sum(k * k for k in range(1, _M + 1)), 2 * sum(k**4 for k in range(1, _M + 1))
_DEN = WINDOW * _Q4 - _Q2 * _Q2
_SG = f"""m AS ({_MAPPING}), r AS (SELECT *, row_number() OVER (ORDER BY sony_idx) AS i, count(*) OVER () AS n FROM m),
s AS (SELECT i AS c, sum(zed_idx) OVER w AS s0, sum(zed_idx * i) OVER w AS s1, sum(zed_idx * i * i) OVER w AS s2 FROM r WINDOW w AS (ORDER BY i ROWS BETWEEN {_M} PRECEDING AND {_M} FOLLOWING)),
p AS (SELECT r.*, least(greatest(i, {_M + 1}), n - {_M}) AS c FROM r),
t AS (SELECT p.*, s0::DOUBLE AS t0, (s1 - c * s0)::DOUBLE AS t1, (s2 - 2 * c * s1 + c * c * s0)::DOUBLE AS t2, (i - c)::DOUBLE AS k FROM p JOIN s USING (c)),
g AS (SELECT sony_idx, zed_idx, (t0 * {_Q4}::DOUBLE - t2 * {_Q2}::DOUBLE) / {_DEN}::DOUBLE + k * t1 / {_Q2}::DOUBLE + k * k * (t2 * {WINDOW}::DOUBLE - t0 * {_Q2}::DOUBLE) / {_DEN}::DOUBLE AS smooth FROM t),
f AS (SELECT *, greatest(1, max(round_even(smooth, 0)::BIGINT) OVER (ORDER BY sony_idx)) AS zed_smooth FROM g)"""
_LINE = "printf('Sony Frame %05d -> ZED Frame %05d', sony_idx, zed_idx) || CASE WHEN zed_idx <> zed_smooth THEN printf('-> Smoothed %05d', zed_smooth) ELSE '' END"
_COSINE = f"""e AS (SELECT (label // 2) || '-' || (vec_id // {RUN}) AS dataset, * FROM embeddings),
a AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS u FROM e WHERE label % 2 = 0),
b AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY vec_id) - 1 AS j, embedding::DOUBLE[] AS v FROM e WHERE label % 2 = 1)"""
_LISTED = ", ".join(f"{n} AS (SELECT {x}key // {RUN} AS dataset, {c} AS p, row_number() OVER (PARTITION BY {x}key // {RUN} ORDER BY {c}) AS k FROM {t})" for n, t, c, x in (("s", "customer", "c_name", "c_cust"), ("z", "supplier", "s_name", "s_supp"), ("d", "part", "p_name", "p_part")))
#: A cell knows the accumulated costs above and to the left of it, as these are in the corner of cells that follow.
_EXACT = {"cosine": "1 - list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)))", "euclidean": "list_distance(u, v)"}
_WARPED = {dist: f"""WITH RECURSIVE {_COSINE},
c AS MATERIALIZED (SELECT dataset, i, j, i + j AS d, {cost} AS c FROM a JOIN b USING (dataset)),
w AS (SELECT dataset, i, j, d, c AS total, 'infinity'::DOUBLE AS up, 'infinity'::DOUBLE AS back, 2 AS step FROM c WHERE d = 0
UNION ALL SELECT dataset, i, j, d, c + least(up, back, corner), up, back, CASE WHEN up <= least(back, corner) THEN 0 WHEN back <= corner THEN 1 ELSE 2 END
  FROM (SELECT c.dataset, c.i, c.j, c.d, any_value(c.c) AS c, min(CASE WHEN w.i < c.i THEN w.total ELSE 'infinity' END) AS up, min(CASE WHEN w.j < c.j THEN w.total ELSE 'infinity' END) AS back, min(CASE WHEN w.i < c.i THEN w.back ELSE w.up END) AS corner
    FROM w JOIN c ON c.dataset = w.dataset AND c.d = w.d + 1 AND c.i - w.i IN (0, 1) GROUP BY ALL)),
made AS MATERIALIZED (SELECT * FROM w),
p AS (SELECT dataset, i, j, step, total AS cost FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY d DESC) AS k FROM made) WHERE k = 1
UNION ALL SELECT e.dataset, e.i, e.j, e.step, p.cost FROM p JOIN made e ON e.dataset = p.dataset AND e.i = p.i - CASE WHEN p.step = 1 THEN 0 ELSE 1 END AND e.j = p.j - CASE WHEN p.step = 0 THEN 0 ELSE 1 END)""" for dist, cost in _EXACT.items()}
_COST = "round(1 - list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 6)"

QUERIES = {f.__name__: f for f in (savgol_mapping, monotone_mapping, drift_series, mapping_comparison_lines, mapping_mismatch_count, mapping_json_object, json_map_rows, sample_every_nth, listing_positions, sync_manifest, zip_by_position, last_write_wins, cosine_cost, cosine_cost_band, dtw_path, dtw_mapping, dtw_fast_path, dtw_euclidean_mapping, frame_names, path_parts, copy_list, depth_cleanup, pixel_channels)}
ORACLE = {
    "savgol_mapping": f"WITH {_SG} SELECT sony_idx, zed_idx, round(smooth, 6) AS smooth FROM f",
    "monotone_mapping": f"WITH {_SG} SELECT sony_idx, zed_idx, zed_smooth FROM f",
    "drift_series": f"WITH {_SG} SELECT sony_idx, sony_idx - zed_idx AS raw_drift, round(sony_idx - smooth, 6) AS smooth_drift FROM f",
    "mapping_comparison_lines": f"WITH {_SG} SELECT sony_idx, {_LINE} AS line FROM f",
    "mapping_mismatch_count": f"WITH {_SG} SELECT count(*) FILTER (zed_idx <> zed_smooth) AS n_changed, count(*) AS n_frames FROM f",
    "mapping_json_object": f"WITH m AS ({_MAPPING}) SELECT (sony_idx - 1) // 1000 AS dataset, '{{' || string_agg('\"' || sony_idx || '\":' || zed_idx, ',' ORDER BY sony_idx) || '}}' AS json FROM m GROUP BY 1",
    "json_map_rows": "SELECT event_id, k AS key, json_extract(props, '$.' || k)::BIGINT AS value FROM events, LATERAL (SELECT unnest(json_keys(props)) AS k)",
    "sample_every_nth": "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS frame_idx FROM events WHERE event_id % 3 = 0",
    "listing_positions": "SELECT c_nationkey AS camera, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS position FROM customer",
    "sync_manifest": f"""WITH {_LISTED},
m AS (SELECT c_custkey // {RUN} AS dataset, c_custkey % {RUN} + 1 AS a, c_custkey % {RUN} // 2 + 1 AS b FROM customer)
SELECT dataset, printf('%05d.png', a) AS name, s.p AS sony_path, z.p AS zed_rgb_path, d.p AS zed_depth_path FROM m JOIN s USING (dataset) JOIN z USING (dataset) JOIN d USING (dataset) WHERE s.k = a AND z.k = b AND d.k = b""",
    "zip_by_position": f"WITH {_LISTED} SELECT dataset, k AS position, s.p AS first, z.p AS second FROM s JOIN z USING (dataset, k)",
    "last_write_wins": "SELECT l_orderkey, max_by(l_partkey, l_linenumber * 10000000 + l_partkey) AS l_partkey FROM lineitem GROUP BY 1",
    "cosine_cost": f"WITH {_COSINE} SELECT dataset, i, j, {_COST} AS cost FROM a JOIN b USING (dataset)",
    "cosine_cost_band": f"WITH {_COSINE}, n AS (SELECT dataset, m, n FROM (SELECT dataset, max(i) AS m FROM a GROUP BY 1) JOIN (SELECT dataset, max(j) AS n FROM b GROUP BY 1) USING (dataset)) SELECT dataset, i, j, {_COST} AS cost FROM a JOIN b USING (dataset) JOIN n USING (dataset) WHERE abs(round(i * n / greatest(m, 1), 0)::BIGINT - j) <= 3",
    "dtw_path": f"{_WARPED['cosine']} SELECT dataset, i, j, round(cost, 6) AS cost FROM p",
    "dtw_mapping": f"{_WARPED['cosine']} SELECT dataset, i + 1 AS sony_idx, max(j) + 1 AS zed_idx FROM p GROUP BY ALL",
    "dtw_euclidean_mapping": f"{_WARPED['euclidean']} SELECT dataset, i + 1 AS sony_idx, max(j) + 1 AS zed_idx FROM p GROUP BY ALL",
    "frame_names": "SELECT o_orderkey, printf('%05d.png', o_orderkey * 37) AS name, lower(o_orderstatus) || printf('_rgb_%05d.png', o_orderkey * 37) AS raw_name, printf('%+.3f', o_totalprice) AS signed FROM orders",
    "path_parts": "SELECT page_id, split_part(url, '/', -1) AS base, split_part(split_part(url, '/', -1), '.', 1) AS stem FROM pages",
    "copy_list": "SELECT url AS src, 'synced/' || printf('%05d.png', page_id) AS dst FROM pages",
    "depth_cleanup": """WITH d AS (SELECT vec_id, [CASE WHEN (i - 1) % 7 = 0 THEN 0 ELSE trunc(least(greatest(embedding[i]::DOUBLE * 100000 - 1000, 0), 65535))::INT END FOR i IN range(1, len(embedding) + 1)] AS d FROM embeddings)
SELECT vec_id, list_sum(d)::BIGINT AS total, d[6]::INT AS sixth FROM d""",
    "pixel_channels": "SELECT p_partkey, '7-' || p_size || '-' || (p_partkey % 256) AS rgb FROM part",
}
