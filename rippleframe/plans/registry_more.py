"""Motion, entropy, contexts, rate, files and streams: the second half of the registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.operators import contexts, entropy, filters, lifting, motion, quality, rate, sampling, temporal
from rippleframe.plans import oracles as Q
from rippleframe.plans.fixtures import fixture, views
from rippleframe.plans.registry import CODED, FR, PHASED, coded, frames, per_frame, register
from rippleframe.sources import logs, planar
from rippleframe.streaming import running

KEY = ["frame", "y", "x"]


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared scratch folder, beside the warehouse where the session names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/rippleframe-{uuid.uuid4().hex}"


def blocks(spark, sf) -> DataFrame:
    return fixture(spark, sf, "blocks")


def side(spark, sf, k: int) -> DataFrame:
    return fixture(spark, sf, "motion").filter(F.col("side") == k)


# ---- joins


@register("JOI1_clip_bundle", views("motion") + " SELECT f.frame, f.y, f.x, f.v, a.m, b.mvx, b.mvy FROM frames16 f JOIN motion a USING (frame, y, x) JOIN motion b USING (frame, y, x) WHERE a.side = 0 AND b.side = 1")
def _bundle(spark, sf):
    return motion.clip_bundle(frames(spark, sf), side(spark, sf, 0).select(*KEY, "m"), side(spark, sf, 1).select(*KEY, "mvx", "mvy"), KEY)


POINTS = "pt AS (SELECT DISTINCT frame, CAST((frame * 5) % 19 - 1 AS INT) AS px, CAST((frame * 3 + y) % 18 - 1 AS INT) AS py FROM frames16)"


@register("JOI2_block_at_point", views("blocks") + f", {POINTS} SELECT pt.frame, px, py, b.path FROM pt LEFT JOIN blocks b ON b.frame = pt.frame AND px >= cx AND px < cx + xblk AND py >= cy AND py < cy + yblk")
def _at(spark, sf):
    points = frames(spark, sf).select("frame", F.expr("cast((frame * 5) % 19 - 1 as int) px"), F.expr("cast((frame * 3 + y) % 18 - 1 as int) py")).distinct()
    return motion.block_at_point(points, blocks(spark, sf), ["frame"], 8, 8).select("frame", "px", "py", F.col("b_path").alias("path"))


@register("JOI3_blocks_to_samples", views("blocks") + " SELECT b.frame, b.path, CAST(y AS INT) AS y, CAST(x AS INT) AS x, b.mvx FROM blocks b, (SELECT unnest(range(15)) AS y), (SELECT unnest(range(14)) AS x) WHERE y >= cy AND y < cy + yblk AND x >= cx AND x < cx + xblk")
def _dense(spark, sf):
    return motion.blocks_to_samples(blocks(spark, sf), 15, 14).select("frame", "path", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "mvx")


@register("JOI4_affine_motion", views("blocks") + f", s AS (SELECT b.frame, b.path, CAST(y AS INT) AS y, CAST(x AS INT) AS x, mvx + (x - cx) / xblk::DOUBLE * (mvy - mvx) + (y - cy) / yblk::DOUBLE * (0.5 * mvx - mvx) AS m FROM blocks b, (SELECT unnest(range(16)) AS y), (SELECT unnest(range(16)) AS x) WHERE y >= cy AND y < cy + yblk AND x >= cx AND x < cx + xblk) SELECT frame, path, y, x, trunc(round(m, 9) * 4) / 4 AS mvx FROM s")
def _affine(spark, sf):
    b = blocks(spark, sf).withColumns({"a1x": F.col("mvx"), "a2x": F.col("mvy"), "a3x": 0.5 * F.col("mvx"), "a1y": F.col("mvy"), "a2y": F.col("mvy"), "a3y": F.col("mvy")}).drop("mvx", "mvy")
    out = motion.affine_motion(motion.blocks_to_samples(b, 16, 16))
    return out.select("frame", "path", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "mvx")


NEAR = "CAST(rint(least(greatest({c} - mv{c}, 0), 15)) AS INT)"


def near(c: str, torch: bool = False) -> str:
    p = f"({c} - mv{c}) * 16 / 15.0 - 0.5" if torch else f"({c} - mv{c})"
    return f"CAST(round_even(least(greatest({p}, 0.0), 15.0), 0) AS INT)"


def warp_sql(torch: bool) -> str:
    return views("motion") + f" SELECT m.frame, m.y, m.x, m.side, f.v FROM (SELECT *, {near('y', torch)} AS sy, {near('x', torch)} AS sx FROM motion) m JOIN frames16 f ON f.frame = m.frame AND f.y = sy AND f.x = sx"


@register("JOI5_warp_nearest", warp_sql(False))
def _warp(spark, sf):
    return motion.warp_nearest(frames(spark, sf), fixture(spark, sf, "motion"), ["frame"], 16, 16).select(*KEY, "side", "v")


@register("JOI5_warp_nearest_torch", warp_sql(True))
def _warpt(spark, sf):
    return motion.warp_nearest(frames(spark, sf), fixture(spark, sf, "motion"), ["frame"], 16, 16, "torch").select(*KEY, "side", "v")


MOTION_DUCK = views("motion").removeprefix("WITH ").split("motion AS (", 1)[1]


@register("JOI6_warp_subpel", PHASED + ", motion AS (" + MOTION_DUCK + f", t AS (SELECT frame, y, x, greatest(0, least(63, 4 * y - CAST(round_even(4 * mvy, 0) AS INT))) AS fy, greatest(0, least(63, 4 * x - CAST(round_even(4 * mvx, 0) AS INT))) AS fx FROM motion WHERE side = 0) SELECT t.frame, t.y, t.x, {Q.rq('ph.v', 8)} AS v FROM t JOIN ph ON ph.frame = t.frame AND ph.phase = 4 * (fy % 4) + fx % 4 AND ph.y = fy // 4 AND ph.x = fx // 4", 8)
def _sub(spark, sf):
    vectors = filters.subpel_vectors(frames(spark, sf), ["frame"], 16, 16)
    return motion.warp_subpel(vectors, side(spark, sf, 0), ["frame"], 16, 16).select(*KEY, "v")


@register("JOI7_blend_bidir", views("motion") + f", w AS (SELECT m.frame, m.y, m.x, m.side, m.m, f.v * m.m AS v FROM (SELECT *, {near('y')} AS sy, {near('x')} AS sx FROM motion) m JOIN frames16 f ON f.frame = m.frame AND f.y = sy AND f.x = sx) SELECT a.frame, a.y, a.x, (CASE WHEN a.m = 0 THEN b.v ELSE a.v END + CASE WHEN b.m = 0 THEN a.v ELSE b.v END) / 2 AS p FROM w a JOIN w b USING (frame, y, x) WHERE a.side = 0 AND b.side = 1")
def _blend(spark, sf):
    warped = motion.warp_nearest(frames(spark, sf), fixture(spark, sf, "motion"), ["frame"], 16, 16)
    return motion.blend_bidir(warped.filter("side = 0"), warped.filter("side = 1"), KEY)


def predictors(spark, sf) -> DataFrame:
    b = blocks(spark, sf)
    before = b.withColumn("frame", F.col("frame") + 2)
    return motion.median_predictor(b, ["frame"], 8, 8, 16, 16, before)


_SPOTS = {"A": ("cx - 1", "cy + yblk - 1"), "B": ("cx + xblk - 1", "cy - 1"), "C": ("cx - 1", "cy - 1"), "D": ("cx + xblk", "cy - 1"), "E": ("cx - 1", "cy + yblk")}
_FIT = "list_filter({0}, lambda v: v IS NOT NULL AND cx - v.x >= 0 AND cy - v.y >= 0 AND cx - v.x + xblk <= 16 AND cy - v.y + yblk <= 16)"


def _uniq(e: str) -> str:
    return f"list_filter({e}, lambda v, i: list_position({e}, v) = i)"


PREDICT = views("blocks") + ",\n" + ",\n".join(f"n{s} AS (SELECT a.frame, a.path, {{'x': b.mvx, 'y': b.mvy}} AS {s.lower()}v FROM blocks a JOIN blocks b ON a.frame = b.frame AND {x.replace('cx', 'a.cx').replace('xblk', 'a.xblk')} >= b.cx AND {x.replace('cx', 'a.cx').replace('xblk', 'a.xblk')} < b.cx + b.xblk AND {y.replace('cy', 'a.cy').replace('yblk', 'a.yblk')} >= b.cy AND {y.replace('cy', 'a.cy').replace('yblk', 'a.yblk')} < b.cy + b.yblk)" for s, (x, y) in _SPOTS.items()) + f""",
j AS (SELECT b.*, av, bv, cv, dv, ev, CASE WHEN p.path IS NOT NULL THEN {{'x': p.mvx, 'y': p.mvy}} END AS pv FROM blocks b LEFT JOIN nA USING (frame, path) LEFT JOIN nB USING (frame, path) LEFT JOIN nC USING (frame, path) LEFT JOIN nD USING (frame, path) LEFT JOIN nE USING (frame, path) LEFT JOIN blocks p ON p.frame = b.frame - 2 AND p.path = b.path),
k0 AS (SELECT *, {_FIT.format("[av, bv, cv, CASE WHEN av IS NULL OR bv IS NULL OR cv IS NULL THEN dv END]")} AS raw FROM j),
k1 AS (SELECT *, {_uniq("raw")} AS k FROM k0),
k2 AS (SELECT *, CASE WHEN len(k) = 3 THEN list_concat(k, {_FIT.format("[{'x': list_sort([k[1].x, k[2].x, k[3].x])[2], 'y': list_sort([k[1].y, k[2].y, k[3].y])[2]}]")}) ELSE k END AS km FROM k1),
k3 AS (SELECT *, list_concat({_uniq("km")}, {_FIT.format("[pv, ev]")}) AS ka FROM k2),
cand AS (SELECT frame, path, mvx, mvy, {_uniq("ka")}[1:4] AS c FROM k3)
"""


@register("JOI8_median_predictor", PREDICT + " SELECT frame, path, CAST(i AS INT) AS pos, c[i + 1].x AS px, c[i + 1].y AS py FROM (SELECT frame, path, c, unnest(range(len(c))) AS i FROM cand)")
def _median(spark, sf):
    return predictors(spark, sf).select("frame", "path", F.posexplode("candidates").alias("pos", "c")).select("frame", "path", "pos", F.col("c.x").alias("px"), F.col("c.y").alias("py"))


@register("JOI9_block_match", FR + """, g AS (SELECT a.frame, CAST(a.y // 8 AS INT) AS "by", CAST(a.x // 8 AS INT) AS bx, dy, dx, a.y, a.x, a.v FROM frames16 a, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)),
 s0 AS (SELECT g.frame, g."by", bx, dy, dx, sum(abs(g.v - r.v)) AS sad FROM g JOIN frames16 r ON r.frame = g.frame - 1 AND r.y = g.y + dy AND r.x = g.x + dx WHERE "by" * 8 + dy BETWEEN 0 AND 8 AND bx * 8 + dx BETWEEN 0 AND 8 GROUP BY ALL), s AS (SELECT frame, "by", bx, dy, dx, sad + 1.5 * (2 + 2 * floor(log2(2 * abs(dy) + 1)) + 2 * floor(log2(2 * abs(dx) + 1))) AS cost FROM s0)
 SELECT frame, "by", bx, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, cost FROM s QUALIFY row_number() OVER (PARTITION BY frame, "by", bx ORDER BY cost, abs(dy) + abs(dx), dy, dx) = 1""")
def _match(spark, sf):
    f = frames(spark, sf)
    return motion.block_match(f, f.withColumn("frame", F.col("frame") + 1), ["frame"], 8, 2, 1.5)


@register("JOI10_mode_select", views("blocks") + ", c AS (SELECT frame, path, CAST(m AS INT) AS mode, (frame * 7 + cx * 3 + cy + m * 5) % 11 AS cost FROM blocks, (SELECT unnest(range(4)) AS m)) SELECT frame, path, mode, cost FROM c QUALIFY row_number() OVER (PARTITION BY frame, path ORDER BY cost, mode) = 1")
def _mode(spark, sf):
    c = blocks(spark, sf).drop("mode").withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("cost", (F.col("frame") * 7 + F.col("cx") * 3 + F.col("cy") + F.col("mode") * 5) % 11)
    return motion.mode_select(c, ["frame", "path"]).select("frame", "path", "mode", "cost")


@register("JOI11_split_by_list", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 3 = 0)")
def _names(spark, sf):
    clips = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return sampling.split_by_list(clips, clips.filter("id % 3 = 0")).select("id", "name")


@register("JOI11_split_by_pattern", "SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(p_name, '.*e.*')")
def _pattern(spark, sf):
    clips = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return sampling.split_by_list(clips, None, "%e%")


@register("JOI12_validate_targets", """WITH c AS (SELECT s_suppkey AS clip, CAST(s_suppkey % 3 + 1 AS INT) AS t_levels, 1000 + s_suppkey % 7 * 100 AS bitrate FROM supplier WHERE s_suppkey % 11 <> 0),
 t AS (SELECT s_suppkey AS clip, 'n' || s_suppkey AS name, CAST(s_suppkey % 5 AS INT) AS t_level, s_suppkey * 37 % 1500 AS rate FROM supplier)
 SELECT t.clip, t.name, CASE WHEN t_levels IS NULL THEN 'unknown clip' WHEN t_level > t_levels THEN 'level' ELSE 'rate' END AS reason FROM t LEFT JOIN c USING (clip) WHERE t_levels IS NULL OR t_level > t_levels OR rate >= bitrate""")
def _targets(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    clips = s.filter("s_suppkey % 11 <> 0").select(F.col("s_suppkey").alias("clip"), F.expr("cast(s_suppkey % 3 + 1 as int) t_levels"), F.expr("1000 + s_suppkey % 7 * 100 bitrate"))
    targets = s.select(F.col("s_suppkey").alias("clip"), F.expr("concat('n', s_suppkey) name"), F.expr("cast(s_suppkey % 5 as int) t_level"), F.expr("s_suppkey * 37 % 1500 rate"))
    return rate.validate_targets(targets, clips)


@register("WIN22_motion_delta", PREDICT + " SELECT frame, path, mvx - c[1].x AS dx, mvy - c[1].y AS dy FROM cand")
def _delta(spark, sf):
    return motion.motion_delta(blocks(spark, sf), predictors(spark, sf), ["frame"])


_AROUND = " ".join(f"LEFT JOIN bd {n} ON {n}.frame = b.frame AND b.cx - {dx} >= {n}.cx AND b.cx - {dx} < {n}.cx + {n}.xblk AND b.cy - {dy} >= {n}.cy AND b.cy - {dy} < {n}.cy + {n}.yblk" for n, dx, dy in (("hor", 1, 0), ("ver", 0, 1), ("dia", 1, 1)))


@register("WIN22_neighbour_deltas", PREDICT + ", d AS (SELECT frame, path, mvx - c[1].x AS dx, mvy - c[1].y AS dy FROM cand), bd AS (SELECT b.frame, b.path, cx, cy, xblk, yblk, dx, dy FROM blocks b JOIN d USING (frame, path)) SELECT b.frame, b.path, b.dx, b.dy, " + ", ".join(f"coalesce({n}.d{a}, 0.0) AS {n}_d{a}" for n in ("hor", "ver", "dia") for a in "xy") + f" FROM bd b {_AROUND}")
def _around(spark, sf):
    b = blocks(spark, sf)
    return motion.neighbour_deltas(b, motion.motion_delta(b, predictors(spark, sf), ["frame"]), ["frame"], 8, 8)


@register("WIN24_motion_cost", PREDICT + ", d AS (SELECT frame, path, mvx - c[1].x AS dx, mvy - c[1].y AS dy FROM cand) SELECT frame, path, 0.5 * ((1 + 2 * floor(log2(abs(dx) * 4 + 1))) + (1 + 2 * floor(log2(abs(dy) * 4 + 1)))) AS cost FROM d")
def _mcost(spark, sf):
    deltas = motion.motion_delta(blocks(spark, sf), predictors(spark, sf), ["frame"])
    words = spark.range(257).select(F.col("id").cast("int").alias("word"), entropy.code_bits(F.col("id"), "golomb").alias("bits"))
    return motion.motion_cost(deltas, words, 0.5).select("frame", "path", "cost")


@register("AGG13_block_histogram", views("blocks") + " SELECT CAST(round_even(log2(greatest(xblk, yblk)), 0) AS INT) AS size_class, mode, count(*) AS n, CAST(sum(xblk * yblk) AS BIGINT) AS area FROM blocks GROUP BY ALL")
def _hist(spark, sf):
    return motion.block_histogram(blocks(spark, sf))


@register("AGG13_mode_shares", views("blocks") + f" SELECT frame, mode, count(*) AS n, {Q.rq('(sum(xblk * yblk) / 256.0)')} AS share FROM blocks GROUP BY ALL")
def _shares(spark, sf):
    return motion.mode_shares(blocks(spark, sf), ["frame"], 16, 16)


# ---- quality and statistics


@register("AGG14_channel_range", views("rgb") + " SELECT plane, min(v) AS low, max(v) AS high FROM rgb GROUP BY 1")
def _range(spark, sf):
    return quality.channel_range(fixture(spark, sf, "rgb"), ["plane"])


@register("AGG23_band_stats", CODED + f" SELECT CAST(frame // 8 AS INT) AS gop, band, {Q.rq('avg(c)')} AS mean, {Q.rq('var_pop(c)')} AS variance FROM k GROUP BY ALL")
def _stats(spark, sf):
    return quality.band_stats(coded(spark, sf).withColumn("gop", F.expr("cast(frame div 8 as int)")), ["gop", "band"])


@register("AGG19_band_planes", CODED + " SELECT frame, band, CAST(CASE WHEN max(abs(q)) > 0 THEN floor(log2(max(abs(q)))) + 1 ELSE 0 END AS INT) AS planes FROM k GROUP BY ALL")
def _planes(spark, sf):
    return entropy.band_planes(coded(spark, sf), ["frame", "band"])


@register("AGG20_magnitude_pyramid", CODED + ", m0 AS (SELECT frame, band, 0 AS up, CAST(y AS INT) AS y, CAST(x AS INT) AS x, abs(q) AS bits FROM k), m1 AS (SELECT frame, band, 1 AS up, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, bit_or(bits) AS bits FROM m0 GROUP BY ALL), m2 AS (SELECT frame, band, 2 AS up, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, bit_or(bits) AS bits FROM m1 GROUP BY ALL) SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2")
def _mag(spark, sf):
    return entropy.magnitude_pyramid(coded(spark, sf), ["frame", "band"], 2)


CENSUS = "SELECT frame, band, CAST(plane AS INT) AS plane, CAST(sum(CASE WHEN (m >> plane) > 0 AND (m >> (plane + 1)) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fresh, CAST(sum(CASE WHEN (m >> plane) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS still_zero, CAST(sum(CASE WHEN (m >> (plane + 1)) > 0 AND (m >> plane) % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ones, CAST(sum(CASE WHEN (m >> (plane + 1)) > 0 AND (m >> plane) % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(sum(CASE WHEN (m >> plane) > 0 AND (m >> (plane + 1)) = 0 AND q < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative FROM (SELECT *, abs(q) AS m FROM k), (SELECT CAST(unnest(range(5)) AS INT) AS plane) GROUP BY ALL"


@register("AGG21_plane_census", CODED + " " + CENSUS)
def _census(spark, sf):
    return entropy.plane_census(coded(spark, sf), ["frame", "band"], 5)


PROG = CODED + """, g AS (SELECT frame, band, y, x, c, c9, k, pow(2.0, 8 - k) AS s FROM (SELECT frame, band, y, x, c, c9 FROM k) z, (SELECT CAST(unnest(range(1, 4)) AS INT) AS k)),
 g1 AS (SELECT *, sign(c9) * floor(abs(c9 / (s * 2))) AS qb, sign(c9) * floor(abs(c9 / s)) AS "current" FROM g),
 pr AS (SELECT *, CASE WHEN qb = 0 THEN 0.0 ELSE sign(qb) * (abs(qb) + 0.5) * s * 2 END AS base, CASE WHEN "current" = 0 THEN 0.0 ELSE sign("current") * (abs("current") + 0.5) * s END AS recon FROM g1)"""


@register("WIN20_progressive_planes", PROG + ' SELECT frame, band, y, x, k, base, "current", "current" - base / s AS residual, recon FROM pr')
def _prog(spark, sf):
    return entropy.progressive_planes(coded(spark, sf), 3).select("frame", "band", "y", "x", "k", "base", "current", "residual", "recon")


@register("AGG22_rd_curve", PROG + f""", cnt AS (SELECT band, k, "current" AS sym, count(*) AS n FROM pr GROUP BY ALL), b AS (SELECT band, k, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits FROM cnt GROUP BY ALL), m AS (SELECT band, k, avg((c - recon) ** 2) AS mse FROM pr GROUP BY ALL),
 r AS (SELECT band, k, bits, mse, lag(mse) OVER w - mse AS gain, bits - lag(bits) OVER w AS more FROM b JOIN m USING (band, k) WINDOW w AS (PARTITION BY band ORDER BY k))
 SELECT band, k, {Q.rq('bits')} AS bits, {Q.rq('mse')} AS mse, {Q.rq('gain')} AS gain, CASE WHEN abs(more) > 1e-9 THEN {Q.rq('gain / more')} END AS slope FROM r""")
def _curve(spark, sf):
    return entropy.rd_curve(coded(spark, sf), ["band"], 3)


@register("AGG5_rd_sweep", CODED + f""", g AS (SELECT band, c, step, discard, CASE WHEN discard < CASE band WHEN 'LL' THEN 13 WHEN 'HL' THEN 6 WHEN 'LH' THEN 5 ELSE 4 END THEN sign(c9) * floor(abs(c9 / step)) ELSE 0 END AS sym FROM k, (VALUES (8.0::DOUBLE), (32.0::DOUBLE)) a(step), (VALUES (0), (4)) b(discard)),
 n AS (SELECT step, discard, sym, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT step, discard, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits FROM n GROUP BY ALL),
 m AS (SELECT step, discard, avg((c - CASE WHEN sym = 0 THEN 0 ELSE sign(sym) * (abs(sym) + 0.5) * step END) ** 2) AS mse FROM g GROUP BY ALL)
 SELECT 'y' AS plane, step, discard, {Q.rq('bits')} AS bits, {Q.rq('mse')} AS mse FROM b JOIN m USING (step, discard)""")
def _sweep(spark, sf):
    k = coded(spark, sf).withColumn("level", F.lit(1)).withColumn("plane", F.lit("y"))
    return entropy.rd_sweep(k, [8.0, 32.0], [0, 4], ["plane"])


_STEPS, _DISCARDS = [float(1 << p) for p in range(7, 2, -1)], [0, 4, 5]


@register("AGG5_rd_sweep_planes", CODED + f""", g AS (SELECT CASE frame % 3 WHEN 0 THEN 'y' WHEN 1 THEN 'u' ELSE 'v' END AS plane, c, step, discard, CASE WHEN discard < CASE band WHEN 'LL' THEN 13 WHEN 'HL' THEN 6 WHEN 'LH' THEN 5 ELSE 4 END THEN sign(c9) * floor(abs(c9 / step)) ELSE 0 END AS sym FROM k, (VALUES (8.0::DOUBLE), (16.0), (32.0), (64.0), (128.0)) a(step), (VALUES (0), (4), (5)) b(discard)),
 n AS (SELECT plane, step, discard, sym, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT plane, step, discard, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits FROM n GROUP BY ALL),
 m AS (SELECT plane, step, discard, avg((c - CASE WHEN sym = 0 THEN 0 ELSE sign(sym) * (abs(sym) + 0.5) * step END) ** 2) AS mse FROM g GROUP BY ALL)
 SELECT plane, step, discard, {Q.rq('bits')} AS bits, {Q.rq('mse')} AS mse FROM b JOIN m USING (plane, step, discard)""")
def _sweep_planes(spark, sf):
    """Bit planes 7 to 3, three discards and three channels (frames by turns)."""
    k = coded(spark, sf).withColumn("level", F.lit(1)).withColumn("plane", F.expr("case frame % 3 when 0 then 'y' when 1 then 'u' else 'v' end"))
    return entropy.rd_sweep(k, _STEPS, _DISCARDS, ["plane"])


# ---- entropy


@register("AGG8_symbol_entropy", views("symbols") + f", c AS (SELECT ctx, sym, count(*) AS n FROM symbols GROUP BY ALL) SELECT ctx, CAST(sum(n) AS BIGINT) AS n, {Q.rq('(log2(sum(n)) - sum(n * log2(n)) / sum(n))')} AS entropy FROM c GROUP BY 1")
def _ent(spark, sf):
    return entropy.symbol_entropy(fixture(spark, sf, "symbols"), ["ctx"])


@register("AGG9_binary_model_cost", views("symbols") + f""", b AS (SELECT ctx, CAST(sum(CASE WHEN sym = 0 THEN 1 ELSE 0 END) AS BIGINT) AS c0, CAST(sum(CASE WHEN sym <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS c1 FROM symbols GROUP BY 1), d AS (SELECT *, log2((c0 + c1) / c0::DOUBLE) AS bits0, log2((c0 + c1) / c1::DOUBLE) AS bits1 FROM b)
 SELECT ctx, c0, c1, {Q.rq('bits0')} AS bits0, {Q.rq('bits1')} AS bits1, {Q.rq('(c0 * bits0 + c1 * bits1)')} AS total, {Q.rq('((c0 * bits0 + c1 * bits1) / (c0 + c1))')} AS average, {Q.rq('(1 - (c0 * bits0 + c1 * bits1) / (c0 + c1))')} AS gap FROM d""")
def _bin(spark, sf):
    return entropy.binary_model_cost(fixture(spark, sf, "symbols"), ["ctx"])


@register("AGG10_conditional_entropy", views("symbols") + f", l AS (SELECT ctx, sym, coalesce(lag(sym) OVER (PARTITION BY stream ORDER BY seq), -1) AS prev FROM symbols), j AS (SELECT ctx, prev, sym, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT ctx, prev, sum(n) AS t, sum(n * log2(n)) AS e FROM j GROUP BY ALL) SELECT ctx, CAST(sum(t) AS BIGINT) AS n, {Q.rq('sum(t * log2(t) - e)')} AS bits FROM s GROUP BY 1")
def _cond(spark, sf):
    from pyspark.sql import Window

    s = fixture(spark, sf, "symbols").withColumn("prev", F.coalesce(F.lag("sym").over(Window.partitionBy("stream").orderBy("seq")), F.lit(-1)))
    return entropy.conditional_entropy(s, ["ctx"], ["prev"])


@register("AGG12_code_size", CODED + " SELECT band, count(*) AS n, CAST(sum(1 + 1 + 2 * floor(log2(abs(q) / 2.0 + 1))) AS BIGINT) AS golomb, CAST(sum(abs(q) + 1 + CASE WHEN q <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS unary, CAST(sum(CASE WHEN abs(q) < 128 THEN 8 WHEN abs(q) < 16384 THEN 16 ELSE 32 END) AS BIGINT) AS number FROM k GROUP BY 1")
def _code(spark, sf):
    k = coded(spark, sf).withColumn("w", F.abs("q"))
    out = entropy.code_size(k, ["band"], "w", "golomb", 1).withColumnRenamed("bits", "golomb")
    for code, word in (("unary", "q"), ("number", "w")):
        out = out.join(entropy.code_size(k, ["band"], word, code).select("band", F.col("bits").alias(code)), "band")
    return out


@register("WIN18_adaptive_cost", views("symbols") + f" SELECT stream, seq, {Q.rq('log2((count(*) OVER (PARTITION BY stream, ctx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5) / (count(*) OVER (PARTITION BY stream, ctx, sym ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)::DOUBLE)')} AS bits FROM symbols")
def _adapt(spark, sf):
    return entropy.adaptive_cost(fixture(spark, sf, "symbols"), 5).select("stream", "seq", "bits")


@register("AGG12_code_size_capped", CODED + " SELECT band, count(*) AS n, CAST(sum(2 + 2 * least(floor(log2(abs(q) / 2.0 + 1)), 2) - CASE WHEN abs(q) >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS golomb, CAST(sum(CASE WHEN abs(q) * 5000 < 32768 THEN 16 ELSE 32 END) AS BIGINT) AS length FROM k GROUP BY 1")
def _code_capped(spark, sf):
    k = coded(spark, sf).withColumn("w", F.abs("q")).withColumn("long", F.abs("q") * 5000)
    out = entropy.code_size(k, ["band"], "w", "golomb", 1, 3).withColumnRenamed("bits", "golomb")
    return out.join(entropy.code_size(k, ["band"], "long", "length").select("band", F.col("bits").alias("length")), "band")


@register("WIN18_adaptive_cost_prior", views("symbols") + f" SELECT stream, seq, {Q.rq('log2((count(*) OVER (PARTITION BY stream, ctx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 19) / (count(*) OVER (PARTITION BY stream, ctx, sym ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + [9, 4, 3, 2, 1][sym + 1])::DOUBLE)')} AS bits FROM symbols")
def _prior(spark, sf):
    return entropy.adaptive_cost(fixture(spark, sf, "symbols"), 5, (9, 4, 3, 2, 1)).select("stream", "seq", "bits")


@register("WIN18_adaptive_cost_capped")
def _capped(spark, sf):
    return entropy.adaptive_cost_capped(fixture(spark, sf, "symbols"), 5, 32)


@register("WIN23_frequency_rank", views("symbols") + ", c AS (SELECT ctx, sym, count(*) AS c FROM symbols GROUP BY ALL) SELECT ctx, sym, c, CAST(row_number() OVER (PARTITION BY ctx ORDER BY c DESC, sym) AS INT) AS rank FROM c")
def _rank(spark, sf):
    return entropy.frequency_rank(fixture(spark, sf, "symbols"), ["ctx"])


# ---- contexts

_BIT = "CASE WHEN (abs(q) >> {p}) > 0 THEN 1 ELSE 0 END"


def ctx_sql(name: str, plane: int) -> str:
    """CTE of neighbour counts at a plane, by a self-join on the nine places."""
    return f"""{name} AS (SELECT a.frame, a.band, a.y, a.x, any_value(a.q) AS q,
 CAST(coalesce(sum(CASE WHEN b.y = a.y AND b.x <> a.x THEN {_BIT.format(p=plane).replace('q', 'b.q')} END), 0) AS INT) AS h, CAST(coalesce(sum(CASE WHEN b.x = a.x AND b.y <> a.y THEN {_BIT.format(p=plane).replace('q', 'b.q')} END), 0) AS INT) AS v,
 CAST(coalesce(sum(CASE WHEN b.x <> a.x AND b.y <> a.y THEN {_BIT.format(p=plane).replace('q', 'b.q')} END), 0) AS INT) AS d
 FROM k a JOIN k b ON a.frame = b.frame AND a.band = b.band AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)"""


def ctx_sql_grouped(name: str, plane: int) -> str:
    return ctx_sql(name, plane).replace("GROUP BY ALL", "GROUP BY a.frame, a.band, a.y, a.x")


@register("WIN21_significance_context", CODED + ",\n" + ctx_sql_grouped("n0", 0) + " SELECT frame, band, CAST(y AS INT) AS y, CAST(x AS INT) AS x, h, v, d, CASE WHEN q <> 0 THEN 1 ELSE 0 END AS sig, CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN 1 ELSE 0 END AS border FROM n0")
def _sig(spark, sf):
    out = contexts.significance_context(coded(spark, sf), ["frame", "band"], 0, None, 8, 8)
    return out.select("frame", "band", "y", "x", "h", "v", "d", "sig", "border")


def two_levels(spark, sf):
    """First-level coefficients, and those of the level above as their parents (frame, band, y, x, q)."""
    first = lifting.wavelet2d(frames(spark, sf), ["frame"])
    low = first.filter("band = 'LL'").select("frame", "y", "x", F.col("c").alias("v"))
    from rippleframe.functions import scalars as S

    parents = lifting.wavelet2d(low, ["frame"]).withColumn("q", S.quantize(F.round("c", 9), 16.0).cast("int"))
    return coded(spark, sf), parents.select("frame", "band", "y", "x", "q")


PARENT = CODED + ",\nlow AS (SELECT frame, y, x, c AS v FROM w1 WHERE band = 'LL'),\n" + Q.wavelet("low", "w2") + ",\nup AS (SELECT frame, band, y, x, CASE WHEN floor(abs(round(c, 9) / 16)) > 0 THEN 1 ELSE 0 END AS p FROM w2),\n" + ctx_sql_grouped("n0", 0)


@register("WIN25_significance_class", PARENT + """, t AS (SELECT n0.frame, n0.band, n0.y, n0.x, CASE WHEN n0.band = 'HL' THEN v ELSE h END AS h, CASE WHEN n0.band = 'HL' THEN h ELSE v END AS v, d, up.p FROM n0 JOIN up ON up.frame = n0.frame AND up.band = n0.band AND up.y = n0.y // 2 AND up.x = n0.x // 2)
 SELECT frame, band, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
 CASE WHEN band = 'HH' THEN CASE WHEN h + v = 0 THEN CASE WHEN d = 1 THEN 0 ELSE 1 END WHEN h + v = 1 THEN 1 ELSE 2 END
      ELSE CASE WHEN h = 0 AND v = 0 THEN CASE WHEN d = 1 THEN 0 ELSE 1 END WHEN h = 0 AND v = 1 THEN 1 WHEN h = 1 AND v = 0 THEN 2 ELSE 3 END END AS alone,
 CASE WHEN p = 1 THEN CASE WHEN band = 'HH' THEN CASE WHEN h + v = 0 THEN CASE WHEN d = 1 THEN 0 ELSE 1 END WHEN h + v = 1 THEN CASE WHEN d < 3 THEN 1 ELSE 2 END WHEN h = 1 AND v = 1 THEN CASE WHEN d < 2 THEN 1 ELSE 2 END WHEN h + v = 2 THEN 2 ELSE 3 END
      ELSE CASE WHEN h = 0 AND v = 0 THEN CASE WHEN d = 1 THEN 0 ELSE 1 END WHEN h = 0 AND v = 1 THEN 1 WHEN h = 1 AND v = 0 THEN 2 WHEN h + v > 2 THEN 4 ELSE 3 END END
      ELSE CASE WHEN band = 'HH' THEN 4 ELSE 5 END + CASE WHEN h + v = 0 THEN 0 WHEN h + v = 1 THEN CASE WHEN d < 3 THEN 0 ELSE 1 END WHEN h + v = 2 THEN 1 ELSE 2 END END AS joint FROM t""")
def _class(spark, sf):
    k, parents = two_levels(spark, sf)
    ctx = contexts.significance_context(k, ["frame", "band"], 0, parents)
    return contexts.significance_class(ctx).select("frame", "band", "y", "x", "alone", "joint")


@register("WIN27_refinement_class", CODED + ",\n" + ctx_sql_grouped("n0", 0) + ",\n" + ctx_sql_grouped("n1", 1) + """, t AS (SELECT a.frame, a.band, a.y, a.x, CASE WHEN a.band = 'HL' THEN a.v ELSE a.h END AS h, CASE WHEN a.band = 'HL' THEN a.h ELSE a.v END AS v, CASE WHEN a.band = 'HL' THEN b.v ELSE b.h END AS oh, CASE WHEN a.band = 'HL' THEN b.h ELSE b.v END AS ov FROM n0 a JOIN n1 b USING (frame, band, y, x))
 SELECT frame, band, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
 CASE WHEN h = 0 AND v = 0 THEN 0 WHEN h = 0 THEN 1 WHEN v = 0 THEN CASE WHEN band = 'HH' THEN 1 ELSE 2 END WHEN h = 2 AND v = 2 THEN CASE WHEN band = 'HH' THEN 3 ELSE 4 END ELSE CASE WHEN band = 'HH' THEN 2 ELSE 3 END END AS refine,
 CASE WHEN h = 0 AND v = 0 THEN 0 WHEN oh = 0 AND ov = 0 THEN 0 WHEN oh = 0 OR ov = 0 THEN CASE WHEN band = 'HH' THEN 1 ELSE 2 END WHEN oh = 2 OR ov = 2 THEN 1 ELSE CASE WHEN band = 'HH' THEN 1 ELSE 2 END END AS aged FROM t""")
def _refine(spark, sf):
    k = coded(spark, sf)
    now = contexts.significance_context(k, ["frame", "band"], 0)
    old = contexts.significance_context(k, ["frame", "band"], 1)
    return contexts.refinement_class(now, old, ["frame", "band"]).select("frame", "band", "y", "x", "refine", "aged")


@register("WIN26_sign_context", CODED + """, s AS (SELECT frame, band, y, x, q, CASE WHEN q <> 0 THEN sign(q) ELSE 0 END AS g FROM k),
 p AS (SELECT a.frame, a.band, a.y, a.x, any_value(a.q) AS q,
  max(CASE WHEN b.y = a.y AND b.x <> a.x AND b.g = 1 THEN 1 ELSE 0 END) - max(CASE WHEN b.y = a.y AND b.x <> a.x AND b.g = -1 THEN 1 ELSE 0 END) AS hb,
  max(CASE WHEN b.x = a.x AND b.y <> a.y AND b.g = 1 THEN 1 ELSE 0 END) - max(CASE WHEN b.x = a.x AND b.y <> a.y AND b.g = -1 THEN 1 ELSE 0 END) AS vb,
  max(CASE WHEN b.x - a.x = b.y - a.y AND b.x <> a.x AND b.g = 1 THEN 1 ELSE 0 END) - max(CASE WHEN b.x - a.x = b.y - a.y AND b.x <> a.x AND b.g = -1 THEN 1 ELSE 0 END) AS fall,
  max(CASE WHEN b.x - a.x = a.y - b.y AND b.x <> a.x AND b.g = 1 THEN 1 ELSE 0 END) - max(CASE WHEN b.x - a.x = a.y - b.y AND b.x <> a.x AND b.g = -1 THEN 1 ELSE 0 END) AS rise
  FROM s a JOIN s b ON a.frame = b.frame AND a.band = b.band AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.frame, a.band, a.y, a.x),
 t AS (SELECT *, CASE WHEN band = 'HL' THEN vb ELSE hb END AS h, CASE WHEN band = 'HL' THEN hb ELSE vb END AS v FROM p WHERE q <> 0),
 u AS (SELECT *, CASE WHEN v > 0 THEN 3 + h WHEN v < 0 THEN 3 - h WHEN h <> 0 THEN 1 WHEN fall <> 0 OR rise <> 0 THEN 5 ELSE 0 END AS sign_class,
  CASE WHEN v > 0 THEN 1 WHEN v < 0 THEN 0 WHEN h <> 0 THEN CASE WHEN band = 'HH' THEN CASE WHEN h > 0 THEN 1 ELSE 0 END ELSE CASE WHEN h < 0 THEN 1 ELSE 0 END END
       WHEN fall < 0 THEN 1 WHEN fall > 0 THEN 0 WHEN rise <> 0 THEN CASE WHEN band = 'HH' THEN CASE WHEN rise < 0 THEN 1 ELSE 0 END ELSE CASE WHEN rise > 0 THEN 1 ELSE 0 END END ELSE 0 END AS flip FROM t)
 SELECT band, CAST(sign_class AS INT) AS sign_class, count(*) AS n, """ + Q.rq("avg(CASE WHEN flip = CASE WHEN q < 0 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END)") + " AS rate FROM u GROUP BY ALL")
def _sign(spark, sf):
    return contexts.sign_agreement(contexts.sign_context(coded(spark, sf), ["frame", "band"], 0), ["band"])


# ---- rate


@register("AGG4_bit_ledger", views("substreams") + ", b AS (SELECT 'c' || gop % 3 AS clip, 'p' || band % 3 AS plane, 't' || fr AS tband, avail AS bits FROM substreams) SELECT clip, plane, tband, CAST(grouping(clip, plane, tband) AS BIGINT) AS gid, CAST(sum(bits) AS BIGINT) AS bits FROM b GROUP BY ROLLUP (clip, plane, tband)")
def _ledger(spark, sf):
    b = fixture(spark, sf, "substreams").select(F.expr("concat('c', gop % 3) clip"), F.expr("concat('p', band % 3) plane"), F.expr("concat('t', fr) tband"), F.col("avail").alias("bits"))
    return rate.bit_ledger(b, ["clip", "plane", "tband"])


@register("AGG6_epoch_metrics", views("steps") + " " + " UNION ALL ".join(f"SELECT epoch, phase, {p} AS pos, {Q.rq('avg(loss)', 10)} AS loss, {Q.rq('avg(psnr)', 10)} AS psnr, {Q.rq('avg(bpp)', 10)} AS bpp FROM steps GROUP BY {g}" for p, g in (("pos", "1, 2, 3"), ("NULL", "1, 2"))), 10)
def _epochs(spark, sf):
    return rate.epoch_metrics(fixture(spark, sf, "steps"))


@register("AGG7_rd_objective", views("steps") + f", m AS (SELECT epoch, phase, avg(bpp) AS bpp, avg(psnr) AS psnr FROM steps GROUP BY ALL) SELECT epoch, phase, {Q.rq('bpp', 10)} AS rate_loss, {Q.rq('(-0.064 * psnr)', 10)} AS quality_loss FROM m", 10)
def _objective(spark, sf):
    m = fixture(spark, sf, "steps").groupBy("epoch", "phase").agg(F.avg("bpp").alias("bpp"), F.avg("psnr").alias("psnr"))
    return entropy.rd_objective(m).select("epoch", "phase", "rate_loss", "quality_loss")


@register("AGG15_motion_bytes", views("mv_bytes") + " SELECT gop, CAST(sum(CASE WHEN level >= 1 THEN bytes ELSE 0 END) AS BIGINT) AS used, CAST(sum(bytes) AS BIGINT) AS existing FROM mv_bytes GROUP BY 1")
def _mvb(spark, sf):
    return rate.motion_bytes(fixture(spark, sf, "mv_bytes"), 1)


TRUNC = views("substreams", "mv_bytes") + ", z AS (SELECT *, least(alloc, avail) AS size FROM substreams), zz AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN size < 32768 THEN 2 ELSE 4 END AS header FROM z)"


@register("AGG17_truncate_streams", TRUNC + " SELECT gop, fr, band, CAST(avail AS BIGINT) AS avail, CAST(alloc AS BIGINT) AS alloc, CAST(size AS BIGINT) AS size, header FROM zz")
def _trunc(spark, sf):
    return rate.truncate_streams(fixture(spark, sf, "substreams"))


@register("AGG18_stream_offsets", TRUNC + ", m AS (SELECT gop, sum(bytes + 4) AS m FROM mv_bytes GROUP BY 1), s AS (SELECT gop, sum(size + header) AS s FROM zz GROUP BY 1), b AS (SELECT gop, coalesce(m, 0) + coalesce(s, 0) AS bytes FROM s FULL JOIN m USING (gop)) SELECT gop, CAST(bytes AS BIGINT) AS bytes, CAST((SELECT ceil(count(*) / 8.0) FROM b) + coalesce(sum(bytes) OVER (ORDER BY gop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM b")
def _offsets(spark, sf):
    return rate.stream_offsets(rate.truncate_streams(fixture(spark, sf, "substreams")), fixture(spark, sf, "mv_bytes"))


@register("SNK3_allocation_report", TRUNC + ", p AS (SELECT gop, 'header' AS item, header AS bytes FROM zz UNION ALL SELECT gop, 'band' || band, size FROM zz UNION ALL SELECT gop, 'motion', bytes FROM mv_bytes) SELECT gop, item, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY ROLLUP (gop, item)")
def _report(spark, sf):
    return rate.allocation_report(rate.truncate_streams(fixture(spark, sf, "substreams")), fixture(spark, sf, "mv_bytes"))


# ---- order and sampling


@register("SRT1_quadtree_order", views("blocks") + " SELECT frame, path, CAST(row_number() OVER (PARTITION BY frame ORDER BY path) - 1 AS INT) AS place FROM blocks")
def _order(spark, sf):
    return sampling.quadtree_order(blocks(spark, sf), ["frame"]).select("frame", "path", "place")


@register("SRT2_batches")
def _batches(spark, sf):
    return sampling.batches(frames(spark, sf).select("frame").distinct(), "frame", 4, 7)


@register("SMP1_random_crop")
def _crop(spark, sf):
    return sampling.random_crop(frames(spark, sf), ["frame"], 8, 7, 16, 16)


# ---- files: written from the stand-ins into the scratch folder, then read


@register("SRC5_scan_tagged_log", views("blocks", "symbols") + " SELECT 'dmv' AS kind, frame * 1000000 + cx * 1000 + cy AS id, mvx AS a, mvy AS b FROM blocks UNION ALL SELECT 'frq', stream, sum(CASE WHEN sym = 0 THEN 1 ELSE 0 END)::DOUBLE, count(*)::DOUBLE FROM symbols GROUP BY stream")
def _tagged(spark, sf):
    path = scratch(spark)
    dmv = blocks(spark, sf).select(F.concat_ws(" ", F.lit("dmv:"), F.expr("cast(cast(frame as bigint) * 1000000 + cx * 1000 + cy as string)"), F.col("mvx").cast("string"), F.col("mvy").cast("string")).alias("value"))
    counts = fixture(spark, sf, "symbols").groupBy("stream").agg(F.count("*").alias("n"), F.sum(F.expr("cast(sym = 0 as int)")).alias("z"))
    frq = counts.select(F.concat_ws(" ", F.lit("frq:"), F.col("stream").cast("string"), F.lit("0"), F.lit("0"), F.lit("0"), F.col("n").cast("string"), F.col("z").cast("string"), (F.col("n") - F.col("z")).cast("string")).alias("value"))
    dmv.unionByName(frq).write.text(path)
    a, b = logs.scan_tagged_log(spark, path)
    f = F.col("fields")
    one = a.select(F.lit("dmv").alias("kind"), f[0].cast("bigint").alias("id"), f[1].alias("a"), f[2].alias("b"))
    return one.unionByName(b.select(F.lit("frq").alias("kind"), F.col("gop").cast("bigint").alias("id"), F.col("freq")[0].cast("double").alias("a"), F.col("total").cast("double").alias("b")))


@register("SRC6_scan_motion_sizes", "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n, o_orderkey % 9001 AS bytes FROM orders) SELECT n // 9 AS gop, CAST(CASE WHEN n % 9 < 2 THEN 2 WHEN n % 9 < 5 THEN 1 ELSE 0 END AS INT) AS level, CAST(CASE WHEN n % 9 < 2 THEN n % 9 WHEN n % 9 < 5 THEN n % 9 - 2 ELSE n % 9 - 5 END AS INT) AS set_k, bytes FROM o")
def _sizes(spark, sf):
    path = scratch(spark)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.orderBy("o_orderkey").select((F.col("o_orderkey") % 9001).cast("string").alias("value")).write.text(path)  # part files in order
    return logs.scan_motion_sizes(spark, path, -(-orders.count() // 9), {2: 2, 1: 3, 0: 4})  # the last group may be short


@register("SNK1_write_planar", FR + " SELECT 'c' AS clip, 'y' AS plane, CAST(frame AS INT) AS frame, y, x, v FROM frames16")
def _planar(spark, sf):
    """One clip of all frames: its ranges of frames become files that are read as one."""
    path = scratch(spark)
    planar.write_planar(frames(spark, sf).withColumn("clip", F.lit("c")).withColumn("plane", F.lit("y")), path, 16, 16, planes="y", partial="true")
    return planar.scan_planar(spark, path, 16, 16, planes="y")


@register("SNK2_export_blocks", views("blocks") + " SELECT CAST(frame AS INT) AS frame, cx, cy, xblk, yblk, mode, 1 AS has_mv, mvx, mvy FROM blocks")
def _export(spark, sf):
    path = scratch(spark)
    logs.export_blocks(blocks(spark, sf), path)
    return spark.read.schema("frame int, cx int, cy int, xblk int, yblk int, mode int, has_mv int, mvx double, mvy double").csv(path, sep="\t")


@register("SRC1_scan_planar", FR + " SELECT 'c' || frame // 8 AS clip, 'y' AS plane, CAST(frame % 8 AS INT) AS frame, y, x, v FROM frames16")
def _container(spark, sf):
    path = scratch(spark)
    clips = frames(spark, sf).select(F.concat(F.lit("c"), F.expr("frame div 8").cast("string")).alias("clip"), F.lit("y").alias("plane"), (F.col("frame") % 8).alias("frame"), "y", "x", "v")
    planar.write_planar(clips, path, 16, 16, planes="y", partial="true")
    return planar.scan_planar(spark, path, 16, 16, planes="y", frames_per_task=3)


@register("SRC2_scan_planar_template", FR + " SELECT 'f' AS clip, 'y' AS plane, CAST(frame AS INT) AS frame, y, x, v FROM frames16")
def _template(spark, sf):
    path = scratch(spark)
    bodies = planar.frame_bytes(frames(spark, sf).withColumn("clip", F.lit("f")).withColumn("plane", F.lit("y")), [("y", 16, 16)])
    planar.write_files(bodies.select(F.concat(F.lit("f_"), F.col("frame").cast("string"), F.lit(".raw")).alias("name"), F.col("body").alias("content")), path)
    return planar.scan_planar_template(spark, path + "/*.raw", 16, 16)


@register("SRC4_scan_clip_bundle", views("motion") + " SELECT 'c' || frame // 8 AS clip, 'frame' AS kind, CAST(frame % 8 AS INT) AS channel, y, x, v FROM frames16 UNION ALL SELECT 'c' || frame // 8, 'mv', CAST(frame % 8 AS INT), y, x, mvx FROM motion WHERE side = 0")
def _npy(spark, sf):
    path = scratch(spark)
    mv = side(spark, sf, 0).select("frame", "y", "x", (F.col("mvx") * 16).alias("v"), F.lit("mv").alias("kind"))
    rows = frames(spark, sf).withColumn("kind", F.lit("frame")).unionByName(mv).withColumn("clip", F.concat(F.lit("c"), F.expr("frame div 8").cast("string"))).withColumn("channel", (F.col("frame") % 8).cast("int"))
    logs.write_clip_bundle(rows, path)
    return logs.scan_clip_bundle(spark, path)


@register("PRJ5_noisy_soft_round")
def _noisy(spark, sf):
    from rippleframe.functions import scalars as S

    return fixture(spark, sf, "series").select("sid", "t", S.noisy_soft_round(F.col("v") / 7, 3.0, 11).alias("v"))


# ---- streams, drained into a table: their batch twins are the check


def drained(spark: SparkSession, batch: DataFrame, query, mode: str, state: str | None = None) -> DataFrame:
    base = scratch(spark)
    batch.write.parquet(base + "/in")
    stream = spark.readStream.schema(batch.schema).parquet(base + "/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if state:
        spark.conf.set(provider, state)
    out = query(stream)
    name = "s" + uuid.uuid4().hex
    kept = []

    def keep(part: DataFrame, n: int) -> None:
        part.write.mode("overwrite").parquet(f"{base}/out/n={n}")
        kept.append(n)

    run = out.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", base + "/state").trigger(availableNow=True).foreachBatch(keep).start()
    try:
        run.awaitTermination()
    finally:
        if state:
            spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    read = spark.read.schema(out.schema).parquet(*[f"{base}/out/n={n}" for n in (kept[-1:] if mode == "complete" else kept)])
    return read


@register("STR1_stream_quality", views("steps") + f" SELECT phase, {Q.rq('avg(psnr)', 10)} AS psnr, count(*) AS n FROM steps GROUP BY 1", 10)
def _squality(spark, sf):
    return drained(spark, fixture(spark, sf, "steps"), lambda s: running.stream_quality(s, ["phase"]), "complete")


@register("STR2_stream_adaptive_cost")
def _sadapt(spark, sf):
    return drained(spark, fixture(spark, sf, "symbols"), lambda s: running.stream_adaptive_cost(s, 5, 32), "append", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@register("STR3_stream_gop_bytes")
def _sbytes(spark, sf):
    sizes = fixture(spark, sf, "mv_bytes").select(F.timestamp_seconds(F.col("gop") * 8 + F.col("set_k")).alias("ts"), "bytes")
    return drained(spark, sizes, lambda s: running.stream_gop_bytes(s, "ts", "bytes", "8 seconds", "10 seconds"), "append")


# ---- temporal lifting along motion


def kept(df: DataFrame) -> DataFrame:
    """df written to the scratch folder and read again, so that a later level does not compute it anew."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clip_motion(spark, sf, levels: int, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The stand-in motion of one clip, the same on each level."""
    return store(fixture(spark, sf, "motion").withColumn("clip", F.lit("a"))).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))


def clip_frames(spark, sf) -> DataFrame:
    return frames(spark, sf).withColumn("clip", F.lit("a"))


def _clamped(src: str, axis: str, own: str, name: str) -> str:
    keys = f"frame{own}"
    parts = [f"SELECT {keys}, 0 AS {name}, y, x, v FROM {src}"]
    parts += [f"SELECT {keys}, {p} AS {name}, y, x, v FROM ({Q.fir(src, axis, 16, {o - 3: w for o, w in enumerate(t)}, None, keys, 'clamp')})" for p, t in Q.PHASES.items()]
    return " UNION ALL ".join(parts)


def _guess(name: str, src: str, odd: int) -> str:
    """CTEs that end in {name} (frame, y, x, p, cut): src (frame, y, x, v), numbered, seen along the motion of odd or even frames."""
    turn = 1 if odd else -1
    return f"""{name}_h AS ({_clamped(src, 'x', '', 'px')}), {name}_v AS ({_clamped(f'{name}_h', 'y', ', px', 'py')}),
{name}_n AS (SELECT max(frame) AS n FROM {src}),
{name}_m AS (SELECT frame, y, x, side, CASE WHEN spot > n THEN 0 ELSE m END AS m, greatest(0, least(spot, n)) AS spot, greatest(0, least(63, 4 * y - CAST(round_even(4 * {turn} * mvy, 0) AS INT))) AS fy, greatest(0, least(63, 4 * x - CAST(round_even(4 * {turn} * mvx, 0) AS INT))) AS fx
  FROM (SELECT *, frame // 2 + side - {1 - odd} AS spot FROM motion WHERE frame % 2 = {odd}), {name}_n),
{name}_w AS (SELECT m.frame, m.y, m.x, m.side, m.m, p.v * m.m AS v FROM {name}_m m JOIN {name}_v p ON p.frame = m.spot AND p.py = fy % 4 AND p.px = fx % 4 AND p.y = fy // 4 AND p.x = fx // 4),
{name} AS (SELECT a.frame, a.y, a.x, (CASE WHEN a.m = 0 THEN b.v ELSE a.v END + CASE WHEN b.m = 0 THEN a.v ELSE b.v END) / 2 AS p, cut FROM {name}_w a JOIN {name}_w b USING (frame, y, x) JOIN (SELECT frame, max(m) = 0 AS cut FROM motion GROUP BY 1) USING (frame) WHERE a.side = 0 AND b.side = 1)"""


_A, _B = "sqrt(23 / 32.0)", "sqrt(1.5)"
#: Weights of copied frames times the gain, by level; the same numbers as in PRJ7.
_COPY = {("h", 1): "1.0", ("l", 1): "1.0", ("h", 2): "(1.0 / 0.92470128353329)", ("l", 2): "(1.0 / 1.10554159678513)"}


def _along_sql(src: str, n: int) -> str:
    """CTEs mh{n} and ml{n} (frame, y, x, v) of one level of src."""
    return f"""e{n} AS (SELECT frame // 2 AS frame, y, x, v FROM {src} WHERE frame % 2 = 0), {_guess(f'gp{n}', f'e{n}', 1)},
mh{n} AS (SELECT frame // 2 AS frame, y, x, CASE WHEN cut THEN {_COPY['h', n]} * v ELSE (v - p) * {_A} END AS v FROM {src} JOIN gp{n} USING (frame, y, x)), {_guess(f'gu{n}', f'mh{n}', 0)},
ml{n} AS (SELECT frame // 2 AS frame, y, x, CASE WHEN cut THEN {_COPY['l', n]} * v ELSE (v + coalesce(p, 0.0) / 2 / {_A}) * {_B} END AS v FROM {src} LEFT JOIN gu{n} USING (frame, y, x) WHERE frame % 2 = 0)"""


ALONG = views("motion") + ", " + _along_sql("frames16", 1)


@register("WIN12_t_predict_along", ALONG + f" SELECT CAST(frame AS INT) AS i, y, x, {Q.rq('v')} AS h FROM mh1")
def _predict_along(spark, sf):
    return temporal.t_predict_along(clip_frames(spark, sf), clip_motion(spark, sf, 1), ["clip"], 16, 16).drop("clip")


@register("WIN13_t_update_along", ALONG + f" SELECT CAST(frame AS INT) AS i, y, x, {Q.rq('v')} AS l FROM ml1")
def _update_along(spark, sf):
    f, m = clip_frames(spark, sf), clip_motion(spark, sf, 1)
    return temporal.t_update_along(f, kept(temporal.t_predict_along(f, m, ["clip"], 16, 16)), m, ["clip"], 16, 16).drop("clip")


@register("WIN14_t_pyramid_along", ALONG + ", " + _along_sql("ml1", 2) + " " + " UNION ALL ".join(f"SELECT '{b[1:].upper()}' AS tband, CAST(frame AS INT) AS idx, y, x, {Q.rq('v')} AS v FROM {b}" for b in ("mh1", "mh2", "ml2")))
def _pyramid_along(spark, sf):
    return temporal.t_pyramid_along(clip_frames(spark, sf), clip_motion(spark, sf, 2), ["clip"], 16, 16, 2, kept).drop("clip")


@register("WIN15_t_unpyramid_along", FR + " SELECT frame, y, x, v FROM frames16")
def _unpyramid_along(spark, sf):
    m = clip_motion(spark, sf, 3, kept)
    bands = temporal.t_pyramid_along(clip_frames(spark, sf), m, ["clip"], 16, 16, 3, kept, True)  # each band is a table that was kept
    return temporal.t_unpyramid_along(bands, m, ["clip"], 16, 16, 3, kept, True).select(F.col("frame").cast("int").alias("frame"), "y", "x", "v")
