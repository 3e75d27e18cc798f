"""Budgets, ledgers, mixtures, coders and sweeps: queries whose twins are written from the definitions, with constants of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.functions import scalars as S
from rippleframe.operators import coder, entropy, grid, quality, rate
from rippleframe.plans import oracles as Q
from rippleframe.plans.fixtures import fixture, views
from rippleframe.plans.registry import CODED, coded, frames, register, unwavelet_sql
from rippleframe.plans.registry_more import two_levels

# ---- a clip's motion budget: the twin tries every number of drops and takes the first that fits

BUDGET = views("clips") + """, r AS (SELECT *, CASE part WHEN 'sub' THEN sub_bit WHEN 'sign' THEN 0 END AS step FROM mv_clips WHERE level >= {t}),
 has AS (SELECT DISTINCT clip, level FROM r WHERE part = 'sub'), good AS (SELECT r.* FROM r WHERE step IS NULL OR EXISTS (SELECT 1 FROM has WHERE has.clip = r.clip AND has.level = r.level)),
 u AS (SELECT clip, level, step, sum(bytes) AS size, count(*) OVER (PARTITION BY clip) AS n, row_number() OVER (PARTITION BY clip ORDER BY level, step DESC) AS turn FROM good WHERE step IS NOT NULL GROUP BY clip, level, step),
 s AS (SELECT clip, unnest(range(CAST(n AS BIGINT) + 1)) AS drops FROM (SELECT DISTINCT clip, n FROM u)),
 left_of AS (SELECT s.clip, drops, (SELECT sum(bytes) FROM good g WHERE g.clip = s.clip) - coalesce(sum(size), 0) AS bytes FROM s LEFT JOIN u ON u.clip = s.clip AND u.turn <= s.drops GROUP BY s.clip, drops),
 b AS (SELECT clip, bitrate * 1000 / 8.0 * (last - start + 1) / framerate AS budget FROM clips),
 k AS (SELECT clip, coalesce(min(drops) FILTER (bytes <= 0.55 * budget), max(drops)) AS drops FROM left_of JOIN b USING (clip) GROUP BY 1)"""


@register("AGG16_motion_budget_prune", BUDGET.format(t=0) + " SELECT g.clip, g.gop, g.level, g.set_k, g.part, g.sub_bit, g.bytes FROM good g LEFT JOIN u ON u.clip = g.clip AND u.level = g.level AND u.step = g.step LEFT JOIN k ON k.clip = g.clip WHERE g.step IS NULL OR u.turn > k.drops")
def _prune(spark, sf):
    return rate.motion_budget_prune(fixture(spark, sf, "mv_clips"), fixture(spark, sf, "clips"))


@register("AGG16_motion_drop_order", BUDGET.format(t=1) + f" SELECT u.clip, u.level, u.step, CAST(u.size AS BIGINT) AS size, {Q.rq('budget')} AS budget, CAST(bytes AS BIGINT) AS left_before, turn <= k.drops AS dropped FROM u JOIN k USING (clip) JOIN b USING (clip) JOIN left_of l ON l.clip = u.clip AND l.drops = u.turn - 1")
def _order(spark, sf):
    return rate.motion_drop_order(fixture(spark, sf, "mv_clips"), fixture(spark, sf, "clips"), 1)


# ---- ledgers


@register("AGG4_bits_per_sample", views("clip_sizes") + """, s AS (SELECT clip, plane, sum(bits) AS bits, any_value((last - start + 1) * CASE plane WHEN 'y' THEN ywidth * yheight ELSE cwidth * cheight END) AS samples FROM frame_bits JOIN clip_sizes USING (clip) GROUP BY ALL),
 t AS (SELECT clip, plane, bits, samples FROM s UNION ALL SELECT clip, NULL, sum(bits), sum(samples) FROM s GROUP BY clip UNION ALL SELECT NULL, NULL, sum(bits), sum(samples) FROM s)
 SELECT clip, plane, CAST(bits AS BIGINT) AS bits, CAST(samples AS BIGINT) AS samples, """ + Q.rq("(bits / samples)") + " AS per_sample FROM t")
def _per_sample(spark, sf):
    return rate.bits_per_sample(fixture(spark, sf, "frame_bits"), fixture(spark, sf, "clip_sizes"))


@register("AGG4_position_bytes", views("frame_bits") + ", e AS (SELECT clip, tband, idx, sum(bits) / 8.0 AS bytes FROM frame_bits GROUP BY ALL) SELECT a.clip, CAST((SELECT count(*) FROM e b WHERE b.clip = a.clip AND (b.tband < a.tband OR b.tband = a.tband AND b.idx < a.idx)) AS INT) AS position, tband, idx, bytes::DOUBLE AS bytes FROM e a UNION ALL SELECT clip, NULL, NULL, NULL, sum(bytes)::DOUBLE FROM e GROUP BY clip")
def _positions(spark, sf):
    return rate.position_bytes(fixture(spark, sf, "frame_bits"))


# ---- mixtures: the twin adds the terms of the series one by one, whatever the size of z


def tail_sql(z: str) -> str:
    """Mass above z >= 0: half less the density times the sum of z**(2n+1) / (1 * 3 * .. * (2n+1)), and a chain of fractions from 4 on."""
    terms = f"list_sum(list_transform(range(90), lambda n: exp((2 * n + 1) * ln({z}) - (n + 1) * ln(2) - lgamma(n + 1.5) + ln(pi()) / 2)))"
    chain = f"list_reduce(range(80, 0, -1), lambda a, n: ({z}) + n / a, ({z})::DOUBLE)"
    density = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi())"
    return f"(CASE WHEN {z} = 0 THEN 0.5 WHEN {z} < 4 THEN 0.5 - {density} * {terms} ELSE {density} / {chain} END)"


@register("UDF1_normal_cdf", views("series") + f" SELECT sid, t, round(CASE WHEN z < 0 THEN {tail_sql('abs(z)')} ELSE 1 - {tail_sql('abs(z)')} END, 12) AS p FROM (SELECT sid, t, (t % 801 - 400) / 50.0::DOUBLE + v / 1e12 AS z FROM series)", 12)
def _cdf(spark, sf):
    z = (F.col("t") % 801 - 400) / 50 + F.col("v") / 1e12
    return fixture(spark, sf, "series").select("sid", "t", z.alias("z")).select("sid", "t", S.normal_cdf(F.col("z")).alias("p"))


@register("AGG11_mixture_bits", CODED + f""", w AS (SELECT k AS i, exp(k) / sum(exp(k)) OVER () AS w, k::DOUBLE AS mu, 1.0 + 3 * k AS sd FROM range(3) r(k)),
 x AS (SELECT band, q AS x, count(*) AS c FROM k GROUP BY ALL), z AS (SELECT band, x, c, w, (x - 0.5 - mu) / sd AS lo, (x + 0.5 - mu) / sd AS hi FROM x, w),
 m AS (SELECT band, x, c, w * CASE WHEN lo >= 0 THEN tl - th WHEN hi <= 0 THEN th - tl ELSE 1 - tl - th END AS m FROM (SELECT *, {tail_sql('abs(lo)')} AS tl, {tail_sql('abs(hi)')} AS th FROM z)),
 p AS (SELECT band, x, c, greatest(sum(m), 1e-9) AS p FROM m GROUP BY ALL) SELECT band, CAST(sum(c) AS BIGINT) AS n, {Q.rq('sum(-log2(p) * c)')} AS bits FROM p GROUP BY 1""")
def _mix(spark, sf):
    x = coded(spark, sf).select("band", F.col("q").alias("x"))
    params = spark.createDataFrame([(b, k, float(k), float(k), 1.0 + 3 * k) for b in ("LL", "HL", "LH", "HH") for k in range(3)], "band string, k int, logit double, mu double, sigma double")
    return entropy.mixture_bits(x, params, ["band"])


# ---- a bit-plane coder with contexts: the twin counts neighbours by a self-join, a plane at a time

_SEEN = "(abs(n.q) >> (b + {up})) > 0"
_COUNT = "CAST(sum(CASE WHEN {where} AND " + _SEEN + " THEN 1 ELSE 0 END) AS INT) AS {name}"
_SIDES = {"h": "n.y = a.y AND n.x <> a.x", "v": "n.x = a.x AND n.y <> a.y", "d": "n.x <> a.x AND n.y <> a.y", "fall": "n.x - a.x = n.y - a.y AND n.x <> a.x", "rise": "n.x - a.x = a.y - n.y AND n.x <> a.x"}
_BALANCE = "max(CASE WHEN {where} AND n.q > 0 AND " + _SEEN + " THEN 1 ELSE 0 END) - max(CASE WHEN {where} AND n.q < 0 AND " + _SEEN + " THEN 1 ELSE 0 END) AS {name}"
_COUNTS = ", ".join([_COUNT.format(where=_SIDES[s], up=up, name=name) for name, s, up in (("h0", "h", 1), ("v0", "v", 1), ("d", "d", 1), ("oh", "h", 2), ("ov", "v", 2))] + [_BALANCE.format(where=_SIDES[s], up=1, name=f"b{s}") for s in ("h", "v", "fall", "rise")])
CODER = CODED + """,
low AS (SELECT frame, y, x, c AS v FROM w1 WHERE band = 'LL'),
""" + Q.wavelet("low", "w2") + f""",
j AS (SELECT a.frame, a.band, a.y, a.x, a.q, b, {_COUNTS} FROM k a JOIN k n ON a.frame = n.frame AND a.band = n.band AND n.y BETWEEN a.y - 1 AND a.y + 1 AND n.x BETWEEN a.x - 1 AND a.x + 1, range(6) p(b) GROUP BY a.frame, a.band, a.y, a.x, a.q, b),
t AS (SELECT j.* EXCLUDE (h0, v0, bh, bv, oh, ov), h0 + v0 AS s, abs(j.q) >> b AS here, abs(j.q) >> (b + 1) AS above, CASE WHEN (CAST(floor(abs(round(w2.c, 9) / 16)) AS INT) >> b) > 0 THEN 1 ELSE 0 END AS p,
 CASE WHEN j.band = 'HL' THEN v0 ELSE h0 END AS h, CASE WHEN j.band = 'HL' THEN h0 ELSE v0 END AS v, CASE WHEN j.band = 'HL' THEN bv ELSE bh END AS gh, CASE WHEN j.band = 'HL' THEN bh ELSE bv END AS gv
 FROM j LEFT JOIN w2 ON w2.frame = j.frame AND w2.band = j.band AND w2.y = j.y // 2 AND w2.x = j.x // 2),
u AS (SELECT *, CASE WHEN p = 1 THEN CASE WHEN band = 'HH' THEN CASE WHEN s = 0 THEN CASE WHEN d = 1 THEN 0 ELSE 1 END WHEN s = 1 THEN CASE WHEN d < 3 THEN 1 ELSE 2 END WHEN h = 1 AND v = 1 THEN CASE WHEN d < 2 THEN 1 ELSE 2 END WHEN s = 2 THEN 2 ELSE 3 END
      ELSE CASE WHEN s = 0 THEN CASE WHEN d = 1 THEN 0 ELSE 1 END WHEN h = 0 AND v = 1 THEN 1 WHEN h = 1 AND v = 0 THEN 2 WHEN s > 2 THEN 4 ELSE 3 END END
      ELSE CASE WHEN band = 'HH' THEN 4 ELSE 5 END + CASE WHEN s = 0 THEN 0 WHEN s = 1 THEN CASE WHEN d < 3 THEN 0 ELSE 1 END WHEN s = 2 THEN 1 ELSE 2 END END AS joint,
 CASE WHEN h = 0 AND v = 0 THEN 0 WHEN h = 0 THEN 1 WHEN v = 0 THEN CASE WHEN band = 'HH' THEN 1 ELSE 2 END WHEN h = 2 AND v = 2 THEN CASE WHEN band = 'HH' THEN 3 ELSE 4 END ELSE CASE WHEN band = 'HH' THEN 2 ELSE 3 END END AS refine,
 CASE WHEN gv > 0 THEN 3 + gh WHEN gv < 0 THEN 3 - gh WHEN gh <> 0 THEN 1 WHEN bfall <> 0 OR brise <> 0 THEN 5 ELSE 0 END AS sign_class,
 CASE WHEN gv > 0 THEN 1 WHEN gv < 0 THEN 0 WHEN gh <> 0 THEN CASE WHEN band = 'HH' THEN CASE WHEN gh > 0 THEN 1 ELSE 0 END ELSE CASE WHEN gh < 0 THEN 1 ELSE 0 END END
      WHEN bfall < 0 THEN 1 WHEN bfall > 0 THEN 0 WHEN brise <> 0 THEN CASE WHEN band = 'HH' THEN CASE WHEN brise < 0 THEN 1 ELSE 0 END ELSE CASE WHEN brise > 0 THEN 1 ELSE 0 END END ELSE 0 END AS flip FROM t),
e AS (SELECT band, b AS plane, 'significance' AS kind, joint AS class, CASE WHEN here > 0 THEN 1 ELSE 0 END AS sym FROM u WHERE above = 0
 UNION ALL SELECT band, b, 'sign', sign_class, CASE WHEN (flip = 1) = (q < 0) THEN 1 ELSE 0 END FROM u WHERE above = 0 AND here > 0 UNION ALL SELECT band, b, 'refinement', refine, here % 2 FROM u WHERE above > 0),
f AS (SELECT band, plane, kind, class, sym, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT band, plane, kind, sum(n) AS n, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits FROM f GROUP BY band, plane, kind, class)"""


@register("AGG22_plane_coder", CODER + f""", s AS (SELECT band, plane, coalesce(sum(bits) FILTER (kind = 'significance'), 0) AS significance, coalesce(sum(bits) FILTER (kind = 'sign'), 0) AS sign, coalesce(sum(bits) FILTER (kind = 'refinement'), 0) AS refinement FROM g GROUP BY ALL),
 m AS (SELECT band, b AS plane, avg((c - CASE WHEN (abs(q) >> b) = 0 THEN 0 ELSE sign(q) * ((abs(q) >> b) + 0.5) * (1 << b) * 16 END) ** 2) AS mse FROM k, range(7) p(b) GROUP BY ALL),
 n AS (SELECT a.band, a.plane, a.mse, c.mse - a.mse AS gain FROM m a JOIN m c ON c.band = a.band AND c.plane = a.plane + 1),
 r AS (SELECT s.*, s.significance + s.sign + s.refinement AS bits, (SELECT sum(z.significance + z.sign + z.refinement) FROM s z WHERE z.band = s.band AND z.plane >= s.plane) AS total FROM s)
 SELECT band, CAST(plane AS INT) AS plane, {Q.rq('significance')} AS significance, {Q.rq('sign')} AS sign, {Q.rq('refinement')} AS refinement, {Q.rq('bits')} AS bits, {Q.rq('total')} AS total, {Q.rq('mse')} AS mse, {Q.rq('gain')} AS gain,
 CASE WHEN bits > 1e-9 THEN {Q.rq('(gain / bits)')} END AS slope FROM r JOIN n USING (band, plane)""")
def _coder(spark, sf):
    k, parents = two_levels(spark, sf)
    return coder.coded_rd_curve(k, ["frame", "band"], ["band"], 6, 16.0, parents).select("band", "plane", *coder.KINDS, "bits", "total", "mse", "gain", "slope")


# ---- rate and distortion of samples: the twin puts the grid point into the frame number

SWEPT = CODED + """,
pt AS (SELECT row_number() OVER () - 1 AS g, step, discard FROM (VALUES (8.0::DOUBLE), (16.0), (32.0), (64.0), (128.0)) a(step), (VALUES (0), (4), (5)) b(discard)),
sy AS (SELECT frame, g, step, discard, band, y, x, CASE WHEN discard < CASE band WHEN 'LL' THEN 13 WHEN 'HL' THEN 6 WHEN 'LH' THEN 5 ELSE 4 END THEN sign(c9) * floor(abs(c9 / step)) ELSE 0 END AS sym FROM k, pt),
dq AS (SELECT frame * 15 + g AS frame, band, y, x, CASE WHEN sym = 0 THEN 0.0 ELSE sign(sym) * (abs(sym) + 0.5) * step END AS c FROM sy),
""" + unwavelet_sql("dq", "rec") + """,
er AS (SELECT a.frame, g, step, discard, avg((a.v - least(greatest(round(r.v), 0), 255)) ** 2) AS mse FROM rec r JOIN pt ON pt.g = r.frame % 15 JOIN frames16 a ON a.frame = r.frame // 15 AND a.y = r.y AND a.x = r.x GROUP BY ALL),
ps AS (SELECT CASE frame % 3 WHEN 0 THEN 'y' WHEN 1 THEN 'u' ELSE 'v' END AS plane, step, discard, CASE WHEN mse > 0 THEN 10 * log10(65025 / mse) END AS psnr FROM er),
ct AS (SELECT CASE frame % 3 WHEN 0 THEN 'y' WHEN 1 THEN 'u' ELSE 'v' END AS plane, step, discard, band, sym, count(*) AS n FROM sy GROUP BY ALL),
bt AS (SELECT plane, step, discard, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits FROM ct GROUP BY plane, step, discard, band)"""


@register("AGG5_sample_rd_sweep", SWEPT + f""", b AS (SELECT plane, step, discard, CAST(grouping(plane, step, discard) AS BIGINT) AS gid, sum(bits) AS bits FROM bt GROUP BY CUBE (plane, step, discard)),
 p AS (SELECT plane, step, discard, count(psnr) AS frames, avg(psnr) AS psnr FROM ps GROUP BY CUBE (plane, step, discard))
 SELECT b.plane, b.step, b.discard, gid, {Q.rq('bits')} AS bits, frames, {Q.rq('psnr')} AS psnr FROM b JOIN p ON b.plane IS NOT DISTINCT FROM p.plane AND b.step IS NOT DISTINCT FROM p.step AND b.discard IS NOT DISTINCT FROM p.discard""")
def _sample_sweep(spark, sf):
    """Bit planes 7 to 3, three discards and three channels (frames by turns)."""
    f = frames(spark, sf).withColumn("plane", F.expr("case frame % 3 when 0 then 'y' when 1 then 'u' else 'v' end"))
    return coder.sample_rd_sweep(f, ["frame", "plane"], "plane", [float(1 << p) for p in range(7, 2, -1)], [0, 4, 5], 1)


# ---- the other directions and matrices of small operators

RGB = views("rgb") + ", w AS (SELECT frame, y, x, max(CASE plane WHEN 'r' THEN v END) AS r, max(CASE plane WHEN 'g' THEN v END) AS g, max(CASE plane WHEN 'b' THEN v END) AS b FROM rgb GROUP BY ALL)"
BACK = RGB + """, t AS (SELECT frame, y, x, 0.212 * r + 0.701 * g + 0.087 * b AS cy, -0.116 * r - 0.384 * g + 0.5 * b AS cu, 0.5 * r - 0.445 * g - 0.055 * b AS cv FROM w)"""


@register("PRJ1_color_convert_240m", BACK + "".join(f"{' UNION ALL' if k else ''} SELECT frame, '{p}' AS plane, y, x, {Q.rq('c' + p)} AS v FROM t" for k, p in enumerate("yuv")))
def _color_240m(spark, sf):
    return grid.color_convert(fixture(spark, sf, "rgb"), "240m")


@register("PRJ1_color_back", BACK + f" SELECT frame, 'r' AS plane, y, x, {Q.rq('(cy - 0.0007 * cu + 1.5758 * cv)', 8)} AS v FROM t UNION ALL SELECT frame, 'g', y, x, {Q.rq('(cy - 0.2264 * cu - 0.4765 * cv)', 8)} FROM t UNION ALL SELECT frame, 'b', y, x, {Q.rq('(cy + 1.826 * cu - 0.0004 * cv)', 8)} FROM t", 8)
def _color_back(spark, sf):
    return grid.color_convert(grid.color_convert(fixture(spark, sf, "rgb"), "240m"), "240m", "rgb")


@register("SRC3_fixed_point_back", views("frames16") + " SELECT frame, y, x, CAST(round((v / 7) * 16) AS SMALLINT) / 16.0 AS v FROM frames16")
def _fixed_back(spark, sf):
    return grid.fixed_point(grid.fixed_point(frames(spark, sf).withColumn("v", F.col("v") / 7), "v"), "v", inverse=True)


@register("AGG2_roi_psnr_legacy", views("frames16") + f""", e AS (SELECT a.frame, sum((a.v - b.v) ** 2) / 128 AS mse FROM frames16 a JOIN frames16 b ON b.frame = a.frame + 1 AND a.y = b.y AND a.x = b.x WHERE a.y BETWEEN 2 AND 9 AND a.x BETWEEN 4 AND 11 GROUP BY 1)
 SELECT frame, {Q.rq('mse')} AS mse, CASE WHEN mse > 0 THEN {Q.rq('(10 * log10(65025 / mse))')} END AS psnr FROM e""")
def _roi_legacy(spark, sf):
    f = frames(spark, sf)
    return quality.roi_psnr(f, f.withColumn("frame", F.col("frame") - 1), ["frame"], 4, 2, 8, 8, legacy_divisor=True)
