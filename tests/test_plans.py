"""Operators whose plans were made for size: same values as the plain forms, and the plans themselves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rippleframe.functions.adaptive import capped_step
from rippleframe.operators import coder, entropy, filters, lifting, motion
from rippleframe.plans import registry
from rippleframe.plans.fixtures import fixture

SF = "/root/testdata/sf0.001"


def image(spark, height, width, frames=2, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(f, y, x, float(rng.randint(0, 255))) for f in range(frames) for y in range(height) for x in range(width)], "frame int, y int, x int, v double")


def near(a, b, keys, c, limit=1e-9):
    """Both tables have the same keys, and values within limit."""
    both = a.withColumnRenamed(c, "_a").join(b.withColumnRenamed(c, "_b"), keys, "full")
    worst, n = both.agg(F.max(F.coalesce(F.abs(F.col("_a") - F.col("_b")), F.lit(1e9))), F.count("*")).first()
    return n > 0 and worst < limit


def windows(df):
    return len(re.findall(r"\bWindow \[", df._jdf.queryExecution().optimizedPlan().toString()))


def test_pyramid_equals_one_level_after_another(spark):
    f = image(spark, 32, 16)
    rest, parts = f, []
    for level in (1, 2, 3):
        bands = lifting.wavelet2d(rest, ["frame"]).withColumn("level", F.lit(level))
        parts.append(bands if level == 3 else bands.filter("band <> 'LL'"))
        rest = bands.filter("band = 'LL'").select("frame", "y", "x", F.col("c").alias("v"))
    expected = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert near(lifting.pyramid(f, ["frame"], 3), expected, ["frame", "level", "band", "y", "x"], "c")


def test_pyramid_restores_and_grows_by_levels(spark):
    f = image(spark, 32, 32)
    assert near(lifting.unpyramid(lifting.pyramid(f, ["frame"], 4), ["frame"], 4), f, ["frame", "y", "x"], "v")
    counts = [windows(lifting.pyramid(f, ["frame"], n)) for n in (1, 2, 3, 4)]
    steps = {b - a for a, b in zip(counts, counts[1:], strict=False)}
    assert steps == {counts[0]} and counts[0] <= 10
    plan = lifting.pyramid(f, ["frame"], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("n", [4, 6, 10, 400, 402])
@pytest.mark.parametrize("block", [3, 4, 50])
def test_blocks_of_a_series_equal_the_whole(spark, n, block):
    rng = random.Random(n)
    df = spark.createDataFrame([(s, t, rng.uniform(-9, 9)) for s in "ab" for t in range(n)], "sid string, t int, v double")
    whole = lifting.lift97(df, ["sid"], "t", "v")
    cut = lifting.lift97(df, ["sid"], "t", "v", block)
    assert near(whole, cut, ["sid", "n"], "l") and near(whole.drop("l"), cut.drop("l"), ["sid", "n"], "h")
    assert near(lifting.unlift97(whole, ["sid"], "t", "v", block), df, ["sid", "t"], "v")


def test_no_window_holds_a_whole_series(spark):
    df = spark.range(20000).select(F.lit(0).alias("sid"), F.col("id").cast("int").alias("t"), F.rand(1).alias("v"))
    rows = lifting._blocked(df, F.expr("t div 2"), 256).groupBy("_block").count()
    assert rows.agg(F.max("count")).first()[0] <= 2 * 256 + 12


def test_phase_vectors_equal_sums_over_taps(spark):
    f = image(spark, 9, 12)
    phases = {0: {0: 1.0}} | {p: {o - 3: w for o, w in enumerate(taps)} for p, taps in filters.PHASES.items()}
    wide = filters.scatter(f, ["frame"], "x", phases, 12, edge="clamp", sets="_px")
    wide = filters.scatter(wide, ["frame", "_px"], "y", phases, 9, edge="clamp", sets="_py")
    expected = wide.select("frame", (4 * F.col("_py") + F.col("_px")).cast("int").alias("phase"), "y", "x", "v")
    assert near(filters.subpel_phases(f, ["frame"]), expected, ["frame", "phase", "y", "x"], "v")
    assert filters.subpel_vectors(f, ["frame"]).count() == 2 * 9 * 12


def test_phases_of_lines_shorter_than_the_filter(spark):
    f = image(spark, 2, 3, 1)
    got = filters.subpel_phases(f, ["frame"]).filter("phase = 2")
    values = {(r.y, r.x): r.v for r in f.collect()}
    for r in got.collect():
        assert r.v == pytest.approx(sum(w * values[r.y, min(max(r.x + o - 3, 0), 2)] for o, w in enumerate(filters.PHASES[2])))


def plain_match(cur, ref, size, reach, lam, height, width):
    bits = lambda d: 1 + 2 * ((2 * abs(d) + 1).bit_length() - 1)
    out = {}
    for by in range(height // size):
        for bx in range(width // size):
            options = []
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    if 0 <= by * size + dy <= height - size and 0 <= bx * size + dx <= width - size:
                        sad = sum(abs(cur[by * size + i, bx * size + j] - ref[by * size + dy + i, bx * size + dx + j]) for i in range(size) for j in range(size))
                        options.append((sad + lam * (bits(dy) + bits(dx)), abs(dy) + abs(dx), dy, dx))
            out[by, bx] = min(options)
    return out


@pytest.mark.parametrize(("size", "lam"), [(4, 0.0), (4, 40.0), (5, 3.0)])
def test_block_search_finds_the_best(spark, size, lam):
    ref = image(spark, 22, 17, 1, 5)
    moved = ref.select("frame", (F.col("y") - 2).alias("y"), (F.col("x") + 1).alias("x"), (F.col("v") + F.col("x") % 3).alias("v")).filter("y >= 0 and x < 17")
    cur = ref.join(moved.withColumnRenamed("v", "m"), ["frame", "y", "x"], "left").select("frame", "y", "x", F.coalesce("m", "v").alias("v"))
    a, b = ({(r.y, r.x): r.v for r in t.collect()} for t in (cur, ref))
    got = {(r.by, r.bx): (r.cost, abs(r.dy) + abs(r.dx), r.dy, r.dx) for r in motion.block_match(cur, ref, ["frame"], size, 3, lam).collect()}
    assert got == plain_match(a, b, size, 3, lam, 22, 17)


def test_most_offsets_fall_before_samples_are_compared(spark):
    rng = random.Random(2)
    smooth = {(y, x): 40 * ((y * 3 + x * 5) // 16 % 6) + rng.randint(0, 3) for y in range(32) for x in range(32)}
    ref = spark.createDataFrame([(0, y, x, float(v)) for (y, x), v in smooth.items()], "frame int, y int, x int, v double")
    cur = spark.createDataFrame([(0, y, x, float(smooth[min(y + 1, 31), max(x - 2, 0)])) for y, x in smooth], "frame int, y int, x int, v double")
    candidates = motion.block_candidates(cur, ref, ["frame"], 8, 4, 1.0)
    left = motion.surviving_candidates(candidates, cur, ref, ["frame"], 8)
    assert left.count() < 0.15 * candidates.count()


def test_counts_in_blocks_equal_one_window(spark):
    s = fixture(spark, SF, "symbols")
    whole = entropy.adaptive_cost(s, 5, block=1 << 40).select("stream", "seq", "bits")
    assert near(entropy.adaptive_cost(s, 5, block=7).select("stream", "seq", "bits"), whole, ["stream", "seq"], "bits")


def test_capped_counts_go_on_over_batches(spark):
    rng = random.Random(9)
    rows = [(0 if k % 2 else k % 5, k, 0 if k % 2 else k % 3, rng.choice([0, 0, 0, 1, 2])) for k in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.seq: r.bits for r in entropy.adaptive_cost_capped(spark.createDataFrame(rows, "stream int, seq long, ctx int, sym int"), 3, {0: 32, 1: 9}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = {}
    for stream, seq, ctx, sym in rows:
        own = counts.setdefault((stream, ctx), [1, 1, 1])
        assert got[seq] == pytest.approx(capped_step(own, sym, {0: 32, 1: 9}.get(ctx, float("inf"))))


def test_sweep_of_samples_over_two_levels(spark):
    f = registry.frames(spark, SF).filter("frame < 4").withColumn("plane", F.expr("case when frame < 2 then 'y' else 'u' end"))
    rows = {(r.plane, r.step, r.discard): r for r in coder.sample_rd_sweep(f, ["frame", "plane"], "plane", [4.0, 64.0], [0, 13], 2).collect()}
    assert len(rows) == 3 * 3 * 3 and rows[None, None, None].frames == 4 * 4
    assert rows["y", 4.0, 0].bits > rows["y", 64.0, 0].bits and rows["y", 4.0, 0].psnr > rows["y", 64.0, 0].psnr > 0
    assert rows["u", 4.0, 13].bits == 0
    assert rows[None, 4.0, 0].bits == pytest.approx(rows["y", 4.0, 0].bits + rows["u", 4.0, 0].bits)
    quantised = lifting.pyramid(f, ["frame", "plane"], 2).withColumn("c", F.when(F.abs("c") < 4, 0.0).otherwise(F.signum("c") * (F.floor(F.abs(F.round("c", 9)) / 4) + 0.5) * 4))
    back = lifting.unpyramid(quantised, ["frame", "plane"], 2).select("frame", "y", "x", F.least(F.greatest(F.round("v"), F.lit(0.0)), F.lit(255.0)).alias("r"))
    each = f.join(back, ["frame", "y", "x"]).groupBy("plane", "frame").agg((10 * F.log10(65025 / F.avg((F.col("v") - F.col("r")) ** 2))).alias("p")).groupBy("plane").agg(F.avg("p").alias("p"))
    assert {r.plane: pytest.approx(r.p) for r in each.collect()} == {p: rows[p, 4.0, 0].psnr for p in "yu"}
