import math

import pytest
from pyspark.sql import functions as F

from rippleframe.functions import scalars as S
from rippleframe.functions.adaptive import capped_step
from rippleframe.operators import entropy, filters, lifting, motion, quality, rate, sampling, temporal
from rippleframe.plans import registry
from rippleframe.plans.fixtures import fixture
from rippleframe.sources import logs

SF = "/root/testdata/sf0.001"


def test_constant_series_has_no_detail(spark):
    df = spark.createDataFrame([(0, t, 10.0) for t in range(8)], "sid int, t int, v double")
    for row in lifting.lift97(df, ["sid"], "t", "v").collect():
        assert math.isclose(row.l, 10 * 2**0.5, rel_tol=1e-4) and abs(row.h) < 1e-6


def test_reflection_uses_the_second_half_sample(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(values)], "sid int, t int, v double")
    low, high = values[0::2], values[1::2]
    a, b, c, d = lifting.STEPS
    for k, step in enumerate((a, b, c, d)):
        if k % 2 == 0:
            high = [h + step * (low[i] + (low[i + 1] if i < 2 else low[1])) for i, h in enumerate(high)]
        else:
            low = [x + step * (high[i] + (high[i - 1] if i else high[1])) for i, x in enumerate(low)]
    got = sorted(lifting.lift97(df, ["sid"], "t", "v").collect(), key=lambda r: r.n)
    assert [r.l for r in got] == pytest.approx([x * lifting.LOW_GAIN for x in low])
    assert [r.h for r in got] == pytest.approx([x * lifting.HIGH_GAIN for x in high])


def test_quantiser_truncates(spark):
    row = spark.range(1).select(S.quantize(F.lit(-31.9), 16).alias("a"), S.quantize(F.lit(31.9), 16).alias("b"), S.dequantize(F.lit(0.0), 16.0).alias("z"), S.dequantize(F.lit(-2.0), 16.0).alias("m")).first()
    assert (row.a, row.b, row.z, row.m) == (-1, 1, 0, -40)


def test_psnr_of_equal_frames_is_null(spark):
    f = registry.frames(spark, SF).filter("frame < 2")
    assert {r.psnr for r in quality.frame_psnr(f, f, ["frame"]).collect()} == {None}


def test_symbol_counts_add_up(spark):
    s = fixture(spark, SF, "symbols")
    assert entropy.symbol_entropy(s, ["ctx"]).agg(F.sum("n")).first()[0] == s.count()


@pytest.mark.parametrize("bank", [0, 1, 2, 5, 7])  # the half-band filters 3 and 4 have no high half to restore from
def test_fir_bank_restores_nearly(spark, bank):
    f = registry.frames(spark, SF).filter("frame < 3")
    back = filters.fir_synthesis(filters.fir_analysis(f, ["frame"], 16, 16, bank), ["frame"], 16, 16, bank)
    worst = f.join(back.withColumnRenamed("v", "b"), ["frame", "y", "x"]).agg(F.max(F.abs(F.col("v") - F.col("b")))).first()[0]
    assert worst < 3.0  # nine rounded taps: nearly, not exactly, perfect reconstruction


def test_temporal_round_trip_with_odd_length(spark):
    df = spark.createDataFrame([(0, 0, t, float((t * 7) % 5)) for t in range(11)], "y int, x int, frame int, v double")
    back = temporal.t_unpyramid(temporal.t_pyramid(df, ["y", "x"], 2), ["y", "x"], 2).orderBy("frame").collect()
    assert [r.v for r in back] == pytest.approx([float((t * 7) % 5) for t in range(11)])


def test_at_most_four_candidates(spark):
    b = fixture(spark, SF, "blocks")
    sizes = motion.median_predictor(b, ["frame"], 8, 8, 16, 16).select(F.size("candidates").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 4


def test_budget_holds_or_all_steps_are_gone(spark):
    clips = fixture(spark, SF, "clips").withColumn("budget", F.expr("bitrate * 1000 / 8 * (last - start + 1) / framerate"))
    kept = rate.motion_budget_prune(fixture(spark, SF, "mv_clips"), clips)
    for r in kept.join(clips, "clip").groupBy("clip", "budget").agg(F.sum("bytes").alias("s"), F.sum(F.expr("cast(part <> 'major' as int)")).alias("n")).collect():
        assert r.s <= 0.55 * r.budget or r.n == 0


def test_capped_cost_is_the_plain_loop(spark):
    got = {(r.stream, r.seq): r.bits for r in entropy.adaptive_cost_capped(fixture(spark, SF, "symbols"), 5, 32).collect()}
    counts = {}
    for r in fixture(spark, SF, "symbols").orderBy("stream", "seq").collect():
        bits = capped_step(counts.setdefault((r.stream, r.ctx), [1] * 5), r.sym, 32)
        assert got[(r.stream, r.seq)] == pytest.approx(bits)


def test_stream_equals_batch(spark):
    a = {(r.stream, r.seq): r.bits for r in registry.QUERIES["STR2_stream_adaptive_cost"](spark, SF).collect()}
    b = {(r.stream, r.seq): r.bits for r in registry.QUERIES["WIN18_adaptive_cost_capped"](spark, SF).collect()}
    assert a == b


def test_closed_windows_equal_batch_sums(spark):
    closed = registry.QUERIES["STR3_stream_gop_bytes"](spark, SF).collect()
    sizes = fixture(spark, SF, "mv_bytes").select(F.timestamp_seconds(F.col("gop") * 8 + F.col("set_k")).alias("ts"), "bytes")
    batch = {r.start: (r.bytes, r.n) for r in sizes.groupBy(F.window("ts", "8 seconds").alias("w")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).select("w.start", "bytes", "n").collect()}
    assert closed and all(batch[r.start] == (r.bytes, r.n) for r in closed)


def test_batches_are_full_and_seeded(spark):
    clips = spark.range(103).withColumnRenamed("id", "k")
    one = {r.k: r.place for r in sampling.batches(clips, "k", 10, 1).collect()}
    assert sorted(one.values()) == list(range(103))
    assert one != {r.k: r.place for r in sampling.batches(clips, "k", 10, 2).collect()}


def test_crop_is_the_same_for_equal_keys(spark):
    f = registry.frames(spark, SF).filter("frame < 4")
    a = sampling.random_crop(f, ["frame"], 8, 3, 16, 16)
    b = sampling.random_crop(f.withColumn("v", -F.col("v")), ["frame"], 8, 3, 16, 16).withColumnRenamed("v", "w")
    both = a.join(b, ["frame", "y", "x"])
    assert both.count() == 4 * 64 and both.filter("v <> -w").count() == 0


def test_mixture_bits_of_a_sure_symbol(spark):
    x = spark.createDataFrame([("a", 0)] * 5, "g string, x int")
    params = spark.createDataFrame([("a", 0, 0.0, 0.0, 1e-9)], "g string, k int, logit double, mu double, sigma double")
    assert entropy.mixture_bits(x, params, ["g"]).first().bits == pytest.approx(0.0)


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    sizes = [5, 4000, 1, 900]
    values, at = [], 0
    for k, n in enumerate(sizes):
        (tmp_path / f"log-{k}.txt").write_text("".join(f"{at + i}\n" for i in range(n)))
        values += range(at, at + n)
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = logs.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.n, int(r.value)) for r in got) == [(v, v) for v in values]


@pytest.mark.parametrize("number", sorted(filters.BANKS))
def test_taps_of_banks(number):
    low, high = (filters.bank_taps(number, half) for half in (0, 1))
    assert sum(low.values()) == pytest.approx(2**0.5 if number == 7 else 1, abs=1e-4)  # constants pass the low half
    assert sum(high.values()) == pytest.approx(0, abs=1e-4)
    if number == 4:
        with pytest.raises(ValueError):
            filters.synthesis_taps(4, 0)


def test_bank_from_a_file(spark, tmp_path):
    side = [1 / 2] + [(-1) ** k / (k + 3) for k in range(16)]
    taps = side[:0:-1] + side
    (tmp_path / "taps.txt").write_text("\n".join(map(repr, taps)))
    (tmp_path / "short.txt").write_text("1.0\n")
    bank = filters.read_bank(spark, str(tmp_path / "taps.txt"))
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]  # shorter than the filter: images of images
    rows = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate(values)], "frame int, y int, x int, v double")
    got = {r.x: r.v for r in filters.scatter(rows, ["frame"], "x", filters.bank_taps(bank, 0), 8).collect()}
    around = values + values[-2:0:-1]
    for x in range(8):
        assert got[x] == pytest.approx(sum(w * around[(x + o) % 14] for o, w in zip(range(-16, 17), taps, strict=True)))
    with pytest.raises(ValueError):
        filters.read_bank(spark, str(tmp_path / "short.txt"))


def test_temporal_plan_grows_by_level_only(spark):
    rows = spark.createDataFrame([("a", t, float(t * t % 7)) for t in range(16)], "clip string, frame int, v double")
    for levels in (1, 2, 3):
        plan = temporal.t_unpyramid(temporal.t_pyramid(rows, ["clip"], levels), ["clip"], levels)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_caps_by_context_and_priors(spark):
    rows = [(0, k, k % 2, (k * k) % 3) for k in range(40)]
    df = spark.createDataFrame(rows, "stream int, seq int, ctx int, sym int")
    got = {r.seq: r.bits for r in entropy.adaptive_cost_capped(df, 3, {0: 8, 1: 16}, (3, 2, 1)).collect()}
    counts = {0: [3, 2, 1], 1: [3, 2, 1]}
    for _, seq, ctx, sym in rows:
        assert got[seq] == pytest.approx(math.log2(sum(counts[ctx]) / counts[ctx][sym]))
        counts[ctx][sym] += 1
        if sum(counts[ctx]) >= (8, 16)[ctx]:
            counts[ctx] = [(c + 1) // 2 for c in counts[ctx]]
