"""Budgets, ledgers and mixtures against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rippleframe.functions import scalars as S
from rippleframe.operators import entropy, rate

MOTION = "clip string, gop long, level int, set_k int, part string, sub_bit int, bytes long"
CLIPS = "clip string, start int, last int, framerate double, bitrate int"


def plain_prune(rows, clip, t_level):
    """Drops sub-symbols one at a time for the whole clip and counts anew each time."""
    budget = clip[4] * 1000 / 8 * (clip[2] - clip[1] + 1) / clip[3]
    exist = {}
    for r in rows:
        if r[4] == "sub":
            exist[r[2]] = max(exist.get(r[2], 0), r[5] + 1)

    def stays(r):
        left = exist.get(r[2], 0)
        return r[2] >= t_level and (r[4] == "major" or r[4] == "sign" and left > 0 or r[4] == "sub" and r[5] < left)

    used = lambda: sum(r[6] for r in rows if stays(r))
    for level in sorted(exist):
        while level >= t_level and exist[level] > 0 and used() / budget > 0.55:
            exist[level] -= 1
    return [r for r in rows if stays(r)]


@pytest.mark.parametrize("t_level", [0, 1])
def test_budget_is_that_of_the_clip(spark, t_level):
    rng, rows, clips = random.Random(5), [], []
    for n, share in enumerate((0.1, 0.4, 0.56, 0.8, 1.5, 9.0)):
        own = []
        for gop in range(4):
            scale = (1, 50, 400, 7)[gop]  # GOPs of very different size share one budget
            for level in range(3):
                own.append((f"c{n}", gop, level, 0, "major", None, rng.randint(1, 9) * scale))
                if level != 2 or n % 2:
                    own.append((f"c{n}", gop, level, 0, "sign", None, rng.randint(1, 9) * scale))
                    own += [(f"c{n}", gop, level, 0, "sub", b, rng.randint(1, 9) * scale) for b in range(3)]
        total = sum(r[6] for r in own)
        clips.append((f"c{n}", 0, 31, 30.0, max(1, round(total / share * 8 / 1000 / 32 * 30))))
        rows += own
    got = Counter(map(tuple, rate.motion_budget_prune(spark.createDataFrame(rows, MOTION), spark.createDataFrame(clips, CLIPS), t_level).select("clip", "gop", "level", "set_k", "part", "sub_bit", "bytes").collect()))
    expected = Counter(r for clip in clips for r in plain_prune([r for r in rows if r[0] == clip[0]], clip, t_level))
    assert got == expected and 0 < len(got) < len(rows)


def test_clips_without_a_budget_or_steps_stay_whole(spark):
    rows = [("a", 0, 0, 0, "major", None, 5), ("a", 0, 0, 0, "sub", 0, 500), ("b", 0, 0, 0, "major", None, 10**9), ("d", 0, 1, 0, "sign", None, 3), ("d", 0, 1, 0, "major", None, 3)]
    out = rate.motion_budget_prune(spark.createDataFrame(rows, MOTION), spark.createDataFrame([("b", 0, 7, 25.0, 1)], CLIPS))
    assert sorted((r.clip, r.part) for r in out.collect()) == [("a", "major"), ("a", "sub"), ("b", "major"), ("d", "major")]
    assert rate.motion_budget_prune(spark.createDataFrame([], MOTION), spark.createDataFrame([], CLIPS)).count() == 0


def test_normal_tail_equals_erfc(spark):
    zs = [k / 37 for k in range(0, 1400)]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", S.normal_tail(F.col("z")).alias("q"), S.normal_cdf(-F.col("z")).alias("p"), S.normal_mass(F.col("z"), F.col("z") + 1).alias("m")).collect():
        exact = math.erfc(r.z / 2**0.5) / 2
        assert r.q == pytest.approx(exact, abs=1e-15, rel=1e-11) and r.p == r.q
        assert r.m == pytest.approx(exact - math.erfc((r.z + 1) / 2**0.5) / 2, abs=2e-15, rel=1e-11)


def test_mixture_bits_equal_a_plain_loop(spark):
    params = {"a": [(0.3, 0.0, 2.0), (1.2, 5.0, 0.0)], "b": [(0.0, -1.0, -3.0)]}
    rows = [(k, x) for k in params for x in (-40, -3, 0, 1, 5, 5, 60)]
    table = spark.createDataFrame([(k, i, *p) for k, ps in params.items() for i, p in enumerate(ps)], "k string, i int, logit double, mu double, sigma double")
    got = {r.k: (r.n, r.bits) for r in entropy.mixture_bits(spark.createDataFrame(rows, "k string, x int"), table, ["k"]).collect()}
    cdf = lambda z: math.erfc(-z / 2**0.5) / 2
    for k, ps in params.items():
        top = sum(math.exp(p[0]) for p in ps)
        bits = 0
        for _, x in (r for r in rows if r[0] == k):
            mass = sum(math.exp(w) / top * (cdf((x + 0.5 - mu) / max(abs(sd), 1e-6)) - cdf((x - 0.5 - mu) / max(abs(sd), 1e-6))) for w, mu, sd in ps)
            bits -= math.log2(max(mass, 1e-9))
        assert got[k] == (7, pytest.approx(bits, rel=1e-9))


def test_golomb_levels_just_under_powers_of_two(spark):
    words = [0, 1, 2, 3, (1 << 49) - 1, (1 << 53) - 3, (1 << 62) - 2]
    rows = spark.createDataFrame([(w,) for w in words], "w long").select("w", entropy.code_bits(F.col("w"), "golomb").alias("bits")).collect()
    assert [r.bits for r in rows] == [1 + 2 * ((w + 1).bit_length() - 1) for w in words]
