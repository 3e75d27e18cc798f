"""Operator 12 against a plain version, its sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rippleframe.llm import queries as registered
from rippleframe.llm import resampling
from tests.compare import differences
from tests.llm.test_operators import HARD, SF, empty, frame, key, sample


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, target, longest=1, buckets=10_000, seed=2024, percent=10, least=20):
    def runs(text):
        words = brute_words(text)
        return [zlib.crc32(" ".join(words[i : i + r]).encode()) % buckets for r in range(1, longest + 1) for i in range(len(words) - r + 1)]

    own, wanted = [runs(t) for _, t in rows], Counter(b for t in target for b in runs(t))
    counts = Counter(b for found in own for b in found)
    n, m = sum(counts.values()), sum(wanted.values())
    out = []
    for (i, t), found in zip(rows, own, strict=True):
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (n + buckets) / ((counts[b] + 1) * (m + buckets)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_words(t)) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        ranks.setdefault((r[0], r[3]), []).append(place)
    return [tuple(r[:4]) for r in out], ranks


@pytest.mark.parametrize("settings", [{}, {"longest": 2, "buckets": 97, "seed": 5, "percent": 40, "min_words": 3}])
def test_equals_brute_force(spark, settings):
    rows = sample(spark) + HARD + [(i, f"tie {i % 3} " * 30) for i in range(200, 260)] + [(7000, "same row " * 15)] * 9
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(frame(spark, rows), goal, **settings).collect()
    plain = {k: v for k, v in settings.items() if k != "min_words"} | ({"least": settings["min_words"]} if settings else {})
    expected, ranks = brute(rows, target, **plain)
    assert Counter((key(r.doc_id), *r[1:4]) for r in got) == Counter((key(e[0]), *e[1:]) for e in expected)
    drawn = {}
    for r in got:
        if r["rank"] is not None:
            drawn.setdefault((r.doc_id, r.score), []).append(r["rank"])
    assert {k: sorted(v) for k, v in drawn.items()} == ranks and ranks


def test_radix_sort_equals_sorted(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, -5, 7, 1 << 40, -(1 << 63), (1 << 63) - 1]), rng.randint(-300, 300), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, payload long").repartition(5)
    out, n = resampling.radix_sorted(df, ["a", "b"], digit_bits=9, part_rows=200)
    got = [(r.a, r.b) for r in sorted(out.collect(), key=lambda r: r._at)]
    assert n == 3000 and got == sorted((a, b) for a, b, _ in rows)
    assert sorted(r._at for r in out.select("_at").collect()) == list(range(3000))


def test_rows_equal_in_all_keys_have_places_of_their_own(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)], "a long, payload long").coalesce(1)
    out = resampling.radix_sorted(df, ["a"], part_rows=50)[0].collect()
    assert sorted(r.payload for r in out) == sorted(r._at for r in out) == list(range(500))


def test_empty_tables(spark):
    goal = spark.createDataFrame([], "text string")
    assert resampling.resampled(empty(spark), goal).count() == 0
    one = resampling.resampled(frame(spark, [(1, "word " * 25)]), goal, percent=100).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in one] == [(1, 25, 1)]


def test_query_equals_sql(spark):
    assert not differences(registered.QUERIES["op12_target_resampling"](spark, SF), registered.ORACLE_SQL["op12_target_resampling"], SF)[:3]
    out = registered.QUERIES["op12_target_resampling"](spark, SF)
    fit = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").filter(F.col("n_features") >= 20).count()
    assert out.filter("rank is not null").count() == 10 * fit // 100
