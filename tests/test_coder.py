"""The bit-plane coder's events and bits against plain loops."""

import math
from collections import Counter

from rippleframe.operators import coder, entropy

SIZE = 12


def smooth(n=SIZE):
    """A band whose large coefficients lie together."""
    return {(y, x): round((24 / (1 + abs(y - 4) + abs(x - 5)) - 2) * (-1 if x > 6 else 1)) for y in range(n) for x in range(n)}


def plain_events(q, planes, parents, band):
    out = []
    for b in range(planes - 1, -1, -1):
        for (y, x), value in q.items():
            seen = lambda dy, dx, up: int(abs(q.get((y + dy, x + dx), 0)) >> (b + up) > 0)  # noqa: B023, E731
            sign = lambda dy, dx: seen(dy, dx, 1) * (1 if q.get((y + dy, x + dx), 0) > 0 else -1)  # noqa: B023, E731
            h, v, d = seen(0, -1, 1) + seen(0, 1, 1), seen(-1, 0, 1) + seen(1, 0, 1), sum(seen(i, j, 1) for i in (-1, 1) for j in (-1, 1))
            if band == "HL":
                h, v = v, h
            here, above = abs(value) >> b, abs(value) >> (b + 1)
            if above:
                if band == "HH":
                    klass = 0 if h + v == 0 else 1 if not h or not v else 3 if h == v == 2 else 2
                else:
                    klass = 0 if h + v == 0 else 1 if not h else 2 if not v else 4 if h == v == 2 else 3
                out.append((b, "refinement", klass, here % 2))
                continue
            parent = abs(parents.get((y // 2, x // 2), 0)) >> b > 0
            if not parent:
                klass = (4 if band == "HH" else 5) + (0 if h + v == 0 else (d >= 3) if h + v == 1 else 1 if h + v == 2 else 2)
            elif h + v == 0:
                klass = 0 if d == 1 else 1
            elif band == "HH":
                klass = 1 + (d >= 3) if h + v == 1 else 1 + (d >= 2) if h == v == 1 else 2 if h + v == 2 else 3
            else:
                klass = 1 + h if h + v == 1 else 3 if h + v == 2 else 4
            out.append((b, "significance", int(klass), int(here > 0)))
            if here:
                clip = lambda a, c: int(1 in (a, c)) - int(-1 in (a, c))
                hb, vb = clip(sign(0, -1), sign(0, 1)), clip(sign(-1, 0), sign(1, 0))
                fall, rise = clip(sign(-1, -1), sign(1, 1)), clip(sign(-1, 1), sign(1, -1))
                if band == "HL":
                    hb, vb = vb, hb
                klass = 3 + hb * vb if vb else 1 if hb else 5 if fall or rise else 0
                if vb or hb:
                    flip = vb > 0 if vb else (hb > 0 if band == "HH" else hb < 0)
                else:
                    flip = fall < 0 if fall else (rise < 0 if band == "HH" else rise > 0) if rise else False
                out.append((b, "sign", klass, int(flip == (value < 0))))
    return out


def table(spark, q, band):
    return spark.createDataFrame([("f", band, y, x, v, v * 16.0 + 3) for (y, x), v in q.items()], "frame string, band string, y int, x int, q int, c double")


def test_events_equal_plain_loops(spark):
    q, parents = smooth(), smooth(SIZE // 2)
    for band in ("HL", "LH", "HH"):
        got = coder.plane_events(table(spark, q, band), ["frame", "band"], 5, table(spark, parents, band).select("frame", "band", "y", "x", "q"))
        assert Counter((r.plane, r.kind, r["class"], r.sym) for r in got.collect()) == Counter(plain_events(q, 5, parents, band))


def test_contexts_save_bits(spark):
    k = table(spark, smooth(), "LH")
    events = coder.plane_events(k, ["frame", "band"], 5)
    total = lambda df: sum(r.bits for r in df.collect())
    spent, blind = total(coder.coder_bits(events, ["band"], [])), total(entropy.conditional_entropy(events, ["band", "plane", "kind"], []))
    index = sum(r.n * r.entropy for r in entropy.symbol_entropy(k.withColumnRenamed("q", "sym"), ["band"]).collect())
    assert spent < 0.8 * blind and spent < index


def test_curve_adds_up_and_falls(spark):
    rows = sorted(coder.coded_rd_curve(table(spark, smooth(), "LH"), ["frame", "band"], ["band"], 5, 16.0).collect(), key=lambda r: -r.plane)
    assert [r.plane for r in rows] == [4, 3, 2, 1, 0]
    assert math.isclose(rows[-1].total, sum(r.bits for r in rows)) and all(math.isclose(r.bits, r.significance + r.sign + r.refinement) for r in rows)
    assert all(a.mse > b.mse for a, b in zip(rows, rows[1:], strict=False)) and all(r.gain > 0 for r in rows)


def test_all_zero_band_costs_nothing(spark):
    rows = coder.coded_rd_curve(table(spark, dict.fromkeys(smooth(), 0), "HH"), ["frame", "band"], ["band"], 3, 16.0).collect()
    assert {r.bits for r in rows} == {0.0} and {r.slope for r in rows} == {None}
