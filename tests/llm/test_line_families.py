import random
from collections import Counter

import numpy as np

from rippleframe.llm import lines

COLUMNS = ["size", *(f"s{k}" for k in range(lines.SKETCH))]


def groups_of(links: list[tuple[int, int]], ids: list[int]) -> list[list[int]]:
    up = {i: i for i in ids}

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    out: dict[int, list[int]] = {}
    for i in ids:
        out.setdefault(top(i), []).append(i)
    return sorted(out.values())


def family(rng: random.Random, many: int) -> list[str]:
    """Lines with some words changed: most pairs are beyond the threshold, though their sketches are close."""
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 6))) for _ in range(40)]
    out = [" ".join(words)]
    for _ in range(many):
        own = list(words)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(len(own))] = "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 6)))
        out.append(" ".join(own))
    return list(dict.fromkeys(out))


def test_a_bucket_gives_no_more_rows_than_members(spark):
    rng = random.Random(8)
    for many, wide in ((300, True), (60, False)):
        rows = []
        for i in range(many):
            sketch = [7, -5, 9, 1 << 62]
            for _ in range(rng.randrange(60)):
                sketch[rng.randrange(lines.SKETCH)] ^= 1 << rng.randrange(63) if rng.random() < 0.8 else -(1 << 63)
            rows += [(key, i, 100 + rng.randrange(5), *sketch) for key in (-3, 4)]
        near = lambda a, b: abs(a[2] - b[2]) <= 8 and sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(a[3:], b[3:], strict=True)) <= 32
        own = [r for r in rows if r[0] == 4]
        close = [(a[1], b[1]) for k, a in enumerate(own) for b in own[:k] if near(a, b)]
        assert len(close) > 2 * many and (many > lines.WIDE) == wide
        got = [tuple(r) for r in lines.families(spark.createDataFrame(rows, "key bigint, id bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS)), None, 1).collect()]
        assert groups_of(got, list(range(many))) == groups_of(close, list(range(many))) and 5 < len(groups_of(got, list(range(many)))) < many
        assert len(got) < many


def test_a_family_gives_no_more_rows_than_lines_and_loses_no_link(spark):
    rng = random.Random(3)
    every = family(rng, 150)
    ids = [rng.getrandbits(64) - (1 << 63) for _ in every]
    codes = [[ord(c) for c in x] for x in every]
    linked = [(ids[i], ids[j]) for i in range(len(every)) for j in range(i) if lines.within(codes[i], codes[j], min(len(codes[i]), len(codes[j])) // lines.PER_EDIT if min(len(codes[i]), len(codes[j])) < 96 else lines.MOST_EDITS)]
    assert len(linked) > len(every)
    expected = groups_of(linked, sorted(ids))
    assert 1 < len(expected) < len(every)
    labels = spark.createDataFrame([(i, -7) for i in ids], "id bigint, label bigint")
    bodies = spark.createDataFrame([(i, x.encode()) for i, x in zip(ids, every, strict=True)], "id bigint, body binary")
    for crowd in (lines.CROWD, 40, 2):
        cut = lines.tiles(labels, crowd)
        got = [tuple(r) for r in lines.verified(cut.join(bodies, "id"), None, 1).collect()]
        assert groups_of(got, sorted(ids)) == expected and len(got) < len(every)


def test_any_two_lines_of_a_family_meet_once(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(i, 5) for i in range(90, 95)], "id bigint, label bigint")
    met: Counter[tuple[int, int]] = Counter()
    tiles: dict[int, list[tuple[int, int]]] = {}
    for r in lines.tiles(labels, 10).collect():
        tiles.setdefault(r.tile, []).append((r.id, r.side))
    for own in tiles.values():
        met.update((min(a, b), max(a, b)) for k, (a, s) in enumerate(own) for b, t in own[:k] if s != t or s < 0)
    family_of = {r.id: r.label for r in labels.collect()}
    assert met == Counter((a, b) for a in family_of for b in family_of if a < b and family_of[a] == family_of[b])


def test_numbers_far_apart_and_large_buckets(spark):
    same = "x" * 60
    every = [f"{same}{k:05d}{'yz'[k % 2] * 40}" for k in range(60)]
    numbers = [k * 40_000 + (k // 30 << 33) for k in range(60)]
    texts = spark.createDataFrame([(n, x.encode()) for n, x in zip(numbers, every, strict=True)], "no bigint, body binary").coalesce(1)
    data, offsets = np.frombuffer("".join(every).encode(), np.uint8), np.arange(61) * 105
    line, keys, indexed = lines.segment_keys(data, offsets, None)
    own: dict[int, set[int]] = {}
    for i, key in zip(line.tolist(), (keys & ~np.uint64(1)).tolist(), strict=True):
        own.setdefault(key, set()).add(numbers[i])
    anchors = set((keys & ~np.uint64(1))[indexed].tolist())
    expected = {(a, b) for key, x in own.items() if key in anchors for a in x for b in x if a < b}
    assert len(expected) > 1000
    for crowd in (1000, 20, 0):
        buckets: dict[int, set[int]] = {}
        for r in lines.bucket_members(texts, None, 3, 0, 1, crowd).collect():
            buckets.setdefault(r.key, set()).add(r.no)
        assert {(a, b) for x in buckets.values() for a in x for b in x if a < b} == expected
        assert max(map(len, buckets.values())) <= max(crowd, 2)
