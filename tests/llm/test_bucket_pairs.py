import random
from pathlib import Path

from rippleframe.llm import lines, tables


def test_pairs_of_small_buckets_are_those_that_traits_allow(spark):
    rng = random.Random(4)
    traits = {k: (rng.randrange(10, 130), *(rng.getrandbits(64) - (1 << 63) for _ in range(lines.SKETCH))) for k in range(40)}
    for k in range(20):  # near copies: a few bits apart
        size, *sketch = traits[k + 20]
        for _ in range(rng.randrange(30)):
            at = rng.randrange(lines.SKETCH)
            sketch[at] ^= 1 << rng.randrange(63) if rng.random() < 0.7 else -(1 << 63)  # the last: the sign
        traits[k] = (size + rng.randrange(3), *sketch)
    members = [(key, i) for key in range(-30, 30) for i in rng.sample(range(40), rng.randrange(1, 12))]
    rows = spark.createDataFrame([(key, i, traits[i]) for key, i in members], f"key bigint, id bigint, traits struct<size: bigint, {', '.join(f's{k}: bigint' for k in range(lines.SKETCH))}>")
    expected = set()
    for key in range(-30, 30):
        own = sorted(i for k, i in members if k == key)
        for x, a in enumerate(own):
            for b in own[x + 1 :]:
                most = min(min(traits[a][0], traits[b][0]) // lines.PER_EDIT, lines.MOST_EDITS)
                apart = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(traits[a][1:], traits[b][1:], strict=True))
                if abs(traits[a][0] - traits[b][0]) <= most and apart <= 4 * most:
                    expected.add((a, b))
    assert len(expected) > 5
    got = [(r.a, r.b) for r in lines.pairs_of_buckets(rows, None, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert lines.pairs_of_buckets(rows.limit(0), None, 1).count() == 0


def test_only_lines_of_pairs_are_read_for_a_check(spark):
    texts = spark.createDataFrame([(k, b"x" * k) for k in range(50)], "id bigint, body binary")
    pairs = tables.stored(spark.createDataFrame([(3, 9), (3, 40), (9, 9)], "a bigint, b bigint"))
    for most in (tables.BROADCAST_IDS, 0):
        assert sorted(r.id for r in lines.paired_lines(texts, pairs, most).collect()) == [3, 9, 40]


def test_tables_on_the_way_are_deleted(spark):
    scratch = Path(tables.scratch(spark))
    scratch.mkdir(parents=True, exist_ok=True)
    texts = tables.stored(spark.createDataFrame([(k, f"a line of a family, number {k // 2} of many {'!' * (k % 2)}".encode()) for k in range(40)], "id bigint, body binary"))
    before = set(scratch.iterdir())
    groups = tables.alone(lambda: lines.line_classes(texts, None))
    assert groups.count() > 30
    assert [Path(groups._stored_at).name] == [p.name for p in set(scratch.iterdir()) - before]
