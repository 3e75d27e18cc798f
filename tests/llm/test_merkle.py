"""Operator 13 against plain recursion."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rippleframe.llm import merkle
from rippleframe.llm import queries as registered
from tests.compare import differences
from tests.llm.test_operators import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    i, text, lang, source, n = row
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(nodes, fanout):
    """(root, the siblings left and right of each node's way up)."""
    ways, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + fanout, len(nodes))) for a in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for leaf in groups[k]:
                    ways[leaf].append(("".join(nodes[x] for x in run if x < k), "".join(nodes[x] for x in run if x > k)))
        groups = [[leaf for k in run for leaf in groups[k]] for run in runs]
        nodes = [digest(*[nodes[k] for k in run]) for run in runs]
    return nodes[0], ways


def brute(rows, fanout=3):
    trees = {}
    for row in rows:
        trees.setdefault(None if row[3] is None else row[3].encode(), []).append((row[0] is not None, row[0] or 0, brute_leaf(row), row))
    names = sorted(trees, key=lambda s: (s is not None, s or b""))
    below = [tree([leaf for _, _, leaf, _ in sorted(trees[s], key=lambda x: x[:3])], fanout) for s in names]
    root, above = tree([r for r, _ in below], fanout)
    out = Counter()
    for s, (subroot, ways), top in zip(names, below, above, strict=True):
        for (_, _, leaf, (i, text, *more)), way in zip(sorted(trees[s], key=lambda x: x[:3]), ways, strict=True):
            even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
            h = brute_leaf((i, text.replace("\n", "") if even and text is not None else text, *more))
            for left, right in way + top:
                h = digest(left, h, right)
            out[(i, leaf, subroot, root, digest(*[x + y for x, y in way + top]), h, h == root)] += 1
    return out


def made(n, sources, seed=1):
    rng = random.Random(seed)
    return [(rng.randint(-5, 3 * n), rng.choice(["line\nline", "plain", "", None, "é\n🙂"]) , rng.choice(["en", None]), rng.choice(sources), rng.choice([1, None])) for _ in range(n)]


CASES = {
    "one row": [(1, "a\nb", "en", "s", 3)],
    "one tree": made(40, ["s"]),
    "hot tree": made(300, ["hot"] * 6 + ["é", "", None, "b", "aa", "z\U0001f642", "￮"]),
    "lone leaves": [(k, "x\n", None, f"s{k}", k) for k in range(29)],
    "repeats": [(7, "same\n", "en", "s", 1)] * 50 + [(None, None, None, None, None)] * 4 + [(7, "other", "en", "s", 1)] * 3,
    "long": [(1, "long line\n" * 200_000, "en", "s", 1), (2, "y" * 500_000, "en", "s", 1)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_equals_brute_force(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_tree", F.lit("x")).withColumn("leaf", F.lit(1)).withColumn("path", F.lit(2)).repartition(4)
    for levels in (1, 2) if name != "long" else (7,):
        got = merkle.manifest(df, changed=merkle.without_line_feeds(), block_levels=levels)
        assert Counter(map(tuple, got.collect())) == brute(rows)


def test_other_fanout_and_proofs(spark):
    rows = made(150, ["a", "a", "a", "b", "c"])
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=2, block_levels=2, with_proof=True)
    assert Counter(tuple(r)[:5] for r in out.collect()) == Counter({k[:5]: n for k, n in brute(rows, 2).items()})
    again = out.withColumn("h", F.aggregate("proof", F.col("leaf"), lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256)))
    assert out.count() == 150 == again.filter("h = root and verified").count()


def test_empty_table(spark):
    out = merkle.manifest(spark.createDataFrame([], SCHEMA), changed=merkle.without_line_feeds())
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_query_equals_sql(spark):
    assert not differences(registered.QUERIES["op13_merkle_manifest"](spark, SF), registered.ORACLE_SQL["op13_merkle_manifest"], SF)[:3]
