"""Operator 1: what copies, classes and chance do to disclosing terms."""

import random

from rippleframe.llm import pii
from tests.llm.test_operators import PRIVATE, frame, sample


def spans_of(spark, rows):
    return {r.doc_id: r.spans for r in pii.private_spans(frame(spark, rows)).collect()}


def test_copies_of_a_row_hide_no_term(spark):
    rows = sample(spark, 60) + PRIVATE + [(30, "Zorblax stands here alone")]
    one = spans_of(spark, rows)
    assert "term" in one[30] and "term" in one[5]
    assert spans_of(spark, rows + [(30, "Zorblax stands here alone")] * 40) == one
    assert spans_of(spark, rows + PRIVATE * 5) == one


def test_words_that_give_a_class_away(spark):
    rng = random.Random(4)
    filler = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    rows = [(k, f"{rng.choice(filler)} {rng.choice(filler)} corpmailbox user{k}@corp.example {rng.choice(filler)} {rng.choice(filler)}") for k in range(60)]
    rows += [(100 + k, " ".join(rng.choice(filler) for _ in range(12)) + f" person{k}@free{k % 40}.example") for k in range(60)]
    rows += [(1000 + k, " ".join(rng.choice(filler) for _ in range(25))) for k in range(600)]
    docs = {i: t for i, t in rows}
    found = spans_of(spark, rows)
    words = {docs[i][int(a) : int(b)] for i, s in found.items() for kind, a, b in (x.split(":") for x in s.split(",") if x) if kind == "term"}
    assert words == {"corpmailbox"}
    assert all("term" in found[k] for k in range(60)) and not any("term" in found[k] for k in found if k >= 100)


def test_words_near_entities_by_chance_stay(spark):
    rng = random.Random(11)
    filler = [f"rare{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(600)]
    rows = [(k, " ".join(rng.choice(filler) for _ in range(8)) + (f" name{k}@big.example" if k % 3 == 0 else "")) for k in range(900)]
    assert not any("term" in s for s in spans_of(spark, rows).values())
