import random

import numpy as np

from rippleframe.llm import lines

LETTERS = "abcdefghijklmnop é"


def edited(rng: random.Random, text: str) -> str:
    out = list(text)
    for _ in range(rng.randrange(14)):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(LETTERS)
        elif kind == 1:
            out.insert(at, rng.choice(LETTERS))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def test_letters_on_both_sides_are_a_bound():
    rng, close, refuted = random.Random(5), 0, 0
    for _ in range(120):
        first = "".join(rng.choice(LETTERS) for _ in range(rng.choice([15, 40, 100, 130, 300])))
        rows = [first, "", *(edited(rng, first) for _ in range(12))]
        data, offsets = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0] + [len(r.encode()) for r in rows])
        base, sketches = lines.letter_sketches(*lines._code_points(data, offsets), len(rows), None)
        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                most = min(min(len(a), len(b)) // lines.PER_EDIT, lines.MOST_EDITS)
                apart = np.unpackbits((sketches[i] ^ sketches[j]).view(np.uint8)).reshape(lines.PARTS - 1, -1).sum(1).max()
                near, ruled_out = lines.within(a, b, most), base[i] == base[j] and apart > 2 * most
                assert not (near and ruled_out), (a, b)
                close, refuted = close + near, refuted + ruled_out
    assert close > 1000 and refuted > 1000


def test_letter_sketches_of_nothing():
    base, sketches = lines.letter_sketches(np.zeros(0, np.uint32), np.zeros(0, np.int64), 0, None)
    assert base.shape == (0,) and sketches.shape == (0, 2 * (lines.PARTS - 1) * lines.SKETCH)
