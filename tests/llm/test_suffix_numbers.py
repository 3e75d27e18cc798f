"""Operator 5: numbers made from numbers at later offsets tell byte strings apart, whatever the run they are made in."""

import numpy as np
import pytest

from rippleframe.llm import suffixes


@pytest.mark.parametrize(("length", "q"), [(50, 20), (50, 30), (20, 20), (37, 5)])
def test_numbers_are_equal_where_bytes_are(monkeypatch, length, q):
    rng = np.random.default_rng(length + q)
    unit = rng.integers(97, 99, 90).astype(np.uint8)
    data = np.concatenate([unit, rng.integers(97, 99, 200).astype(np.uint8), unit[5:], np.full(150, 97, np.uint8), unit])
    starts = np.repeat(np.arange(len(data) - 2 * length), 4)
    sizes = np.tile([q, length, max(q, length - 3), length + q], len(starts) // 4)
    for hashed in (1 << 18, 64):
        monkeypatch.setattr(suffixes, "HASHED", hashed)
        got = suffixes.numbers(data, starts, starts + sizes, length, q)
        seen, back = {}, {}
        for s, n, number in zip(starts.tolist(), sizes.tolist(), got.tolist(), strict=True):
            body = data[s : s + n].tobytes()
            assert seen.setdefault(body, number) == number and back.setdefault(number, body) == body
    assert len(seen) < len(starts)


def test_levels_double_up_to_the_full_depth():
    data = np.arange(256, dtype=np.uint8)
    assert list(suffixes.Numbers(data, 50, 20).levels) == [20, 40, 50]
    assert list(suffixes.Numbers(data[:30], 50, 20).levels) == [20, 40, 50] and len(suffixes.Numbers(data[:30], 50, 20).levels[50]) == 0
