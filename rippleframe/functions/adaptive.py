"""The adaptive model that batch and stream share."""

from __future__ import annotations

from math import log2


def capped_step(counts: list[int], sym: int, cap: float) -> float:
    """Bits of one symbol; the counts move on, and halve, rounding up, when their sum reaches the cap."""
    bits = log2(sum(counts) / counts[sym])
    counts[sym] += 1
    if sum(counts) >= cap:
        counts[:] = [(c + 1) // 2 for c in counts]
    return bits
