"""Fold assignment by a SplitMix64 Fisher-Yates shuffle of row positions, for small data on one machine.

Trees grown by ``plans.grow`` draw their folds from a hash instead, which scales and does not depend on row order.
"""

from __future__ import annotations

_MASK = (1 << 64) - 1
# Fixed values of the published SplitMix64 generator: increment, two multipliers.
_GAMMA = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class SplitMix64:
    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = (self.state + _GAMMA) & _MASK
        z = self.state
        z = ((z ^ (z >> 30)) * _MIX[0]) & _MASK
        z = ((z ^ (z >> 27)) * _MIX[1]) & _MASK
        return z ^ (z >> 31)

    def below(self, bound: int) -> int:
        return self.next() % bound


def shuffled_folds(ids: list[int], k: int, seed: int, shuffle: bool = True, most: int | None = None) -> dict[int, int]:
    """Fold of each id. ``most`` caps the number of folds."""
    n = len(ids)
    if not n:
        return {}
    k = min(max(k, 2), n, most or n)
    order = list(ids)
    if shuffle:
        rng = SplitMix64(seed ^ (n * _GAMMA & _MASK))
        for i in range(n - 1, 0, -1):
            j = rng.below(i + 1)
            order[i], order[j] = order[j], order[i]
    size, longer = divmod(n, k)
    ends = [size * (f + 1) + min(f + 1, longer) for f in range(k)]
    out, f = {}, 0
    for place, row in enumerate(order):
        while place >= ends[f]:
            f += 1
        out[row] = f
    return out
