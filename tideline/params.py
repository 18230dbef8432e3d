"""Parameters of the scoring kernel."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class ScorerParams:
    """Sketch sizes, decay and smoothing of the scorer.

    ``hashes`` are (a, b) of the linear hash of each sketch row, odd a by default so that all buckets are used;
    ``record_hashes`` and ``planes`` those of the record sketch. All are drawn from ``seed`` unless given.
    ``time_mode`` is the T of the scoring function: the observed step number, or the raw clock.
    """

    rows: int = 2
    buckets: int = 64
    alpha: float = 0.8
    beta: float = 1.0
    min_count: float = 0.0
    normaliser: str = "streaming"
    compat: bool = False
    time_mode: str = "step"
    seed: int = 0
    hashes: tuple[tuple[int, int], ...] | None = None
    total_hashes: tuple[tuple[int, int], ...] | None = None
    planes: tuple[tuple[tuple[float, ...], ...], ...] | None = field(default=None)

    def __post_init__(self):
        if self.rows < 1:
            raise ValueError("rows must be at least 1")
        if self.buckets < 2:
            raise ValueError("buckets must be at least 2")
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must lie between 0 and 1")
        if self.beta < 0:
            raise ValueError("beta must not be negative")
        if self.normaliser not in ("streaming", "apriori"):
            raise ValueError("normaliser is 'streaming' or 'apriori'")
        if self.time_mode not in ("step", "raw"):
            raise ValueError("time_mode is 'step' or 'raw'")

    @property
    def bits(self) -> int:
        """Sign bits of the record sketch."""
        return max(1, int(np.ceil(np.log2(self.buckets))))

    def linear(self) -> tuple[tuple[int, int], ...]:
        if self.hashes is not None:
            return self.hashes
        rng = np.random.default_rng(self.seed)
        return tuple((int(rng.integers(0, self.buckets // 2)) * 2 + 1, int(rng.integers(0, self.buckets))) for _ in range(self.rows))

    def plane(self, row: int, bit: int, dimension: int) -> tuple[float, ...]:
        if self.planes is not None:
            return self.planes[row][bit]
        rng = np.random.default_rng((self.seed, row, bit))
        return tuple(round(float(x), 6) for x in rng.standard_normal(dimension))
