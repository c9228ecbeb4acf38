"""Resampling weights: how often each row is drawn in each replicate.

Default: independent Poisson(1) counts from a hash of the row key, so a row keeps its weights
under any partitioning and every hypothesis sees the same resamples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The splitmix64 mixing constants.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

POISSON_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(19)])


def row_hash(key: Column, seed: int) -> Column:
    """60 bits of md5("key:seed") as BIGINT; one digest per row whatever the number of replicates."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


#: Weight by the first STEP_BITS bits of a draw, AMBIGUOUS where these leave two or more open.
STEP_BITS, AMBIGUOUS = 12, -1


def _steps() -> np.ndarray:
    edge = np.arange((1 << STEP_BITS) + 1) * 2.0**-STEP_BITS
    low, high = (np.searchsorted(POISSON_CDF, e, side=side) for e, side in ((edge[:-1], "right"), (edge[1:], "left")))
    return np.where(low == high, low, AMBIGUOUS).astype(np.int32)


_STEPS = _steps()
#: Draws mixed at once, so that they stay in the processor's cache.
AT_ONCE = 1 << 15


def poisson_weights(base: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Weights (rows x replicates) from row hashes and replicate numbers."""
    base = base.astype(np.uint64)
    with np.errstate(over="ignore"):
        turns = (reps.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
    out = np.empty((len(base), len(turns)), np.int32)
    step = max(1, AT_ONCE // max(1, len(turns)))
    for at in range(0, len(base), step):
        z = base[at:at + step, None] + turns[None, :]
        y = z >> np.uint64(30)
        z ^= y
        z *= np.uint64(MIX_1)
        np.right_shift(z, np.uint64(27), out=y)
        z ^= y
        z *= np.uint64(MIX_2)
        np.right_shift(z, np.uint64(31), out=y)
        z ^= y
        np.right_shift(z, np.uint64(64 - STEP_BITS), out=y)
        w = np.take(_STEPS, y.view(np.int64))
        open_ = w == AMBIGUOUS
        u = (z[open_] >> np.uint64(11)).astype(float) * 2.0**-53
        w[open_] = np.searchsorted(POISSON_CDF, u, side="right")
        out[at:at + step] = w
    return out


@dataclass(frozen=True)
class Weights:
    """`kind` is 'ones' (the plain sample), 'poisson', or 'index'.

    'index' draws row positions 0..rows-1 with a seeded numpy generator, n out of n. It needs the
    row order of a file and the whole draw in memory, so it only serves to repeat recorded runs on
    small tables; the key column must then be the row position.
    """

    kind: str = "ones"
    reps: int = 1
    seed: int = 42
    rows: int = 0
    _draws: dict = field(default_factory=dict, compare=False, repr=False)

    MAX_INDEX_ROWS = 100_000

    def count(self) -> int:
        """Replicates that `matrix` has columns for."""
        return 1 if self.kind == "ones" else self.reps

    def base(self, key: Column) -> Column:
        return key.cast("bigint") if self.kind == "index" else row_hash(key, self.seed)

    def matrix(self, base: np.ndarray) -> np.ndarray:
        if self.kind == "ones":
            return np.ones((len(base), 1), dtype=np.int32)
        if self.kind == "poisson":
            return poisson_weights(np.asarray(base), np.arange(self.reps))
        return self._counts()[np.asarray(base, dtype=np.int64)]

    def _counts(self) -> np.ndarray:
        if "m" not in self._draws:
            if self.rows > self.MAX_INDEX_ROWS:
                raise ValueError("index draws are for small tables; use Poisson weights")
            rng = np.random.default_rng(self.seed)
            m = np.zeros((self.rows, self.reps), dtype=np.int32)
            for r in range(self.reps):
                m[:, r] = np.bincount(rng.integers(0, self.rows, size=self.rows), minlength=self.rows)
            self._draws["m"] = m
        return self._draws["m"]
