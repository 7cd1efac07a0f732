import numpy as np
import pandas as pd

from tessella.operators import similar as V


def test_parities_differ_in_no_more_bits_than_sets_in_elements(spark):
    rng = np.random.default_rng(3)
    marks = V._marks(24, 4).func
    for size, other in ((150, 10), (150, 120), (3, 1), (2000, 900), (1, 1)):
        a = rng.integers(-(1 << 63), (1 << 63) - 1, size)
        b = np.concatenate([a[: size - other // 2], rng.integers(-(1 << 63), (1 << 63) - 1, other - other // 2)])
        x, y = marks(pd.Series([a, b]))
        assert len(x) == V.PARITY + 24
        turned = sum(bin(int(p) & (1 << 64) - 1).count("1") for p in x[: V.PARITY] ^ y[: V.PARITY])
        assert turned <= len(set(a) ^ set(b)) and (turned - len(set(a) ^ set(b))) % 2 == 0
