"""Vector scalar functions as Columns, and the two that Catalyst lacks as pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: y at which the suspicion -log10(erfc(y / sqrt 2) / 2) reaches 8; suspicion grows with y.
PHI_8 = 5.612001244174788


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclid(a, b) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def quantile_exclusive(values, p: float) -> Column:
    """Exclusive quantile at ``(n + 1) p`` of an array, by interpolation, clamped to the ends."""
    s, n = F.array_sort(_c(values)), F.size(_c(values))
    h = (n + 1) * F.lit(p)
    j = F.least(F.greatest(F.floor(h), F.lit(1)), n - 1).cast("int")
    lo, hi = F.element_at(s, j), F.element_at(s, F.least(j + 1, n))
    return F.when(n == 1, F.element_at(s, 1)).otherwise(lo + (h - j) * (hi - lo))


@F.pandas_udf(DoubleType())
def phi(y: pd.Series) -> pd.Series:
    """Suspicion of a deviation of ``y`` standard deviations, at most 100."""

    def one(v: float) -> float:
        if v is None or np.isnan(v):
            return float("nan")
        p = 0.5 * math.erfc(v / math.sqrt(2))
        return 100.0 if p < 1e-100 else -math.log10(p)

    return y.map(one)
