"""Moment-based statistics as aggregate Column expressions.

Spark's ``skewness`` / ``kurtosis`` are the population (biased) g1 / g2;
the tabular model reports the bias-adjusted G1 / G2, 0 for a constant
column and NULL below 3 / 4 observations.  Every ratio goes through
``try_divide`` so ANSI mode never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adj_skew(x: Column) -> Column:
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    adj = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.var_pop(x) == 0, F.lit(0.0))
            .otherwise(g1 * adj))


def adj_kurt(x: Column) -> Column:
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    fac = F.try_divide(n - 1, (n - 2) * (n - 3))
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.var_pop(x) == 0, F.lit(0.0))
            .otherwise(fac * ((n + 1) * g2 + 6)))


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson r (rows where both are non-null); NULL
    for fewer than two pairs or a zero variance."""
    return F.try_divide(F.regr_sxy(b, a), F.sqrt(F.regr_sxx(b, a) * F.regr_syy(b, a)))
