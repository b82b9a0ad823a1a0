"""Columns for statistics: bucketed latency, normal tails, effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits of the latency buckets in milliseconds; the last bucket is open.
LATENCY_LIMITS = [10, 25, 50, 100, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000, 10000]


def latency_bucket(ms: Column) -> Column:
    """Number of the latency bucket, from 0; the open one is the last."""
    chain = reduce(lambda c, x: c.when(ms <= x[1], x[0]), list(enumerate(LATENCY_LIMITS))[1:], F.when(ms <= LATENCY_LIMITS[0], 0))
    return F.when(ms.isNotNull(), chain.otherwise(len(LATENCY_LIMITS)))


def bucket_limit(bucket: Column) -> Column:
    """Upper limit of a bucket; the open one reports that of the last closed one."""
    return F.get(F.array(*(F.lit(x) for x in [*LATENCY_LIMITS, LATENCY_LIMITS[-1]])), bucket)


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by Abramowitz and Stegun's formula 7.1.26."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def welch_p(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """Two-sided p of equal means by the normal approximation; null below five values on a side."""
    se = F.sqrt(var_a / n_a + var_b / n_b)
    same = F.when(mean_a == mean_b, 1.0).otherwise(0.0)
    return F.when((n_a < 5) | (n_b < 5), F.lit(None).cast("double")).when(se == 0, same).otherwise(normal_two_sided((mean_a - mean_b) / F.nullif(se, F.lit(0.0))))


def ratio_effect(test_before: Column, test_after: Column, control_before: Column, control_after: Column) -> Column:
    """Growth of the test over growth of the control, less one; null where a base is 0."""
    return F.try_divide(F.try_divide(test_after, test_before), F.try_divide(control_after, control_before)) - 1


def relative_change(before: Column, after: Column) -> Column:
    """(after - before) / before; from 0 it is 1, or 0 when both are 0."""
    return F.when(before == 0, F.when(after == 0, 0.0).otherwise(1.0)).otherwise((after - before) / F.nullif(before, F.lit(0)))


def priority(impact: Column, confidence: Column, affected: Column, weight: Column, effort: Column, risk: Column) -> Column:
    """Impact by reach over effort and risk, to one decimal."""
    reach = F.least(F.log10(F.greatest(affected, F.lit(1))) + 1, F.lit(5.0))
    return F.floor(impact * confidence * reach * weight / F.greatest(effort * risk, F.lit(1)) * 10 + 0.5) / 10
