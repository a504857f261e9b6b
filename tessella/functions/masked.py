"""Masked statistics as aggregate columns, for use in agg() or over a window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

EPS = 1e-8


def only(x: Column, mask: Column) -> Column:
    """x where the mask is on and 0 elsewhere, so NaN outside the mask can't leak into sums."""
    return F.when(mask, x).otherwise(F.lit(0.0))


def _over(c: Column, w: WindowSpec | None) -> Column:
    return c if w is None else c.over(w)


def masked_sum(x: Column, mask: Column, w: WindowSpec | None = None) -> Column:
    return _over(F.sum(only(x, mask)), w)


def masked_count(mask: Column, w: WindowSpec | None = None) -> Column:
    return _over(F.sum(F.when(mask, 1.0).otherwise(0.0)), w)


def masked_mean(x: Column, mask: Column, w: WindowSpec | None = None) -> Column:
    return masked_sum(x, mask, w) / (masked_count(mask, w) + EPS)


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token divergence estimate. A trailing + only changes gradients, so the value is the same."""
    d = logp - ref
    match kind.rstrip("+"):
        case "kl" | "k1":
            return d
        case "abs":
            return F.abs(d)
        case "mse" | "k2":
            return 0.5 * d * d
        case "low_var_kl" | "k3":
            r = clamp(-d, -20.0, 20.0)
            return clamp(F.exp(r) - r - 1, -10.0, 10.0)
    raise ValueError(f"unknown estimator {kind}")
