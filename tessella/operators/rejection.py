"""Importance weights and rejection masks between the policy that sampled and the one that trains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.masked import EPS, clamp, masked_mean, only

BOUND = 20.0


def parse_threshold(spec: str | float, k1: bool = False) -> tuple[float | None, float]:
    """"0.1_1.2" is (0.1, 1.2); a single number u is (1/u, u) for k1 and (None, u) otherwise."""
    parts = [float(p) for p in str(spec).split("_")]
    if any(p <= 0 for p in parts) or len(parts) > 2:
        raise ValueError(f"bad threshold {spec!r}")
    if len(parts) == 2:
        if parts[0] > parts[1]:
            raise ValueError(f"lower above upper in {spec!r}")
        return parts[0], parts[1]
    return (1 / parts[0] if k1 else None), parts[0]


def divergence(ratio: Column, kind: str) -> Column:
    """Of a log-ratio, clipped to +-20: k1 = -lr, k2 = lr^2/2, k3 = e^lr - 1 - lr."""
    lr = clamp(ratio, -BOUND, BOUND)
    return {"k1": -lr, "k2": 0.5 * lr * lr, "k3": F.exp(lr) - 1 - lr}[kind]


def rejection_mask(tokens: DataFrame, seq: list[str], log_ratio: Column, mask: Column, options: dict[str, str | float]) -> DataFrame:
    """Add `kept`: valid tokens that pass every option. Options are token_k1.., seq_sum_k1.., seq_mean_k1.., seq_max_k2..

    Bounds are inclusive. k1 has bounds on both sides, as logarithms of the ratio's; the others an upper bound.
    """
    w = Window.partitionBy(*seq)
    kept = mask
    for name, spec in options.items():
        scope, kind = name.rsplit("_", 1)
        low, high = parse_threshold(spec, kind == "k1")
        d = divergence(log_ratio, kind)
        if scope == "token":
            stat = d
        elif scope == "seq_sum":
            stat = F.sum(only(d, mask)).over(w)
        elif scope == "seq_mean":
            stat = masked_mean(d, mask, w)
        elif scope == "seq_max":
            stat = F.max(F.when(mask, d)).over(w)
        else:
            raise ValueError(f"unknown option {name}")
        ok = ((stat >= math.log(low)) & (stat <= math.log(high))) if kind == "k1" else ((stat <= high) if low is None else ((stat >= low) & (stat <= high)))
        kept = kept & F.coalesce(ok, F.lit(False))
    return tokens.withColumn("kept", kept)


def is_weights(tokens: DataFrame, seq: list[str], log_ratio: Column, mask: Column, level: str = "token", threshold: float = 2.0, normalize: bool = False) -> DataFrame:
    """Truncated importance weights per token or per sequence, 0 outside the mask, optionally scaled to mean 1."""
    if level == "token":
        raw = F.exp(clamp(log_ratio, -BOUND, BOUND))
    else:
        raw = F.exp(clamp(F.sum(only(log_ratio, mask)).over(Window.partitionBy(*seq)), -BOUND, BOUND))
    df = tokens.withColumn("is_weight", F.when(mask, F.least(raw, F.lit(threshold))).otherwise(0.0))
    if normalize:
        mean = df.agg(F.try_divide(F.sum("is_weight"), F.sum(F.when(mask, 1.0).otherwise(0.0))).alias("_m"))
        df = df.crossJoin(F.broadcast(mean)).withColumn("is_weight", F.col("is_weight") / F.greatest(F.col("_m"), F.lit(EPS))).drop("_m")
    return df


def weight_metrics(df: DataFrame, weight: str, mask: Column, threshold: float = 2.0) -> DataFrame:
    """Mean, extremes, shares beyond the bounds, std and effective sample size of the weights."""
    c = clamp(F.col(weight), 1 / threshold, threshold)
    own = lambda x: F.when(mask, x)
    first = df.agg(
        F.avg(own(F.col(weight))).alias("mean"), F.max(own(F.col(weight))).alias("max"), F.min(own(F.col(weight))).alias("min"),
        F.avg(own((F.col(weight) > threshold).cast("double"))).alias("fraction_high"), F.avg(own((F.col(weight) < 1 / threshold).cast("double"))).alias("fraction_low"),
        F.stddev_pop(own(c)).alias("std"), F.avg(own(c)).alias("_cm"), F.avg(own(c * c)).alias("_c2"),
    )
    return first.withColumn("ess", F.try_divide((F.col("_cm") + EPS) * (F.col("_cm") + EPS), F.col("_c2"))).drop("_cm", "_c2")


def off_policy_metrics(tokens: DataFrame, seq: list[str], logp: Column, rollout: Column, mask: Column) -> DataFrame:
    """Perplexities, divergences and chi-squared distances, first per sequence and then over the batch."""
    d = logp - rollout
    per = tokens.groupBy(*seq).agg(
        F.sum(F.when(mask, 1.0).otherwise(0.0)).alias("m"), masked_mean(logp, mask).alias("lp"), masked_mean(rollout, mask).alias("rlp"), F.sum(only(-d, mask)).alias("kl"),
        F.sum(only(F.exp(d) - d - 1, mask)).alias("k3"), F.sum(only(F.exp(2 * clamp(d, -BOUND, BOUND)), mask)).alias("c2"), F.sum(only(d, mask)).alias("sd"),
    )
    return per.agg(
        F.avg(F.exp(-F.col("lp"))).alias("training_ppl"), F.avg(F.exp(-F.col("rlp"))).alias("rollout_ppl"), F.avg(-F.col("lp") + F.col("rlp")).alias("log_ppl_diff"),
        F.avg(F.exp(F.col("rlp") - F.col("lp"))).alias("ppl_ratio"), (F.sum("kl") / (F.sum("m") + EPS)).alias("kl"), (F.sum("k3") / (F.sum("m") + EPS)).alias("k3_kl"),
        (F.sum("c2") / (F.sum("m") + EPS) - 1).alias("chi2_token"), (F.avg(F.exp(2 * clamp(F.col("sd"), -BOUND, BOUND))) - 1).alias("chi2_seq"),
    )


def correct_rollouts(tokens: DataFrame, seq: list[str], log_ratio: Column, mask: Column, options: dict[str, str | float] | None = None, weights: str | None = None, threshold: float = 2.0, normalize: bool = False) -> DataFrame:
    """Add `kept` (the mask, less what the options reject) and, for weights `token` or `sequence`, `is_weight`."""
    out = rejection_mask(tokens, seq, log_ratio, mask, options or {})
    return out if weights is None else is_weights(out, seq, log_ratio, mask, weights, threshold, normalize)
