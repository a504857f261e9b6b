"""Group-relative statistics of sampled responses.

Sequence level: one row per response with its group (prompt uid) and score. Token level: one row per response with
arrays in token order, or long form (uid, seq, pos, ...). Every estimator is a transform DataFrame -> DataFrame in the
registry ADVANTAGES; a statistic that must reach the rows is a window, otherwise an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.masked import EPS, clamp, only
from tessella.operators.batch import first_rows, running_total
from tessella.session import cut_lineage

ADVANTAGES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f):
        if ADVANTAGES.get(name, f) is not f:
            raise ValueError(f"{name} is registered already")
        ADVANTAGES[name] = f
        return f

    return add


def advantage(name: str) -> Callable[..., DataFrame]:
    if name not in ADVANTAGES:
        raise ValueError(f"unknown estimator {name}; there are {sorted(ADVANTAGES)}")
    return ADVANTAGES[name]


def _stats(group: str, score: str):
    w = Window.partitionBy(group)
    return F.count(score).over(w), F.avg(score).over(w), F.stddev_samp(score).over(w)


@register("grpo")
def grpo(df: DataFrame, group: str = "uid", score: str = "score", scaled: bool = True, eps: float = 1e-6) -> DataFrame:
    """(s - mean) / (sample std + eps), or s - mean; a singleton has mean 0 and std 1."""
    n, mean, std = _stats(group, score)
    centred = F.col(score) - F.when(n > 1, mean).otherwise(0.0)
    return df.withColumn("advantage", centred / (F.when(n > 1, std).otherwise(1.0) + eps) if scaled else centred)


@register("dr_grpo")
def dr_grpo(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    return grpo(df, group, score, scaled=False)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, group: str = "uid", score: str = "score", eps: float = 1e-6) -> DataFrame:
    """The variance, not the std, has a floor."""
    n, mean, std = _stats(group, score)
    root = F.sqrt(F.greatest(std * std, F.lit(eps)))
    return df.withColumn("advantage", (F.col(score) - F.when(n > 1, mean).otherwise(0.0)) / (F.when(n > 1, root).otherwise(1.0) + eps))


@register("grpo_passk")
def grpo_passk(df: DataFrame, group: str = "uid", score: str = "score", tie: str = "seq", eps: float = 1e-6) -> DataFrame:
    """Only the best row gets (best - second) / (std + eps). A group of one is an error; ties go to the least `tie`."""
    w = Window.partitionBy(group)
    best = w.orderBy(F.desc(score), tie)
    n, _, std = _stats(group, score)
    gain = (F.col(score) - F.lead(score).over(best)) / (std + eps)
    alone = F.raise_error(F.lit("a group needs two responses")).cast("double")
    return df.withColumn("_r", F.row_number().over(best)).withColumn("advantage", F.when(n < 2, alone).when(F.col("_r") == 1, gain).otherwise(0.0)).drop("_r")


@register("rloo")
def rloo(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """s n/(n-1) - mean n/(n-1); a singleton keeps s."""
    n, mean, _ = _stats(group, score)
    return df.withColumn("advantage", F.when(n > 1, (F.col(score) - mean) * n / F.greatest(n - 1, F.lit(1))).otherwise(F.col(score)))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """(n s - sum) / max(n-1, 1); a singleton has 0."""
    w = Window.partitionBy(group)
    n = F.count(score).over(w)
    return df.withColumn("advantage", (n * F.col(score) - F.sum(score).over(w)) / F.greatest(n - 1, F.lit(1)))


@register("opo")
def opo(df: DataFrame, group: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """Baseline weighted by length; a singleton's baseline is 0."""
    w = Window.partitionBy(group)
    base = F.try_divide(F.sum(F.col(length) * F.col(score)).over(w), F.sum(length).over(w).cast("double"))
    return df.withColumn("advantage", F.col(score) - F.when(F.count(score).over(w) > 1, base).otherwise(0.0))


@register("gpg")
def gpg(df: DataFrame, group: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """N / max(number of nonzero scores, 1) * (s - mean) / f_norm; the factor comes from one broadcast row."""
    n, mean, _ = _stats(group, score)
    total = df.agg((F.count(F.lit(1)) / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("_alpha"))
    return df.withColumn("_c", F.col(score) - F.when(n > 1, mean).otherwise(0.0)).crossJoin(F.broadcast(total)).withColumn("advantage", F.col("_alpha") * F.col("_c") / f_norm).drop("_alpha", "_c")


def whiten(df: DataFrame, x: str, mask: Column, out: str, shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(variance + eps) with masked moments of the whole table, from one broadcast row of partial sums."""
    d = only(F.col(x), mask)
    on = F.when(mask, 1.0).otherwise(0.0)
    sums = df.agg(F.sum(on).alias("_n"), (F.sum(d) / (F.sum(on) + EPS)).alias("_mean"))
    second = df.crossJoin(F.broadcast(sums)).agg((F.sum(only((F.col(x) - F.col("_mean")) * (F.col(x) - F.col("_mean")), mask)) / (F.max("_n") + EPS)).alias("_v"), F.max("_n").alias("_n"), F.max("_mean").alias("_mean"))
    moments = second.select("_mean", (F.col("_v") * F.col("_n") / (F.col("_n") - 1)).alias("_var"))
    white = (F.col(x) - F.col("_mean")) / F.sqrt(F.col("_var") + EPS)
    return df.crossJoin(F.broadcast(moments)).withColumn(out, white if shift_mean else white + F.col("_mean")).drop("_mean", "_var")


@register("reinforce_plus_plus_baseline")
def rpp_baseline(tokens: DataFrame, group: str = "uid", score: str = "score", seq: str = "seq", mask: str = "mask") -> DataFrame:
    """Group-centred score on each token, whitened over all valid tokens. Long form; the group mean is over responses."""
    per = tokens.groupBy(group, seq).agg(F.max(score).alias("_s"))
    w = Window.partitionBy(group)
    per = per.withColumn("_c", F.col("_s") - F.when(F.count("_s").over(w) > 1, F.avg("_s").over(w)).otherwise(0.0)).select(group, seq, "_c")
    on = F.col(mask)
    return whiten(tokens.join(per, [group, seq]), "_c", on, "_a").withColumn("advantage", F.when(on, F.col("_a")).otherwise(0.0)).drop("_a", "_c")


def discounted_return(reward: Column, mask: Column, gamma: float) -> Column:
    """R_t = r_t + gamma * R_{t+1} per array; the running value is reset after a masked position (mask 0/1)."""
    steps = F.reverse(F.arrays_zip(reward.alias("r"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        total = x["r"].cast("double") + gamma * s["run"]
        return F.struct((total * x["m"].cast("double")).alias("run"), F.concat(F.array(total), s["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda s: s["out"])


def reward_to_go(tokens: DataFrame, seq: list[str], pos: str, reward: Column, mask: Column) -> DataFrame:
    """Sum of the rewards of valid tokens from here on."""
    w = Window.partitionBy(*seq).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("reward_to_go", F.sum(only(reward, mask)).over(w))


def gae(reward: Column, value: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Unwhitened advantages per array; tokens outside the mask pass the state on unchanged."""
    steps = F.reverse(F.arrays_zip(reward.alias("r"), value.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("nv"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        v, on = x["v"].cast("double"), x["m"].cast("int") == 1
        last = x["r"].cast("double") + gamma * s["nv"] - v + gamma * lam * s["last"]
        last = F.when(on, last).otherwise(s["last"])
        return F.struct(F.when(on, v).otherwise(s["nv"]).alias("nv"), last.alias("last"), F.concat(F.array(last), s["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda s: s["out"])


def optimal_token_baseline(tokens: DataFrame, group: str, seq: str, pos: str, reward: Column, weight: Column, mask: Column) -> DataFrame:
    """A = (G - B) * m: G reward-to-go, W the running sum of token weights, B = sum(G W m) / (sum(W m) + eps) per group and position.

    A group of one response has B = 0. So has the one longest response of a group from the second greatest length on,
    where the baseline would be its own return. Dealt by group, a table is shuffled no more for this.
    """
    own = Window.partitionBy(group, seq).orderBy(pos)
    t = reward_to_go(tokens, [group, seq], pos, reward, mask).withColumn("_w", F.sum(only(weight, mask)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_len", F.sum(mask.cast("int")).over(Window.partitionBy(group, seq)))
    at = Window.partitionBy(group, pos)
    base = F.sum(only(F.col("reward_to_go") * F.col("_w"), mask)).over(at) / (F.sum(only(F.col("_w"), mask)).over(at) + EPS)
    lengths = t.groupBy(group, seq).agg(F.max("_len").alias("_l")).groupBy(group).agg(F.sort_array(F.collect_list("_l"), False).alias("_ls"), F.count(F.lit(1)).alias("_n"))
    t = t.withColumn("_base", base).join(lengths, group)
    second = F.coalesce(F.get("_ls", F.lit(1)), F.lit(0))
    tail = (F.col("_n") > 1) & (F.get("_ls", F.lit(0)) > second) & (F.col("_len") == F.get("_ls", F.lit(0))) & (F.col("_at") >= second)
    t = t.withColumn("_at", F.row_number().over(own) - 1)
    base = F.when((F.col("_n") > 1) & ~tail, F.col("_base")).otherwise(0.0)
    return t.withColumn("advantage", F.when(mask, F.col("reward_to_go") - base).otherwise(0.0)).drop("_w", "_len", "_base", "_ls", "_n", "_at")


def compacted_positions(tokens: DataFrame, group: str, seq: str, pos: str, mask: Column) -> DataFrame:
    """Positions counted over valid tokens only, from 0 (for responses of several turns)."""
    w = Window.partitionBy(group, seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("valid_pos", F.sum(mask.cast("int")).over(w) - 1)


def position_ids(tokens: DataFrame, seq: list[str], pos: str, mask: Column) -> DataFrame:
    w = Window.partitionBy(*seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("position_id", F.greatest(F.sum(mask.cast("int")).over(w) - 1, F.lit(0)))


def eos_mask(tokens: DataFrame, seq: list[str], pos: str, is_eos: Column) -> DataFrame:
    """1 up to and including the first end token."""
    w = Window.partitionBy(*seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("response_mask", F.when(F.coalesce(F.sum(is_eos.cast("int")).over(w), F.lit(0)) == 0, 1).otherwise(0))


def aggregate_loss(tokens: DataFrame, seq: list[str], loss: Column, mask: Column, horizon: float | None = None) -> DataFrame:
    """All aggregation modes in one pass over (sequence, then batch): fully masked sequences don't count in seq-mean modes."""
    per = tokens.groupBy(*seq).agg(F.sum(only(loss, mask)).alias("s"), F.sum(F.when(mask, 1.0).otherwise(0.0)).alias("m"))
    live = F.col("m") > 0
    return per.agg(
        F.try_divide(F.sum("s"), F.sum("m")).alias("token_mean"),
        F.avg(F.when(live, F.col("s"))).alias("seq_mean_token_sum"),
        (F.avg(F.when(live, F.col("s"))) / F.lit(horizon or 1.0)).alias("seq_mean_token_sum_norm"),
        F.avg(F.when(live, F.col("s") / (F.col("m") + EPS))).alias("seq_mean_token_mean"),
    )


POLICY_LOSSES: dict[str, Callable[..., Column]] = {}


def _loss(name: str):
    def add(f):
        POLICY_LOSSES[name] = f
        return f

    return add


@_loss("vanilla")
def clip_loss(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Clipped surrogate with a second clip for negative advantages."""
    r = F.exp(clamp(logp - old, -20.0, 20.0))
    c1 = F.greatest(-adv * r, -adv * clamp(r, 1 - low, 1 + high))
    return F.when(adv < 0, F.least(-adv * dual, c1)).otherwise(c1)


@_loss("gpg")
def gpg_loss(logp: Column, old: Column, adv: Column) -> Column:
    return -logp * adv


@_loss("cispo")
def cispo_loss(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    r = F.exp(clamp(logp - old, -20.0, 20.0))
    return -clamp(r, 1 - low, 1 + high) * adv * logp


@_loss("dppo_tv")
def dppo_tv_loss(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """Tokens whose probability moved too far in the advantage's direction get no loss."""
    gap = F.exp(logp) - F.exp(old)
    ok = F.when(adv > 0, gap <= high).otherwise(gap >= -low)
    return F.when(ok, -adv * F.least(F.exp(clamp(logp - old, -20.0, 20.0)), F.lit(20.0)) * logp).otherwise(0.0)


@_loss("sapo")
def sapo_loss(logp: Column, old: Column, adv: Column, tau_pos: float = 1.0, tau_neg: float = 1.05) -> Column:
    """Soft gate 4/tau * sigmoid(tau (r - 1)) in place of the ratio."""
    r = F.exp(clamp(logp - old, -20.0, 20.0))
    gate = lambda t: F.lit(4.0 / t) / (1 + F.exp(-t * (r - 1)))
    return -F.when(adv > 0, gate(tau_pos)).otherwise(gate(tau_neg)) * adv


@_loss("dppo_kl")
def dppo_kl_loss(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """As dppo_tv, by the divergence of the token's two-valued distribution; moves back are always allowed."""
    p, q = F.exp(logp), F.exp(old)
    kl = q * (old - logp) + (1 - q) * F.ln((1 - q + EPS) / (1 - p + EPS))
    ok = F.when(adv > 0, (kl <= high) | (p <= q)).otherwise((kl <= low) | (p >= q))
    return F.when(ok, -adv * F.least(F.exp(clamp(logp - old, -20.0, 20.0)), F.lit(20.0)) * logp).otherwise(0.0)


@_loss("reinforce")
def reinforce_loss(logp: Column, old: Column, adv: Column) -> Column:
    return -adv * logp


def clip_cov_loss(tokens: DataFrame, key: list[str], logp: Column, old: Column, adv: Column, mask: Column, ratio: float = 0.0002, low: float = 1.0, high: float = 5.0, clip: float = 0.2, seed: int = 0) -> DataFrame:
    """Add `loss`: the clipped surrogate, 0 for a seeded share `ratio` (one token at least) of the tokens whose covariance
    lies between the bounds and that the clip leaves alone. The share is taken in the order of a hash of the key."""
    r = F.exp(logp - old)
    l1, l2 = -adv * r, -adv * clamp(r, 1 - clip, 1 + clip)
    own = tokens.withColumn("_l1", l1).withColumn("_l2", l2).withColumn("_lp", logp).withColumn("_a", adv)
    means = own.agg(F.avg(F.when(mask, F.col("_lp"))).alias("_ml"), F.avg(F.when(mask, F.col("_a"))).alias("_ma"), F.count_if(mask).alias("_n"))
    own = own.crossJoin(F.broadcast(means))
    cov = (F.col("_a") - F.col("_ma")) * (F.col("_lp") - F.col("_ml"))
    band = mask & ~(F.col("_l2") > F.col("_l1")) & (cov < high) & (cov > low)
    k = max(1, int(ratio * (own.agg(F.count_if(mask)).first()[0] or 0)))
    chosen = first_rows(own.where(band).select(*key, F.xxhash64(F.lit(seed), *key).alias("_h")), k, "_h", *key).select(*[F.col(c).alias(f"_k_{c}") for c in key], F.lit(True).alias("_out"))
    same = [F.col(c) == F.col(f"_k_{c}") for c in key]
    out = own.join(chosen, same, "left").withColumn("loss", F.when(F.col("_out"), 0.0).otherwise(F.greatest("_l1", "_l2")))
    return out.drop("_l1", "_l2", "_lp", "_a", "_ml", "_ma", "_n", "_out", *[f"_k_{c}" for c in key])


def geo_mean_loss(tokens: DataFrame, seq: list[str], logp: Column, old: Column, adv: Column, mask: Column, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Mean over sequences of -A * exp(masked mean of the pessimistically clipped log-ratio), A the masked mean advantage."""
    d, s = logp - old, F.signum(adv)
    worst = s * F.least(s * d, s * clamp(d, -low, high))
    n = F.sum(F.when(mask, 1.0).otherwise(0.0)) + EPS
    per = tokens.groupBy(*seq).agg((F.sum(only(worst, mask)) / n).alias("r"), (F.sum(only(adv, mask)) / n).alias("a"))
    return per.agg(F.avg(-F.col("a") * F.exp("r")).alias("loss"))


def gspo_ratio(tokens: DataFrame, seq: list[str], logp: Column, old: Column, mask: Column) -> DataFrame:
    """Sequence ratio exp(min(masked mean of logp - old, 10)) on every row of the sequence."""
    w = Window.partitionBy(*seq)
    mean = F.sum(only(logp - old, mask)).over(w) / F.greatest(F.sum(F.when(mask, 1.0).otherwise(0.0)).over(w), F.lit(1.0))
    return tokens.withColumn("seq_ratio", F.exp(F.least(mean, F.lit(10.0))))


def value_loss(pred: Column, old: Column, returns: Column, clip: float = 0.5) -> Column:
    near = clamp(pred, old - clip, old + clip)
    return 0.5 * F.greatest((pred - returns) * (pred - returns), (near - returns) * (near - returns))


def kl_cov_rows(tokens: DataFrame, key: list[str], logp: Column, adv: Column, mask: Column, ratio: float, digits: int = 12) -> DataFrame:
    """The share `ratio` of valid tokens (at least one) with the greatest covariance of log-probability and advantage.

    Tokens are numbered by covariance (to `digits` digits, ties by key); means are one broadcast row.
    """
    own = tokens.withColumn("_l", logp.cast("double")).withColumn("_a", adv.cast("double")).where(mask)
    means = own.agg(F.avg("_l").alias("_ml"), F.avg("_a").alias("_ma"))
    cov = own.crossJoin(F.broadcast(means)).select(*key, ((F.col("_l") - F.col("_ml")) * (F.col("_a") - F.col("_ma"))).alias("covariance"))
    k = max(1, int(own.count() * ratio))
    return first_rows(cov.withColumn("_o", -F.round("covariance", digits)), k, "_o", *key).drop("_o")


def kl_cov_loss(tokens: DataFrame, key: list[str], logp: Column, old: Column, adv: Column, mask: Column, ratio: float = 0.0002, coefficient: float = 1.0, digits: int = 12) -> DataFrame:
    """Add `loss`: -A * ratio of probabilities, plus coefficient * |logp - old| for the tokens of greatest covariance (kl_cov_rows)."""
    d = logp - old
    out = tokens.withColumn("_d", d).withColumn("_adv", adv)
    chosen = kl_cov_rows(tokens, key, logp, adv, mask, ratio, digits).select(*[F.col(c).alias(f"_k_{c}") for c in key], F.lit(True).alias("_in"))
    out = out.join(chosen, [F.col(c) == F.col(f"_k_{c}") for c in key], "left")
    plain = -F.col("_adv") * F.exp("_d")
    return out.withColumn("loss", plain + F.when(F.col("_in"), coefficient * F.abs("_d")).otherwise(0.0)).drop("_d", "_adv", "_in", *[f"_k_{c}" for c in key])


def resample(df: DataFrame, weights: Column, key: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement, each row with a probability in proportion to its weight: columns of df and `draw`.

    A draw is a seeded uniform; the rows' running totals of weight, in the order of the key, cut [0, total) into
    intervals, and a draw takes the row whose interval holds it. Draws are sorted into the same ranges as the rows, so
    each range is searched by itself and no row is paired with every draw.
    """
    import pyarrow as pa

    summed = cut_lineage(running_total(df.withColumn("_w", weights.cast("double")), F.col("_w"), key, out="_end"))
    total = float(summed.agg(F.max("_end")).first()[0] or 0)
    if total <= 0:
        raise ValueError("no weight to draw by")
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) * (1.0 / (1 << 53))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform * total).alias("_at"))
    rows = summed.where("_w > 0").select(F.lit(None).cast("long").alias("draw"), F.col("_end").alias("_at"), F.col(key).alias("_key"))
    both = draws.select("draw", "_at", F.lit(None).cast(df.schema[key].dataType).alias("_key")).union(rows)
    # descending: a row comes right before the draws of its interval
    placed = both.repartitionByRange(F.desc("_at")).sortWithinPartitions(F.desc("_at"), F.col("draw").isNotNull())
    placed = cut_lineage(placed.withColumn("_p", F.spark_partition_id()))
    last = {r["_p"]: r["k"] for r in placed.where("draw is null").groupBy("_p").agg(F.min_by("_key", "_at").alias("k")).collect()}  # a row for each partition
    carried, now = {}, None
    for p in sorted(r["_p"] for r in placed.select("_p").distinct().collect()):
        carried[p] = now
        now = last.get(p, now)

    def run(batches):
        at = None
        for batch in batches:
            out = []
            for d, k, p in zip(*(batch.column(c).to_pylist() for c in ("draw", "_key", "_p"))):
                if d is None:
                    at = k
                else:
                    out.append((d, at if at is not None else carried[p]))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([k for _, k in out], batch.column("_key").type)], ["draw", "_key"])

    kind = df.schema[key].dataType.simpleString()
    chosen = placed.mapInArrow(run, f"draw long, _key {kind}")
    return chosen.join(df, F.col("_key") == F.col(key)).drop("_key")


def resample_weights(df: DataFrame, score: str, kind: str = "pow", power: float = 1.0) -> DataFrame:
    """Weights of reweighted resampling: |s|^power, or 1 for the rows at the extremes (max_min), or max plus a hashed row."""
    s = F.col(score).cast("double")
    if kind == "pow":
        raw = F.pow(F.abs(s), F.lit(power))
    elif kind == "max_min":
        ends = df.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
        df = df.crossJoin(F.broadcast(ends))
        raw = F.when((s == F.col("_hi")) | (s == F.col("_lo")), 1.0).otherwise(0.0)
    else:
        top = df.agg(F.max(score).alias("_hi"))
        df = df.crossJoin(F.broadcast(top))
        raw = F.when(s == F.col("_hi"), 0.4).otherwise(0.1)
    df = df.withColumn("_w", raw)
    total = df.agg(F.sum("_w").alias("_t"))
    return df.crossJoin(F.broadcast(total)).withColumn("weight", F.try_divide(F.col("_w"), F.col("_t"))).drop("_w", "_t", "_hi", "_lo")


def adaptive_kl(steps: DataFrame, order: str, kl: str, beta: float, target: float, horizon: float, n: Column) -> DataFrame:
    """beta after each step: the running product of 1 + clip(kl/target - 1, -0.2, 0.2) n / horizon, as a running total of logs."""
    factor = 1 + clamp(F.col(kl) / target - 1, -0.2, 0.2) * n / horizon
    return running_total(steps, F.ln(factor), order, out="_log").withColumn("beta", beta * F.exp("_log")).drop("_log")


def bypass_loss(
    tokens: DataFrame, seq: list[str], logp: Column, sampled: Column, adv: Column, mask: Column, loss: str = "ppo_clip", options: dict | None = None, weights: str = "token", threshold: float = 2.0, norm: float = 1.0
) -> DataFrame:
    """Loss where the policy that sampled stands for the old one (no third policy is evaluated).

    `ppo_clip`: the clipped surrogate, whose ratio is against the sampling policy, so no weight is needed. `reinforce`:
    -A * w * logp with the truncated importance weight w. Tokens that the options reject don't count.
    """
    from tessella.operators.rejection import correct_rollouts

    if loss not in ("ppo_clip", "reinforce"):
        raise ValueError(f"unknown loss {loss}")
    c = correct_rollouts(tokens, seq, logp - sampled, mask, options, weights if loss == "reinforce" else None, threshold)
    each = POLICY_LOSSES["vanilla"](logp, sampled, adv) if loss == "ppo_clip" else -adv * F.col("is_weight") * logp
    return aggregate_loss(c, seq, each, F.col("kept"), norm)


def at_last_token(tokens: DataFrame, seq: str, pos: str, reward: Column, out: str) -> DataFrame:
    """Add `out`: the sequence's reward at its last token, 0 elsewhere."""
    last = F.max(pos).over(Window.partitionBy(seq))
    return tokens.withColumn(out, F.when(F.col(pos) == last, reward).otherwise(0.0))
