"""Queries of group-relative statistics, losses, importance weights and rejection."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.masked import kl_estimate, masked_mean
from tessella.operators import groupmath as G
from tessella.operators import rejection as R
from tessella.plans.registry import query, r6
from tessella.session import dealt

E6, E8 = "0.000001::DOUBLE", "0.00000001::DOUBLE"
ST = "{responses}, s AS (SELECT *, count(*) OVER g AS n, avg(score) OVER g AS mu, stddev_samp(score) OVER g AS sd, sum(score) OVER g AS total FROM responses WINDOW g AS (PARTITION BY uid))"
TO = "{tokens}"


def _seq(name: str, expr: str):
    def add(f):
        return query(f"WITH {ST} SELECT seq, round({expr}, 9) AS advantage FROM s", name=name)(f)

    return add


def _adv(df):
    return df.select("seq", F.round("advantage", 9).alias("advantage"))


@_seq("grpo_advantage", f"CASE WHEN n > 1 THEN (score - mu) / (sd + {E6}) ELSE score / (1 + {E6}) END")
def _(t):
    return _adv(G.advantage("grpo")(t.responses))


@_seq("dr_grpo_advantage", "CASE WHEN n > 1 THEN score - mu ELSE score END")
def _(t):
    return _adv(G.advantage("dr_grpo")(t.responses))


@_seq("grpo_vectorized", f"CASE WHEN n > 1 THEN (score - mu) / (sqrt(greatest(sd * sd, {E6})) + {E6}) ELSE score / (1 + {E6}) END")
def _(t):
    return _adv(G.advantage("grpo_vectorized")(t.responses))


@query(f"WITH {ST}, r AS (SELECT *, row_number() OVER b AS k, lead(score) OVER b AS second FROM s WHERE n > 1 WINDOW b AS (PARTITION BY uid ORDER BY score DESC, seq)) SELECT seq, round(CASE WHEN k = 1 THEN (score - second) / (sd + {E6}) ELSE 0 END, 9) AS advantage FROM r")
def grpo_passk(t):
    r = t.responses.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("uid"))).where("n > 1")
    return _adv(G.advantage("grpo_passk")(r))


@_seq("rloo", "CASE WHEN n > 1 THEN score * n / (n - 1) - mu * n / (n - 1) ELSE score END")
def _(t):
    return _adv(G.advantage("rloo")(t.responses))


@_seq("rloo_vectorized", "(n * score - total) / greatest(n - 1, 1)")
def _(t):
    return _adv(G.advantage("rloo_vectorized")(t.responses))


@query(f"WITH {ST} SELECT seq, round(CASE WHEN n > 1 THEN score - sum(length * score) OVER (PARTITION BY uid) / sum(length) OVER (PARTITION BY uid) ELSE score END, 9) AS advantage FROM s")
def opo(t):
    return _adv(G.advantage("opo")(t.responses))


@_seq("gpg", "(SELECT count(*)::DOUBLE / greatest(count(*) FILTER (score <> 0), 1) FROM responses) * CASE WHEN n > 1 THEN score - mu ELSE score END")
def _(t):
    return _adv(G.advantage("gpg")(t.responses))


WHITE = f"mo AS (SELECT sum(x) FILTER (mask) / (count(*) FILTER (mask) + {E8}) AS m FROM v), va AS (SELECT sum((x - m) * (x - m)) FILTER (mask) / (count(*) FILTER (mask) + {E8}) * count(*) FILTER (mask) / (count(*) FILTER (mask) - 1) AS var FROM v, mo)"


@query(f"""WITH {TO}, p AS (SELECT uid, seq, max(reward) AS s FROM tokens GROUP BY 1, 2), c AS (SELECT uid, seq, s - CASE WHEN count(*) OVER (PARTITION BY uid) > 1 THEN avg(s) OVER (PARTITION BY uid) ELSE 0 END AS x FROM p),
v AS (SELECT seq, pos, mask, x FROM tokens JOIN c USING (uid, seq)), {WHITE} SELECT seq, pos, round(CASE WHEN mask THEN (x - m) / sqrt(var + {E8}) ELSE 0 END, 6) AS advantage FROM v, mo, va""")
def rpp_baseline(t):
    return G.advantage("reinforce_plus_plus_baseline")(t.tokens, score="reward").select("seq", "pos", r6("advantage").alias("advantage"))


@query(f"WITH {TO}, v AS (SELECT seq, pos, mask, ret AS x FROM tokens), {WHITE} SELECT seq, pos, round((x - m) / sqrt(var + {E8}), 6) AS white FROM v, mo, va")
def masked_whiten(t):
    return G.whiten(t.tokens, "ret", F.col("mask"), "white").select("seq", "pos", r6("white").alias("white"))


@query(f"WITH {TO} SELECT seq, round(coalesce(sum(value) FILTER (mask), 0), 6) AS total, round(coalesce(sum(value) FILTER (mask), 0) / (count(*) FILTER (mask) + {E8}), 6) AS mean FROM tokens GROUP BY 1")
def masked_stats(t):
    return t.tokens.groupBy("seq").agg(r6(F.sum(F.when(F.col("mask"), F.col("value")).otherwise(0.0))).alias("total"), r6(masked_mean(F.col("value"), F.col("mask"))).alias("mean"))


ARR = "a AS (SELECT seq, list(reward ORDER BY pos) AS r, list(value ORDER BY pos) AS v, list(mask::INT ORDER BY pos) AS m FROM tokens GROUP BY 1)"


def _arrays(t):
    s = F.sort_array(F.collect_list(F.struct("pos", "reward", "value", F.col("mask").cast("int").alias("mask"))))
    g = t.tokens.groupBy("seq").agg(s.alias("s"))
    return g.select("seq", *[F.col("s")[c].alias(c) for c in ("reward", "value", "mask")])


@query("""WITH RECURSIVE {tokens}, n AS (SELECT seq, max(pos) AS last FROM tokens GROUP BY 1), x AS (
SELECT t.seq, t.pos, t.reward AS ret, t.reward * t.mask::INT AS run FROM tokens t JOIN n ON n.seq = t.seq AND n.last = t.pos
UNION ALL SELECT t.seq, t.pos, t.reward + 0.9::DOUBLE * x.run, (t.reward + 0.9::DOUBLE * x.run) * t.mask::INT FROM x JOIN tokens t ON t.seq = x.seq AND t.pos = x.pos - 1) SELECT seq, pos, round(ret, 9) AS ret FROM x""")
def discounted_return(t):
    d = _arrays(t).select("seq", F.posexplode(G.discounted_return(F.col("reward"), F.col("mask"), 0.9)).alias("pos", "ret"))
    return d.select("seq", F.col("pos").cast("long").alias("pos"), F.round("ret", 9).alias("ret"))


@query("""WITH RECURSIVE {tokens}, n AS (SELECT seq, max(pos) AS last FROM tokens GROUP BY 1), x AS (
SELECT t.seq, t.pos, CASE WHEN mask THEN t.reward - t.value ELSE 0 END AS l, CASE WHEN mask THEN t.value ELSE 0 END AS nv FROM tokens t JOIN n ON n.seq = t.seq AND n.last = t.pos
UNION ALL SELECT t.seq, t.pos, CASE WHEN t.mask THEN t.reward + 0.95::DOUBLE * x.nv - t.value + 0.95::DOUBLE * 0.9::DOUBLE * x.l ELSE x.l END, CASE WHEN t.mask THEN t.value ELSE x.nv END FROM x JOIN tokens t ON t.seq = x.seq AND t.pos = x.pos - 1)
SELECT seq, pos, round(l, 6) AS advantage FROM x""")
def gae(t):
    d = _arrays(t).select("seq", F.posexplode(G.gae(F.col("reward"), F.col("value"), F.col("mask"), 0.95, 0.9)).alias("pos", "advantage"))
    return d.select("seq", F.col("pos").cast("long").alias("pos"), r6("advantage").alias("advantage"))


@query(f"WITH {TO} SELECT seq, pos, round(sum(CASE WHEN mask THEN reward ELSE 0 END) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS reward_to_go FROM tokens")
def reward_to_go(t):
    return G.reward_to_go(t.tokens, ["seq"], "pos", F.col("reward"), F.col("mask")).select("seq", "pos", r6("reward_to_go").alias("reward_to_go"))


@query(f"""WITH {TO}, base AS (SELECT uid, avg(s) AS b FROM (SELECT uid, seq, sum(reward) FILTER (mask) AS s FROM tokens GROUP BY 1, 2) GROUP BY 1)
SELECT seq, pos, round(sum(CASE WHEN mask THEN reward ELSE 0 END) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - CASE WHEN mask THEN b ELSE 0 END, 6) AS advantage FROM tokens JOIN base USING (uid)""")
def remax(t):
    per = t.tokens.groupBy("uid", "seq").agg(F.sum(F.when(F.col("mask"), F.col("reward"))).alias("s")).groupBy("uid").agg(F.avg("s").alias("b"))
    r = G.reward_to_go(t.tokens, ["seq"], "pos", F.col("reward"), F.col("mask")).join(per, "uid")
    return r.select("seq", "pos", r6(F.col("reward_to_go") - F.when(F.col("mask"), F.col("b")).otherwise(0.0)).alias("advantage"))


OTB = f"""o AS (SELECT *, sum(CASE WHEN mask THEN reward ELSE 0 END) OVER (PARTITION BY seq ORDER BY P ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g, sum(CASE WHEN mask THEN w ELSE 0 END) OVER (PARTITION BY seq ORDER BY P) AS wt,
count(*) FILTER (mask) OVER (PARTITION BY seq) AS len, row_number() OVER (PARTITION BY seq ORDER BY P) - 1 AS ix FROM k), l AS (SELECT uid, list(len ORDER BY len DESC) AS ls FROM (SELECT DISTINCT uid, seq, len FROM o) GROUP BY 1),
b AS (SELECT *, sum(CASE WHEN mask THEN g * wt ELSE 0 END) OVER (PARTITION BY uid, P) / (sum(CASE WHEN mask THEN wt ELSE 0 END) OVER (PARTITION BY uid, P) + {E8}) AS base FROM o)
SELECT seq, pos, round(CASE WHEN len(ls) > 1 AND ls[1] > ls[2] AND len = ls[1] AND ix >= ls[2] AND mask THEN g WHEN NOT mask THEN 0 WHEN len(ls) > 1 THEN g - base ELSE g END, 6) AS advantage FROM b JOIN l USING (uid)"""


@query(f"WITH {TO}, k AS (SELECT *, 1 - 2 * exp(logp) + 0.5::DOUBLE AS w FROM tokens), " + OTB.replace("BY P", "BY pos").replace(", P)", ", pos)"))
def otb(t):
    w = 1 - 2 * F.exp("logp") + 0.5
    o = G.optimal_token_baseline(dealt(t.tokens, "uid"), "uid", "seq", "pos", F.col("reward"), w, F.col("mask"))
    return o.select("seq", "pos", r6("advantage").alias("advantage"))


@query(f"WITH {TO}, k AS (SELECT *, sum(mask::INT) OVER (PARTITION BY seq ORDER BY pos) - 1 AS vp, 1 - 2 * exp(logp) + 0.5::DOUBLE AS w FROM tokens QUALIFY mask), " + OTB.replace("BY P", "BY vp").replace(", P)", ", vp)"))
def tir_otb(t):
    """Several turns: positions are counted over valid tokens. All windows are within a prompt, and so in one task."""
    k = G.compacted_positions(dealt(t.tokens, "uid"), "uid", "seq", "pos", F.col("mask")).where("mask").withColumnRenamed("pos", "_pos").withColumnRenamed("valid_pos", "pos")
    o = G.optimal_token_baseline(k, "uid", "seq", "pos", F.col("reward"), 1 - 2 * F.exp("logp") + 0.5, F.col("mask"))
    return o.select("seq", F.col("_pos").alias("pos"), r6("advantage").alias("advantage"))


@query(f"WITH {TO} SELECT seq, pos, round(reward - 0.05::DOUBLE * (logp - old), 6) AS reward FROM tokens")
def kl_penalised_reward(t):
    return t.tokens.select("seq", "pos", r6(F.col("reward") - 0.05 * kl_estimate(F.col("logp"), F.col("old"), "kl")).alias("reward"))


@query(f"WITH {TO}, d AS (SELECT seq, pos, logp - old AS d, least(greatest(old - logp, -20), 20) AS r FROM tokens) SELECT seq, pos, round(d, 6) AS k1, round(abs(d), 6) AS abs, round(0.5::DOUBLE * d * d, 6) AS k2, round(least(greatest(exp(r) - r - 1, -10), 10), 6) AS k3 FROM d")
def kl_estimators(t):
    return t.tokens.select("seq", "pos", *[r6(kl_estimate(F.col("logp"), F.col("old"), k)).alias(k) for k in ("k1", "abs", "k2", "k3")])


@query(f"""WITH s AS (SELECT o_orderkey AS step, (o_orderkey % 13)::DOUBLE / 100 AS kl FROM orders), f AS (SELECT step, 1 + least(greatest(kl / 0.06::DOUBLE - 1, -0.2::DOUBLE), 0.2::DOUBLE) * 64 / 10000 AS x FROM s)
SELECT step, round(0.2::DOUBLE * exp(sum(ln(x)) OVER (ORDER BY step)), 6) AS beta FROM f""")
def adaptive_kl(t):
    s = t.orders.select(F.col("o_orderkey").alias("step"), ((F.col("o_orderkey") % 13) / 100).alias("kl"))
    return G.adaptive_kl(s, "step", "kl", 0.2, 0.06, 10000.0, F.lit(64)).select("step", r6("beta").alias("beta"))


@query("WITH {responses} SELECT seq, round(pow(abs(score), 2) / (SELECT sum(pow(abs(score), 2)) FROM responses) * 1000, 6) AS weight FROM responses")
def pf_weights(t):
    return G.resample_weights(t.responses, "score", "pow", 2.0).select("seq", r6(F.col("weight") * 1000).alias("weight"))


@query(f"WITH {TO} SELECT seq, pos, (CASE WHEN coalesce(sum((NOT mask)::INT) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END)::INT AS response_mask FROM tokens")
def eos_mask(t):
    return G.eos_mask(t.tokens, ["seq"], "pos", ~F.col("mask")).select("seq", "pos", "response_mask")


@query(f"WITH {TO} SELECT seq, pos, greatest(sum(mask::INT) OVER (PARTITION BY seq ORDER BY pos) - 1, 0)::BIGINT AS position_id FROM tokens")
def position_ids(t):
    return G.position_ids(t.tokens, ["seq"], "pos", F.col("mask")).select("seq", "pos", F.col("position_id").cast("long").alias("position_id"))


AGG = f"""p AS (SELECT seq, coalesce(sum(x) FILTER (mask), 0) AS s, (count(*) FILTER (mask))::DOUBLE AS m FROM l GROUP BY 1) SELECT round(sum(s) / sum(m), 6) AS token_mean, round(avg(s) FILTER (m > 0), 6) AS seq_mean_token_sum,
round(avg(s) FILTER (m > 0) / 7, 6) AS seq_mean_token_sum_norm, round(avg(s / (m + {E8})) FILTER (m > 0), 6) AS seq_mean_token_mean FROM p"""
RATIO = "exp(least(greatest(logp - old, -20), 20))"


def _losses(df):
    return df.select(*[r6(c).alias(c) for c in df.columns])


def _loss(name: str, sql: str):
    def add(f):
        return query(f"WITH {TO}, l AS (SELECT seq, mask, {sql} AS x FROM tokens), {AGG}", name=name)(lambda t: _losses(G.aggregate_loss(t.tokens, ["seq"], f(F.col("logp"), F.col("old"), F.col("adv")), F.col("mask"), 7.0)))

    return add


_loss("agg_loss", "logp * adv")(lambda lp, old, adv: lp * adv)
_loss("ppo_clip_loss", f"CASE WHEN adv < 0 THEN least(-adv * 3, greatest(-adv * {RATIO}, -adv * least(greatest({RATIO}, 0.8::DOUBLE), 1.2::DOUBLE))) ELSE greatest(-adv * {RATIO}, -adv * least(greatest({RATIO}, 0.8::DOUBLE), 1.2::DOUBLE)) END")(G.POLICY_LOSSES["vanilla"])
_loss("gpg_loss", "-logp * adv")(G.POLICY_LOSSES["gpg"])
_loss("cispo_loss", f"-least(greatest({RATIO}, 0.8::DOUBLE), 1.2::DOUBLE) * adv * logp")(G.POLICY_LOSSES["cispo"])
_loss("dppo_tv_loss", f"CASE WHEN CASE WHEN adv > 0 THEN exp(logp) - exp(old) <= 0.2::DOUBLE ELSE exp(logp) - exp(old) >= -0.2::DOUBLE END THEN -adv * least({RATIO}, 20) * logp ELSE 0 END")(G.POLICY_LOSSES["dppo_tv"])
_loss("dppo_kl_loss", f"""CASE WHEN CASE WHEN adv > 0 THEN exp(old) * (old - logp) + (1 - exp(old)) * ln((1 - exp(old) + {E8}) / (1 - exp(logp) + {E8})) <= 0.2::DOUBLE OR exp(logp) <= exp(old)
ELSE exp(old) * (old - logp) + (1 - exp(old)) * ln((1 - exp(old) + {E8}) / (1 - exp(logp) + {E8})) <= 0.2::DOUBLE OR exp(logp) >= exp(old) END THEN -adv * least({RATIO}, 20) * logp ELSE 0 END""")(G.POLICY_LOSSES["dppo_kl"])
_loss("reinforce_loss", "-adv * logp")(G.POLICY_LOSSES["reinforce"])
_loss("sapo_loss", f"-CASE WHEN adv > 0 THEN 4 / (1 + exp(-({RATIO} - 1))) ELSE (4 / 1.05::DOUBLE) / (1 + exp(-1.05::DOUBLE * ({RATIO} - 1))) END * adv")(G.POLICY_LOSSES["sapo"])


@query(f"""WITH {TO}, r AS (SELECT *, exp(least(coalesce(sum(logp - old) FILTER (mask) OVER (PARTITION BY seq), 0) / greatest(count(*) FILTER (mask) OVER (PARTITION BY seq), 1), 10)) AS q FROM tokens),
l AS (SELECT seq, mask, greatest(-adv * q, -adv * least(greatest(q, 0.8::DOUBLE), 1.2::DOUBLE)) AS x FROM r), {AGG}""")
def gspo_loss(t):
    g = G.gspo_ratio(t.tokens, ["seq"], F.col("logp"), F.col("old"), F.col("mask"))
    q, adv = F.col("seq_ratio"), F.col("adv")
    loss = F.greatest(-adv * q, -adv * F.least(F.greatest(q, F.lit(0.8)), F.lit(1.2)))
    return _losses(G.aggregate_loss(g, ["seq"], loss, F.col("mask"), 7.0))


@query(f"""WITH {TO}, c AS (SELECT seq, mask, adv, sign(adv) * least(sign(adv) * (logp - old), sign(adv) * least(greatest(logp - old, -0.2::DOUBLE), 0.2::DOUBLE)) AS w FROM tokens),
p AS (SELECT seq, coalesce(sum(w) FILTER (mask), 0) / (count(*) FILTER (mask) + {E8}) AS r, coalesce(sum(adv) FILTER (mask), 0) / (count(*) FILTER (mask) + {E8}) AS a FROM c GROUP BY 1) SELECT round(avg(-a * exp(r)), 6) AS loss FROM p""")
def geo_mean_loss(t):
    g = G.geo_mean_loss(t.tokens, ["seq"], F.col("logp"), F.col("old"), F.col("adv"), F.col("mask"))
    return g.select(r6("loss").alias("loss"))


@query()
def clip_cov_loss(t):
    """Which tokens of the band lose their loss is seeded: no SQL; a test holds them against the band."""
    c = G.clip_cov_loss(t.tokens, ["seq", "pos"], F.col("logp"), F.col("old"), F.col("adv"), F.col("mask"), ratio=0.01, low=0.0)
    return c.select("seq", "pos", r6("loss").alias("loss"))


@query(f"WITH {TO}, l AS (SELECT seq, mask, 0.5::DOUBLE * greatest((value - reward) * (value - reward), (least(greatest(value, 0.04 - 0.01), 0.04 + 0.01) - reward) * (least(greatest(value, 0.04 - 0.01), 0.04 + 0.01) - reward)) AS x FROM tokens), {AGG}".replace("0.04 - 0.01", "0.04::DOUBLE - 0.01::DOUBLE").replace("0.04 + 0.01", "0.04::DOUBLE + 0.01::DOUBLE"))
def value_loss(t):
    return _losses(G.aggregate_loss(t.tokens, ["seq"], G.value_loss(F.col("value"), F.lit(0.04), F.col("reward"), 0.01), F.col("mask"), 7.0))


@query(f"""WITH {TO}, m AS (SELECT avg(logp) AS ml, avg(adv) AS ma, greatest(1, floor(count(*) * 0.01::DOUBLE))::BIGINT AS k FROM tokens WHERE mask), c AS (SELECT seq, pos, (logp - ml) * (adv - ma) AS covariance FROM tokens, m WHERE mask)
SELECT seq, pos, round(covariance, 6) AS covariance FROM c QUALIFY row_number() OVER (ORDER BY round(covariance, 9) DESC, seq, pos) <= (SELECT k FROM m)""")
def kl_cov_topk(t):
    c = G.kl_cov_rows(t.tokens, ["seq", "pos"], F.col("logp"), F.col("adv"), F.col("mask"), 0.01, digits=9)
    return c.select("seq", "pos", r6("covariance").alias("covariance"))


@query(f"""WITH {TO}, m AS (SELECT avg(logp) AS ml, avg(adv) AS ma, greatest(1, floor(count(*) * 0.01::DOUBLE))::BIGINT AS k FROM tokens WHERE mask), c AS (SELECT seq, pos, (logp - ml) * (adv - ma) AS covariance FROM tokens, m WHERE mask),
k AS (SELECT seq, pos FROM c QUALIFY row_number() OVER (ORDER BY round(covariance, 9) DESC, seq, pos) <= (SELECT k FROM m)), l AS (SELECT t.seq, mask, -adv * exp(logp - old) + CASE WHEN k.seq IS NOT NULL THEN abs(logp - old) ELSE 0 END AS x FROM tokens t LEFT JOIN k ON k.seq = t.seq AND k.pos = t.pos), {AGG}""")
def kl_cov_loss(t):
    k = G.kl_cov_loss(t.tokens, ["seq", "pos"], F.col("logp"), F.col("old"), F.col("adv"), F.col("mask"), ratio=0.01, digits=9)
    return _losses(G.aggregate_loss(k, ["seq"], F.col("loss"), F.col("mask"), 7.0))


@query()
def pf_resample(t):
    """Draws with replacement in proportion to the weights: seeded, no SQL; a test holds the shares against the weights."""
    return G.resample(t.responses, F.pow(F.abs("score"), F.lit(2.0)), "seq", t.responses.count(), seed=3).select("draw", "seq", "uid")


@query(f"WITH {TO}, n AS (SELECT seq, pos, logp, lead(mask) OVER (ORDER BY seq, pos) AS nm, first_value(mask) OVER (ORDER BY seq, pos) AS f FROM tokens) SELECT round(-sum(logp) FILTER (coalesce(nm, f)) / count(*) FILTER (coalesce(nm, f)), 6) AS loss FROM n")
def sft_loss(t):
    """The mask is rolled over the flattened batch, so it crosses the ends of rows: the next token's mask is the next
    position's of the same row, or the next row's first; rows are chained by a window over their first masks only."""
    tok = t.tokens
    w = Window.partitionBy("seq").orderBy("pos")
    heads = tok.where("pos = 0").select(F.col("seq").alias("h_seq"), F.col("mask").alias("h_mask"))
    order = Window.partitionBy(F.floor(F.col("h_seq") / 4096)).orderBy("h_seq")
    edge = heads.withColumn("b", F.floor(F.col("h_seq") / 4096)).groupBy("b").agg(F.min_by("h_mask", "h_seq").alias("first"))
    edge = edge.withColumn("after", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("b"))).withColumn("start", F.first("first").over(Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    nxt = heads.withColumn("b", F.floor(F.col("h_seq") / 4096)).withColumn("n", F.lead("h_mask").over(order)).join(edge, "b").select("h_seq", F.coalesce("n", "after", "start").alias("next_head"))
    rolled = tok.withColumn("nm", F.lead("mask").over(w)).join(nxt, F.col("seq") == F.col("h_seq")).withColumn("rolled", F.coalesce("nm", "next_head"))
    return rolled.agg(r6(-F.sum(F.when(F.col("rolled"), F.col("logp"))) / F.count_if("rolled")).alias("loss"))


# importance weights and rejection

LR = "least(greatest(logp - old, -20), 20)"


def _kept(name: str, options: dict, cond: str):
    def run(t):
        return R.rejection_mask(t.tokens, ["seq"], F.col("logp") - F.col("old"), F.col("mask"), options).select("seq", "pos", "kept")

    query(f"WITH {TO}, d AS (SELECT *, -{LR} AS k1, 0.5::DOUBLE * {LR} * {LR} AS k2, exp({LR}) - 1 - {LR} AS k3 FROM tokens) SELECT seq, pos, mask AND coalesce({cond}, false) AS kept FROM d", name=name)(run)


_kept("reject_token", {"token_k1": "0.7_1.3", "token_k3": 0.03}, "k1 >= ln(0.7::DOUBLE) AND k1 <= ln(1.3::DOUBLE) AND k3 <= 0.03::DOUBLE")
_kept("reject_seq_sum", {"seq_sum_k2": 0.21}, "coalesce(sum(k2) FILTER (mask) OVER (PARTITION BY seq), 0) <= 0.21::DOUBLE")
_kept("reject_seq_mean", {"seq_mean_k1": 1.23}, f"coalesce(sum(k1) FILTER (mask) OVER (PARTITION BY seq), 0) / (count(*) FILTER (mask) OVER (PARTITION BY seq) + {E8}) BETWEEN ln(1 / 1.23::DOUBLE) AND ln(1.23::DOUBLE)")
_kept("reject_seq_max", {"seq_max_k3": 0.11}, "max(k3) FILTER (mask) OVER (PARTITION BY seq) <= 0.11::DOUBLE")


@query(f"WITH {TO}, w AS (SELECT seq, pos, mask, CASE WHEN mask THEN least(exp({LR}), 1.5::DOUBLE) ELSE 0 END AS t, CASE WHEN mask THEN least(exp(least(greatest(coalesce(sum(logp - old) FILTER (mask) OVER (PARTITION BY seq), 0), -20), 20)), 1.5::DOUBLE) ELSE 0 END AS s FROM tokens) SELECT seq, pos, round(t, 6) AS token_weight, round(s / (SELECT sum(s) / count(*) FILTER (mask) FROM w), 6) AS seq_weight FROM w")
def is_weights(t):
    d = F.col("logp") - F.col("old")
    a = R.is_weights(t.tokens, ["seq"], d, F.col("mask"), "token", 1.5).withColumnRenamed("is_weight", "token_weight")
    b = R.is_weights(a, ["seq"], d, F.col("mask"), "sequence", 1.5, normalize=True)
    return b.select("seq", "pos", r6("token_weight").alias("token_weight"), r6("is_weight").alias("seq_weight"))


@query(f"""WITH {TO}, w AS (SELECT mask, least(exp({LR}), 2) AS w FROM tokens), c AS (SELECT w, least(greatest(w, 0.5), 2) AS c FROM w WHERE mask) SELECT round(avg(w), 6) AS mean, round(max(w), 6) AS max, round(min(w), 6) AS min, round(avg((w > 2)::INT), 6) AS fraction_high,
round(avg((w < 0.5)::INT), 6) AS fraction_low, round(stddev_pop(c), 6) AS std, round((avg(c) + {E8}) * (avg(c) + {E8}) / avg(c * c), 6) AS ess FROM c""".replace("greatest(w, 0.5)", "greatest(w, 0.5::DOUBLE)"))
def is_ess(t):
    w = R.is_weights(t.tokens, ["seq"], F.col("logp") - F.col("old"), F.col("mask"), "token", 2.0)
    m = R.weight_metrics(w, "is_weight", F.col("mask"), 2.0)
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query(f"WITH {TO} SELECT round(avg(abs_k), 6) AS mean, round(max(abs_k), 6) AS max, round(min(abs_k), 6) AS min, round(avg((k3 > 0.1::DOUBLE)::INT), 6) AS fraction_high, round(stddev_pop(k3), 6) AS std FROM (SELECT exp({LR}) - 1 - {LR} AS k3, abs(exp({LR}) - 1 - {LR}) AS abs_k FROM tokens WHERE mask)")
def rs_metrics(t):
    k3 = R.divergence(F.col("logp") - F.col("old"), "k3")
    d = t.tokens.where("mask").select(k3.alias("k"))
    return d.agg(r6(F.avg(F.abs("k"))).alias("mean"), r6(F.max(F.abs("k"))).alias("max"), r6(F.min(F.abs("k"))).alias("min"), r6(F.avg((F.col("k") > 0.1).cast("int"))).alias("fraction_high"), r6(F.stddev_pop("k")).alias("std"))


@query(f"""WITH {TO}, p AS (SELECT seq, (count(*) FILTER (mask))::DOUBLE AS m, coalesce(sum(logp) FILTER (mask), 0) / (count(*) FILTER (mask) + {E8}) AS lp, coalesce(sum(old) FILTER (mask), 0) / (count(*) FILTER (mask) + {E8}) AS rlp,
coalesce(sum(old - logp) FILTER (mask), 0) AS kl, coalesce(sum(exp(logp - old) - (logp - old) - 1) FILTER (mask), 0) AS k3, coalesce(sum(exp(2 * {LR})) FILTER (mask), 0) AS c2, coalesce(sum(logp - old) FILTER (mask), 0) AS sd FROM tokens GROUP BY 1)
SELECT round(avg(exp(-lp)), 6) AS training_ppl, round(avg(exp(-rlp)), 6) AS rollout_ppl, round(avg(rlp - lp), 6) AS log_ppl_diff, round(avg(exp(rlp - lp)), 6) AS ppl_ratio, round(sum(kl) / (sum(m) + {E8}), 6) AS kl, round(sum(k3) / (sum(m) + {E8}), 6) AS k3_kl,
round(sum(c2) / (sum(m) + {E8}) - 1, 6) AS chi2_token, round(avg(exp(2 * least(greatest(sd, -20), 20))) - 1, 6) AS chi2_seq FROM p""")
def offpolicy_metrics(t):
    m = R.off_policy_metrics(t.tokens, ["seq"], F.col("logp"), F.col("old"), F.col("mask"))
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query(f"""WITH {TO}, d AS (SELECT *, 0.5::DOUBLE * {LR} * {LR} AS k2, CASE WHEN mask THEN least(exp({LR}), 2) ELSE 0 END AS w FROM tokens) SELECT seq, pos, mask AND coalesce(k2 <= 0.08::DOUBLE, false) AS kept, round(w, 6) AS is_weight FROM d""")
def rollout_correction(t):
    """Mask and weights in one call."""
    c = R.correct_rollouts(t.tokens, ["seq"], F.col("logp") - F.col("old"), F.col("mask"), {"token_k2": 0.08}, weights="token", threshold=2.0)
    return c.select("seq", "pos", "kept", r6("is_weight").alias("is_weight"))


@query(f"""WITH {TO}, d AS (SELECT *, mask AND exp({LR}) - 1 - {LR} <= 0.03::DOUBLE AS kept, CASE WHEN mask THEN least(exp({LR}), 2) ELSE 0 END AS w FROM tokens), l AS (SELECT seq, kept AS mask, -adv * w * logp AS x FROM d), {AGG}""")
def bypass_loss(t):
    """The policy that sampled is the old one: weights and mask come from it, the loss is REINFORCE's."""
    return _losses(G.bypass_loss(t.tokens, ["seq"], F.col("logp"), F.col("old"), F.col("adv"), F.col("mask"), "reinforce", {"token_k3": 0.03}, threshold=2.0, norm=7.0))


@query("SELECT k, low, high FROM (VALUES ('0.1_1.2', 0.1::DOUBLE, 1.2::DOUBLE), ('2', 0.5::DOUBLE, 2.0::DOUBLE), ('1.25', 0.8::DOUBLE, 1.25::DOUBLE)) AS v(k, low, high)")
def threshold_specs(t):
    """A driver's function: the specification is an option, not data."""
    return t.spark.createDataFrame([(k, *R.parse_threshold(k, k1=True)) for k in ("0.1_1.2", "2", "1.25")], "k string, low double, high double")
