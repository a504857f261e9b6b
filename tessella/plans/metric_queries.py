"""Queries of metrics: data, timing, validation, aggregation by name, balance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators import balance as L
from tessella.operators import batch as B
from tessella.operators import metrics as M
from tessella.operators import scheduler as Q
from tessella.plans.registry import query, r6
from tessella.session import dealt
from tessella.sources import sinks as W


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max, min(value) AS min, round(avg((value >= 490)::INT), 6) AS clip_ratio, round(avg((event_type = 'error')::INT), 6) AS aborted_ratio, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_live FROM events")
def data_metrics(t):
    v, err = F.col("value"), F.col("event_type") == "error"
    return t.events.agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(v)).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), r6(F.avg((v >= 490).cast("int"))).alias("clip_ratio"),
        r6(F.avg(err.cast("int"))).alias("aborted_ratio"), r6(F.avg(F.when(~err, v))).alias("mean_live"),
    )


@query("WITH {tokens} SELECT round(1 - var_samp(ret - value) / (var_samp(ret) + 0.00001::DOUBLE), 6) AS explained_variance FROM tokens WHERE mask")
def explained_variance(t):
    e = M.explained_variance(t.tokens.where("mask"), "ret", "value")
    return e.select(r6("explained_variance").alias("explained_variance"))


@query("SELECT event_type AS section, round(sum(value) * 1000 / sum(event_id % 50 + 1), 6) AS ms_per_token FROM events GROUP BY 1")
def timing_per_token(t):
    return t.events.groupBy(F.col("event_type").alias("section")).agg(r6(F.sum("value") * 1000 / F.sum(F.col("event_id") % 50 + 1)).alias("ms_per_token"))


@query("SELECT user_id, round(sum(event_id % 50 + 1) / (sum(value) * 8), 6) AS throughput FROM events GROUP BY 1")
def throughput(t):
    return t.events.groupBy("user_id").agg(r6(F.sum(F.col("event_id") % 50 + 1) / (F.sum("value") * 8)).alias("throughput"))


@query("""WITH {tokens}, s AS (SELECT seq, sum(adv * adv * value) FILTER (mask) / count(*) FILTER (mask) AS p1, sum(adv * adv) FILTER (mask) / count(*) FILTER (mask) AS a2, sum(value) FILTER (mask) / count(*) FILTER (mask) AS w FROM tokens GROUP BY 1 HAVING count(*) FILTER (mask) > 0)
SELECT round(avg(p1) * 1000, 6) AS proxy1, round(avg(a2) * 1000, 6) AS expected_a_squared, round(avg(w) * 1000, 6) AS expected_w, round(greatest(0, (avg(p1) - avg(a2) * avg(w)) / (count(*) - 1)) * 1000000, 4) AS noise FROM s""")
def variance_proxy(t):
    m = F.col("mask")
    k = F.count_if(m)
    s = t.tokens.groupBy("seq").agg(F.try_divide(F.sum(F.when(m, F.col("adv") * F.col("adv") * F.col("value"))), k).alias("p1"), F.try_divide(F.sum(F.when(m, F.col("adv") * F.col("adv"))), k).alias("a2"), F.try_divide(F.sum(F.when(m, F.col("value"))), k).alias("w"), k.alias("k")).where("k > 0")
    noise = F.greatest(F.lit(0.0), (F.avg("p1") - F.avg("a2") * F.avg("w")) / (F.count(F.lit(1)) - 1))
    return s.agg(r6(F.avg("p1") * 1000).alias("proxy1"), r6(F.avg("a2") * 1000).alias("expected_a_squared"), r6(F.avg("w") * 1000).alias("expected_w"), F.round(noise * 1000000, 4).alias("noise"))


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f, min_by(value, event_id) AS v FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS majority_pred, v AS majority_value FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def majority_vote(t):
    return M.majority_vote(t.events, ["user_id"], "event_type", "value", "event_id")


@query("""WITH {responses}, p AS (SELECT source, uid, avg(score) AS m, stddev_pop(score) AS s, count(*) AS n FROM responses GROUP BY 1, 2)
SELECT source, round(avg(m), 6) AS mean_at_n, round(avg(s), 6) AS std_at_n, max(n) AS n_max, count(*) AS n_prompts FROM p GROUP BY 1""")
def mean_at_n(t):
    m = M.mean_at_n(t.responses, "source", "uid", "score")
    return m.withColumns({"mean_at_n": r6("mean_at_n"), "std_at_n": r6("std_at_n")})


@query("""WITH {responses}, s AS (SELECT uid, score, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER (PARTITION BY uid ORDER BY score, seq) AS i FROM responses),
k AS (SELECT DISTINCT uid, n, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64], lambda x: x < n), n)) AS k FROM s WHERE n > 1)
SELECT s.uid, k.k::INT AS k, round(sum(score * (pow(i / s.n, k.k) - pow((i - 1) / s.n, k.k))), 6) AS best_mean, round(sum(score * (pow((s.n - i + 1) / s.n, k.k) - pow((s.n - i) / s.n, k.k))), 6) AS worst_mean FROM s JOIN k USING (uid) GROUP BY 1, 2""")
def best_of_k(t):
    return M.best_of_k(dealt(t.responses.select("uid", "seq", "score"), "uid"), ["uid"], "score", "seq").withColumns({"best_mean": r6("best_mean"), "worst_mean": r6("worst_mean")})


@query("""WITH {responses}, c AS (SELECT uid, count(*) AS n, count(*) FILTER (score > 2.5) AS c FROM responses GROUP BY 1) SELECT uid, round(1 - pow((n - c) / n, 4), 6) AS pass_at_4 FROM c""")
def pass_at_k_exact(t):
    return M.pass_at_k(t.responses, ["uid"], F.col("score") > 2.5, 4).withColumn("pass_at_4", r6("pass_at_4"))


@query("""WITH {responses}, v AS (SELECT source, uid, seq, 'score' AS variable, score AS x FROM responses UNION ALL SELECT source, uid, seq, 'length', length::DOUBLE FROM responses),
s AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY source, uid, variable ORDER BY x, seq) AS i FROM v WINDOW g AS (PARTITION BY source, uid, variable)),
k AS (SELECT DISTINCT source, uid, variable, n, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64], lambda x: x < n), n)) AS k FROM s WHERE n > 1),
b AS (SELECT s.source, s.uid, s.variable, k.k, sum(x * (pow(i / s.n, k.k) - pow((i - 1) / s.n, k.k))) AS best, sum(x * (pow((s.n - i + 1) / s.n, k.k) - pow((s.n - i) / s.n, k.k))) AS worst FROM s JOIN k ON s.source = k.source AND s.uid = k.uid AND s.variable = k.variable GROUP BY 1, 2, 3, 4),
p AS (SELECT source, uid, variable, avg(x) AS m, stddev_pop(x) AS sd, count(*) AS n FROM v GROUP BY 1, 2, 3),
a AS (SELECT source, variable, 'mean@' || n AS metric, m AS value FROM p UNION ALL SELECT source, variable, 'std@' || n, sd FROM p UNION ALL SELECT source, variable, 'best@' || k || '/mean', best FROM b UNION ALL SELECT source, variable, 'worst@' || k || '/mean', worst FROM b)
SELECT source, variable, metric, round(avg(value), 6) AS value FROM a GROUP BY 1, 2, 3""")
def validation_report(t):
    """All reducers of every numeric variable; the text variable `pred` is skipped."""
    return M.validation_report(t.responses, "source", "uid", "seq").withColumn("value", r6("value"))


@query()
def majority_at_k(t):
    """Seeded resamples: no SQL; a test holds them against exact shares."""
    return M.majority_at_k(t.responses, "source", "uid", "pred", "score", "seq")


@query()
def bootstrap_best_n(t):
    """Seeded resamples: rows only; a test compares the means with best_of_k."""
    import numpy as np

    return M.bootstrap(t.responses, ["uid"], "score", 4, {"best": np.max, "worst": np.min})


@query("""SELECT var AS name, CASE WHEN var IN ('acc', 'reward') THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || var AS routed FROM (SELECT DISTINCT o_orderpriority AS source FROM orders), (SELECT unnest(['acc', 'reward', 'length']) AS var)""")
def metric_routing(t):
    names = t.orders.select(F.col("o_orderpriority").alias("source")).distinct().withColumn("name", F.explode(F.array(*map(F.lit, ("acc", "reward", "length")))))
    return names.select("name", F.concat(F.when(F.col("name").isin("acc", "reward"), "val-core").otherwise("val-aux"), F.lit("/"), "source", F.lit("/"), "name").alias("routed"))


@query("SELECT event_type, round(avg((value > 400)::INT), 6) AS clip_ratio, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")
def clip_ratio_rollup(t):
    return t.events.rollup("event_type").agg(r6(F.avg((F.col("value") > 400).cast("int"))).alias("clip_ratio"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top FROM events GROUP BY 1")
def partial_final_merge(t):
    half = [t.events.where(F.col("event_id") % 2 == i).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")) for i in (0, 1)]
    return half[0].unionByName(half[1]).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"), F.max("top").alias("top"))


NAMED = "m AS (SELECT event_id AS step, value, (['actor/kl_max', 'actor/grad_min', 'critic/score', 'timing_s/step', 'perf/total_tokens', 'perf/mfu_weighted_avg'])[event_id % 6 + 1] AS name FROM events)"


def _named(t):
    names = F.array(*map(F.lit, ("actor/kl_max", "actor/grad_min", "critic/score", "timing_s/step", "perf/total_tokens", "perf/mfu_weighted_avg")))
    return t.events.select(F.col("event_id").alias("step"), "value", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("name"), (F.col("event_id") % 7 + 1).alias("weight"))


@query(f"WITH {NAMED} SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END, 6) AS reduced FROM m GROUP BY 1")
def reduce_metrics(t):
    return M.reduce_by_name(_named(t), "name", "value").withColumn("reduced", r6("reduced"))


@query(f"""WITH {NAMED} SELECT name, CASE WHEN name LIKE '%timing_s/%' THEN 'sum' WHEN name LIKE '%mean%' OR name LIKE '%avg%' THEN 'avg' WHEN name LIKE '%max%' THEN 'max' WHEN name LIKE '%min%' THEN 'min' WHEN name LIKE '%total%' THEN 'sum' WHEN name = 'critic/score' THEN 'last' ELSE 'avg' END AS rule,
round(CASE WHEN name LIKE '%timing_s/%' THEN sum(value) WHEN name LIKE '%avg%' THEN avg(value) WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) WHEN name LIKE '%total%' THEN sum(value) ELSE max_by(value, step) END, 2) AS value FROM m GROUP BY 1""")
def metrics_aggregator(t):
    return M.aggregate_metrics(_named(t), "name", "value", "weight", "step", last=("critic/score",)).withColumn("value", F.round("value", 2))


@query("""WITH m AS (SELECT event_type AS name, event_id % 4 AS rank, (['sum', 'mean', 'max', 'min'])[user_id % 4 + 1] AS how, value / 0.97::DOUBLE AS value FROM events), r AS (SELECT name, how, rank, CASE how WHEN 'sum' THEN sum(value) WHEN 'mean' THEN avg(value) WHEN 'max' THEN max(value) ELSE min(value) END AS v FROM m GROUP BY 1, 2, 3)
SELECT name, how, round(CASE WHEN how IN ('sum', 'mean') THEN avg(v) WHEN how = 'max' THEN max(v) ELSE min(v) END, 5) AS merged FROM r GROUP BY 1, 2""")
def metric_dp_merge(t):
    how = F.element_at(F.array(*map(F.lit, ("sum", "mean", "max", "min"))), (F.col("user_id") % 4 + 1).cast("int"))
    m = t.events.select(F.col("event_type").alias("name"), (F.col("event_id") % 4).alias("rank"), how.alias("how"), (F.col("value") / 0.97).alias("value"))
    return M.dp_merge(m, "name", "rank", "how", "value").withColumn("merged", F.round("merged", 5))


@query("SELECT event_type, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(t):
    p = M.latency_percentiles(t.events, ["event_type"], "value")
    return p.select("event_type", *[r6(c).alias(c) for c in p.columns[1:]])


@query("""WITH d AS (SELECT source, text, doc_id FROM documents), p AS (SELECT source, avg((length(text) > 1000)::INT) AS m FROM d GROUP BY 1) SELECT source, round(m, 6) AS mean_score FROM p""")
def offline_eval(t):
    scored = t.documents.select("source", F.array("text").alias("responses")).select("source", F.transform("responses", lambda r: (F.length(r) > 1000).cast("double")).alias("scores"))
    per = scored.select("source", (F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) / F.size("scores")).alias("m"))
    return per.groupBy("source").agg(r6(F.avg("m")).alias("mean_score"))


@query("WITH {tokens} SELECT round(corr(logp, old), 6) AS pearson, round(max(abs(exp(logp) - exp(old))), 6) AS max_diff, round(avg(abs(exp(logp) - exp(old))), 6) AS mean_diff, round(stddev_samp(abs(exp(logp) - exp(old))), 6) AS std_diff FROM tokens WHERE mask")
def pearson_corr(t):
    d = F.abs(F.exp("logp") - F.exp("old"))
    return t.tokens.where("mask").agg(r6(F.corr("logp", "old")).alias("pearson"), r6(F.max(d)).alias("max_diff"), r6(F.avg(d)).alias("mean_diff"), r6(F.stddev_samp(d)).alias("std_diff"))


@query("WITH {tokens} SELECT seq, count(*) FILTER (reward <> value) AS n_diff FROM tokens GROUP BY 1")
def token_diff_count(t):
    return t.tokens.groupBy("seq").agg(F.count_if(F.col("reward") != F.col("value")).alias("n_diff"))


@query("WITH p AS (SELECT o_orderkey % 8 AS part, sum(o_orderkey % 97 + 1) AS n FROM orders GROUP BY 1) SELECT min(n)::BIGINT AS min, max(n)::BIGINT AS max, (max(n) - min(n))::BIGINT AS diff, avg(n) AS mean FROM p")
def seqlen_unbalance(t):
    return L.unbalance(t.responses.withColumn("part", F.col("seq") % 8), "length", "part")


@query("SELECT o_orderkey, 24576 * (o_orderkey % 97 + 1) + (o_orderkey % 97 + 1) * (o_orderkey % 97 + 1) AS cost FROM orders")
def workload(t):
    return t.responses.select(F.col("seq").alias("o_orderkey"), T.workload(F.col("length")).alias("cost"))


@query()
def kk_partition(t):
    """The differencing heuristic has no SQL; tests check spread and that each row has one place."""
    batches = t.responses.withColumn("batch", F.floor(F.col("seq") / 256))
    return L.balance_batches(batches, "batch", "seq", "length", 8)


@query()
def micro_batches(t):
    """Micro-batches of at most 2000 tokens or so: no SQL; a test holds their number, cost and order."""
    return L.micro_batch_rows(t.responses.withColumn("batch", F.floor(F.col("seq") / 256)), "batch", "seq", "length", 2000)


@query()
def group_partition(t):
    """Four parts of each batch, prompts kept together: no SQL; a test holds that no run is split."""
    r = t.responses.withColumn("batch", F.floor(F.col("seq") / 256)).withColumn("run", F.floor(F.col("seq") / 4))
    return L.grouped_rows(r, "batch", "seq", "run", "length", 4)


@query("""SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value > b""")
def best_checkpoint(t):
    return M.best_so_far(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("SELECT min(value) AS time_min, max(value) AS time_max, round(avg(value), 6) AS time_mean, (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 1) AS slowest_event_id, (SELECT user_id FROM events ORDER BY value DESC, event_id LIMIT 1) AS slowest_user_id FROM events")
def slowest_sample(t):
    return M.slowest(t.events, F.col("value"), "event_id", ["user_id"]).withColumn("time_mean", r6("time_mean"))


@query("SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.value > 480)")
def zero_acc_group_filter(t):
    """Rollouts of prompts of which at least one rollout is right."""
    return M.any_right(t.events, "user_id", F.col("value") > 480).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 489)")
def semi_any_correct(t):
    return M.any_right(t.events, "user_id", F.col("value") > 489).select("event_id")


@query("WITH r AS (SELECT avg((value >= 400)::INT) AS ratio FROM events) SELECT event_id, value FROM events, r WHERE value >= 400 AND ratio >= 0.01")
def clipped_samples(t):
    return M.clipped(t.events, F.col("value"), 400, 0.01).select("event_id", "value")


@query("WITH {tokens}, l AS (SELECT seq, sum(mask::INT) AS n FROM tokens GROUP BY 1) SELECT round(avg(n), 6) AS mean_length, max(n)::BIGINT AS max_length, round(avg((n >= 5)::INT), 6) AS clip_ratio FROM l")
def response_lengths(t):
    n = t.tokens.groupBy("seq").agg(F.count_if("mask").alias("n"))
    return n.agg(r6(F.avg("n")).alias("mean_length"), F.max("n").alias("max_length"), r6(F.avg((F.col("n") >= 5).cast("int"))).alias("clip_ratio"))


@query("WITH p AS (SELECT event_type, user_id, avg((value > 245)::INT) AS rho FROM events GROUP BY 1, 2) SELECT event_type, round(avg(rho), 6) AS success_rate, count(*) AS n_prompts FROM p GROUP BY 1")
def cluster_success_rate(t):
    from tessella.operators.scheduler import cluster_rates, success_rates

    r = success_rates(t.events, "event_type", "user_id", (F.col("value") > 245).cast("int"))
    return cluster_rates(r, "event_type").withColumn("success_rate", r6("success_rate"))


RATES = "p AS (SELECT event_type, user_id, avg((value > 245)::INT) AS rho FROM events GROUP BY 1, 2), r AS (SELECT event_type, avg(rho) AS r FROM p GROUP BY 1)"


@query(f"WITH {RATES} SELECT event_type, round(CASE WHEN (SELECT sum(r) FROM r) > 0 THEN r / (SELECT sum(r) FROM r) ELSE 1.0 / (SELECT count(*) FROM r) END, 6) AS prob FROM r")
def cluster_target_prob(t):
    return Q.target_probabilities(_rates(t), "event_type").select("event_type", r6("target").alias("prob"))


def _rho(t):
    return Q.success_rates(t.events, "event_type", "user_id", (F.col("value") > 245).cast("int"))


def _rates(t):
    return Q.cluster_rates(_rho(t), "event_type")


@query(f"WITH {RATES}, h AS (SELECT event_type, r / (SELECT sum(r) FROM r) AS t FROM r), e AS (SELECT event_type, 0.7::DOUBLE * (1.0::DOUBLE / (SELECT count(*) FROM h)) + 0.3::DOUBLE * t AS p FROM h) SELECT event_type, round(p / (SELECT sum(p) FROM e), 6) AS prob, round((SELECT -sum((p / (SELECT sum(p) FROM e)) * ln(p / (SELECT sum(p) FROM e) + 1e-12)) FROM e), 6) AS entropy FROM e")
def ema_prob(t):
    p = Q.smoothed_probabilities(Q.target_probabilities(_rates(t), "event_type"), "event_type", 0.3)
    return p.select("event_type", r6("prob").alias("prob"), r6("entropy").alias("entropy"))


@query(f"WITH {RATES} SELECT CASE WHEN rho < 0.33::DOUBLE THEN 'easier' WHEN rho > 0.67::DOUBLE THEN 'harder' ELSE 'keep' END AS band, count(*) AS n FROM p GROUP BY 1")
def band_counts(t):
    return Q.bands(_rho(t)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("WITH q AS (SELECT user_id, count(*) AS produced, count(*) FILTER (event_type = 'view') AS consumed FROM events GROUP BY 1) SELECT user_id, produced, consumed, least(produced - consumed, 20) AS waiting, produced - consumed - least(produced - consumed, 20) AS dropped FROM q")
def queue_stats(t):
    from tessella.streaming import rollouts as S

    return S.queue_stats(t.events, "user_id", 20, F.col("event_type") == "view")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def bounded_queue(t):
    from tessella.streaming import rollouts as S

    return S.keep_last(t.events.select("event_id", "user_id"), "user_id", "event_id", 10)


@query("SELECT count(*) AS n, count(*) FILTER (event_id // 100 - event_id // 250 >= 1) AS n_stale, max(event_id // 100 - event_id // 250) AS max_lag FROM events")
def staleness(t):
    from tessella.streaming import rollouts as S

    return S.staleness(t.events, F.floor(F.col("event_id") / 100), F.floor(F.col("event_id") / 250))


@query("SELECT event_id % 512 AS slot, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1")
def replay_ring(t):
    from tessella.streaming import rollouts as S

    return S.replay_ring(t.events.select("event_id", "value"), "event_id", 512)


@query()
def replay_sample(t):
    """Sixty-four slots of the ring without replacement: seeded, no SQL; a test holds their number."""
    from tessella.streaming import rollouts as S

    return S.replay_sample(S.replay_ring(t.events.select("event_id", "value"), "event_id", 512), 64, 5).select("slot", "event_id")


@query("WITH i AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events) SELECT event_id, row_idx // 300 AS step, count(*) OVER (PARTITION BY row_idx // 300) = 300 AS complete FROM i")
def assemble_steps(t):
    from tessella.streaming import rollouts as S

    return S.assemble(B.with_row_index(t.events.select("event_id"), "event_id"), 300).select("event_id", "step", "complete")


@query("SELECT event_id FROM events WHERE event_id <= 0 OR event_id % 500 = 0")
def snapshot_steps(t):
    from tessella.streaming import rollouts as S

    return S.snapshot_steps(t.events.select("event_id"), "event_id", 500)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    from tessella.streaming import rollouts as S

    w = S.windowed_counts(t.events, "ts", "event_type", "value", "1 day")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def _schedule(t, steps: int):
    """A schedule over the embeddings' clusters, driven by a fixed rule of success: (scheduler, the batches it emitted)."""
    from tessella.operators.scheduler import Scheduler

    sizes = {r["label"]: r["n"] for r in t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cluster
    s = Scheduler(sizes, batch=8, active=3)
    emitted = []
    for step in range(steps):
        batch = s.emit()
        emitted += [(step, c, p) for c, p in batch]
        rho: dict[int, dict[int, float]] = {}
        for c, p in batch:
            rho.setdefault(c, {})[p] = ((c * 31 + p * 17 + step * 7) % 10) / 9
        s.update(rho)
    return s, emitted


@query()
def scheduler_state(t):
    """State after twenty steps (the generator draws the clusters: no SQL; tests replay the transitions)."""
    s, _ = _schedule(t, 20)
    rows = [(c, s.sizes[c], s.rate[c], s.prob[c], s.positions[c]) for c in sorted(s.sizes)]
    return t.spark.createDataFrame(rows, "cluster_id int, cluster_size long, success_rate double, prob double, mini_positions array<long>")


@query()
def weighted_sample(t):
    """Clusters drawn by probability without replacement, and their positions, for five steps."""
    return t.spark.createDataFrame(_schedule(t, 5)[1], "step int, cluster_id int, position int")


@query("SELECT event_id, value FROM events WHERE event_id < 500 UNION ALL SELECT event_id, value FROM events WHERE event_id >= 500 AND length(props) <= 9")
def dynamic_append(t):
    """Rows that are added after a step pass the length filter first."""
    first, later = t.events.where("event_id < 500"), t.events.where("event_id >= 500")
    return B.append_rows(first, later, F.length("props"), 9).select("event_id", "value")


@query("""WITH p AS (SELECT conv_id, min_by(text, turn) AS prompt, max_by(text, turn) AS chosen, max_by(text, turn) FILTER (role = 'user') AS rejected FROM conversations GROUP BY 1)
SELECT conv_id, 1 AS is_chosen, md5(prompt || chr(10) || chosen) AS text FROM p UNION ALL SELECT conv_id, 0, md5(prompt || chr(10) || rejected) FROM p""")
def preference_pairs(t):
    """Of each conversation, its first text with its last one (chosen) and with the user's last one (rejected)."""
    p = t.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"), F.max_by("text", "turn").alias("chosen"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("rejected"))
    return W.preference_pairs(p, "conv_id", "prompt", "chosen", "rejected").withColumn("text", F.md5("text"))


@query("SELECT doc_id, md5('0:' || source || '|1:' || lang || '|2:' || doc_id) AS responses FROM documents")
def generation_table(t):
    """Three samples of each prompt, generated outside in any order, folded back as its responses."""
    d = t.documents.select("doc_id", "source", "lang")
    g = B.repeat_by(d, F.lit(3)).repartition("copy").select("doc_id", F.col("copy").alias("sample"), F.concat(F.col("copy").cast("string"), F.lit(":"), F.element_at(F.array("source", "lang", F.col("doc_id").cast("string")), F.col("copy") + 1)).alias("response"))
    return W.generation_table(d, g, "doc_id", 3).select("doc_id", F.md5(F.array_join("responses", "|")).alias("responses"))


@query("SELECT user_id, array_to_string(list(event_type ORDER BY event_id), ',') AS responses, count(*) AS n FROM events GROUP BY 1")
def collect_responses(t):
    s = F.sort_array(F.collect_list(F.struct("event_id", "event_type")))
    return t.events.groupBy("user_id").agg(s.alias("s"), F.count(F.lit(1)).alias("n")).select("user_id", F.array_join(F.col("s")["event_type"], ",").alias("responses"), "n")
