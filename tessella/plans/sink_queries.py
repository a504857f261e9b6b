"""Queries of writers and their readers: each writes to a folder beside the checkpoints and returns what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import terms
from tessella.operators import batch as B
from tessella.plans.registry import query, r6
from tessella.sources import io
from tessella.sources import sinks as W


@query("SELECT count(*) AS n_rows, max(doc_id) AS last_id, (SELECT min(doc_id) FROM documents) AS example_id FROM documents")
def sink_summary(t):
    folder = io.work_folder(t.spark, "summary")
    W.write_example_and_summary(t.documents.select("doc_id", "source"), folder, "doc_id", last_id=F.max("doc_id"))
    summary, example = t.spark.read.json(f"{folder}/summary"), t.spark.read.json(f"{folder}/example").select(F.col("doc_id").alias("example_id"))
    return summary.crossJoin(F.broadcast(example)).select("n_rows", "last_id", "example_id")  # one row each


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, 2.0::DOUBLE * embedding[1]::DOUBLE AS other FROM embeddings")
def sink_embeddings(t):
    folder = io.work_folder(t.spark, "embeddings")
    e = t.embeddings.withColumn("twice", F.transform("embedding", lambda x: x.cast("double") * 2))
    W.write_embeddings(e, folder, "vec_id", "embedding", "twice")
    a, b = t.spark.read.parquet(f"{folder}/embeddings"), t.spark.read.parquet(f"{folder}/auxiliary")
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    return a.join(b, "vec_id").select("vec_id", total.alias("total"), F.get("twice", F.lit(0)).alias("other"))


@query("SELECT vec_id, label, embedding[1]::DOUBLE AS reduced, (SELECT count(DISTINCT label) FROM embeddings) AS n_clusters FROM embeddings")
def sink_clustering(t):
    folder = io.work_folder(t.spark, "clustering")
    own = t.embeddings.select("vec_id", "label", F.array(F.get("embedding", F.lit(0)).cast("double")).alias("reduced"))
    W.write_clustering(own, folder, "vec_id", reduced="reduced", stats=own.agg(F.countDistinct("label").alias("n_clusters")))
    read = lambda x: t.spark.read.parquet(f"{folder}/{x}")
    both = read("assignments").join(read("reduced"), "vec_id").select("vec_id", "label", F.get("reduced", F.lit(0)).alias("reduced"))
    return both.crossJoin(F.broadcast(t.spark.read.json(f"{folder}/stats")))  # one row


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IS NOT NULL")
def sink_examples(t):
    folder = io.work_folder(t.spark, "examples")
    W.write_examples(t.documents.where("lang is not null").select("doc_id", "lang", "n_chars"), folder, ["lang", "doc_id"], parquet=True)
    a, b = t.spark.read.json(f"{folder}/examples_json"), t.spark.read.parquet(f"{folder}/examples_parquet")
    return b.join(a.select("doc_id"), "doc_id")


@query()
def sink_terms(t):
    """Top terms and distinctiveness by language, through CSV and JSON; tests/test_sinks.py holds them against what was written."""
    folder = io.work_folder(t.spark, "terms")
    w = terms.ctfidf(t.documents.where("lang is not null"), "lang", "text", (), 2, min_df=1, max_df=1.0).withColumn("weight", F.round("weight", 9))
    W.write_terms(terms.top_terms(w, "lang", 10), terms.distinctiveness(w, "lang", 10), folder, "lang")
    top = t.spark.read.option("header", True).option("escape", "\"").csv(f"{folder}/top_terms")
    return top.join(t.spark.read.json(f"{folder}/distinctiveness"), "lang").select("lang", "term", F.col("rank").cast("int").alias("rank"), r6("distinctiveness").alias("distinctiveness"))


@query("SELECT event_id AS step, event_type AS name, value FROM events UNION ALL SELECT event_id, 'twice', value * 2 FROM events")
def metric_log(t):
    folder = io.work_folder(t.spark, "metrics")
    rows = t.events.select(F.col("event_id").alias("step"), F.explode(F.map_from_arrays(F.array("event_type", F.lit("twice")), F.array("value", F.col("value") * 2))).alias("name", "value"))
    for half in (0, 1):  # two batches of a stream
        W.log_metrics(rows.where(F.col("step") % 2 == half), folder, "step")
    return W.read_metrics(t.spark, folder, "step")


@query("SELECT doc_id AS row_idx, source, lang AS kept, 3 AS step FROM documents WHERE lang IS NOT NULL")
def dump_generations(t):
    """Of two extra columns, the one as long as the rows is written; the other isn't."""
    folder = io.work_folder(t.spark, "dump")
    d = t.documents.where("lang is not null").select(F.col("doc_id").alias("row_idx"), "source", F.col("lang").alias("value"))
    W.dump_generations(d.select("row_idx", "source"), folder, 3, {"kept": d.select("row_idx", "value"), "short": d.where("row_idx % 2 = 0").select("row_idx", "value")})
    return t.spark.read.json(f"{folder}/3").select("row_idx", "source", "kept", F.col("step").cast("int").alias("step"))


@query("SELECT doc_id, source FROM documents")
def cached_generations(t):
    """The second call replays what the first one kept, and would fail if it generated again."""
    folder = io.work_folder(t.spark, "cache")
    W.cached(t.spark, folder, "step 1 / n=2", lambda: t.documents.select("doc_id", "source"))
    return W.cached(t.spark, folder, "step 1 / n=2", lambda: t.spark.sql("SELECT raise_error('generated again')"))


@query("SELECT doc_id, lang FROM documents")
def local_copy(t):
    return t.spark.read.parquet(W.local_copy(t.spark, f"{t.sf_dir}/documents.parquet", io.work_folder(t.spark, "copies"))).select("doc_id", "lang")


@query("WITH r AS (SELECT event_id, event_id // 100 AS step, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS row, user_id, props FROM events) SELECT step, row, event_id::VARCHAR AS event_id, regexp_replace(props, '[0-9]', '*', 'g') AS props FROM r")
def rollout_log_scan(t):
    """A file for each hundred events, named by number; digits of `props` are masked."""
    folder = io.work_folder(t.spark, "log")
    rows = t.events.select(F.floor(F.col("event_id") / 100).cast("long").alias("step"), "event_id", "props")
    W.write_log(rows, folder, "step", "event_id")
    r = W.log_rows(t.spark, folder, mask=None)
    f = lambda k: F.element_at("fields", k)
    return r.select("step", F.col("row").cast("long").alias("row"), f("event_id").alias("event_id"), F.regexp_replace(f("props"), "[0-9]", "*").alias("props"))


@query("SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || '=' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def sft_scan(t):
    """Conversations as nested messages in two files, read as one table."""
    folder = io.work_folder(t.spark, "sft")
    m = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    nested = t.conversations.groupBy("conv_id").agg(m.alias("messages"))
    for half in (0, 1):
        nested.where(F.col("conv_id") % 2 == half).write.parquet(f"{folder}/{half}.parquet")
    read = io.load_many(t.spark, [f"{folder}/{half}.parquet" for half in (0, 1)])
    lines = F.transform("messages", lambda x: F.concat(x["role"], F.lit("="), x["content"]))
    return read.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(lines, "|")).alias("digest"))


@query("SELECT row_idx, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders)")
def batch_round_trip(t):
    """A batch with its order, written and read again."""
    path = f"{io.work_folder(t.spark, 'batch')}/orders.parquet"
    io.write_verified(B.with_row_index(t.orders.select("o_orderkey"), "o_orderkey"), path)
    return t.spark.read.parquet(path)
