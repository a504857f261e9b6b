"""Queries of the batch algebra: row addressing, unions, repeats, chunks, padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import batch as B
from tessella.plans.registry import Tables, query, r6

IDX = "i AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders)"


def _orders(t: Tables):
    return B.with_row_index(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), "o_orderkey")


@query(f"WITH {IDX} SELECT o_orderkey, row_idx FROM i")
def row_index(t):
    return _orders(t).select("o_orderkey", "row_idx")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def batch_select(t):
    return B.select_columns(t.orders, ["o_orderkey", "o_orderstatus"])


@query(f"WITH {IDX}, n AS (SELECT count(*) AS n FROM i), p AS (SELECT row_idx AS out_pos, row_idx * 7919 % n AS row_idx FROM i, n) SELECT out_pos, o_orderkey FROM p JOIN i USING (row_idx)")
def batch_select_idxs(t):
    """A gather as long as the batch, over all of its rows."""
    o = _orders(t)
    n = o.count()
    p = o.select(F.col("row_idx").alias("out_pos"), (F.col("row_idx") * 7919 % n).alias("row_idx"))
    return B.take_rows(o, p).select("out_pos", "o_orderkey")


@query(f"""WITH {IDX}, n AS (SELECT count(*) AS n FROM i) SELECT 'slice' AS how, row_idx AS out_pos, o_orderkey FROM i WHERE row_idx >= 5 AND row_idx % 2 = 1 UNION ALL SELECT 'int', 0, o_orderkey FROM i, n WHERE row_idx = n - 3
UNION ALL SELECT 'list', p.k, o_orderkey FROM (VALUES (0, 4), (1, 2), (2, 4), (3, -1)) AS p(k, x), n JOIN i ON i.row_idx = CASE WHEN p.x < 0 THEN p.x + n.n ELSE p.x END""")
def batch_getitem(t):
    """By a slice, a negative integer and a list with a repeat and a negative place."""
    o = _orders(t)
    parts = [B.get_item(o, slice(5, None, 2)).withColumn("out_pos", F.col("row_idx")), B.get_item(o, -3).withColumn("out_pos", F.lit(0).cast("long")), B.get_item(o, [4, 2, 4, -1])]
    named = [x.select(F.lit(how).alias("how"), "out_pos", "o_orderkey") for how, x in zip(("slice", "int", "list"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SELECT coalesce(a.k, b.k) AS key, coalesce(a.v, b.v) AS value FROM (SELECT n_name AS k, n_regionkey AS v FROM nation WHERE n_nationkey % 3 < 2) a FULL JOIN (SELECT n_name AS k, n_regionkey AS v FROM nation WHERE n_nationkey % 3 > 0) b ON a.k = b.k")
def meta_union(t):
    n = t.nation.select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"), F.col("n_nationkey") % 3)
    n = n.toDF("key", "value", "m")
    return B.union_meta_tables(n.where("m < 2").drop("m"), n.where("m > 0").drop("m"), "key", "value")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS index, '{}' AS tools_kwargs FROM documents")
def extra_defaults(t):
    d = t.documents.select("doc_id", F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("index")).alias("extra_info"))
    return B.with_defaults(d, "extra_info", {"index": F.lit(0).cast("long"), "tools_kwargs": F.lit("{}")}).select("doc_id", "index", "tools_kwargs")


@query(f"WITH {IDX} SELECT row_idx // 5 * 2 + c AS out_idx, o_orderkey, 'g' || (row_idx // 5 * 2 + c) AS generated FROM i, (VALUES (0), (1)) AS k(c) WHERE row_idx % 5 = 0")
def replay_probe(t):
    """Every fifth row, twice each, beside what was generated for it."""
    o = _orders(t)
    p = o.where("row_idx % 5 = 0").select(F.floor(F.col("row_idx") / 5).cast("long").alias("out_pos"), "row_idx")
    generated = p.select(F.explode(F.array(F.col("out_pos") * 2, F.col("out_pos") * 2 + 1)).alias("out_idx")).withColumn("generated", F.concat(F.lit("g"), F.col("out_idx").cast("string")))
    return B.replay_rows(o, p, 2, generated).select("out_idx", "o_orderkey", "generated")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def batch_mask(t):
    return B.mask_rows(t.orders, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey")


@query(f"WITH {IDX}, n AS (SELECT count(*) AS n FROM i) SELECT o_orderkey, row_idx FROM i, n WHERE row_idx >= 10 AND row_idx < n - 20 AND (row_idx - 10) % 3 = 0")
def batch_slice(t):
    return B.slice_rows(_orders(t), 10, -20, 3).select("o_orderkey", "row_idx")


@query("SELECT o_orderkey, o_custkey, o_totalprice, p.o_orderstatus AS popped FROM orders JOIN (SELECT o_orderkey, o_orderstatus FROM orders) p USING (o_orderkey)")
def batch_pop(t):
    popped, rest = B.pop_columns(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"])
    return rest.join(popped.withColumnRenamed("o_orderstatus", "popped"), "o_orderkey")


@query("SELECT c_custkey AS uid, c_acctbal AS score FROM customer")
def batch_rename(t):
    return B.rename_columns(t.customer.select("c_custkey", "c_acctbal"), ["c_custkey", "c_acctbal"], ["uid", "score"])


PERM = f"{IDX}, n AS (SELECT count(*) AS n FROM i), perm AS (SELECT n - 1 - row_idx AS pos, row_idx AS idx FROM i, n)"


@query(f"WITH {PERM} SELECT pos AS out_pos, o_orderkey FROM perm JOIN i ON i.row_idx = perm.idx")
def batch_reorder(t):
    o = _orders(t)
    n = o.count()
    return B.take_rows(o, o.select((F.lit(n - 1) - F.col("row_idx")).alias("out_pos"), "row_idx")).select("out_pos", "o_orderkey")


@query(f"WITH {IDX} SELECT (row_idx * 7 + 3) % 15 + row_idx // 15 * 15 AS pos, row_idx AS idx FROM i")
def inverse_permutation(t):
    perm = _orders(t).select(F.col("row_idx").alias("pos"), ((F.col("row_idx") * 7 + 3) % 15 + F.floor(F.col("row_idx") / 15) * 15).cast("long").alias("idx"))
    return B.inverse_permutation(perm)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def batch_union(t):
    return B.union_batches(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderkey"])


@query("""SELECT 'score' AS "column", count(*) FILTER (o_totalprice IS DISTINCT FROM CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END)::BIGINT AS n_conflicts FROM orders
UNION ALL SELECT 'gap', count(*) FILTER (false)::BIGINT FROM orders""")
def conflict_check(t):
    a = t.orders.select("o_orderkey", F.col("o_totalprice").alias("score"), F.lit(float("nan")).alias("gap"))
    b = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("score"), F.lit(float("nan")).alias("gap"))
    return B.conflicts(a, b, ["o_orderkey"], ["score", "gap"])


@query("SELECT c_custkey AS id, c_acctbal AS score, CAST(NULL AS VARCHAR) AS tag, 0 AS batch_no FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name, 1 FROM supplier")
def batch_concat(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.col("s_name").alias("tag"))
    return B.concat_batches([a, b]).select("id", "score", "tag", "batch_no")


@query(f"WITH {IDX}, c AS (SELECT unnest(range(3)) AS k) SELECT o_orderkey, k::INT AS copy, row_idx * 3 + k AS out_idx FROM i, c")
def repeat_interleave(t):
    return B.repeat_rows(_orders(t), 3).select("o_orderkey", "copy", "out_idx")


@query(f"WITH {IDX}, n AS (SELECT count(*) AS n FROM i), c AS (SELECT unnest(range(3)) AS k) SELECT o_orderkey, k::INT AS copy, k * n + row_idx AS out_idx FROM i, n, c")
def repeat_tile(t):
    return B.repeat_rows(_orders(t), 3, interleave=False).select("o_orderkey", "copy", "out_idx")


@query("SELECT o_orderkey, k::INT AS copy FROM (SELECT o_orderkey, unnest(range(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 0 ELSE 1 END)) AS k FROM orders)")
def repeat_by_source(t):
    n = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    return B.repeat_by(t.orders, n).select("o_orderkey", "copy")


@query(f"WITH {IDX}, n AS (SELECT count(*) AS n FROM i) SELECT o_orderkey, (row_idx // (n // 5))::INT AS chunk FROM i, n")
def batch_chunk(t):
    o = _orders(t)
    return B.chunk_rows(o, 5, o.count()).select("o_orderkey", "chunk")


@query(f"WITH {IDX} SELECT o_orderkey, (row_idx // 64)::INT AS part FROM i")
def batch_split(t):
    return B.split_rows(_orders(t), 64).select("o_orderkey", "part")


@query(f"""WITH {IDX}, n AS (SELECT count(*) AS n, (-count(*) % 64 + 64) % 64 AS pad FROM i)
SELECT o_orderkey, row_idx, false AS padded FROM i UNION ALL SELECT o_orderkey, row_idx + n, true FROM i, n WHERE row_idx < pad""")
def pad_to_divisor(t):
    o = _orders(t)
    return B.pad_to_divisor(o, 64, o.count()).select("o_orderkey", "row_idx", "padded")


@query(f"WITH {IDX}, n AS (SELECT count(*) AS n FROM i) SELECT o_orderkey, row_idx FROM i UNION ALL SELECT o_orderkey, n + k FROM i, n, (SELECT unnest(range(5)) AS k) WHERE row_idx = n - 1")
def pad_with_last(t):
    o = _orders(t)
    return B.pad_with_row(o, 5, o.count(), "last").select("o_orderkey", "row_idx")


@query(f"WITH {IDX} SELECT o_orderkey, (ntile(7) OVER (ORDER BY row_idx) - 1)::INT AS shard FROM i")
def contiguous_shard(t):
    o = _orders(t)
    return B.contiguous_shards(o, 7, o.count()).select("o_orderkey", "shard")


@query(f"""WITH {IDX} SELECT row_idx // 100 AS batch_id, array_to_string(list(o_orderkey ORDER BY row_idx), ',') AS keys, array_to_string(list(o_orderstatus ORDER BY row_idx), ',') AS statuses FROM i GROUP BY 1""")
def collate_batches(t):
    c = B.collate(_orders(t), 100, ["o_orderkey", "o_orderstatus"])
    return c.select("batch_id", F.array_join("o_orderkey", ",").alias("keys"), F.array_join("o_orderstatus", ",").alias("statuses"))


@query("""SELECT c_custkey, 'actor/balance' AS metric, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'actor/nation', c_nationkey::DOUBLE FROM customer""")
def unpivot_metrics(t):
    return t.customer.select("c_custkey", F.col("c_acctbal").alias("actor/balance"), F.col("c_nationkey").cast("double").alias("actor/nation")).unpivot("c_custkey", ["actor/balance", "actor/nation"], "metric", "value")


@query(f"WITH {IDX} SELECT row_idx // 4 AS batch_id, array_to_string(list(o_orderkey ORDER BY row_idx), ',') AS folded FROM i GROUP BY 1")
def fold_batch(t):
    return B.collate(_orders(t), 4, ["o_orderkey"]).select("batch_id", F.array_join("o_orderkey", ",").alias("folded"))


@query("SELECT vec_id, k::INT AS part, round(list_sum(list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: x::DOUBLE)), 6) AS part_sum FROM embeddings, (SELECT unnest(range(4)) AS k)")
def unfold_chunks(t):
    u = B.unfold_chunks(t.embeddings, "embedding", 4)
    return u.select("vec_id", "part", r6(F.aggregate("embedding_part", F.lit(0.0), lambda s, x: s + x)).alias("part_sum"))


@query(f"WITH {IDX}, n AS (SELECT count(*) AS n FROM i) SELECT o_orderkey, (CASE WHEN row_idx % 2 = 0 THEN row_idx // 2 ELSE n - 1 - row_idx // 2 END)::BIGINT AS place FROM i, n")
def zigzag_order(t):
    o = _orders(t)
    return o.select("o_orderkey", B.zigzag_order(F.lit(o.count()), F.col("row_idx")).alias("place"))


@query(f"WITH {IDX} SELECT o_orderkey FROM i WHERE row_idx < 37")
def head_n(t):
    return B.head_rows(_orders(t), 37).select("o_orderkey")


@query()
def mini_batches(t):
    """Seeded: no SQL. Tests check that every epoch is a permutation cut into equal parts."""
    return B.shuffled_mini_batches(t.orders.select("o_orderkey"), "o_orderkey", 64, 7, epochs=2)


@query("""WITH e AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS run FROM e""")
def uid_runs(t):
    return B.runs_of(t.events, "event_type", ["ts", "event_id"], ["user_id"]).select("event_id", "run")


@query("SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier EXCEPT SELECT p_partkey FROM part WHERE p_partkey % 3 = 0")
def set_ops(t):
    a = t.customer.select(F.col("c_custkey").alias("k")).union(t.supplier.select("s_suppkey")).distinct()
    return a.subtract(t.part.where("p_partkey % 3 = 0").select("p_partkey"))


@query("SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def key_intersection(t):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 0").select("c_custkey"))
