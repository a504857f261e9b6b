"""Queries by name, each with the SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, and the views that many queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def tokens(self) -> DataFrame:
        """Tokens of responses, long form: a line is a token, an order a response, four neighbouring orders a prompt.

        Rewards, values and scores are divided by primes, so that no result lies on a tie of decimal rounding."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        return self.lineitem.select(
            F.floor(F.col("l_orderkey") / 4).cast("long").alias("uid"), F.col("l_orderkey").alias("seq"), (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("l_discount") / 0.97).alias("reward"), (F.col("l_tax") / 0.97).alias("value"),
            (F.col("l_returnflag") != "R").alias("mask"), (F.col("l_tax") * -10).alias("logp"), (F.col("l_discount") * -10).alias("old"), (F.col("l_discount") - 0.05).alias("adv"), F.col("l_quantity").alias("ret"),
        )

    @property
    def responses(self) -> DataFrame:
        """Responses with a score: an order is a response, its customer the prompt."""
        return self.orders.select(
            F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 99991.0).alias("score"), (F.col("o_orderkey") % 97 + 1).alias("length"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("pred")
        )


TOKENS = """tokens AS (SELECT l_orderkey // 4 AS uid, l_orderkey AS seq,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos,
  l_discount / 0.97::DOUBLE AS reward, l_tax / 0.97::DOUBLE AS value, l_returnflag <> 'R' AS mask, l_tax * -10 AS logp, l_discount * -10 AS old, l_discount - 0.05::DOUBLE AS adv, l_quantity AS ret FROM lineitem)"""
RESPONSES = """responses AS (SELECT o_custkey AS uid, o_orderkey AS seq, o_totalprice / 99991.0::DOUBLE AS score, o_orderkey % 97 + 1 AS length,
  o_orderpriority AS source, o_orderstatus AS pred FROM orders)"""


def query(sql: str | None = None, name: str | None = None):
    """Register f(Tables) under its name; `sql` may use {tokens} and {responses} for the shared views."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(Tables(spark, sf_dir))

        run.__name__ = key
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql.replace("{tokens}", TOKENS).replace("{responses}", RESPONSES)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)
