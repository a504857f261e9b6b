"""Term statistics of clusters: n-gram TF-IDF in DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import clean_words
from tessella.session import cut_lineage, spread


def ngrams(df: DataFrame, group: str, text: str, stop_words: tuple[str, ...], longest: int) -> DataFrame:
    """(group, term, n): tokens of two letters or more, stop words out first, then n-grams of 1..longest tokens, counted.

    n-grams stay within a row's text. Counting per row and then per group sums on the map side: a hot group costs a row
    per term and task.
    """
    words = F.filter(clean_words(F.col(text)), lambda w: ~w.isin(*stop_words)) if stop_words else clean_words(F.col(text))
    df = spread(df.select(group, text)).select(group, words.alias("_w"))

    def grams(n: int):
        if n == 1:
            return F.col("_w")
        last = F.greatest(F.size("_w") - (n - 1), F.lit(0))
        out = F.slice("_w", F.lit(1), last)
        for k in range(1, n):
            out = F.zip_with(out, F.slice("_w", F.lit(k + 1), last), lambda a, b: F.concat_ws(" ", a, b))
        return out

    terms = df.select(group, F.explode(F.concat(*[grams(n) for n in range(1, longest + 1)])).alias("term"))
    return terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))


def ctfidf(df: DataFrame, group: str, text: str, stop_words: tuple[str, ...] = (), longest: int = 2, min_df: int = 3, max_df: float = 0.85) -> DataFrame:
    """(group, term, weight): tf = 1 + ln n, idf = ln((1+N)/(1+df)) + 1, rows of norm 1; rare and common terms out."""
    n_groups = df.select(group).distinct().agg(F.count(F.lit(1)).alias("_N"))
    # a term's counts come together, a row for each group at most, so its document frequency is their number: no join
    by_term = ngrams(df, group, text, stop_words, longest).groupBy("term").agg(F.collect_list(F.struct(group, "n")).alias("_c"))
    by_term = by_term.withColumn("_df", F.size("_c")).where(F.col("_df") >= min_df).crossJoin(F.broadcast(n_groups)).where(F.col("_df") <= max_df * F.col("_N"))  # one row
    idf = F.ln((1 + F.col("_N")) / (1 + F.col("_df"))) + 1
    raw = by_term.select("term", idf.alias("_idf"), F.explode("_c").alias("_e")).select(F.col("_e")[group].alias(group), "term", ((1 + F.ln("_e.n")) * F.col("_idf")).alias("_x"))
    raw = cut_lineage(raw)  # read twice
    norms = raw.groupBy(group).agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    return raw.join(F.broadcast(norms), group).select(group, "term", (F.col("_x") / F.col("_norm")).alias("weight"))  # a row per group


def top_terms(weights: DataFrame, group: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distinctiveness(weights: DataFrame, group: str, k: int) -> DataFrame:
    """Mean of the k greatest weights; missing ones count as 0."""
    return top_terms(weights, group, k).groupBy(group).agg((F.sum("weight") / k).alias("distinctiveness"))
