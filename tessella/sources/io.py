"""Readers and writers: raw datasets, shard sets, rollout logs, verified writes, upserts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.session import ensure_checkpoint_dir

SUFFIXES = {"parquet": "parquet", "json": "json", "jsonl": "json"}


def load_raw(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """parquet, json or jsonl (any case, blanks off); anything else is an error."""
    kind = SUFFIXES.get(fmt.strip().lower())
    if kind is None:
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(kind).load(path)


def load_source(spark: SparkSession, path: str) -> DataFrame:
    """A local or remote file by its suffix, with the split label `local`."""
    return load_raw(spark, path, path.rstrip("/").rsplit(".", 1)[-1]).withColumn("source_split", F.lit("local"))


def load_many(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Several files, mixed by suffix, one below the other by name; columns that a file lacks are null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [load_raw(spark, p, p.rstrip("/").rsplit(".", 1)[-1]) for p in paths])
    return out.select(*columns) if columns else out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Write parquet unless it is there already; whether it was written."""
    if not overwrite and exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return True


def write_verified(df: DataFrame, path: str) -> int:
    """Write parquet and read it back: the number of rows, which must be that of df."""
    df.write.mode("overwrite").parquet(path)
    wrote, have = df.sparkSession.read.parquet(path).count(), df.count()
    if wrote != have:
        raise RuntimeError(f"{path} has {wrote} rows, not {have}")
    return wrote


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def shard_path(folder: str, name: str, rank: int) -> str:
    return f"{folder}/{name}_rank{rank}.parquet"


def merge_shards(spark: SparkSession, folder: str, name: str, world: int, key: str) -> DataFrame:
    """All shards 0..world-1, sorted by key; a missing shard or a repeated key is an error."""
    paths = [shard_path(folder, name, r) for r in range(world)]
    if lost := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(f"missing shards: {lost}")
    out = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in paths])
    if twice := out.groupBy(key).count().where("count > 1").limit(10).collect():
        raise ValueError(f"repeated {key}: {[r[key] for r in twice]}")
    return out.orderBy(key)


def rollout_log(spark: SparkSession, folder: str, mask: str | None = None, schema: str | None = None) -> DataFrame:
    """A folder of {step}.jsonl: step from the file name, other types as JSON text, matches of `mask` as asterisks."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(folder)
    df = df.withColumn("step", F.regexp_extract(F.input_file_name(), r"/(\d+)\.jsonl", 1).cast("long")) if "step" not in df.columns else df
    out = []
    for name, kind in df.dtypes:
        if name == "step":
            out.append(F.col(name))
            continue
        c: Column = F.col(name) if kind == "string" else F.to_json(name) if kind.startswith(("struct", "array", "map")) else F.col(name).cast("string")
        out.append((F.regexp_replace(c, mask, "*") if mask else c).alias(name))
    return df.select(*out)


def dump_rollouts(df: DataFrame, folder: str, step: str = "step") -> None:
    """One folder of JSON lines for each step."""
    df.write.mode("overwrite").partitionBy(step).json(folder)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows by key in a parquet table; the new table is written beside the old one and then takes its place."""
    from tessella.operators.curriculum import upsert

    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    if exists(spark, path):
        beside = f"{path}.next"
        upsert(spark.read.parquet(path), new, keys).orderBy(*keys).write.mode("overwrite").parquet(beside)
        fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(fs_path(path), True)
        fs.rename(fs_path(beside), fs_path(path))
    else:
        new.orderBy(*keys).write.parquet(path)
    return spark.read.parquet(path)


def unify_records(df: DataFrame, source: str, question: Column, truth: Column, target: Column | None = None, **extra: Column) -> DataFrame:
    """The unified nested record: prompt as one user message, reward_model, target and extra_info."""
    question = F.trim(question)
    fields = {"source_dataset": F.lit(source), "raw_question": question, "raw_answer": truth} | extra
    return df.select(
        F.lit(source).alias("data_source"),
        T.to_messages(question).alias("prompt"),
        F.lit("math").alias("ability"),
        F.struct(truth.cast("string").alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        (target if target is not None else F.lit(None).cast("string")).alias("target"),
        F.struct(*[v.alias(k) for k, v in fields.items()]).alias("extra_info"),
    )


def validate_records(df: DataFrame) -> DataFrame:
    """How many unified records break each rule."""
    first = F.get("prompt", F.lit(0))
    rules = {
        "not_one_message": F.size("prompt") != 1,
        "role_not_user": ~F.coalesce(first["role"] == "user", F.lit(False)),
        "empty_question": F.coalesce(F.trim(first["content"]), F.lit("")) == "",
        "ends_with_think": F.coalesce(F.trim(first["content"]), F.lit("")).endswith("<think>"),
        "empty_truth": F.coalesce(F.trim("reward_model.ground_truth"), F.lit("")) == "",
    }
    return df.agg(F.count(F.lit(1)).alias("n_records"), *[F.count_if(c).alias(n) for n, c in rules.items()])
