"""Writers of derived artefacts, and their readers: examples, summaries, clusterings, term lists, metrics, cached generations.

All paths go through Spark or the Hadoop file system, so any store that these reach will do; files of a log in a mounted
folder are written by the tasks themselves. Small JSON artefacts are tables of one row, written as one file of JSON lines.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.io import exists


def write_example_and_summary(df: DataFrame, folder: str, order: str, **stats: Column) -> None:
    """`example` holds the first record by `order`; `summary` its number of rows and the given aggregates."""
    df.orderBy(order).limit(1).coalesce(1).write.mode("overwrite").json(f"{folder}/example")
    df.agg(F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in stats.items()]).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def write_embeddings(df: DataFrame, folder: str, key: str, vector: str, other: str | None = None) -> None:
    """Ids and vectors as parquet; a second kind of vector, where there is one, beside it."""
    df.select(key, vector).write.mode("overwrite").parquet(f"{folder}/embeddings")
    if other:
        df.select(key, other).write.mode("overwrite").parquet(f"{folder}/auxiliary")


def write_clustering(assigned: DataFrame, folder: str, key: str, reduced: str | None = None, probabilities: str | None = None, stats: DataFrame | None = None) -> None:
    """Assignments, reduced vectors, membership probabilities and statistics, each a table of its own."""
    extra = [c for c in (reduced, probabilities) if c]
    assigned.drop(*extra).write.mode("overwrite").parquet(f"{folder}/assignments")
    for c in extra:
        assigned.select(key, c).write.mode("overwrite").parquet(f"{folder}/{c}")
    if stats is not None:
        stats.coalesce(1).write.mode("overwrite").json(f"{folder}/stats")


def write_examples(df: DataFrame, folder: str, order: list[str], parquet: bool = False) -> None:
    """Examples as JSON lines in the given order, and as parquet if wanted."""
    df.orderBy(*order).write.mode("overwrite").json(f"{folder}/examples_json")
    if parquet:
        df.write.mode("overwrite").parquet(f"{folder}/examples_parquet")


def write_terms(terms: DataFrame, distinct: DataFrame, folder: str, group: str) -> None:
    """Top terms as CSV, a row each; distinctiveness by group as JSON lines."""
    terms.orderBy(group, "rank").write.mode("overwrite").option("header", True).option("escape", "\"").csv(f"{folder}/top_terms")
    distinct.coalesce(1).write.mode("overwrite").json(f"{folder}/distinctiveness")


def log_metrics(df: DataFrame, folder: str, step: str) -> None:
    """Append metrics (step, name, value) as JSON lines, a row for each step with all its metrics: the sink of a stream's batches as well."""
    rows = df.groupBy(step).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("data"))
    rows.write.mode("append").json(folder)


def read_metrics(spark: SparkSession, folder: str, step: str) -> DataFrame:
    """(step, name, value) of all logged rows."""
    rows = spark.read.schema(f"{step} long, data map<string, double>").json(folder)
    return rows.select(step, F.explode("data").alias("name", "value"))


def dump_generations(df: DataFrame, folder: str, step: int, extra: dict[str, DataFrame] | None = None, key: str = "row_idx") -> DataFrame:
    """Write a step's rows as JSON lines, with those extra tables (key, value) that have as many rows; returns what was written."""
    n, out = df.count(), df
    for name, table in (extra or {}).items():
        if table.count() == n:
            out = out.join(table.select(key, F.col("value").alias(name)), key, "left")
    out = out.withColumn("step", F.lit(step))
    out.write.mode("overwrite").json(f"{folder}/{step}")
    return out


def cached(spark: SparkSession, folder: str, tag: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that was kept under this tag, or that make() gives, which is then kept: replay in place of generation."""
    path = f"{folder}/{hashlib.md5(tag.encode()).hexdigest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def local_copy(spark: SparkSession, path: str, folder: str) -> str:
    """Copy a file or folder of any store into `folder`, once, under the MD5 of its path; the copy must have the same files
    of the same sizes, else it is made again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file_path = jvm.org.apache.hadoop.fs.Path
    source = file_path(path)
    target = file_path(f"{folder.rstrip('/')}/{hashlib.md5(path.encode()).hexdigest()}/{source.getName()}")
    of, to = source.getFileSystem(conf), target.getFileSystem(conf)

    def listing(fs, root) -> set[tuple[str, int]]:
        if not fs.exists(root):
            return set()
        files, out, base = fs.listFiles(root, True), set(), fs.makeQualified(root).toString()
        while files.hasNext():
            f = files.next()
            out.add((f.getPath().toString().removeprefix(base), f.getLen()))
        return out

    wanted = listing(of, source)
    if not wanted:
        raise FileNotFoundError(path)
    if listing(to, target) != wanted:
        to.delete(target, True)
        to.mkdirs(target.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(of, source, to, target, False, conf)
        if listing(to, target) != wanted:
            raise OSError(f"the copy of {path} differs from it")
    return target.toString()


def generation_table(prompts: DataFrame, generated: DataFrame, key: str, n: int, order: str = "sample", text: str = "response") -> DataFrame:
    """Prompts with `responses`, the n generated texts of each in order; a prompt with fewer or more is an error when run."""
    lists = generated.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_r"))
    joined = prompts.join(lists, key, "left").withColumn("responses", F.transform(F.coalesce("_r", F.array().cast(lists.schema["_r"].dataType)), lambda r: r[text])).drop("_r")
    wrong = F.raise_error(F.concat(F.lit(f"not {n} responses for "), F.col(key).cast("string"))).cast("array<string>")
    return joined.withColumn("responses", F.when(F.size("responses") == n, F.col("responses")).otherwise(wrong))


def preference_pairs(df: DataFrame, key: str, prompt: str, chosen: str, rejected: str, separator: str = "\n") -> DataFrame:
    """Two rows for each preference: (key, is_chosen, text), the text being the prompt and one of its answers. Both answers must be there."""
    answers = F.array(F.struct(F.lit(1).alias("is_chosen"), F.col(chosen).alias("a")), F.struct(F.lit(0).alias("is_chosen"), F.col(rejected).alias("a")))
    long = df.select(key, F.col(prompt).alias("_p"), F.explode(answers).alias("_x"))
    text = F.when(F.col("_x.a").isNotNull() & F.col("_p").isNotNull(), F.concat("_p", F.lit(separator), "_x.a")).otherwise(F.raise_error(F.lit("a preference lacks its prompt or an answer")))
    return long.select(key, F.col("_x.is_chosen").alias("is_chosen"), text.alias("text"))


def write_log(df: DataFrame, folder: str, step: str, order: str) -> None:
    """{step}.jsonl for each step: its rows as JSON lines in order. A step's rows, one batch of a training run, are one file.

    In a folder that is mounted, tasks write the files under their names. In other stores Spark writes them, and they are
    renamed then, which takes the driver several calls a file.
    """
    jvm = df.sparkSession._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(fs_path(folder))
        _write_files(df, fs.makeQualified(fs_path(folder)).toUri().getPath(), step, order)
        return
    by_step = f"{folder}/_by_step"
    df.withColumn("_s", F.col(step)).repartition("_s").sortWithinPartitions("_s", order).write.partitionBy("_s").json(by_step)

    def rename(path) -> None:
        fs.rename(path, fs_path(f"{folder}/{path.getParent().getName().split('=')[1]}.jsonl"))

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(rename, [status.getPath() for status in fs.globStatus(fs_path(f"{by_step}/_s=*/part-*"))]))
    fs.delete(fs_path(by_step), True)


def _write_files(df: DataFrame, folder: str, step: str, order: str) -> None:
    """The files of write_log in a mounted folder. A file has another name until it is whole, so a task may run again."""
    import pyarrow as pa

    def finish(file, step) -> None:
        """The file gets the name that Spark gives a partition."""
        name = (re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", step) if step is not None else "__HIVE_DEFAULT_PARTITION__") + ".jsonl"
        file.close()
        with contextlib.suppress(FileNotFoundError):  # of a file that Hadoop wrote
            os.remove(f"{folder}/.{name}.crc")
        os.replace(file.name, f"{folder}/{name}")

    def run(batches):
        file = last = None
        for batch in batches:
            for s, line in zip(batch.column("_s").to_pylist(), batch.column("_line").to_pylist()):
                if file is None or s != last:
                    if file is not None:
                        finish(file, last)
                    file, last = open(f"{folder}/_{uuid.uuid4().hex}", "wb"), s
                file.write(line.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
        if file is not None:
            finish(file, last)

    name = F.nullif(F.col(step).cast("string"), F.lit(""))
    lines = df.select(name.alias("_s"), F.col(order).alias("_o"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("_line"))
    lines.repartition("_s").sortWithinPartitions("_s", "_o").select("_s", "_line").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def log_rows(spark: SparkSession, folder: str, mask: str | None = None) -> DataFrame:
    """JSON lines of a folder of {step}.jsonl: step (the file's number), row (place in the file from 0), and the record's
    fields as text, matches of `mask` as asterisks. Files are read whole by line, in order of their step."""
    lines = spark.read.format("text").option("wholetext", False).option("pathGlobFilter", "*.jsonl").load(folder)  # one listing, not a look at each file
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    from pyspark.sql.window import Window

    # a file's blocks are in order, and so are the lines of a block
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_id")) - 1
    rows = lines.where(F.length("value") > 0).withColumn("row", place).withColumn("step", F.regexp_extract("_file", r"/(\d+)\.jsonl$", 1).cast("long"))
    fields = F.from_json("value", "map<string, string>")
    return rows.select("step", "row", F.transform_values(fields, lambda k, v: F.regexp_replace(v, mask, "*") if mask else v).alias("fields"))
