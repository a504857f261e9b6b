"""Session helpers shared by every module."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tessella", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Bytes of an Arrow batch that goes to a Python worker, at most: with few large rows, the row count alone bounds nothing.
ARROW_BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; a smaller bound that the session has is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error, since a local folder
    is not seen by the other machines.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-checkpoint-"))


#: Bytes; Spark's own estimate for a table of which it knows nothing is 2^63 - 1.
LARGEST_ESTIMATE = 1 << 62


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor and ends the lineage.

    A checkpoint keeps the estimated size of its plan, and a join's estimate is the product of its sides': in a loop, the
    number's digits multiply with every round until they fill the driver. An estimate beyond LARGEST_ESTIMATE is dropped.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    try:
        absurd = done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > LARGEST_ESTIMATE
    except ValueError:  # too many digits to be read
        absurd = True
    if not absurd:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


#: Bytes of a table's files, as Spark estimates them, for each partition of a scan whose rows are taken apart into many.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores, and over a partition for each SPREAD_BYTES of it at least: a small file is often a single row
    group, and then a single task; of a large one, what a task holds must not grow with the table."""
    scan = df.rdd.getNumPartitions()
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except ValueError:  # too many digits to be read: nothing is known
        size = 0
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES) if size <= LARGEST_ESTIMATE else 0)
    return df.repartition(wanted) if scan <= wanted else df


#: Rows of a task that sorts or groups the rows of whole keys.
DEALT_ROWS = 100_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in a partition for each DEALT_ROWS rows at least.

    A shuffle without a number has partitions that are joined by the bytes they take when compressed, up to 64 MB, of which
    sorts and windows hold many times as much.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT_ROWS)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so functions pickled by name can be loaded there.

    Batches for the workers are bounded from here on (bound_batches).
    """
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tessella-ship-")) / "tessella.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
