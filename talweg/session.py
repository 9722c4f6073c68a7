"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "talweg") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TALWEG_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers of this session, once, so that they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_talweg_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="talweg-code-")) / "talweg.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._talweg_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master, else an error.

    The setting is fixed when a session starts, so the temporary folder is kept with the context, not in the configuration.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(context, "_talweg_folder", None):
        context._talweg_folder = tempfile.mkdtemp(prefix="talweg-")
    return context._talweg_folder


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row.

    Input of many files or row groups is left as it is; only where a table comes in fewer pieces (one small file) its rows are dealt out.
    What has been shuffled already is left as it is too: counting its partitions would run the shuffle.
    """
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if "Exchange" in plan or "Aggregate" in plan or "Join" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into ``spark.sql.shuffle.partitions`` parts, which adaptive execution does not merge: for a distinct before heavy work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bounded(small: DataFrame, most: int = 50_000) -> DataFrame:
    """``small`` marked for broadcast behind a count of its rows; over ``most`` rows the planner joins it as it sees fit."""
    return F.broadcast(small) if small.count() <= most else small


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` as a compressed table into the shared folder, where a lost executor cannot take it along, and reads that."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/talweg-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.append(path)
    return spark.read.schema(df.schema).parquet(path)


_cuts: list[str] = []


def clear_cuts(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` has written so far; results that still read them must have been written before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _cuts:
        path = jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
