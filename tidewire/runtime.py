"""Session, table and lineage helpers that every plan uses."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidewire", cpus: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that the plans expect (UTC, Arrow, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """So many tasks keep the cluster busy where the size of rows says nothing of their work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a purely local session without that setting gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = getattr(spark, "_tidewire_dir", None)
    if found is None:
        found = tempfile.mkdtemp(prefix="tidewire-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark._tidewire_dir = found
    return found


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    settled(spark).add(path)
    return out


def settled(spark: SparkSession) -> set[str]:
    """The paths that settle() wrote for this session's application and that still stand."""
    found = getattr(spark.sparkContext, "_tidewire_settled", None)
    if found is None:
        found = spark.sparkContext._tidewire_settled = set()
    return found


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in list(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        settled(spark).discard(name)


def drop(*frames: DataFrame) -> None:
    """Delete tables that settle() wrote and nothing reads any more."""
    for df in frames:
        drop_paths(df.sparkSession, [df._settled_at])


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
