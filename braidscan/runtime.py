"""Session, table and scratch-storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app: str = "braidscan", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings every operator is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BRAIDSCAN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's source folder.

    Needed only where neither PYTHONPATH nor --py-files names it already.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, REPO_ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temp folder in local mode and an error elsewhere."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", "") or ""
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else ""
    if not root and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="braidscan-")
        sc.setCheckpointDir(root)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


class Scratch:
    """Tables an operator writes to the shared folder to cut lineage.

    ``put`` writes Parquet and returns a DataFrame over the files, so that a lost
    executor costs a re-read and not a recomputation. ``drop`` frees what is no
    longer read; the rest goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/braidscan-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, self.root)

    def put(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.root}/{name}")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager)


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


__all__ = ["Scratch", "StorageLevel", "attach", "build_session", "chain", "cut", "shared_root", "table"]
