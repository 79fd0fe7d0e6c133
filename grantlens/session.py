"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, shared_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one you are given."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared_dir) if shared_dir else SparkSession.builder
    return (
        builder.master(f"local[{cores}]")
        .appName("grantlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a session whose tasks run in the driver's own process may do without: it gets a temporary
    folder. Elsewhere executors would each write to a disk that the others can't read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Stages:
    """Owns intermediates that several branches read, and deletes them when closed.

    Each is a table in the shared folder: it survives lost executors, keeps the branches from
    recomputing (and possibly disagreeing about) the same shuffle, and tells the planner its true size.
    Close after the results built on them are written; whatever is still open goes at the end of the program.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def add(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "stage")
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *raised: object) -> None:
        self.close()


_open: dict[str, Stages] = {}


@atexit.register
def _close_all() -> None:
    for stages in _open.values():
        if stages.spark.sparkContext._jsc is not None:
            stages.close()


def stages_of(spark: SparkSession) -> Stages:
    """The owner used where a caller names none: one per application."""
    return _open.setdefault(spark.sparkContext.applicationId, Stages(spark))
