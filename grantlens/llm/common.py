"""Helpers that several operators of this folder share."""

from __future__ import annotations

import functools
import gc
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import reduce_by
from ..session import shared_path, stages_of

ENCODED = "_payload"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it; once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        packed = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-")) / package.name), "zip", package.parent, package.name)
        context.addPyFile(packed)
        _shipped.add(context.applicationId)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, whose first argument is a session, with the package sent ahead."""
    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write an intermediate below the shared folder and read it back. What isn't discarded goes at the end of the program."""
    path = shared_path(df.sparkSession, name)
    stages_of(df.sparkSession).paths.append(path)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def discard(*staged: DataFrame) -> None:
    """Delete intermediates that no later plan reads."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        stages_of(spark).paths.remove(df.staged_at)


def as_bytes(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and the UTF-8 bytes of a text, null as empty; nothing else is read."""
    return docs.select(*keys, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(ENCODED))


def lowest(hashed: Column, n: int, total: Column | int) -> Column:
    """Whether a 64-bit hash is among the lowest of `total`: true of about 20 n rows, or of all.

    Put before a limit to the first n by hash, it keeps what reaches the limit's one task from growing
    with the number of tasks.
    """
    rows = F.greatest(F.lit(total) if isinstance(total, int) else total, F.lit(1))
    share = F.least(F.lit(1.0), F.lit(20.0 * n) / rows)
    return hashed.cast("double") <= F.lit(-2.0**63) + share * F.lit(2.0**64)


def forest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """For nodes 0..size-1 and the given edges, the smallest node that each one reaches."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in an edge table (a, b): the smallest node it reaches.

    Alternates large-star and small-star steps, each an aggregate and a join, and keeps every round
    as a table in the shared folder. Nothing but a row count and a checksum reaches the driver.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs, before = stage(ordered.distinct(), "pairs"), None
    while True:
        check = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if check == before or check.n == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = check
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = reduce_by(both, ["u"], F.least(F.min("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = reduce_by(large, ["u"], F.min("v").alias("m"))
        linked = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(linked.unionByName(lower.withColumnRenamed("m", "v")).distinct(), "pairs")
        discard(pairs)
        pairs = after


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    The scheduler holds on to the last query until the next one has run, so a tiny one is run first.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()
