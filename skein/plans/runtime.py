"""Where steps are kept and how workers find this package: shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where only the driver has its folder on the path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder for steps: ``spark.checkpoint.dir``. Without that setting a temporary folder of this process, if all runs in it; on a cluster, where executors don't share local disks, an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="skein-steps-"))
    return _local[0]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/skein-{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame, kind: str = "step", few_files: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there and survives lost executors.

    ``few_files``: for rows much smaller than what they are computed from; they are
    dealt anew into partitions of even, advisory size, so that the heavy tasks write
    no file each.
    """
    path = new_path(df.sparkSession, kind)
    (df.hint("rebalance") if few_files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a durable DataFrame that nothing will read again."""
    path = getattr(df, "_skein_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
