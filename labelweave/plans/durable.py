"""Where results that must outlive a lost executor are written."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    ``spark.checkpoint.dir`` when it is set, otherwise the warehouse, which
    every session has and which all executors of a cluster share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


# Folders handed out by this driver and not removed yet.
_runs: list[str] = []


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's written tables."""
    _runs.append(f"{shared_root(spark)}/labelweave/{name}-{uuid.uuid4().hex}")
    return _runs[-1]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_runs(spark: SparkSession) -> None:
    """Remove every folder that this driver was given by ``run_dir``.

    For the end of a job: results that were only read from there go with it.
    """
    while _runs:
        _delete(spark, _runs.pop())


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a frame once to the shared folder and go on from the files.

    Used where a result is read more than once. A lost executor re-reads
    files instead of redoing the work behind them, readers still get column
    and partition pruning, and joins see the table's true size.
    """
    path = run_dir(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a frame made by ``stored`` once nothing reads them."""
    spark = df.sparkSession
    root = f"{shared_root(spark)}/labelweave/".split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root):
            _delete(spark, folder)
