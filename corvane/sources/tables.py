"""Reading the tables of a folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Bytes for each core below which a table of few files is dealt anew.
SMALL = 16 << 20


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A Parquet table; ``spread`` deals a small one to all cores, see :func:`spread_rows`."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_rows(df) if spread else df


def spread_rows(df: DataFrame) -> DataFrame:
    """For heavy work on each row: a table of fewer files than cores, and of at most SMALL bytes a core, is dealt to all cores. Larger ones are read as they are.

    Files and bytes decide, not the number of splits: splits of one row group leave all its rows to one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL * cores and len(df.inputFiles()) < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where a local session names none, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder.

    ``small`` is for tables of counts, edges and states, which take few bytes: they are written by one task for each core of the cluster, not one for each shuffle partition."""
    checkpoint_dir(df.sparkSession)
    return (df.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism)) if small else df).checkpoint(eager=True)
