"""Session helpers: table loading, shared checkpoints, sizes that are checked before a broadcast."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast if it has at most so many rows; beyond that a shuffled way is taken.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names in spark.checkpoint.dir. Where none is set, a local session gets a folder of this machine; a cluster must name a shared one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spectrail-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, once, and go on from there: later uses neither recompute it nor depend on an executor.

    The write runs while a query is put together. Its files go when df does if the session sets
    spark.cleaner.referenceTracking.cleanCheckpoints; else whoever owns the folder empties it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows, else df as it is (a shuffled join follows).

    The count is taken with a limit, so that a large table isn't counted to its end; pass a cut() table.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
