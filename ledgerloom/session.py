"""Session helpers: table access, shared-folder staging and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGES: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on a single machine (tests) a temporary folder is made,
    set as the checkpoint folder and removed when the process ends; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, is columnar and compressed, and outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    _STAGES.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def unstage(*staged: DataFrame | None) -> None:
    """Deletes stages whose rows have gone into later ones; no plan that is still to run may read them."""
    for df in staged:
        path = getattr(df, "_stage_path", None)
        if path in _STAGES:
            _STAGES.remove(path)
            _delete(df.sparkSession, path)


def clear_stages(spark: SparkSession) -> int:
    """Deletes the stages this process has written; call it when their results are stored. Returns how many."""
    done = 0
    while _STAGES:
        done += _delete(spark, _STAGES.pop())
    return done


def fence(df: DataFrame, *columns: str) -> DataFrame:
    """Keeps the optimiser from copying the expressions of ``columns`` into every filter and projection above."""
    return df.select(F.inline(F.array(F.struct(*(columns or df.columns)))))


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Even partitions ahead of work that costs far more than its bytes tell (Python on whole texts):
    adaptive execution would otherwise merge small partitions into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def first_by_id(df: DataFrame, *columns: str) -> DataFrame:
    """One row per redelivered record: copies carry equal content, so DISTINCT on it suffices
    and hash-aggregates without a sort."""
    return df.select(*columns).distinct()
