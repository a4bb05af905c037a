"""Cutting lineage: a stage is written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_written: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  One of our own only where none is named and driver and tasks share a machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _own_folder[app]


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df``, written as Parquet and read again; a lost executor then costs no recomputation.

    ``instead_of``: an earlier cut that nothing but ``df`` reads; its folder goes once the new one is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    if instead_of is not None:
        _remove(spark, instead_of._cut_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def discard_stages(spark: SparkSession) -> int:
    """Removes the folders of all stages that this application wrote, once their results are where they belong; how many there were.

    Nothing that was built on a stage can be read after that.
    """
    paths = sorted(_written.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _remove(spark, path)
    return len(paths)
