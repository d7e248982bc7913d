"""Shared scratch tables: where lineage is cut, the rows go to the folder the cluster names.

``spark.checkpoint.dir`` is read from the session; where it is unset, a local folder is used on a local master only,
and any other master raises, as its executors would write to disks of their own.  Tables are removed when the driver
process ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder, without a trailing slash."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = spark.sparkContext.applicationId
        if own not in _local:
            _local[own] = "file://" + tempfile.mkdtemp(prefix="loomlog-")
        conf = _local[own]
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted at the end of the driver process."""
    path = f"{shared_dir(spark)}/loomlog/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: later branches do not recompute it,
    and a lost executor costs no more than reading the files again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            pass
