"""Durable intermediate tables in the folder that all executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it
back: the files survive lost executors, and later plans prune the columns they
need. Tables are written without compression, so that the sizes by which Spark
decides about broadcasts are near those in memory.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; without the setting a local one, but only if the master is local, too."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        if "local" not in _own:
            _own["local"] = "file://" + tempfile.mkdtemp(prefix="spark-strandloom-")
        folder = _own["local"]
    app = spark.sparkContext.applicationId
    path = f"{folder.rstrip('/')}/strandloom-{app}"
    if path not in _made:
        _made[path] = spark
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, for sessions whose workers can't import it by themselves."""
    context = spark.sparkContext
    if _own.get("shipped") == context.applicationId:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-strandloom-zip-"), "strandloom")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(home), os.path.basename(home)))
    _own["shipped"] = context.applicationId


_own: dict[str, str] = {}
_made: dict[str, SparkSession] = {}


@atexit.register
def _remove_tables() -> None:
    for path, spark in _made.items():
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; the cluster clears its scratch folder
            pass


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "none")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
