"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it may be unset, a temporary folder.

    Raises on a cluster without the setting: a folder of one machine would lose rows there.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="weft-"))


def scratch(spark: SparkSession, name: str = "graph") -> str:
    """A new folder under shared_root."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table: ends its lineage and outlives lost executors."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made(spark: SparkSession) -> int:
    """How many folders scratch has handed out in this application: a mark for cleared."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def cleared(spark: SparkSession, since: int = 0) -> int:
    """Deletes the folders that scratch has handed out since a mark, whose tables nobody reads any more; returns how many."""
    paths = _MADE.get(spark.sparkContext.applicationId, [])
    gone = 0
    for path in paths[since:]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))
    del paths[since:]
    return gone
