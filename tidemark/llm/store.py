"""Tables in the shared checkpoint folder: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder in the one that the cluster names in ``spark.checkpoint.dir``; a temporary one where that is unset in a local session, as in tests."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/tables-{app}"
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tables-")
    return _own[app]


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    _delete(df.sparkSession, df.stored_at)


def clear(spark: SparkSession) -> None:
    """Delete all stored tables of this application, once no result that reads them is needed."""
    _delete(spark, folder(spark))


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
