"""Session defaults and table access."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_instants(df: DataFrame) -> DataFrame:
    """``df`` with its zone-less timestamps as instants, read as UTC: watermarks and epoch casts need them."""
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


_folders: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """A folder that driver and executors share: this application's in ``spark.checkpoint.dir``; a temporary one where that is unset in a local session."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/work-{app}"
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="work-")
    return _folders[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the workspace and read again: what several steps need is computed once, and a lost executor costs a re-read."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes and rows of an Arrow batch unless the session says otherwise: rows here are whole texts, and Spark's own limit is of rows alone.
ARROW_BYTES, ARROW_ROWS = 8 << 20, 1000
_ARROW_KEY, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_BYTES_KEY, _BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: they need not have it installed nor on their path.

    Also bounds the bytes and rows of an Arrow batch where the session left
    Spark's defaults; the settings stay with the session.
    """
    if spark.conf.get(_BYTES_KEY, _BYTES_DEFAULT) == _BYTES_DEFAULT:
        spark.conf.set(_BYTES_KEY, str(ARROW_BYTES))
    if spark.conf.get(_ARROW_KEY, _ARROW_DEFAULT) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_KEY, str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
