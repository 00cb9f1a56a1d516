"""File sources and sinks (section 2.1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Media types by extension, of the file store and of uploads.
STORED_MIME = {
    "txt": "text/plain", "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "json": "application/json", "csv": "text/csv", "xml": "application/xml",
    "html": "text/html", "md": "text/markdown",
}
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml",
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "txt": "text/plain", "rtf": "application/rtf", "html": "text/html", "htm": "text/html",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "csv": "text/csv",
    "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "json": "application/json", "xml": "application/xml", "zip": "application/zip",
}
DEFAULT_MIME = "application/octet-stream"


def local_path(path: Column) -> Column:
    """Without a ``file://`` prefix (2.1 #6)."""
    return F.regexp_replace(path, r"^file:/{2,3}(?=/)|^file:(?=/)", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime_type(path: Column, types: dict[str, str] = MIME) -> Column:
    """The media type by extension: of an upload, or with ``STORED_MIME`` as the file store has it (2.1 #8, #9)."""
    table = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(DEFAULT_MIME))


def by_time(files: DataFrame, newest_first: bool = True) -> DataFrame:
    """Files by modification time, ties by path (2.7 #8)."""
    at = F.col("modified").desc_nulls_last() if newest_first else F.col("modified").asc_nulls_last()
    return files.orderBy(at, "path")


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database over JDBC, read in ``parts`` ranges of a key where its bounds are given (2.1 #2); the driver's jar is the caller's."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, name, size, modified, type, content) of files (2.1 #6, #8, 2.7 #8)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(path)
    return df.select(
        "path", base_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        mime_type(F.col("path"), STORED_MIME).alias("type"), "content",
    )


def with_content(frames: DataFrame, files: DataFrame, reference: str) -> DataFrame:
    """Frames with their image's bytes, null where the file is missing (2.1 #6)."""
    found = files.select(local_path(F.col("path")).alias("_path"), "content")
    return frames.join(found, local_path(F.col(reference)) == F.col("_path"), "left").drop("_path")


def data_uri(path: Column, content: Column) -> Column:
    """Bytes as a data URI; what is no image by its name counts as JPEG (2.1 #7)."""
    kind = mime_type(path)
    image = F.when(kind.startswith("image/"), kind).otherwise(F.lit("image/jpeg"))
    return F.concat(F.lit("data:"), image, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def export_union(stores: dict[str, DataFrame], created: str = "created_at", include_embeddings: bool = False) -> DataFrame:
    """All stores in one table by column name, with memory_type; by type, the newest first by the time's text (2.1 #11, 2.8 #2)."""
    out = None
    for name, df in stores.items():
        part = flattened(df, include_embeddings).withColumn("memory_type", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("memory_type", F.col(created).cast("string").desc_nulls_last())


def flattened(df: DataFrame, include_embeddings: bool = False) -> DataFrame:
    """Nested columns as JSON, times in ISO form, vectors left out or as JSON too (2.1 #13)."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("array<float>", "array<double>") and not include_embeddings:
            continue
        column = F.col(field.name)
        if kind.startswith(("array", "map", "struct")):
            column = F.to_json(column)
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        out.append(column.alias(field.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_sheets(stores: dict[str, DataFrame], folder: str, created: str = "created_at") -> None:
    """A CSV folder for each store, the newest first (2.1 #12)."""
    for name, df in stores.items():
        write_csv(flattened(df.orderBy(F.col(created).desc_nulls_last())), f"{folder}/{name}")


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet under a folder (2.1 #16)."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def catalog(spark: SparkSession) -> DataFrame:
    """(name, kind) of the session's tables and views (2.1 #17)."""
    rows = [(t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string")
