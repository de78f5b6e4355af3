"""Readers: whole texts, images, JSON documents and numbered log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions.text import LINE_ENDS
from assayline.operators.scale import numbered
from assayline.schemas import BRAND


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole small text files, one row each: (file, raw)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")
    )


def read_images(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Image files; without ``content`` only the listing is read."""
    files = spark.read.format("binaryFile").load(path)
    return files if content else files.select("path", "modificationTime", "length")


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Multi-line JSON files under an explicit schema; unreadable ones land in
    ``_corrupt_record`` when the schema has that column."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )


def parent_name(path: Column) -> Column:
    """Name of the directory a file lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def read_brands(spark: SparkSession, root: str, file_name: str = "brand.json") -> DataFrame:
    """All brands under a root: one row per sub-directory, named after it."""
    brands = read_json_documents(spark, f"{root}/*/{file_name}", BRAND)
    return brands.withColumn("brand", parent_name(F.col("file")))


def read_log_names(spark: SparkSession, path: str) -> DataFrame:
    """Every log file once, empty ones included: (file)."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))


def read_log_lines(spark: SparkSession, path: str, rows_per_slice: int | None = None) -> DataFrame:
    """Numbered lines of log files of any size: (file, line_no, line).

    Files are split by Spark at newlines, and each piece is cut further at the other line ends
    (carriage return, vertical tab, form feed, separators). Bytes that are no UTF-8 are replaced.
    Order in a file is that of the split's offset and the row in it.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("seq"),
        F.octet_length("value").alias("bytes"),
        F.make_valid_utf8("value").alias("text"),
    )
    returned = F.endswith("text", F.lit("\r"))
    parts = F.split(F.when(returned, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")), LINE_ENDS, -1)
    pieces = raw.select("file", "block", "seq", F.posexplode(parts).alias("pos", "line"))

    # A last line without newline that stops at another line end opens no further, empty line.
    # Only such files lose their last number: bytes plus one newline per line then exceed their size.
    stops = ~returned & F.col("text").rlike(LINE_ENDS + r"\z")
    surplus = (
        raw.groupBy("file")
        .agg(
            F.sum(F.col("bytes") + 1).alias("covered"),
            F.max("size").alias("size"),
            F.max(F.struct("block", "seq", stops.alias("stops"))).alias("last"),
            F.sum(F.size(parts)).alias("line_no"),
        )
        .filter("covered > size AND last.stops")
        .select("file", "line_no")
    )
    lines = numbered(pieces, ["file"], ["block", "seq", "pos"], "line_no", rows_per_slice).select("file", "line_no", "line")
    return lines.join(surplus, ["file", "line_no"], "left_anti")
