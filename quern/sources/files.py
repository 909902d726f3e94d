"""JSON, JSON lines, text lines, saved pages and images; a missing place reads as an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAILURES = "url string, stage string, reason string, brand string, ts string, error_type string, detail string"


def read_documents(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """One JSON document a file, with its path; files that don't parse give no row."""
    try:
        rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(place)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, file string")
    return rows.select("*", F.col("_metadata.file_path").alias("file")).filter("_corrupt_record is null").drop("_corrupt_record")


def read_lines(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    try:
        return spark.read.schema(schema).json(place)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_lines(rows: DataFrame, place: str) -> None:
    rows.write.mode("append").json(place)


def read_pages(spark: SparkSession, place: str) -> DataFrame:
    """path and html of saved pages."""
    return spark.read.option("wholetext", True).text(place).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_images(spark: SparkSession, place: str, pattern: str = "*") -> DataFrame:
    """path, content and the type that the first bytes tell (null: none known)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(place)
    return rows.select("path", "content", image_type(F.col("content")).alias("content_type"))


def image_type(content):
    head = F.hex(F.substring(content, 1, 12))
    brand = F.substring(head, 9, 16)
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E47"), "image/png").when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").when(brand == "6674797061766966", "image/avif").when(brand.startswith("6674797068656963"), "image/heic")
    )


def latest_pass(rows: DataFrame, column: str = "pass_id") -> DataFrame:
    """The rows of the newest pass; the filter prunes partitions of that column."""
    newest = rows.agg(F.max(column).alias("_newest"))
    return rows.join(F.broadcast(newest), F.col(column) == F.col("_newest")).drop("_newest")
