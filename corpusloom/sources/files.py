"""File sources and sinks: JSON-lines catalogues, trees of text files, verified binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "document_id string, path string, format string, sha256 string, split string, title string, knowledge_base string, source_family string, source_revision string, license string"


def read_catalog(spark: SparkSession, *paths: str, schema: str = CATALOG) -> DataFrame:
    """Catalogue rows of JSON-lines files with fixed fields; others are ignored, missing ones null.

    Lines that are no JSON come out with ``malformed`` set, so that nothing is dropped unseen.
    """
    rows = spark.read.schema(f"{schema}, malformed string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(list(paths))
    return rows


def duplicate_ids(catalog: DataFrame, key: str = "document_id") -> DataFrame:
    """``key, n``: ids that stand in more than one row; an empty result is the gate's pass."""
    return catalog.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``path, bytes, sha256, valid, text`` of all files below ``folder`` that match; text only where it is valid UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    valid = F.is_valid_utf8("content")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), valid.alias("valid"), F.when(valid, F.decode("content", "UTF-8")).alias("text"))


def integrity(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """``path, error_code`` of catalogue rows without file, files without row, and files whose hash differs."""
    both = catalog.select("path", F.col("sha256").alias("stated")).join(files.select("path", F.col("sha256").alias("actual")), "path", "full_outer")
    code = F.when(F.col("actual").isNull(), "file_missing").when(F.col("stated").isNull(), "file_unlisted").when(F.lower("stated") != F.col("actual"), "hash_mismatch")
    return both.select("path", code.alias("error_code")).where("error_code is not null")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """``rows`` as JSON lines; null fields are written, so that a round trip keeps them."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
