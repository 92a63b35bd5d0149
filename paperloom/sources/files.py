"""Recursive file scans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_path(path: Column) -> Column:
    """Local paths without their URI scheme; other file systems keep theirs."""
    return F.regexp_replace(path, "^file:/+", "/")


def exclude_paths(files: DataFrame, excluded: str, column: str = "path") -> DataFrame:
    """Rows whose path does not contain the text, taken literally; an empty text keeps all."""
    return files.where(~F.col(column).contains(excluded)) if excluded else files


# Larger files do not fit a row of bytes.
LARGEST_FILE = 2**31 - 2**20


def scan_files(spark: SparkSession, path: str, glob: str = "*", excluded: str = "",
               modified_after: datetime | None = None) -> DataFrame:
    """Files below a folder, by name pattern: path, content, length and modification time.

    Contents are read only when the content column is used. With ``modified_after`` (in the
    session's time zone) files that have not been written since are left out of the listing, so
    a repeated run opens only what is new.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.load(path).withColumn("path", plain_path(F.col("path")))
    return exclude_paths(files, excluded)


def fitting(files: DataFrame, largest: int = LARGEST_FILE) -> DataFrame:
    """Files whose content can be read; the length is tested before any content is."""
    return files.where(F.col("length") <= largest)


def oversized(files: DataFrame, largest: int = LARGEST_FILE) -> DataFrame:
    """(path, error) of the files that are too large; their content is not read."""
    large = files.where(F.col("length") > largest)
    error = F.concat(F.lit("file of "), F.col("length").cast("string"), F.lit(" bytes is too large"))
    return large.select("path", error.alias("error"))


def list_files(spark: SparkSession, path: str, glob: str = "*", excluded: str = "") -> DataFrame:
    """Paths only; opens no file."""
    return scan_files(spark, path, glob, excluded).select("path")
