"""Folders of versions that count once Spark has committed them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none where there is no such folder."""
    fs, hadoop_path = _hadoop(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isDirectory())


def committed(spark: SparkSession, path: str) -> bool:
    """Has a Spark write to this folder been completed?"""
    fs, hadoop_path = _hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(hadoop_path)


def committed_subfolders(spark: SparkSession, path: str) -> list[str]:
    return [n for n in subfolders(spark, path) if committed(spark, f"{path}/{n}")]
