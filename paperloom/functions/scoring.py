"""BM25 (Robertson and Zaragoza 2009) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75


def idf(doc_count: Column, doc_freq: Column) -> Column:
    return F.log1p((doc_count - doc_freq + 0.5) / (doc_freq + 0.5))


def saturation(tf: Column, length: Column, average_length: Column) -> Column:
    """The term-frequency part; 0 where the term does not occur, below K1 + 1 everywhere."""
    norm = K1 * (1.0 - B + B * length / average_length)
    return F.when(tf > 0, tf * (K1 + 1.0) / (tf + norm)).otherwise(0.0)
