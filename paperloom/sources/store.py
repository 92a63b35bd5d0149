"""The corpus table: Parquet folders per kind, written in layers.

``root/doc_type=<kind>/layer=<number>-base`` holds a whole kind, sorted by id, and each later
``...-delta`` layer the documents one run added, changed or deleted. A run writes what it changed
and nothing else; `compact` folds deltas into a new base. Readers take the newest base and the
deltas after it; while the deltas fit a broadcast the base is read without a shuffle, so compact
after a run that changed a large part. A layer counts once Spark has committed it (``_SUCCESS``), so a run that dies
leaves nothing half-written, and no path is overwritten while it is read.

The state of earlier runs is a projection of this table, so the two cannot disagree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.corpus import upsert
from paperloom.plans.sizing import partitions_for
from paperloom.schemas import CORPUS_SCHEMA, KIND_NAMES
from paperloom.sources.folders import committed_subfolders, subfolders

LAYER_SCHEMA = T.StructType(
    [f for f in CORPUS_SCHEMA if f.name != "doc_type"] + [T.StructField("deleted", T.BooleanType())]
)


@dataclass(frozen=True)
class CorpusStore:
    spark: SparkSession
    root: str

    # -- layers ----------------------------------------------------------------------------

    def layers(self, kind: str) -> list[str]:
        """Committed layers a reader needs, the base first."""
        folder = f"{self.root}/doc_type={kind}"
        names = committed_subfolders(self.spark, folder)
        bases = [i for i, n in enumerate(names) if n.endswith("-base")]
        return names[bases[-1]:] if bases else []

    def _next(self, kind: str, suffix: str) -> str:
        """Path of a new layer; a layer that bears the same tag already is written again."""
        folder = f"{self.root}/doc_type={kind}"
        names = subfolders(self.spark, folder)
        again = [n for n in names if "@" in suffix and n.endswith(suffix)]
        if again:
            return f"{folder}/{again[0]}"
        number = max((int(n.split("=")[1].split("-")[0]) for n in names), default=0) + 1
        return f"{folder}/layer={number:06d}-{suffix}"

    # -- reading ---------------------------------------------------------------------------

    def _read(self, kind: str, layers: Sequence[str]) -> DataFrame:
        """Rows of some layers, with the position of their layer in ``_layer``."""
        frames = [
            self.spark.read.schema(LAYER_SCHEMA)
            .parquet(f"{self.root}/doc_type={kind}/{name}")
            .withColumn("_layer", F.lit(i))
            for i, name in enumerate(layers)
        ]
        if not frames:
            frames = [self.spark.createDataFrame([], LAYER_SCHEMA).withColumn("_layer", F.lit(0))]
        return reduce(DataFrame.unionByName, frames).withColumn("doc_type", F.lit(kind))

    def _kind(self, kind: str) -> DataFrame:
        layers = self.layers(kind)
        rows = self._read(kind, layers[:1])
        if len(layers) > 1:
            later = self._read(kind, layers[1:])
            rows = upsert(rows, later, F.desc("_layer"), F.desc("process_time")).where(~F.col("deleted"))
        return rows.select(*CORPUS_SCHEMA.fieldNames())

    def existing(self) -> list[str]:
        return [k for k in KIND_NAMES if self.layers(k)]

    def current(self, kinds: Sequence[str] | None = None) -> DataFrame:
        """The corpus now; kinds that are not asked for are not even listed."""
        frames = [self._kind(k) for k in (kinds or KIND_NAMES) if self.layers(k)]
        if not frames:
            return self.spark.createDataFrame([], CORPUS_SCHEMA)
        return reduce(DataFrame.unionByName, frames)

    def state(self, kind: str) -> DataFrame:
        """Path hash, content hash and path of every document; reads no text."""
        return self._kind(kind).select(
            F.col("id").alias("path_hash"), "content_hash", F.col("original_file_path").alias("original_path"),
            "doc_type",
        )

    # -- writing ---------------------------------------------------------------------------

    def _write(self, rows: DataFrame, path: str) -> None:
        known = set(rows.columns)
        columns = [
            (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LAYER_SCHEMA
        ]
        rows.select(*columns).write.mode("overwrite").parquet(path)

    def ensure(self, kind: str) -> None:
        """Create the table of a kind with its schema if there is none."""
        if not self.layers(kind):
            self._write(self.spark.createDataFrame([], CORPUS_SCHEMA), self._next(kind, "base"))

    def append(self, kind: str, batch: DataFrame, tag: str = "", filled: bool = False) -> bool:
        """Add a layer of new and changed documents; an empty batch adds none and gives False.

        A tag makes a repeated write replace itself. ``filled`` saves the look whether there is
        anything, for callers who know.
        """
        if not filled and batch.isEmpty():
            return False
        self.ensure(kind)
        rows = batch.withColumn("deleted", F.lit(False))
        self._write(rows, self._next(kind, f"delta@{tag}" if tag else "delta"))
        return True

    def delete(self, kind: str, ids: DataFrame, at) -> None:
        """Add a layer of deletions (column ``id``), stamped with the time ``at``; none for no ids."""
        if ids.isEmpty():
            return
        rows = ids.select("id", F.lit(at).cast("timestamp").alias("process_time"), F.lit(True).alias("deleted"))
        self._write(rows, self._next(kind, "delta"))

    def replace(self, kind: str, batch: DataFrame) -> None:
        """Start the kind anew from the batch alone."""
        rows = batch.withColumn("deleted", F.lit(False))
        self._write(self._sorted(rows, partitions_for(batch)), self._next(kind, "base"))

    def compact(self, kind: str) -> None:
        """Fold all layers of a kind into a new base."""
        rows = self._kind(kind).withColumn("deleted", F.lit(False))
        partitions = partitions_for(self._read(kind, self.layers(kind)))
        self._write(self._sorted(rows, partitions), self._next(kind, "base"))

    def _sorted(self, rows: DataFrame, partitions: int) -> DataFrame:
        """Ranges of ids, sorted, so that a lookup by id skips all row groups but one."""
        return rows.repartitionByRange(partitions, "id").sortWithinPartitions("id")
