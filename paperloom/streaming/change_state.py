"""Change detection with the state kept by the stream itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("path_hash", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


class ChangeProcessor(StatefulProcessor):
    """Remembers the last content hash of a path and emits rows that differ from the one before.

    Rows of a micro-batch come in any order; they are put in the order of their arrival first.
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("hash", T.StringType())])
        self.last = handle.getValueState("last", schema, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("arrived", kind="stable", na_position="first")
        hashes = arrived["content_hash"]
        known = self.last.get()[0] if self.last.exists() else None
        before = hashes.shift(1)
        before.iloc[0] = known
        differs = hashes.ne(before)
        labels = before.isna().map({True: "new", False: "changed"})
        self.last.update((hashes.iloc[-1],))
        yield pd.DataFrame({"path_hash": key[0], "content_hash": hashes[differs], "label": labels[differs]})

    def close(self) -> None:
        pass


def stateful_changes(arrivals: DataFrame, arrived: str | None = None, keep_ms: int | None = None) -> DataFrame:
    """New and changed rows of a stream (path_hash, content_hash).

    The state is one hash per path. ``arrived`` names the column that orders the rows of a path
    within a micro-batch; without one they count as they come. With ``keep_ms`` a path that is
    not seen for so long is forgotten, and new when it comes again. Rows without a content hash
    are left out. The session has to use the RocksDB state store
    (`paperloom.session.STATE_STORE_SETTING`).
    """
    order = F.col(arrived) if arrived else F.lit(0)
    rows = arrivals.select("path_hash", "content_hash", order.alias("arrived")).where(F.col("content_hash").isNotNull())
    return rows.groupBy("path_hash").transformWithStateInPandas(
        statefulProcessor=ChangeProcessor(keep_ms),
        outputStructType=CHANGE_SCHEMA,
        outputMode="Append",
        timeMode="None" if keep_ms is None else "ProcessingTime",
    )
