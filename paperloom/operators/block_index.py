"""The index in blocks, kept up to date by signed deltas.

Postings of one term, field and kind are cut into blocks by intervals of documents. All terms share
the intervals, so what the blocks of an interval can score at most adds up over the query terms. A
block's head (documents, highest term frequency, shortest length) bounds the score of everything in
it under any statistics; searches read heads first and the documents of few blocks afterwards.

A run adds one layer to every table, never rewriting an older one:

* ``forward``: (doc_type, id, interval, field, dl, runs), what a document has in the index;
* ``blocks``: the heads and the documents of the layer;
* ``doc_freq`` and ``field_stats``: counts, negative for what the run took away;
* ``grams``: the k-grams of the layer's terms, for wildcards;
* ``gone``: ids whose older rows are void.

What changed and removed documents had is looked up in ``forward`` and subtracted, so a run costs
what it changes. A layer counts from the moment its number is written to ``layers``; readers that
began earlier keep what they saw, and a run that failed half-way is written over by the next one.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.index import field_rows, term_runs
from paperloom.plans.sizing import broadcast_if_small, for_hash_join, partitions_for
from paperloom.plans.skew import frequent_first_join
from paperloom.plans.staging import stored
from paperloom.session import aggregation_in_order, shuffles_dropped

# About so many documents of one length class share an interval.
INTERVAL_DOCS = 128
# What one task of the block table gets, in stored bytes of forward rows; its postings are some forty times as large in memory.
BLOCK_TASK_BYTES = 12 * 1024 * 1024
# A term has letters, digits and underscores only, so these two can stand between terms and positions.
BETWEEN_TERMS, BETWEEN_PLACES = " ", ","
BLOCK_ORDER = ("field", "term", "doc_type", "interval")
# Length classes: powers of two.
CLASS_SHIFT = 32
GRAM = 3
TERM_START, TERM_END = "^", "$"

FORWARD = (
    "doc_type string, id string, interval bigint, field string, dl int, "
    "runs array<struct<term:string,tf:int,positions:array<int>>>, layer int"
)
BLOCKS = (
    "field string, term string, doc_type string, interval bigint, n bigint, max_tf int, min_dl int, "
    "docs array<struct<id:string,tf:int,dl:int,positions:array<int>>>, layer int"
)
DOC_FREQ = "doc_type string, field string, term string, df bigint, total_tf bigint, layer int"
FIELD_STATS = "doc_type string, field string, n_docs bigint, sum_dl bigint, layer int"
GRAMS = "gram string, term string, layer int"
GONE = "id string, layer int"
SCHEMAS = {
    "forward": FORWARD, "blocks": BLOCKS, "doc_freq": DOC_FREQ, "field_stats": FIELD_STATS, "grams": GRAMS, "gone": GONE,
}


def length_class(text: Column) -> Column:
    """Powers of two of a text's length; documents of like length score alike, which keeps bounds close."""
    return F.floor(F.log2(F.coalesce(F.length(text), F.lit(0)) + 1)).cast("long")


def interval_of(doc_id: Column, of_class: Column, bits: int) -> Column:
    """The interval of a document, the same for all its fields: its length class, then so many bits of its hash."""
    spread = F.shiftrightunsigned(F.xxhash64(doc_id), 64 - bits) if bits else F.lit(0).cast("long")
    return F.shiftleft(of_class, CLASS_SHIFT) + spread


def forward_rows(corpus: DataFrame, bits: int) -> DataFrame:
    """What every document has in the index, one row per field; texts are tokenised here and nowhere else."""
    interval = interval_of(F.col("id"), length_class(F.col("content")), bits)
    rows = field_rows(corpus.withColumn("interval", interval), "interval")
    runs = term_runs(rows, F.col("text"), "doc_type", "id", "interval", "field")
    empty = F.array().cast("array<struct<term:string,tf:int,positions:array<int>>>")
    return runs.select("doc_type", "id", "interval", "field", "dl", F.coalesce("runs", empty).alias("runs"))


def packed(forward: DataFrame, *keys: str) -> DataFrame:
    """Forward rows that have terms, their runs as one text of terms and positions: a fraction of what the arrays take in a shuffle."""

    def text(run: Column) -> Column:
        return F.array_join(F.concat(F.array(run["term"]), run["positions"].cast("array<string>")), BETWEEN_PLACES)

    texts = F.array_join(F.transform("runs", text), BETWEEN_TERMS).alias("packed")
    return forward.where(F.col("dl") > 0).select(*keys, "dl", texts)


def unpacked(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per document and term of `packed` rows: keys, ``dl``, ``term``, ``tf``, ``positions``."""
    one = rows.select(*keys, "dl", F.explode(F.split("packed", BETWEEN_TERMS)).alias("_run"))
    parts = one.select(*keys, "dl", F.split("_run", BETWEEN_PLACES).alias("_parts"))
    return parts.select(
        *keys, "dl", F.get("_parts", F.lit(0)).alias("term"), (F.size("_parts") - 1).alias("tf"),
        F.slice("_parts", F.lit(2), F.size("_parts")).cast("array<int>").alias("positions"),
    )


def narrow(postings: DataFrame) -> DataFrame:
    """Posting rows as they move one by one: ids that are hashes in hexadecimal as bytes, positions as text."""
    is_hash = F.coalesce(F.lower(F.hex(F.unhex("id"))) == F.col("id"), F.lit(False))
    return postings.select(
        "doc_type", F.when(is_hash, F.unhex("id")).alias("_hash"), F.when(~is_hash, F.col("id")).alias("_id"), "field", "term", "dl",
        F.array_join(F.col("positions").cast("array<string>"), BETWEEN_PLACES).alias("_places"),
    )


def widen(rows: DataFrame) -> DataFrame:
    """Rows of `narrow` as they were, and what else they have got."""
    places = rows.withColumn("_places", F.split("_places", BETWEEN_PLACES).cast("array<int>"))
    own = (F.coalesce("_id", F.lower(F.hex("_hash"))).alias("id"), F.size("_places").alias("tf"), F.col("_places").alias("positions"))
    return places.select("*", *own).drop("_hash", "_id", "_places")


def block_rows(forward: DataFrame, partitions: int) -> DataFrame:
    """Blocks of forward rows, sorted within files.

    Documents move, not postings: all of an interval meet in one task, which sorts its own postings.
    A file has all terms of its intervals, so that a hot term is read by as many tasks as there are files.
    """
    keys = ("doc_type", "id", "interval", "field")
    dealt = packed(forward, *keys).repartition(partitions, "doc_type", "interval")
    one = unpacked(dealt, *keys)
    return one.sortWithinPartitions(*BLOCK_ORDER).groupBy(*BLOCK_ORDER).agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"),
        F.sort_array(F.collect_list(F.struct("id", "tf", "dl", "positions"))).alias("docs"),
    ).sortWithinPartitions(*BLOCK_ORDER)


def counted(forward: DataFrame, *more: str) -> DataFrame:
    """What the counts need of forward rows that have terms: these as one text and frequencies, positions are not read then."""
    terms = F.array_join("runs.term", BETWEEN_TERMS).alias("terms")
    return forward.where(F.col("dl") > 0).select("doc_type", "field", "dl", terms, F.col("runs.tf").alias("tfs"), *more)


def signed_doc_freq(forward: DataFrame) -> DataFrame:
    """Counts per term of `counted` rows with a ``sign``; terms whose counts cancel out have no row."""
    lists = forward.select("doc_type", "field", "sign", F.split("terms", BETWEEN_TERMS).alias("terms"), "tfs")
    terms = lists.select("doc_type", "field", "sign", F.explode(F.arrays_zip("terms", "tfs")).alias("r"))
    counts = terms.groupBy("doc_type", "field", F.col("r.terms").alias("term")).agg(
        F.sum("sign").cast("long").alias("df"), F.sum(F.col("sign") * F.col("r.tfs")).cast("long").alias("total_tf")
    )
    return counts.where((F.col("df") != 0) | (F.col("total_tf") != 0))


def signed_field_stats(forward: DataFrame) -> DataFrame:
    """Documents and lengths per field of forward rows with a ``sign``."""
    present = forward.where(F.col("dl") > 0)
    return present.groupBy("doc_type", "field").agg(
        F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("dl")).cast("long").alias("sum_dl")
    )


def gram_rows(terms: DataFrame, size: int = GRAM) -> DataFrame:
    """(gram, term): the runs of ``size`` characters of every distinct term between its edge marks."""
    marked = F.concat(F.lit(TERM_START), F.col("term"), F.lit(TERM_END))
    distinct = terms.select("term").distinct()
    grams = F.transform(F.sequence(F.lit(1), F.length(marked) - (size - 1)), lambda i: F.substr(marked, i, F.lit(size)))
    return distinct.select("term", F.explode(F.array_distinct(grams)).alias("gram")).select("gram", "term")


class BlockIndex:
    """The tables of an index below a path, as they are when it is opened; its own writes are seen as well."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._layers = self._finished()

    # --- reading ------------------------------------------------------------------------

    def layers(self) -> list[dict]:
        """Finished layers from the last full one on."""
        return self._layers

    def _finished(self) -> list[dict]:
        """One short row per layer."""
        try:
            rows = self.spark.read.schema("layer int, whole boolean, bits int").parquet(f"{self.path}/layers").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []  # nothing has been written yet
        found = sorted((r.asDict() for r in rows), key=lambda r: r["layer"])
        whole = max((r["layer"] for r in found if r["whole"]), default=0)
        return [r for r in found if r["layer"] >= whole]

    def table(self, name: str) -> DataFrame:
        """Rows of the finished layers; their number is a partition filter."""
        numbers = [r["layer"] for r in self.layers()]
        schema = SCHEMAS[name]
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("layer").isin(*numbers))

    def _gone(self) -> DataFrame:
        """The last layer that made rows of an id void."""
        return self.table("gone").groupBy("id").agg(F.max("layer").alias("_gone"))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, layer) that no later layer has made void. ``gone`` holds ids only; its size decides the join."""
        return rows if len(self.layers()) < 2 else self._kept(rows, for_hash_join(self._gone()))

    @staticmethod
    def _kept(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.join(gone, "id", "left").where(F.coalesce("_gone", F.lit(0)) <= F.col("layer")).drop("_gone")

    def forward(self) -> DataFrame:
        return self.live(self.table("forward"))

    def documents(self) -> DataFrame:
        """(doc_type, id) of every document, also of those without any term."""
        return self.forward().where(F.col("field") == "content").select("doc_type", "id")

    def postings(self, blocks: DataFrame | None = None) -> DataFrame:
        """Posting rows of given blocks (default: all), in the columns that `search.search_index` reads."""
        rows = (self.table("blocks") if blocks is None else blocks).select(
            "doc_type", "field", "term", "layer", F.inline("docs")
        )
        return self.live(rows).select("doc_type", "id", "field", "term", "tf", "dl", "positions")

    def all_postings(self) -> DataFrame:
        """`postings` of all terms, from the forward table: a document moves once with all it has, not once per term.

        Where its void ids are too many for a broadcast, documents move packed.
        """
        forward, keys = self.table("forward"), ("doc_type", "id", "field")
        gone, small = broadcast_if_small(self._gone()) if len(self.layers()) > 1 else (None, True)
        if small:
            live = forward.select(*keys, "dl", "runs", "layer")
            found = (live if gone is None else self._kept(live, gone)).select(*keys, "dl", F.inline("runs"))
        else:
            found = unpacked(self._kept(packed(forward, *keys, "layer"), gone.hint("shuffle_hash")), *keys)
        return found.select(*keys, "term", "tf", "dl", "positions")

    def sized_postings(self) -> DataFrame:
        """`all_postings` with ``df``, ``total_tf``, ``n_docs`` and ``sum_dl``; only postings of rarer terms move for it."""
        counts = stored(self.doc_freq(), "counts")
        found = frequent_first_join(self.all_postings(), counts, ["doc_type", "field", "term"], "df", narrow=narrow, widen=widen)
        return found.join(F.broadcast(self.field_stats()), ["doc_type", "field"])

    def doc_freq(self) -> DataFrame:
        """Documents and occurrences per kind, field and term: the sum over the layers."""
        sums = self.table("doc_freq").groupBy("doc_type", "field", "term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))
        return sums.where(F.col("df") != 0)

    def field_stats(self) -> DataFrame:
        sums = self.table("field_stats").groupBy("doc_type", "field").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"))
        return sums.where(F.col("n_docs") != 0)

    # --- writing ------------------------------------------------------------------------

    def build(self, corpus: DataFrame) -> BlockIndex:
        """Write the index of a corpus as a full layer; older layers stay for readers that use them."""
        with shuffles_dropped(self.spark):
            n = corpus.count()
        bits = max(0, ceil(log2(max(1, n / INTERVAL_DOCS))))
        return self._add(forward_rows(corpus, bits), None, whole=True, bits=bits)

    def apply(self, changed: DataFrame, removed: DataFrame) -> BlockIndex:
        """Add a layer: ``changed`` are corpus rows (new or in place of older ones), ``removed`` has ``id``."""
        layers = self.layers()
        if not layers:
            raise ValueError("build the index first")
        bits = layers[0]["bits"]
        return self._add(forward_rows(changed, bits), removed.select("id"), whole=False, bits=bits)

    def compact(self) -> BlockIndex:
        """Fold all layers into a full one without reading any text."""
        live = self.forward().drop("layer")
        n = self.documents().count()
        bits = max(0, ceil(log2(max(1, n / INTERVAL_DOCS))))
        of_class = F.shiftright("interval", CLASS_SHIFT)
        folded = live.withColumn("interval", interval_of(F.col("id"), of_class, bits))
        return self._add(folded, None, whole=True, bits=bits)

    def _add(self, new: DataFrame, removed: DataFrame | None, whole: bool, bits: int) -> BlockIndex:
        known = self.layers()
        number = known[-1]["layer"] + 1 if known else 1

        def put(name: str, rows: DataFrame) -> DataFrame:
            path = f"{self.path}/{name}/layer={number}"
            with shuffles_dropped(self.spark):
                rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
            return self.spark.read.schema(rows.schema).parquet(path)

        forward = put("forward", new)
        signed = counted(forward).withColumn("sign", F.lit(1))
        if removed is not None:
            ids = put("gone", forward.select("id").unionByName(removed).distinct())
            stale = counted(self.table("forward"), "id", "layer").join(for_hash_join(ids), "id", "left_semi")
            old = self.live(stale).drop("id", "layer")
            signed = signed.unionByName(old.withColumn("sign", F.lit(-1)))
        n = partitions_for(forward, BLOCK_TASK_BYTES)
        with aggregation_in_order(self.spark):
            put("blocks", block_rows(forward, n))
        counts = put("doc_freq", signed_doc_freq(signed).repartitionByRange("field", "term").sortWithinPartitions("field", "term"))
        put("field_stats", signed_field_stats(signed).coalesce(1))
        put("grams", gram_rows(counts.where(F.col("df") > 0)).repartitionByRange("gram").sortWithinPartitions("gram", "term"))
        marker = self.spark.range(1).select(F.lit(number).alias("layer"), F.lit(whole).alias("whole"), F.lit(bits).alias("bits"))
        marker.write.mode("append").parquet(f"{self.path}/layers")
        self._layers = self._finished()
        return self
