"""Line dedup: lines that many documents hold go from all of them.

DataFrame expressions only. Lines are exploded and hashed; a document's distinct lines are found inside its row, so
counting documents per line is one aggregate with partial sums before the shuffle. Texts do not travel with their
lines: what is joined with the frequent lines is (name of the row, position, hash), and the positions to drop come
back to the texts in one join.

A few lines may make up a third of all rows. Lines with at least one ``1 / HEAVY`` share of what the frequent lines
hold number at most ``HEAVY``; they are broadcast and split into as many parts as they have such shares. No other
line holds more than that share.

Every row is a document of its own, also where ids are null or repeated; a null text is one empty line. Rows equal in
id and text are decided alike. Columns ``n_lines`` and ``n_dropped`` of the input are replaced, others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stored
from paperloom.plans.columns import computed_once

# A line's key has no white space at its ends and no capitals A-Z.
WHITE = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCUMENTS = 10
MIN_CHARS = 1
HEAVY = 1_000


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def lines_of(text: Column) -> Column:
    """The lines of a text; an empty text has one."""
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def _hashes(key: Column) -> list[Column]:
    """128 bits that name a key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def frequent_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n): the hashes of keys of at least ``min_chars`` code points in at least ``min_documents`` rows."""
    lines = lines_of(lowered(F.coalesce("text", F.lit(""))))
    own = docs.select(F.explode_outer(F.array_distinct(F.transform(lines, _key))).alias("key"))
    own = own.where(F.length("key") >= min_chars)
    return own.select(*_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_documents
    )


def drop_frequent_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows with frequent lines cut from ``text``, ``n_lines`` before and ``n_dropped``."""
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    text = F.coalesce("text", F.lit(""))
    named = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("row"),
        text.alias("text"),
        F.xxhash64("doc_id", text).alias("r1"),
        F.xxhash64(F.lit(1), F.col("doc_id"), text).alias("r2"),
    )
    places = _places(named, stored(frequent_lines(docs, min_documents, min_chars), "lines"), min_chars)
    drops = places.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    met = named.join(drops.hint("shuffle_hash"), ["r1", "r2"], "left")
    apart = computed_once(
        met, ["row"], text=F.col("text"), lines=lines_of(F.col("text")), drops=F.coalesce("drops", F.array().cast("array<int>"))
    )
    edges = F.concat(F.array(F.lit(-1)), F.col("drops"), F.array(F.size("lines")))
    apart = computed_once(apart, ["row", "text"], lines=F.col("lines"), n=F.size("drops"), edges=edges)

    def between(i: Column) -> Column:
        a, b = F.get("edges", i - 1), F.get("edges", i)
        return F.slice("lines", a + 2, b - a - 1)

    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") + 1), between))
    done = apart.select(
        "row",
        F.when(F.col("n") == 0, F.col("text")).otherwise(F.array_join(pieces, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("n").cast("long").alias("n_dropped"),
    )
    return done.select(*[F.col("row")[c].alias(c) for c in kept], done["text"], done["n_lines"], done["n_dropped"])


def _places(named: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    """(r1, r2, pos) of every line whose key is frequent."""
    lines = named.select("r1", "r2", F.posexplode_outer(lines_of(lowered(F.col("text")))).alias("pos", "line"))
    keyed = lines.select("r1", "r2", "pos", _key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    entries = keyed.select("r1", "r2", "pos", *_hashes(F.col("key")))
    total = frequent.agg(F.sum("n").alias("n")).scalar()
    parts = F.ceil(F.col("n") * HEAVY / total).cast("int")
    heavy = frequent.where(F.col("n") * HEAVY >= total).select("h1", "h2", parts.alias("parts"))
    dealt = entries.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn(
        "part", F.pmod(F.xxhash64("r1", "pos"), F.coalesce("parts", F.lit(1))).cast("int")
    )
    spread = frequent.select(
        "h1", "h2", F.explode(F.sequence(F.lit(0), F.when(F.col("n") * HEAVY >= total, parts).otherwise(1) - 1)).alias("part")
    )
    return dealt.join(spread, ["h1", "h2", "part"], "left_semi").select("r1", "r2", "pos")


def digest(rows: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
