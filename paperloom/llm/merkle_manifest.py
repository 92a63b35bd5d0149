"""Merkle manifest of a dataset: a leaf per row, a tree per source, a tree over the sources, a proof per leaf.

Leaves are numbered within their source by ranges of (source, doc_id), so a source of any size is spread over many
tasks. Every ``FANOUT`` consecutive nodes of a level become one node above. A run of leaves is kept as one row with
its node, since its leaves differ in nothing but their own first step.

Proofs come by pointer jumping: every node holds the step (its siblings to the left and to the right) towards its
parent and a pointer to it. A self-join puts the steps of the node pointed at behind one's own and takes over its
pointer, so the distance doubles each time; after about log2(depth) joins all nodes have reached the root. A node's
descendants at a distance of 2 ** k are up to 16 ** (2 ** k), and as many times fewer nodes are pointed at, so a
join whose keys are few has a side of few rows, which adaptive execution broadcasts by its measured size.

Nulls in a field are written ``-``; null sources form a source of their own, before the others; null doc_ids come
first. Repeated doc_ids follow each other in the order of their leaves. An empty table has no rows. Columns other than
the five fields are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import numbered, stored
from paperloom.llm.line_dedup import lowered
from paperloom.plans.columns import computed_once

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
# The tree over the sources; the trees of the sources are named by the place of their first leaf.
TOP = -1
NODE = ("tree", "level", "idx")
PARENT = ("up_tree", "up_level", "up_idx")
STEP = "struct<left:string,right:string>"


def hashed(*inputs: Column) -> Column:
    """The lower-case hex SHA-256 of the inputs one after the other."""
    return F.sha2(F.concat(*inputs), 256)


def leaf(**changed: Column) -> Column:
    """The digest of a row's five fields; ``changed`` puts a column in a field's place."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return hashed(*map(field, FIELDS))


def leaves(docs: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, source, leaf) and further named columns of every row; texts are read once and not passed on."""
    return docs.select("doc_id", "source", leaf().alias("leaf"), *[c.alias(k) for k, c in more.items()])


def manifest(found: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Per leaf: doc_id, source, leaf, subroot, root, ``proof`` (the steps from the leaf to the root) and ``carried``."""
    columns = ["doc_id", "source", "leaf", *carried]
    runs, inner, top, depth = _trees(found.select(*columns), columns)
    reached = _jump(_steps(inner, top), depth)
    root = top.orderBy(F.desc("level")).limit(1).select("digest").scalar()
    met = runs.select("tree", F.lit(1).alias("level"), "idx", "n", "kids").join(reached, list(NODE))
    each = met.select(
        "n", "subroot", "steps", F.transform("kids", lambda k: k["leaf"]).alias("digests"), F.posexplode("kids").alias("at", "kid")
    )
    own = F.when(F.col("n") > 1, F.array(_step(F.col("digests"), F.col("at")))).otherwise(F.array().cast(f"array<{STEP}>"))
    return each.select(
        *[F.col("kid")[c].alias(c) for c in columns], "subroot", root.alias("root"), F.concat(own, "steps").alias("proof")
    )


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, start, lambda acc, s: hashed(s["left"], acc, s["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _step(digests: Column, at: Column) -> Column:
    """The siblings of member ``at`` (from 0) of a run."""
    before, after = F.slice(digests, F.lit(1), at), F.slice(digests, at + 2, F.size(digests))
    return F.struct(F.array_join(before, "").alias("left"), F.array_join(after, "").alias("right"))


def _trees(found: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Runs of leaves, the nodes of all sources' trees, those of the tree over them, and the depth above the runs."""
    # Fully equal rows could not be dealt to several ranges without a column of their own.
    rows = stored(found.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    rows = numbered(rows, "source", "doc_id", "leaf", "_row")
    spans = rows.groupBy("part", "source").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    sources = spans.groupBy(F.col("source").alias("of")).agg(F.min("first").alias("tree"), F.sum("n").alias("n"))
    # Joined by task and source, a source is as spread as its leaves are.
    named = spans.select(F.col("part").alias("in_part"), F.col("source").alias("in_source")).join(
        sources, F.col("in_source").eqNullSafe(F.col("of"))
    )
    here = (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("in_source"))
    placed = rows.join(named, here).select("tree", "n", (F.col("pos") - F.col("tree")).alias("at"), *columns)
    kids = F.array_sort(F.collect_list(F.struct("at", *columns)))
    runs = placed.groupBy("tree", "n", _up(F.col("at")).alias("idx")).agg(kids.alias("kids"))
    runs = stored(runs, "runs")

    longest, n_sources = sources.agg(F.max("n"), F.count(F.lit(1))).first()
    digests = F.transform("kids", lambda k: k["leaf"])
    bottom = runs.select(
        "tree", F.lit(1).alias("level"), "idx", _count(F.col("n")).alias("m"),
        F.when(F.col("n") > 1, hashed(F.array_join(digests, ""))).otherwise(F.get(digests, F.lit(0))).alias("digest"),
    )
    inner, levels = _levels(stored(bottom, "nodes"), longest or 0, 1)
    subroots = numbered(inner.where(F.col("m") == 1).select("tree", "level", "digest"), "tree")
    ranked = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("pos").alias("idx"),
        F.lit(n_sources).cast("long").alias("m"), "digest", F.col("tree").alias("of"), F.col("level").alias("of_level"),
    )
    top, above = _levels(stored(ranked, "subroots"), n_sources * FANOUT, 0)
    return runs, inner, top, levels + above


def _up(idx: Column) -> Column:
    return F.floor(idx / FANOUT).cast("long")


def _count(n: Column) -> Column:
    """Nodes one level above ``n`` nodes."""
    return F.ceil(n / FANOUT).cast("long")


def _levels(bottom: DataFrame, below: int, level: int) -> tuple[DataFrame, int]:
    """The nodes from the given level up to the one where each tree has a single node, and the number of levels.

    ``below`` is the most nodes a tree has on the level below the given one. Each level has a 16th of the rows.
    """
    found, current, most = bottom, bottom, -(-below // FANOUT)
    levels = 1
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        above = current.where(F.col("m") > 1).groupBy("tree", "m", _up(F.col("idx")).alias("up")).agg(run.alias("run"))
        current = stored(
            above.select(
                "tree", F.lit(level + levels).alias("level"), F.col("up").alias("idx"), _count(F.col("m")).alias("m"),
                hashed(F.array_join(F.transform("run", lambda k: k["digest"]), "")).alias("digest"),
            ),
            "nodes",
        )
        found, most, levels = found.unionByName(current, allowMissingColumns=True), -(-most // FANOUT), levels + 1
    return found, levels


def _steps(inner: DataFrame, top: DataFrame) -> DataFrame:
    """Every node below the root: its pointer (null: the root), its steps so far, and the subroot among them."""
    run = F.array_sort(F.collect_list(F.struct("idx", *[c for c in ("of", "of_level", "m", "digest")])))

    def stepped(nodes: DataFrame) -> DataFrame:
        """The members of every run with their step and parent."""
        runs = nodes.where(F.col("m") > 1).groupBy("tree", "level", _up(F.col("idx")).alias("up")).agg(run.alias("run"))
        each = runs.select(
            "tree", "level", "up", F.transform("run", lambda k: k["digest"]).alias("digests"),
            F.posexplode("run").alias("at", "kid"),
        )
        return each.select(
            "tree", "level", F.col("kid.idx").alias("idx"), "kid", F.array(_step(F.col("digests"), F.col("at"))).alias("steps"),
            F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), F.col("up").alias("up_idx"),
        )

    # In the tree over the sources, a node whose run is its whole level stands right below the root.
    at_root = F.col("kid.m") <= FANOUT
    higher = stepped(top).withColumns({c: F.when(~at_root, F.col(c)) for c in PARENT})
    alone = top.where((F.col("m") == 1) & (F.col("level") == 0))
    none = F.lit(None).cast("long")
    subroots = higher.where(F.col("level") == 0).select(
        F.col("kid.of").alias("tree"), F.col("kid.of_level").alias("level"), F.lit(0).cast("long").alias("idx"), *PARENT,
        "steps", F.col("kid.digest").alias("subroot"),
    ).unionByName(
        alone.select(
            F.col("of").alias("tree"), F.col("of_level").alias("level"), F.lit(0).cast("long").alias("idx"),
            none.alias("up_tree"), F.lit(None).cast("int").alias("up_level"), none.alias("up_idx"),
            F.array().cast(f"array<{STEP}>").alias("steps"), F.col("digest").alias("subroot"),
        )
    )
    no = F.lit(None).cast("string").alias("subroot")
    lower = stepped(inner.withColumns({"of": none, "of_level": F.lit(None).cast("int")}))
    return (
        lower.select(*NODE, *PARENT, "steps", no)
        .unionByName(higher.where(F.col("level") > 0).select(*NODE, *PARENT, "steps", no))
        .unionByName(subroots)
    )


def _jump(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, steps, subroot) with the steps of every node up to the root."""
    nodes, distance = stored(nodes, "steps"), 1
    while distance < depth:
        done, open_ = nodes.where(F.col("up_level").isNull()), nodes.where(F.col("up_level").isNotNull())
        # Only nodes this high, and those of the tree over the sources, are pointed at.
        met = nodes.where((F.col("level") > distance) | (F.col("tree") == TOP)).select(
            *[F.col(a).alias(b) for a, b in zip(NODE, PARENT, strict=True)],
            *[F.col(c).alias(f"far_{c}") for c in (*PARENT, "steps", "subroot")],
        )
        joined = open_.join(met, list(PARENT)).select(
            *NODE, *[F.col(f"far_{c}").alias(c) for c in PARENT], F.concat("steps", "far_steps").alias("steps"),
            F.coalesce("subroot", "far_subroot").alias("subroot"),
        )
        nodes, distance = stored(done.unionByName(joined), "steps"), distance * 2
    return nodes.select(*NODE, "steps", "subroot")


def tampered(text: Column, doc_id: Column) -> Column:
    """What the check of the registered query does to a text: A-Z lowered where 5 divides the id's checksum."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, lowered(text)).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query: the manifest of the table, checked against a tampered table."""
    changed = leaf(text=tampered(F.col("text"), F.col("doc_id")))
    rows = manifest(leaves(docs, changed=changed), ["changed"])
    checked = computed_once(
        rows, ["doc_id", "leaf", "subroot", "root"], proof_sha256=F.sha2(siblings(F.col("proof")), 256),
        folded_root=folded(F.col("changed"), F.col("proof")),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
