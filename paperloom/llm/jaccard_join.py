"""N-gram Jaccard join: groups of documents whose word shingles have a similarity of 0.75 or more.

Exact join by prefix lists, with set-relation skipping (Wang and others 2017):

1. every text becomes the set of its 64-bit shingle hashes; equal sets are one, named by the hash of the set;
2. sets are ordered by hash, shingles met in many documents last, so lists stay short; the first
   quarter of each set goes to the lists of its shingles. Two linked sets share a list;
3. a list is sorted by set size and read once. Its entries fall into blocks of sizes that can link: an entry is a
   candidate for its block's first entry only, and blocks that cannot hold a partner are skipped by position.
   Short lists give all their pairs;
4. candidates are filtered by a parity sketch of two to four bits per shingle, whose difference never exceeds that of
   the sets (the longer one of two is folded), then verified on the
   whole sets: one candidate of each set first, then those that the components so far leave open;
5. the answers of all entries of a list that have become one component follow from each other: such lists, the
   long lists of large groups of copies, are skipped. In the others only pairs across components are still open; these
   are compared by sketch in blocks, in rounds: each set names the closest of its partners in a list, one at first and
   eight times as many each time, and these are verified. What has become one component meanwhile is settled and not
   named again; a list that has named all its open pairs is done.

So no pair within a group of copies is listed but one per entry and list, and no link that would join two components is
lost. Hot lists arrive with one row per set and batch; open lists and hot first entries are split into blocks.

Defined cases: a null or empty text has no shingles, is linked with nothing and is a component of its own; rows of one
doc_id and one text count as one document; a null doc_id names no component unless nothing else does; an empty
table gives an empty result; other columns are ignored (or passed through by ``one_of_each``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import WordHashes, gram_hashes, mixed, removed, signed, slices, stored, texts
from paperloom.llm.components import components

SHINGLE = 5
# Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
# Lists up to this length give all their pairs at once.
SHORT = 8
# Entries of an open list, and partners of one set, that one task compares.
BLOCK = 1024
# Places of texts to fetch are broadcast up to so many rows of 20 bytes; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 200_000
# A shingle in more than this share of the documents is ordered last; so at most (mean set size / share) are.
COMMON = 0.001
# Least 64-bit words of a parity sketch.
SKETCH = 2

NULL_ID = -(1 << 63)
SETS = "id long, key int, n long, name long, sketch array<long>, shingle long, documents long"
ENTRIES = "shingle long, name long, n int"
FOUND = "shingle long, a long, n long, b long"
OPEN = "shingle long, a long, b long"


def shingles(text: bytes, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = hashes.of(text.lower().split())
    return np.unique(gram_hashes(words, min(size, max(1, len(words)))))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many shingles of a set of n stand in lists: linked sets have one of these in common."""
    return n - -(-percent * n // 100) + 1 if n else 0


def name_of(own: np.ndarray) -> int:
    """The hash that names a set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def sketch_of(own: np.ndarray) -> np.ndarray:
    """One bit per hash bucket: whether it holds an odd number of shingles. Buckets are a power of two, two to four per
    shingle: sets whose similarity is below some 0.71 then hardly ever pass."""
    bits = max(SKETCH * 64, 1 << max(0, 2 * len(own) - 1).bit_length())
    odd = np.bincount((mixed(own) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch of half as many buckets."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def _alike(x: str, y: str) -> tuple[Column, Column]:
    """Two sketch columns in the length of the shorter; sets that can link differ by one fold at most."""

    def fold(own: Column, other: Column) -> Column:
        half = F.floor(F.size(own) / 2).cast("int")
        once = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(own) > F.size(other), once).otherwise(own)

    return fold(F.col(x), F.col(y)), fold(F.col(y), F.col(x))


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.hash(text_col).alias("key"),
        F.col(text_col).alias("text"),
    )


def _sets(size: int):
    """One row per document, and one per shingle that many documents of a batch hold."""

    def run(stream):
        hashes = WordHashes()
        for batch in slices(stream, 2):
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = [shingles(t, hashes, size) for t in texts(batch.column(2))]
            names = [name_of(s) if len(s) else None for s in own]
            none = [None] * len(own)
            yield _batch([ids, keys, [len(s) for s in own], names, [sketch_of(s) for s in own], none, none], SETS)
            distinct = [*dict(zip(names, own, strict=True)).values()]
            common, counts = np.unique(np.concatenate(distinct), return_counts=True)
            often = counts >= max(3, COMMON * len(distinct))
            none = [None] * int(often.sum())
            yield _batch([none, none, none, none, none, signed(common[often]), counts[often]], SETS)

    return run


def _entries(common, size: int, percent: int):
    def run(stream):
        hashes, last = WordHashes(), common.value
        for batch in slices(stream, 0):
            seen, rows = set(), []
            for text in texts(batch.column(0)):
                own = shingles(text, hashes, size)
                n, name = len(own), name_of(own)
                if not n or name in seen:
                    continue
                seen.add(name)
                at = np.minimum(np.searchsorted(last, own), len(last) - 1)
                late = last[at] == own
                k = prefix_length(n, percent)
                first = np.concatenate([own[~late], own[late]])[:k]
                rows.append((signed(first), np.full(k, name), np.full(k, n)))
            if rows:
                yield _batch([np.concatenate(c) for c in zip(*rows, strict=True)], ENTRIES)

    return run


def fits(small: int, large: int, percent: int = PERCENT) -> bool:
    """Whether sets of these sizes can link."""
    return 100 * small >= percent * large


def _candidates(stream, percent: int):
    """Lists sorted by shingle and size: candidate pairs, and the entries of lists that are not short."""

    def made(lists: list) -> pa.RecordBatch:
        rows = []
        for shingle, members in lists:
            if len(members) <= SHORT:
                rows += [(None, a[0], None, b[0]) for a, b in combinations(members, 2) if fits(a[1], b[1], percent)]
        return _batch(list(zip(*rows, strict=True)) or [[]] * 4, FOUND)

    shingle, held, long, first, lists, out = None, [], False, None, [], []
    for batch in stream:
        # Most lists have one entry: within a batch they are left out before rows are looked at.
        listed = batch.column(0).to_numpy()
        alike = listed[1:] == listed[:-1]
        met = np.concatenate([[True], alike]) | np.concatenate([alike, [True]])
        for s, name, n in zip(*(c.to_numpy()[met[: len(listed)]].tolist() for c in batch.columns), strict=True):
            if s != shingle:
                if len(held) > 1 and not long:
                    lists.append((shingle, held))
                shingle, held, long, first = s, [(name, n)], False, (name, n)
                continue
            if name == held[-1][0]:
                continue
            if not long:
                held.append((name, n))
                if len(held) <= SHORT:
                    continue
                long, members, first = True, held, held[0]
            else:
                held, members = [(name, n)], [(name, n)]
            for m in members:
                out.append((s, m[0], m[1], None))
                if not fits(first[1], m[1], percent):
                    first = m
                elif m is not first:
                    out.append((None, first[0], None, m[0]))
        yield made(lists)
        lists = []
        if out:
            yield _batch(list(zip(*out, strict=True)), FOUND)
            out = []
    if len(held) > 1 and not long:
        lists.append((shingle, held))
    yield made(lists)


def _across(stream, percent: int, tries: int):
    """Open lists in blocks (shingle, i, j): pairs of different components that size and sketch allow.

    Each set names its closest larger partners, up to ``tries``; a row with the shingle alone says that a list has more.
    """

    def pairs(shingle: int, rows: list) -> pa.RecordBatch:
        name, block, size, part = (np.array(c) for c in zip(*[r[:4] for r in rows], strict=True))
        order = np.argsort(size, kind="stable")
        name, block, size, part = (c[order] for c in (name, block, size, part))
        sketches = [np.array(rows[k][4], np.int64).view(np.uint64) for k in order]
        words = np.array([len(x) for x in sketches])
        # Sets that can link have as many words, or twice as many: a matrix of each length, and of each longer one folded.
        lengths = np.unique(words).tolist()
        place = {m: np.flatnonzero(words == m) for m in lengths}
        whole = {m: np.stack([sketches[k] for k in place[m]]) for m in lengths}
        half = {m: folded(whole[m]) for m in lengths if m // 2 in place}
        far = np.searchsorted(size, size * 100 // percent, "right")
        split = len(set(block.tolist())) > 1
        a, b, more = [], [], False
        for k in range(len(name)):
            own, found, gap = int(words[k]), [], []
            for m, sketch in ((own, whole), (2 * own, half)):
                if m not in sketch:
                    continue
                first, last = np.searchsorted(place[m], (k + 1, far[k]))
                other = place[m][first:last]
                open_ = (part[other] != part[k]) & (name[other] != name[k])
                if split:
                    open_ &= block[other] != block[k]
                other = other[open_]
                differ = np.bitwise_count(sketch[m][first:last][open_] ^ sketches[k]).sum(1, dtype=np.int64)
                total = size[other] + size[k]
                fit = possible(differ, total, percent)
                found.append(other[fit])
                gap.append(differ[fit] / total[fit])
            if not any(map(len, found)):
                continue
            found = np.concatenate(found)
            if len(found) > tries:
                found, more = found[np.lexsort((name[found], np.concatenate(gap)))[:tries]], True
            a += [name[k]] * len(found)
            b += name[found].tolist()
        none = [None] * more
        return _batch([[None] * len(a) + [shingle] * more, a + none, b + none], OPEN)

    group, held = None, []
    for batch in stream:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != group:
                if held:
                    yield pairs(group[0], held)
                group, held = row[:3], []
            held.append(row[3:])
    if held:
        yield pairs(group[0], held)


def possible(differ, total, percent: int = PERCENT):
    """Whether sets of so many elements together may link if they differ in at least ``differ``."""
    return (100 + percent) * differ <= (100 - percent) * total


class _Join:
    """The steps that both rounds of verifying share."""

    def __init__(self, docs: DataFrame, sets: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        named = sets.filter("name is not null")
        self.docs = docs
        self.reps = named.groupBy("name").agg(
            F.min(F.struct("id", "key")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
        )

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Pairs that size and sketch allow."""
        side = lambda x: self.reps.select(F.col("name").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        joined = joined.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        bits = F.zip_with(*_alike("s_a", "s_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        differ = F.aggregate(bits, F.lit(0), lambda n, x: n + x)
        return joined.filter(possible(differ, F.col("n_a") + F.col("n_b"), self.percent)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs, by the whole sets; a set's partners are compared in blocks."""
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
        places = places_table = stored(self.reps.join(wanted, "name").select("name", "rep.id", "rep.key"), "places")
        if places.count() <= BROADCAST_ROWS:
            places = F.broadcast(places)
        fetched = stored(self.docs.join(places, ["id", "key"]).select("name", "text"), "texts")
        blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        first = fetched.join(blocks.withColumnRenamed("a", "name"), "name").select(
            F.col("name").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.lit(None).cast("long").alias("b"), "text",
        )
        second = pairs.join(blocks, "a").join(fetched.withColumnRenamed("name", "b"), "b").select(
            "a", F.pmod(F.hash("b"), F.col("blocks")).alias("block"), "b", "text"
        )
        rows = first.unionByName(second).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))

        size, percent = self.size, self.percent

        def run(stream):
            hashes, own = WordHashes(), None
            for batch in slices(stream, 3):
                a, b = [], []
                columns = [c.to_pylist() for c in batch.columns[:3]]
                for left, _, right, text in zip(*columns, texts(batch.column(3)), strict=True):
                    given = shingles(text, hashes, size)
                    if right is None:
                        own = given
                        continue
                    both = len(np.intersect1d(own, given, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(given) - both):
                        a.append(left)
                        b.append(right)
                yield _batch([a, b], "a long, b long")

        found = stored(rows.mapInArrow(run, "a long, b long"), "verified")
        for done in (fetched, places_table, pairs):
            removed(done)
        return found


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose sets are not in one component yet."""
    for x in "ab":
        side = groups.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}"))
        pairs = pairs.join(side, x, "left")
    return pairs.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).drop("part_a", "part_b")


def _named(join: _Join, lists: DataFrame, groups: DataFrame, tries: int) -> DataFrame:
    """Of the lists (shingle, name, n) that hold several components: the pairs that their sets name, in blocks."""
    part = F.coalesce("component", "name").alias("part")
    lists = lists.join(groups.withColumnRenamed("node", "name"), "name", "left").select("shingle", "name", "n", part)
    lists = stored(lists, "lists")
    open_ = lists.groupBy("shingle").agg(F.count("*").alias("g"), F.min("part").alias("x"), F.max("part").alias("y"))
    open_ = open_.filter("x < y").select("shingle", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks"))
    split = lists.join(open_, "shingle").join(join.reps.select("name", "sketch"), "name")
    split = split.withColumn("block", F.pmod(F.hash("name"), F.col("blocks")))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select(
        "shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "name", "block", "n", "part", "sketch",
    )
    dealt = split.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    percent = join.percent
    named = stored(dealt.mapInArrow(lambda stream: _across(stream, percent, tries), OPEN), "named")
    removed(lists)
    return named


def _completed(join: _Join, lists: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """The links with those that the lists (shingle, name, n) still hold between components.

    A list takes part until its sets have named all their open pairs; pairs tried before are not verified again.
    """
    tries, tried = 1, None
    while True:
        named = _named(join, lists, groups, tries)
        pairs = named.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        links = links.unionByName(join.verified(pairs))
        more = named.filter("shingle is not null").select("shingle").distinct()
        if more.isEmpty():
            return links
        lists = lists.join(more, "shingle", "left_semi")
        tried = pairs if tried is None else tried.unionByName(pairs)
        groups = stored(components(links), "components")
        tries *= 8


def group_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Per document (and text): id, key, n, name of its set, the component's own name (part) and component_id."""
    spark = docs.sparkSession
    source = _keyed(docs, id_col, text_col)
    both = stored(source.mapInArrow(_sets(size), SETS), "sets")
    sets = both.filter("id is not null").select("id", "key", "n", "name", "sketch")
    total = sets.count()
    common = both.filter("shingle is not null").groupBy("shingle").agg(F.sum("documents").alias("documents"))
    common = common.filter(F.col("documents") > COMMON * total).select("shingle").toArrow()["shingle"].to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(np.append(common, -1).view(np.uint64)))
    entries = source.select("text").mapInArrow(_entries(shared, size, percent), ENTRIES)
    entries = entries.repartition("shingle").sortWithinPartitions("shingle", "n", "name")
    found = stored(entries.mapInArrow(lambda stream: _candidates(stream, percent), FOUND), "candidates")
    join = _Join(source, sets, size, percent)
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    likely = stored(join.sketched(found.filter("b is not null").select(*pair).distinct()), "likely")
    links = join.verified(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    groups = stored(components(links), "components")
    links = links.unionByName(join.verified(_apart(likely, groups).select("a", "b")))
    groups = stored(components(links), "components")

    lists = found.filter("b is null").select("shingle", F.col("a").alias("name"), "n")
    groups = components(_completed(join, lists, links, groups))

    part = F.coalesce("component", "name").alias("part")
    grouped = sets.join(groups.withColumnRenamed("node", "name"), "name", "left")
    grouped = stored(grouped.select("id", "key", "n", "name", part), "groups")
    least = grouped.filter("part is not null").groupBy("part")
    least = least.agg(F.min(F.when(F.col("id") != NULL_ID, F.col("id"))).alias("component_id"), F.min("id").alias("first"))
    own = F.when(F.col("id") != NULL_ID, F.col("id"))
    return grouped.join(least, "part", "left").select(
        own.alias("doc_id"), "id", "key", F.col("n").alias("n_shingles"), "name", "part",
        F.when(F.col("part").isNull(), own).otherwise(F.col("component_id")).alias("component_id"),
    )


def digest(grouped: DataFrame) -> DataFrame:
    """The contract's columns."""
    return grouped.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id names their component; all columns as they are."""
    grouped = group_documents(docs, id_col, text_col)
    stay = grouped.filter("component_id <=> doc_id").select("id", "key").distinct()
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.hash(text_col).alias("key"),
    )
    return rows.join(stay, ["id", "key"], "left_semi").select("row.*")


def brute_force(docs: list[tuple]) -> dict:
    """(n_shingles, component_id) by comparing all pairs, for tests."""
    sets = {}
    for d, t in docs:
        ws = (t or "").encode().lower().split()
        n = min(SHINGLE, max(1, len(ws)))
        sets[d] = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if ws else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= PERCENT * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}
