"""Joins where one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.plans.sizing import BROADCAST_ROW_LIMIT
from paperloom.session import shuffles_dropped

# A key is spread over one sub-key per such share of all rows: no sub-key holds more.
SHARES = 1_000
# Steps per doubling of a key's rows, in which the limit between frequent and rare keys is found.
STEPS = 8


def heavy_keys(rows: DataFrame, on: str, shares: int = SHARES) -> DataFrame:
    """(key, parts): keys with at least one ``1 / shares`` of the rows, and how many such shares they hold.

    A frequent-items sketch finds them in one pass that shuffles sketches only. At most ``shares``
    keys are that heavy; the sketch keeps ten times as many items, and its counts are never too low
    for those. One pass, one row per heavy key.
    """
    sketch = F.expr(f"approx_top_k(`{on}`, {shares}, {10 * shares})")
    found = rows.agg(sketch.alias("top"), F.count(on).alias("n")).select("n", F.inline("top"))
    parts = F.ceil(F.col("count") * shares / F.col("n")).cast("int")
    return found.where(F.col("item").isNotNull() & (F.col("count") * shares >= F.col("n"))).select(F.col("item").alias(on), parts.alias("parts"))


def salted_join(big: DataFrame, small: DataFrame, on: str, spread_by: str, salts: int = SHARES) -> DataFrame:
    """Equi-join whose big side may be dominated by a few keys.

    Rows of a heavy key are spread over sub-keys by another column, more of them the more rows it
    has; the other side's rows of that key are repeated once per sub-key, those of other keys stay
    single. The result is that of the plain join.
    """
    heavy = F.broadcast(heavy_keys(big, on, salts))
    parts = F.coalesce("parts", F.lit(1))
    left = big.join(heavy, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("parts")
    right = small.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [on, "_salt"]).drop("_salt")


def least_frequent(keyed: DataFrame, rows: str, limit: int) -> int | None:
    """The fewest rows of a key that make it frequent, so that at most ``limit`` keys are; None if even the first step has more."""
    step = F.floor(F.log2(F.greatest(F.col(rows), F.lit(1))) * STEPS)
    with shuffles_dropped(keyed.sparkSession):
        steps = keyed.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min(rows).alias("least")).collect()
    least, n = None, 0
    for s in sorted(steps, key=lambda s: -s["step"]):
        n += s["n"]
        if n > limit:
            break
        least = s["least"]
    return least


def frequent_first_join(big: DataFrame, keyed: DataFrame, on: list[str], rows: str, limit: int = BROADCAST_ROW_LIMIT,
                        narrow: Callable[[DataFrame], DataFrame] = lambda df: df,
                        widen: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Equi-join with one row per key whose column ``rows`` says how many rows of the big side have the key.

    The keys that most rows have are broadcast, up to a limit; only rows of the rarer keys move. The
    result is that of the plain join. ``keyed`` is read several times. ``narrow`` and ``widen`` turn
    rows into what moves and back; the key stays as it is.
    """
    least = least_frequent(keyed, rows, limit)
    if least is None:
        return widen(narrow(big).join(keyed.hint("shuffle_hash"), on))
    is_frequent = F.col(rows) >= least
    frequent = F.broadcast(keyed.where(is_frequent))
    rest = narrow(big.join(frequent, on, "left_anti")).join(keyed.where(~is_frequent).hint("shuffle_hash"), on)
    return big.join(frequent, on).unionByName(widen(rest))
