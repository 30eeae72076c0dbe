"""First come, first served: a row stays unless an earlier row that stayed has its key or its domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import materialise, release


def greedy_distinct(rows: DataFrame, order: str, keys: tuple[str, ...] = ("key", "domain")) -> DataFrame:
    """The rows that a sequential pass in the given order (unique, not null) would keep.

    Rounds settle all rows at once: an undecided row that is first among the undecided rows of each of
    its values stays, and the rows that share a value with it go. Null values are shared with nobody.
    The number of rounds follows the longest chain of rows that block one another, not the number of rows; the
    first undecided row always stays, so each round settles some and the last one ends it.
    """
    left = materialise(rows.select(order, *keys), "undecided")
    kept: DataFrame | None = None
    while True:
        firsts = left
        for k in keys:
            least = left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first_{k}"))
            firsts = firsts.join(least, k, "left")
        stays = F.lit(True)
        for k in keys:
            stays = stays & (F.col(k).isNull() | (F.col(f"_first_{k}") == F.col(order)))
        winners = materialise(firsts.where(stays).select(order, *keys), "winners")
        kept = winners if kept is None else kept.unionByName(winners)
        rest = left.join(winners.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(winners.where(F.col(k).isNotNull()).select(k), k, "left_anti")
        new = materialise(rest, "undecided")
        release(left)
        left = new
        if left.isEmpty():
            return rows.join(kept.select(order), order, "left_semi")
