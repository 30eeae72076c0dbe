"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rollcall.session import materialise, release

#: A vertex of more edges than this is a hub: its edges are not joined in one task, but look the hub up in a table
#: that every task has. Of E edges at most E / HUB_EDGES vertices are hubs, and HUB_EDGES grows until that is MOST_HUBS.
HUB_EDGES, MOST_HUBS = 100_000, 100_000
#: Vertices that a worker remembers while it leaves out edges between those it has linked already.
HELD_VERTICES = 200_000


def _looked_up(edges: DataFrame, key: str, least: DataFrame, n_edges: int) -> DataFrame:
    """The edges with m, the entry (key, m) that `least` has for their end `key`, or null."""
    many = max(HUB_EDGES, n_edges // MOST_HUBS)
    if n_edges > many:
        hubs = edges.groupBy(key).count().where(F.col("count") > many).select(key)
        hubs = materialise(hubs.join(least, key, "left").select(F.col(key), "m"), "hubs")
        if not hubs.isEmpty():
            few = F.broadcast(hubs)
            rest = edges.join(few, key, "left_anti").join(least, key, "left")
            return rest.select("a", "b", "m").union(edges.join(few, key).select("a", "b", "m"))
    return edges.join(least, key, "left").select("a", "b", "m")


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One round over edges (a, b) with a > b.

    Large star: every neighbour above u moves to the least vertex of u's neighbourhood.
    Small star: u and its neighbours below u move to the least of them.
    The least vertex comes from a partial aggregate, and hubs are looked up apart, so that no hub meets all its
    neighbours in one task.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        up = least.withColumnRenamed("a", "b")
        moved = _looked_up(edges, "b", up, n_edges).select("a", F.coalesce("m", "b").alias("b"))
    else:
        moved = _looked_up(edges, "a", least, n_edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every vertex of an edge list; component is the least vertex reachable.

    Vertices may be longs or strings. Edges with a null end are ignored; a self-loop makes its vertex
    a component of its own; repeated and reversed edges count once; an empty list gives no rows.
    Rounds grow with the logarithm of the longest path, and each is written to the shared folder, so
    lineage stays one round deep. They end when a round changes nothing.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs = materialise(pairs, "edges")
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    now, mark = _marked(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = (0, None)
    while mark != seen and mark[0]:
        larger, mid = _marked(_star(now, True, mark[0])) if mark[0] > HUB_EDGES else (None, mark)
        new, after = _marked(_star(larger or _star(now, True, mark[0]), False, mid[0]))
        for used in (now, larger):
            if used is not None:
                release(used)
        seen, now, mark = mark, new, after
    member = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).union(loops).distinct()
    alone = roots.join(member.select("node"), "node", "left_anti")
    return member.union(alone.select("node", F.col("node").alias("component")))


def _linking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict = {}

    def root(v):
        while (up := above.setdefault(v, v)) != v:
            above[v] = v = above.setdefault(up, up)
        return v

    for batch in batches:
        if len(above) > HELD_VERTICES:
            above.clear()
        kept = []
        for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            x, y = root(a), root(b)
            if x != y:
                above[max(x, y)] = min(x, y)
            if x != y or a == b:
                kept.append(k)
        yield batch.take(pa.array(kept, pa.int64()))


def thinned(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges (a, b) with the same components: those of a partition without most of the ones between vertices that its earlier ones
    link. Where all pairs of a group lie together, a group of n is left with about n edges before any of them is shuffled."""
    pairs = edges.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return pairs.mapInArrow(_linking, pairs.schema)


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and a fingerprint of the set that does not depend on its order, taken while writing."""
    seen = Observation()
    out = materialise(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "stars")
    got = seen.get
    return out, (got["n"], got["s"])
