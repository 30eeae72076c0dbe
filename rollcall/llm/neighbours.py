"""Near-duplicate vectors by NN-descent, within labels, at a cosine threshold.

Exact copies become one vertex. A first neighbour graph comes from several orders by random hyperplanes
(each vertex and a few before it). Rounds then join neighbours with neighbours: each vertex brings its
neighbours, and those it is a neighbour of, together and offers every pair of them to each other. A
list that is full of entries beyond the threshold is saturated and grows. The edges beyond the
threshold are kept, checked in double precision. A saturated list ends as large as its component: within
components all vectors are compared, block against block, so no list is cut short. Further passes then
leave pairs of one component aside, so that dense groups, whose lists are full of their own members, find
their links with other groups; they follow until one finds no new link and a sample of queries against all
rows, which audits the recall, is content. A recall that stays too low is reported.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.components import connected_components
from rollcall.session import materialise, release

#: Entries of a list at first; orders of the first graph; rows before it that a row of an order is compared with.
LIST, ORDERS, BEFORE = 6, 6, 4
#: Rounds of neighbours with neighbours; vectors that meet in one task for one vertex or in one block.
ROUNDS, MEET, BLOCK = 2, 64, 512
#: Queries of an audit, the recall it asks for (of all links, and on average over queries that have links), and passes at most.
AUDIT, RECALL, PASSES = 400, 0.97, 4
_LOG = logging.getLogger(__name__)
_SLACK = 1e-4  # of single precision


def _vertices(rows: DataFrame) -> DataFrame:
    """vec_id, label, ok, k1, k2 (key of the vector), unit (float32), vec (float64), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, k1, k2, units, vectors = [], [], [], [], []
            for value in batch.column(2):
                x = value.values
                good = x is not None and len(x) > 0 and x.null_count == 0
                v = np.asarray(x, dtype=np.float64) + 0.0 if good else np.empty(0)
                scale = np.abs(v).max() if good else 0.0
                good = good and bool(np.isfinite(scale)) and scale > 0
                ok.append(good)
                key = xxhash.xxh3_128_digest(v.tobytes())
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                v = v / scale if good else v  # so that squares neither vanish nor overflow
                units.append((v / np.linalg.norm(v)).astype(np.float32).tobytes() if good else b"")
                vectors.append(v.tobytes() if good else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ok), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(units, pa.binary()), pa.array(vectors, pa.binary())],
                ["vec_id", "label", "ok", "k1", "k2", "unit", "vec"],
            )

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, ok boolean, k1 long, k2 long, unit binary, vec binary")


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _pairs_batch(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float32())], ["a", "b", "sim"])


_PAIRS = "a long, b long, sim float"


def _first_edges(vertices: DataFrame, seed: int) -> DataFrame:
    """Pairs of rows of different components that stand close in an order by the signs of random projections, for ORDERS
    orders: of each of the last few components before it, a row meets the last BEFORE rows."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(3).to_pylist()])
            for n in np.unique(lengths):  # vectors of one dimension
                part = batch.filter(pa.array(lengths == n))
                unit = _matrix(part.column(3))
                for t in range(ORDERS):
                    planes = np.random.default_rng([seed, t, int(n)]).standard_normal((unit.shape[1], 24)).astype(np.float32)
                    bits = (unit @ planes > 0) @ (1 << np.arange(23, -1, -1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(unit), t), pa.int32()), *part.columns, pa.array(bits, pa.int64())],
                        ["t", "node", "group", "component", "unit", "code"],
                    )

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = None, {}  # by component its last rows, the component that came last at the end
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            sim: list[float] = []
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for t, node, group, component, unit in zip(*columns, strict=True):
                if (t, group) != place:
                    place, last = (t, group), {}
                x = np.frombuffer(unit, np.float32)
                for other, rows in last.items():
                    if other != component:
                        for name, y in rows:
                            a.append(node)
                            b.append(name)
                            sim.append(float(x @ y))
                last[component] = [*last.pop(component, [])[-BEFORE + 1 :], (node, x)]
                if len(last) > BEFORE + 1:
                    del last[next(iter(last))]
            yield _pairs_batch(a, b, sim)

    coded = vertices.select("node", "group", "component", "unit").mapInArrow(code, "t int, node long, group long, component long, unit binary, code long")
    ordered = coded.repartitionByRange("t", "group", "code", "node").sortWithinPartitions("t", "group", "code", "node")
    return ordered.select("t", "node", "group", "component", "unit").mapInArrow(slide, _PAIRS)


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def _lists(pairs: DataFrame, room: DataFrame | None, threshold: float) -> DataFrame:
    """a, b, sim, n (of a's list), worst: the best entries of each list; a saturated list doubles its room."""
    one = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    size = F.lit(LIST)
    if room is not None:
        one = one.join(room, "a", "left")
        size = F.coalesce("room", F.lit(LIST))
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    ranked = one.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= size)
    whole = Window.partitionBy("a")
    worst, n = F.min("sim").over(whole), F.count("*").over(whole)
    return ranked.select("a", "b", "sim", F.when(n >= size, worst).otherwise(F.lit(-2.0).cast("float")).alias("worst"), size.alias("room"))


def _meet(graph: DataFrame, vertices: DataFrame) -> DataFrame:
    """Offers all pairs of different components among each vertex's neighbours (either way) and itself; what is no improvement is left out.

    A vertex that is the neighbour of very many has them meet in parts of about MEET, each with itself.
    """
    worst = graph.groupBy("a").agg(F.min("worst").alias("worst"))
    guests = graph.select(F.col("a").alias("v"), F.col("b").alias("u")).union(graph.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct()
    load = guests.groupBy("v").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts"))
    placed = guests.join(load, "v").select("v", "u", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"))
    hosts = load.select("v", F.col("v").alias("u"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    known = vertices.select(F.col("node").alias("u"), "component", "unit").join(worst.withColumnRenamed("a", "u"), "u", "left")
    rows = placed.unionByName(hosts).join(known, "u").select("v", "part", "u", "component", "unit", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, own, units, bounds = None, [], [], [], []

        def offers() -> pa.RecordBatch | None:
            if len(ids) < 2:
                return None
            x, node, part_of, bound = np.stack(units), np.array(ids), np.array(own), np.array(bounds, np.float32)
            sim = x @ x.T
            i, j = np.nonzero((sim > bound[:, None]) & (part_of[:, None] != part_of[None, :]))
            return _pairs_batch(node[i], node[j], sim[i, j])

        held = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for v, part, u, component, unit, bound in zip(*columns, strict=True):
                if (v, part) != key:
                    if (made := offers()) is not None:
                        held.append(made)
                    if len(held) >= 500:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held = []
                    key, ids, own, units, bounds = (v, part), [], [], [], []
                ids.append(u)
                own.append(component)
                units.append(np.frombuffer(unit, np.float32))
                bounds.append(bound)
        if (made := offers()) is not None:
            held.append(made)
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.repartition("v", "part").sortWithinPartitions("v", "part").mapInArrow(run, _PAIRS)


def _descend(vertices: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """The threshold edges (a > b) after ROUNDS rounds from the given pairs."""
    graph = materialise(_lists(_both_ways(edges), None, threshold), "graph")
    for _ in range(ROUNDS):
        room = graph.groupBy("a").agg(F.max("room").alias("room"), F.min("worst").alias("worst")).select(
            "a", F.when(F.col("worst") >= threshold, 2 * F.col("room")).otherwise(F.col("room")).alias("room")
        )
        offered = _meet(graph, vertices)
        graph = materialise(_lists(graph.select("a", "b", "sim").union(_both_ways(offered)), room, threshold), "graph")
    near = graph.where(F.col("sim") >= threshold - _SLACK)
    return near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _cosines(pairs: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine in double precision reaches the threshold."""
    full = vertices.select("node", "vec")
    rows = pairs.join(full.select(F.col("node").alias("a"), F.col("vec").alias("x")), "a").join(
        full.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b"
    ).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                float(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold
                for x, y in ((np.frombuffer(p, np.float64), np.frombuffer(q, np.float64)) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            ]
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _counted(members: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """node, links: rows within its component at the threshold, all blocks against all, copies included."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.withColumn("other", other).select(
        "component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node"
    )
    rows = spread.join(vertices.select("node", "copies", "vec"), "node").select("component", "p", "q", "block", "node", "copies", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def count() -> pa.RecordBatch:
            block, node, copies = (np.array([h[k] for h in held]) for k in (0, 1, 2))
            x = np.stack([np.frombuffer(h[3], np.float64) for h in held])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            if key[1] == key[2]:
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                total = near @ copies
            else:
                left = block == key[1]
                near = x[left] @ x[~left].T >= threshold
                total = np.zeros(len(node), np.int64)
                total[left], total[~left] = near @ copies[~left], near.T @ copies[left]
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(total.astype(np.int64))], ["node", "links"])

        made = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if row[:3] != key:
                    if held:
                        made.append(count())
                    if len(made) >= 500:
                        yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                        made = []
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            made.append(count())
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    counted = rows.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q", "block").mapInArrow(run, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def audit_recall(vertices: DataFrame, found: DataFrame, threshold: float, queries: int = AUDIT) -> tuple[int, int, float]:
    """(links found, links there are, mean recall of those with links) of a hashed sample of vertices, each compared with all others.

    Only the bounded sample's vectors are sent to the tasks.
    """
    sample = vertices.orderBy(F.xxhash64("node", F.lit(1))).limit(queries).select("node", "group", "unit", "vec").collect()
    spark = vertices.sparkSession
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_group: dict[int, list] = {}
        for r in shared.value:
            by_group.setdefault(r["group"], []).append((r["node"], np.frombuffer(r["vec"], np.float64)))
        for batch in batches:
            group = np.asarray(batch.column(1))
            names, counts = [], []
            for g in np.unique(group):
                if int(g) not in by_group:
                    continue
                part = batch.filter(pa.array(group == g))
                x = _matrix(part.column(2), np.float64)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                node, copies = np.asarray(part.column(0)), np.asarray(part.column(3))
                for name, q in by_group[int(g)]:
                    near = (x @ (q / np.linalg.norm(q)) >= threshold) & (node != name)
                    names.append(name)
                    counts.append(int(copies[near].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts, pa.int64())], ["node", "there"])

    there = vertices.select("node", "group", "vec", "copies").mapInArrow(run, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    seen = F.least(F.coalesce("links", F.lit(0)), F.col("there"))
    row = there.join(found, "node", "left").agg(F.sum(seen), F.sum("there"), F.avg(F.when(F.col("there") > 0, seen / F.col("there")))).first()
    return (row[0] or 0, row[1] or 0, 1.0 if row[2] is None else row[2])


def near_duplicates(
    embeddings: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows are compared within equal labels and dimensions. A row without a label, or whose vector is
    null, empty, zero, or holds a null or non-finite component, links with nothing and is kept. Equal
    vectors of one label always link (their cosine is 1). n_links counts other rows directly linked;
    component_id is the least vec_id reachable; kept marks that row. Empty tables give no rows.
    """
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    prepared = materialise(_vertices(rows), "vectors")
    valid = prepared.where("ok and label is not null").withColumn("group", F.xxhash64(F.col("label").cast("string"), F.length("vec")))
    keys = ["label", "k1", "k2"]
    vertices = materialise(
        valid.groupBy(*keys).agg(
            F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("group").alias("group"), F.first("unit").alias("unit"), F.first("vec").alias("vec")
        ),
        "vertices",
    )
    edges, members = None, None
    for turn in range(PASSES):
        if members is None:
            known = vertices.withColumn("component", F.col("node"))
        else:
            known = vertices.join(members, "node", "left").withColumn("component", F.coalesce("component", "node"))
        known = materialise(known, "known")
        new = _descend(known, _first_edges(known, turn), threshold)
        new = materialise(_cosines(new if edges is None else new.join(edges, ["a", "b"], "left_anti"), vertices, threshold), "links")
        release(known)
        done = new.isEmpty()
        if members is None or not done:
            edges = new if edges is None else edges.union(new)
            members = materialise(connected_components(edges), "members")
            links = materialise(_counted(members, vertices, threshold), "counted")
        if turn and done or turn == PASSES - 1:
            got, there, mean = audit_recall(vertices, links, threshold)
            if min(mean, got / there if there else 1.0) >= RECALL:
                break
    else:
        _LOG.warning("neighbour search: %d of %d audited links found, mean recall %.4f, below %.2f", got, there, mean, RECALL)
    table = vertices.select(*keys, "node", "copies").join(members, "node", "left").join(links, "node", "left").select(
        *keys, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "node").alias("_component")
    )
    out = prepared.select("vec_id", "label", "ok", "k1", "k2").join(table, keys, "left")
    alone = ~F.col("ok") | F.col("label").isNull()
    n = F.when(alone, 0).otherwise(F.col("_links")).cast("long")
    root = F.when(alone, F.col("vec_id")).otherwise(F.col("_component"))
    return out.select("vec_id", n.alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))
