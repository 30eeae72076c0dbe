"""Near-duplicate documents by the Jaccard similarity of their word shingles, with a token-group matrix.

Equal shingle sets become one class first. The classes that share a prefix shingle with another are
partitioned into groups of similar ones: those whose most frequent prefix shingle is the same, up to about
GROUP_ROWS to a group. All pairs inside a group are compared at once. The matrix keeps, for each group,
the prefix shingles of its members (the sparse part, in which a query's shared prefix shingles are
counted) and a bitmap of the union of their whole sets. Either bounds the overlap that a query can have
with any member; only groups whose bounds reach the threshold are opened and compared member by member,
and only groups that hold members of another component than the query's.

A pair is left out only where the prefix, the sizes or the bounds rule it out, or where its two documents
are connected already. Words and shingles are compared by hashes of 64 bits; two different ones agree
with a probability of 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.batches import small_batches
from rollcall.llm.hashing import MIX, mixed, word_hashes
from rollcall.operators.components import connected_components
from rollcall.session import materialise, release

#: Members of a group, about, and shingles of all of them; queries that meet a group in one task, about.
GROUP_ROWS, GROUP_TOKENS, QUERY_ROWS = 512, 1 << 18, 2048
#: Turns in which the groups of one key merge.
MERGE_TURNS = 3
#: Shingles found in several documents are ranked behind all others, by the magnitude of their count. Their
#: list is sent to every task; it holds at most so many (9 bytes each), the ones of the highest counts.
MOST_COMMON = 2_000_000
#: A table of up to so many bytes (its rows are counted, its bitmaps summed up) is sent to every task; a larger
#: one is joined by shuffles.
SENT_BYTES = 32 << 20
#: Bytes of texts that are read at once; shingles that are given out at once.
_SLICE, _GIVEN = 1 << 20, 1 << 19

#: Bits set in each byte.
_ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the place of each word of the bytes; a word also begins where a text does (ends: from 0)."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    return word_hashes(data, at, inside), at


def _windows(h: np.ndarray, width: int, size: int) -> np.ndarray:
    """The hash of every `width` words in a row; size: what the words' number counts as."""
    out = np.full(max(0, len(h) - width + 1), np.uint64(size))
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * MIX[k % 4] + h[k : k + len(out)]
    return mixed(out)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its shingles of `width` words, each once; the whole sequence
    if it has fewer words. Words are what ASCII white space leaves, with A-Z lower-cased. No words, no shingles.
    """
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, where, held = texts.buffers()
    offset = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + _SLICE, "right")) - 1)
        ends = offset[i : j + 1] - offset[i]
        h, at = _words(data[offset[i] : offset[j]], ends)
        whole = _windows(h, width, width)
        word = np.searchsorted(at, ends)
        for k in range(j - i):
            a, b = word[k], word[k + 1]
            s = whole[a : b - width + 1].copy() if b - a >= width else _windows(h[a:b], b - a, b - a) if b > a else h[:0]
            s.sort()
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s
        i = j


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets(pa.array([text], pa.string()), width))


def _need(n: int, percent: int) -> int:
    """The overlap that a set of n must have with any set it links with."""
    return -(-percent * n // 100)


def _both(a: int, b: int, percent: int) -> int:
    """The overlap with which sets of a and of b link."""
    return -(-percent * (a + b) // (100 + percent))


def _ratio_up(x: Column, over: int) -> Column:
    """x / over, rounded up; whole numbers of at least 0."""
    return F.ceil(x / F.lit(over) - F.lit(1e-9)).cast("long")


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _list_column(arrays: list[np.ndarray | None]) -> pa.Array:
    """A list column; None becomes null."""
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *(_signed(a) for a in arrays if a is not None)])
    empty = pa.array([a is None for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=empty)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column of longs, without a copy."""
    flat, offset = np.asarray(column.values), np.asarray(column.offsets)
    for k in range(len(column)):
        yield flat[offset[k] : offset[k + 1]].view(np.uint64)


def _prefix_rows(n: int, percent: int) -> tuple[int, int, int]:
    """The prefix within which a set of n meets each set it links with, the shingles taken beyond it (so many more must
    be shared), and those that a head holds beyond it."""
    return n - _need(n, percent) + 1, n // 24, max(16, n // 12)


def _sketch(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n (size of the set), k1, k2 (128-bit key of the set), head (its least hashes, more than the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, head = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                key = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                want, _, room = _prefix_rows(len(s), percent)
                head.append(s[: want + room].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _list_column(head)],
                ["doc_id", "n", "k1", "k2", "head"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, head array<long>")


def _prefixes(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int, percent: int, texts: bool) -> DataFrame:
    """node, n, more, prefix: the first shingles in the order (magnitude of the count, hash), `more` of them beyond the
    prefix that is needed. prefix is null where a head doesn't hold enough shingles of the first rank; rows with
    texts in place of heads always have one."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, magnitude = shared.value
        for batch in batches:
            out: list[np.ndarray | None] = []
            sizes: list[int] = []
            more: list[int] = []
            sets = shingle_sets(batch.column(2), width) if texts else _lists(batch.column(2))
            for size, s in zip(batch.column(1).to_pylist(), sets, strict=True):
                size = len(s) if texts else size
                want, beyond, _ = _prefix_rows(size, percent)
                rank = np.zeros(len(s), np.uint8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, magnitude[at], 0)
                first = s[rank == 0]
                if len(first) < want + beyond and len(s) == size:
                    first = s[np.lexsort((s, rank))]
                first = first[: want + beyond]
                out.append(first.copy() if len(first) >= want else None)
                sizes.append(size)
                more.append(len(first) - want)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(more, pa.int64()), _list_column(out)], ["node", "n", "more", "prefix"]
            )

    return rows.mapInArrow(run, "node long, n long, more long, prefix array<long>")


def _common_shingles(heads: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of two heads or more, sorted, and the magnitude (binary logarithm) of each one's count.

    Beyond MOST_COMMON of them, those of the least magnitudes are left out: any such list gives right results.
    """
    counts = materialise(
        heads.select(F.explode("head").alias("token")).groupBy("token").count().where("count > 1")
        .select("token", F.floor(F.log2("count")).cast("int").alias("magnitude")), "common"
    )
    floor, room = 64, MOST_COMMON
    for step, n in sorted(counts.groupBy("magnitude").count().collect(), reverse=True):
        if n > room:
            break
        floor, room = step, room - n
    rows = counts.where(F.col("magnitude") >= floor).toArrow().combine_chunks()
    release(counts)
    token = np.asarray(rows.column("token").combine_chunks() if rows.num_rows else [], dtype=np.int64).view(np.uint64)
    magnitude = np.asarray(rows.column("magnitude").combine_chunks() if rows.num_rows else [], dtype=np.uint8)
    order = np.argsort(token)
    return token[order], magnitude[order]


def _sent(keys: DataFrame, marks: str | None = None) -> DataFrame:
    """The frame, marked for broadcast if it is small: its rows are counted, at 16 bytes for each column (of numbers),
    and the bytes of the column `marks` are summed up."""
    if marks is None:
        most = SENT_BYTES // (16 * len(keys.columns))
        return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys
    rows, held = keys.agg(F.count("*"), F.sum(F.length(marks))).first()
    return F.broadcast(keys) if 16 * rows * len(keys.columns) + (held or 0) <= SENT_BYTES else keys


def _marks(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of a set, of at least eight bits for each shingle: bit (hash mod size)."""
    bits = 64
    while bits < 8 * len(tokens):
        bits *= 2
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def _folded(marks: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    while len(marks) > size:
        marks = marks[: len(marks) // 2] | marks[len(marks) // 2 :]
    return marks


def _full_sets(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, its whole set, and the bitmap of it, of the given nodes."""

    def given(node: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        marks = pa.array([_marks(s).tobytes() for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), _list_column(sets), marks], ["node", "tokens", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node: list[int] = []
            sets: list[np.ndarray] = []
            held = 0
            for one, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
                node.append(one)
                sets.append(s)
                held += len(s)
                if held >= _GIVEN:
                    yield given(node, sets)
                    node, sets, held = [], [], 0
            yield given(node, sets)

    picked = texts.join(_sent(nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    return picked.select("doc_id", "text").mapInArrow(run, "node long, tokens array<long>, marks binary")


class _Group:
    """The sets of a group's members: their union, and for each of its tokens the members that have it."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.node, self.component, self.sets = [m[0] for m in members], [m[1] for m in members], [m[2] for m in members]
        self.size = np.array([len(m[2]) for m in members])
        token = np.concatenate([m[2] for m in members])
        order = np.argsort(token, kind="stable")
        token = token[order]
        self.begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        self.union = token[self.begin]
        self.many = np.diff(np.append(self.begin, len(token)))
        self.member = np.repeat(np.arange(len(members)), self.size)[order]

    def overlaps(self, tokens: np.ndarray, least: int = 0) -> np.ndarray | None:
        """With every member; None where not even the union has the least."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        hit = at[self.union[at] == tokens]
        if len(hit) < max(1, least):
            return None
        many = self.many[hit]
        places = np.repeat(self.begin[hit] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(self.member[places], minlength=len(self.node))

    def linked(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The numbers of the members that link with the set."""
        both = self.overlaps(tokens, _need(len(tokens), percent))
        if both is None:
            return np.empty(0, np.int64)
        return np.flatnonzero(100 * both >= percent * (len(tokens) + self.size - both))


def _streamed(rows: DataFrame, work, schema: str) -> DataFrame:
    """Runs work on each (g, part): rows of kind 0 are members, those of kind 1 queries.

    Rows arrive sorted, so a task holds one group's members and one query at a time. rows: g, part,
    kind, node, component, tokens. work(group, query) with query (node, component, tokens), or None at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, group = None, [], None
        for batch in batches:
            found: list[tuple] = []
            g, part, kind, node, component = (batch.column(i).to_pylist() for i in range(5))
            for i, tokens in enumerate(_lists(batch.column(5))):
                if (g[i], part[i]) != key:
                    found += work(group or (_Group(members) if members else None), None)
                    key, members, group = (g[i], part[i]), [], None
                if kind[i] == 0:
                    members.append((node[i], component[i], tokens.copy()))
                elif members or group:
                    group, members = group or _Group(members), []
                    found += work(group, (node[i], component[i], tokens))
            yield _links_batch(found)
        yield _links_batch(work(group or (_Group(members) if members else None), None))

    return rows.repartition("g", "part").sortWithinPartitions("g", "part", "kind", "node").mapInArrow(run, schema)


def _links_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _merge_members(percent: int):
    """Within one group: (node, least member it is connected with by links inside the group)."""

    def work(group: _Group | None, query) -> list[tuple]:
        if group is None:
            return []
        first: dict[int, int] = {}  # the texts of one document are one node
        root = [first.setdefault(node, i) for i, node in enumerate(group.node)]

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, tokens in enumerate(group.sets if len(root) > 1 else ()):
            for j in group.linked(tokens, percent):
                x, y = sorted((find(i), find(int(j))), key=lambda k: group.node[k])
                root[y] = x
        return [(group.node[i], group.node[find(i)]) for i in range(len(root))]

    return work


def _open_group(percent: int):
    """For each query: the bound from the group's union, then one link with each other component among the members."""

    def work(group: _Group | None, query) -> list[tuple]:
        if query is None or group is None:
            return []
        node, own, tokens = query
        met = {group.component[k]: group.node[k] for k in group.linked(tokens, percent)}
        return [(own, other) for other in met if other != own]

    return work


def _connect(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, component for all nodes of the index (token, c, pos, node, n, more); c: how many have the token."""
    nodes = materialise(index.groupBy("node").agg(F.max_by("token", F.struct("c", "token")).alias("key"), F.max("n").alias("n")), "nodes")
    # groups of similar ones: equal in the most frequent of their prefix shingles. Where that makes several groups, their
    # roots are dealt anew; this only spares work, since what remains apart meets as queries and groups.
    roots, member = nodes, None
    for turn in range(MERGE_TURNS):
        dealt = materialise(_dealt(roots, turn), "groups")
        merged = materialise(_merge_round(dealt, sets, percent), "merged")
        if member is None:
            member = materialise(dealt.select("node", "g").join(merged, "node"), "member")
        else:
            up = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
            new = materialise(member.join(_sent(up), "component", "left").select("node", "g", F.coalesce("root", "component").alias("component")), "member")
            release(member)
            member = new
        split = dealt.where("parts > 1").select("node")
        roots = nodes.join(split, "node", "left_semi").join(merged.select(F.col("component").alias("node")).distinct(), "node", "left_semi")
        if split.isEmpty():
            break
    pairs = materialise(_query_groups(index, member, percent), "pairs")
    probed = None
    # first the likeliest query of each component for each group; what these connect need not be opened by all the others
    for last in (False, True):
        if not last:
            best = pairs.groupBy("cq", "g").agg(F.max_by(F.struct("q", "lo"), F.struct("c", "q")).alias("best"))
            probed = now = materialise(best.select("best.q", "g", "best.lo"), "probe")
        else:
            mixed = member.groupBy("g").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
            now = pairs.select("q", "g", "lo").join(probed.select("q", "g"), ["q", "g"], "left_anti")
            now = now.join(_sent(member.select(F.col("node").alias("q"), F.col("component").alias("cq"))), "q").join(_sent(mixed), "g")
            now = materialise(now.where("cq <> c1 or cq <> c2").select("q", "g", "lo").distinct(), "rest")
        if now.isEmpty():
            break
        kept = materialise(_qualifying(now, member, sets, percent), "kept")
        top = connected_components(_opened(kept, member, sets, percent))
        top = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
        member = materialise(member.join(_sent(top), "component", "left").select("node", "g", F.coalesce("top", "component").alias("component")), "member")
        release(kept)
    for used in (nodes, pairs, *([probed] if probed is not None else [])):
        release(used)
    return member.select("node", "component")


def _dealt(nodes: DataFrame, turn: int) -> DataFrame:
    """node, g, parts: the nodes of one key, dealt by hash into so many groups of about GROUP_ROWS, otherwise in each turn."""
    load = nodes.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("long").alias("parts"))
    place = F.pmod(F.xxhash64(F.lit(turn), "node"), "parts")
    return nodes.join(load, "key").select("node", F.xxhash64("key", place).alias("g"), "parts")


def _merge_round(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    rows = sets.select("node", "tokens").join(_sent(groups.select("node", "g")), "node")
    zero = F.lit(0)
    found = _streamed(rows.select("g", zero.alias("part"), zero.alias("kind"), "node", F.col("node").alias("component"), "tokens"), _merge_members(percent), "a long, b long")
    return found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _query_groups(index: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """q, cq, g, lo, c: queries and other groups that may agree in size and share c prefix shingles, which are enough for
    a link; lo: the least size among the members that share one.

    Of two components the smaller one asks: a query asks the groups that hold a larger component than its own (of
    equal ones, that of the greater name). If sets of a and b link, they share o = percent * (a + b) / (100 + percent)
    shingles, so that in one order the first k shared ones are among the first a - o + k and b - o + k. k is the
    least number of shingles that either took beyond its prefix, and one.
    """
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    placed = index.join(_sent(member.join(_sent(sizes), "component")), "node")
    matrix = placed.groupBy("token", "g").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("more").alias("less"), F.min("pos").alias("least"),
        F.max("size").alias("size"), F.max_by("component", F.struct("size", "component")).alias("component"),
    )
    mixed = placed.groupBy("token").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 <> g2").select("token")
    asking = placed.join(mixed, "token", "left_semi").select(
        "token", "pos", F.col("node").alias("q"), F.col("component").alias("cq"), F.col("size").alias("sq"), F.col("g").alias("gq"), F.col("n").alias("nq"), "more"
    )
    n, p = F.col("nq"), percent
    need = lambda x: _ratio_up(x * p, 100)
    both = lambda x: _ratio_up((n + x) * p, 100 + p)
    low = F.greatest("lo", need(n))
    high = F.least(F.col("hi"), F.floor(n * 100 / p + 1e-9).cast("long"))
    k = F.least("more", "less") + 1
    met = asking.join(matrix, "token").where(
        (F.col("gq") != F.col("g")) & ((F.col("sq") < F.col("size")) | (F.col("sq") == F.col("size")) & (F.col("cq") < F.col("component")))
        & (F.col("hi") * 100 >= n * p) & (F.col("lo") * p <= n * 100)
        # a member's bound rises with its size; one more for the rounding
        & (F.col("pos") < n - both(low) + k) & (F.col("least") <= high - both(high) + k)
    )
    counted = met.groupBy("q", "cq", "nq", "g").agg(F.count("*").alias("c"), F.min("lo").alias("lo"), F.min(k).alias("k"))
    return counted.where("c >= k").select("q", "cq", "g", low.alias("lo"), "c")


def _qualifying(pairs: DataFrame, member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, g, lo) whose bound, from the bitmaps of the query and of the group's union, reaches the threshold.

    A bit of the query that the union lacks stands for at least one shingle that no member has.
    """
    marks = sets.select("node", "marks")
    placed = member.join(_sent(pairs.select("g").distinct()), "g", "left_semi").select("node", "g").join(marks, "node")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, union = None, np.empty(0, np.uint8)
        for batch in batches:
            done: list[tuple[int, bytes]] = []
            for g, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(value.as_buffer(), np.uint8)
                if g != key:
                    if key is not None:
                        done.append((key, union.tobytes()))
                    key, union = g, one.copy()
                else:
                    size = max(len(one), len(union))
                    union = _spread(one, size) | _spread(union, size)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary())], ["g", "union"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([union.tobytes()], pa.binary())], ["g", "union"])

    unions = materialise(placed.select("g", "marks").repartition("g").sortWithinPartitions("g").mapInArrow(unite, "g long, union binary"), "unions")
    queries = sets.select(F.col("node").alias("q"), F.size("tokens").alias("n"), "marks").join(_sent(pairs.select("q").distinct()), "q", "left_semi")
    queries = materialise(queries, "queries")
    rows = pairs.join(_sent(queries, "marks"), "q").join(_sent(unions, "union"), "g").select("q", "g", "lo", "n", "marks", "union")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for lo, n, a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                lacking = int(_ONES[_folded(x, size) & ~_folded(y, size)].sum())
                keep.append(n - lacking >= _both(n, lo, percent))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(part.columns[:2], ["q", "g"])

    return rows.mapInArrow(bound, "q long, g long")


def _spread(marks: np.ndarray, size: int) -> np.ndarray:
    """The bitmap with more bits: each place that may hold a member of the set."""
    return np.tile(marks, size // len(marks))


def _opened(pairs: DataFrame, member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of components that a query and a member of its group link."""
    load = pairs.groupBy("g").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    members = sets.join(_sent(member.join(_sent(load), "g")), "node").select(
        "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "node", "component", "tokens"
    )
    asked = pairs.join(_sent(load), "g").join(_sent(member.select(F.col("node").alias("q"), "component")), "q")
    queries = sets.withColumnRenamed("node", "q").join(_sent(asked), "q").select(
        "g", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("q").alias("node"), "component", "tokens"
    )
    return materialise(_streamed(members.unionByName(queries), _open_group(percent), "a long, b long").distinct(), "links")


def _each_once(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """doc_id, text, each text of each document once; only texts of ids that repeat are shuffled."""
    repeated = materialise(sketch.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs
    ids = _sent(repeated)
    return docs.join(ids, "doc_id", "left_anti").union(docs.join(ids, "doc_id", "left_semi").dropDuplicates())


def jaccard_components(
    documents: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents link at 100 * intersection >= percent * union.

    component_id is the least doc_id reachable by links. A null, empty or blank text has no shingles
    and links with nothing; a text of fewer than `width` words is one shingle. Equal sets always link.
    doc_id must be a whole number and not null; a repeated doc_id should repeat its text (its rows all
    come back; the differing texts' links are united). Other columns, whatever their names, are not read.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(documents.sparkSession):
        return _components(docs, width, percent)


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    sketch = materialise(_sketch(docs, width, percent), "sketch")
    texts = _each_once(docs, sketch)
    own = materialise(
        sketch.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")), "classes"
    )
    # all but the least document of a class; the others' heads say the same
    copied = own.where("node <> last").select("k1", "k2", "node")
    copies = materialise(
        sketch.select("doc_id", "k1", "k2").join(_sent(copied), ["k1", "k2"]).where("doc_id <> node").select("doc_id").distinct(), "copies"
    )
    heads = sketch.where("n > 0").join(_sent(copies), "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "n", "head")
    common = _common_shingles(heads)
    known = materialise(_prefixes(heads, common, width, percent, texts=False), "prefixes")
    late = known.where("prefix is null").select(F.col("node").alias("doc_id"), "n")
    more = texts.join(_sent(late), "doc_id").select(F.col("doc_id").alias("node"), "n", "text")
    more = materialise(_prefixes(more, common, width, percent, texts=True), "prefixes")
    tokens = known.where("prefix is not null").unionByName(more).select("node", "n", "more", F.posexplode("prefix").alias("pos", "token"))
    shared = materialise(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    index = materialise(tokens.join(_sent(shared), "token").distinct(), "index")
    sets = materialise(_full_sets(texts, index.select("node").distinct(), width), "sets")
    member = _connect(index, sets, percent)
    for used in (known, more, shared, index, sets, copies):
        release(used)
    linked = own.join(member, "node", "left").select(
        "k1", "k2", "node", F.coalesce("component", "node").alias("component")
    )
    # least member over all documents of a component, since a class is named by its least document
    names = linked.groupBy("component").agg(F.min("node").alias("component_id"))
    table = linked.join(names, "component").select("k1", "k2", "component_id")
    out = sketch.select("doc_id", "n", "k1", "k2").join(table, ["k1", "k2"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one_per_component(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose doc_id names their component: one of each near-duplicate group, the least. Of rows
    that repeat a doc_id the one of the least text (null first) stays, and of rows that repeat both any; documents
    without words all stay."""
    found = jaccard_components(documents, width, percent)
    chosen = found.where("doc_id = component_id").groupBy("doc_id").count()
    kept = documents.join(chosen.withColumnRenamed("count", "_rows"), "doc_id")
    once = kept.where("_rows = 1").select(documents.columns)
    order = [F.col("text"), *(F.col(c).cast("string") for c in documents.columns if c != "text")]
    more = kept.where("_rows > 1").groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), F.struct(*order)).alias("_row")).select("_row.*")
    return once.unionByName(more)
