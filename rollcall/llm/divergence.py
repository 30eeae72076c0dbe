"""How the sources of a language differ in their words: an audit by exact divergences.

Every text is cut into terms, counted by (lang, source, term). A language keeps the terms that enough of its
documents use. Its kept terms are dealt into blocks; a block and the language's groups make a dense tile of
int64 counts, group by term, in which all pairs of groups are computed at once by broadcasting. Tiles
give partial matrices over pairs, which are summed, and a heap of the highest terms of each group, which
are merged in two rounds. Tiles have a bounded number of cells: with many groups a block has fewer terms, and
blocks of groups meet blocks of groups.

All arithmetic is on whole numbers. With N a group's occurrences of kept terms and V their number,

    p = 1 + floor(SCALE * (count + 1) / (N + V)),    f(p, q) = floor((p - q)^2 / q)

A pair's value is the sum of f over all kept terms, p the group's and q the other's; a term's value is f against the
whole language, for terms that the group uses more than the language does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.batches import small_batches
from rollcall.session import materialise, release

#: Of p; a power of 1000 that leaves (p - q)^2 in 63 bits.
SCALE = 10**9
#: Cells of a tile, and groups of a block of groups.
CELLS, GROUPS = 1 << 20, 256
#: Different (lang, source, term) that a task gathers before it hands them on, and bytes of a text counted at once.
GATHERED, SLICE = 400_000, 1 << 20

#: Bytes of terms stay (A-Z as a-z, and all that isn't ASCII), others become blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = "lang string, source string, term binary, n long, docs long"
_TILED = "lang string, a int, part string, b int, term binary, value long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice of about SLICE bytes at a time."""
    lo = 0
    while lo < len(text):
        hi = min(lo + SLICE, len(text))
        while hi < len(text) and _FOLD[text[hi]] != 32:
            hi += 1
        yield text[lo:hi].translate(_FOLD).split()
        lo = hi


def count_terms(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within a task; a key may come several times.

    Null text, lang and source are ''. Every row is a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in terms_of(text):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
            if sum(len(n) for n, _ in groups.values()) > GATHERED:
                yield from _counted(groups)
                groups = {}
        yield from _counted(groups)

    texts = documents.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    return texts.mapInArrow(run, _COUNTED)


def _counted(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in groups.items():
        terms = list(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()),
                pa.array(n.values(), pa.int64()),
                pa.array([docs[t] for t in terms], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / totals), by long division in steps of 1000, which stay in 63 bits for
    totals under 9 * 10^15; counts + 1 must be at most the totals."""
    out, left = np.zeros_like(counts), counts + 1
    scale = SCALE
    while scale > 1:
        digits, left = np.divmod(left * 1000, totals)
        out = out * 1000 + digits
        scale //= 1000
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return ((p - q) ** 2).view(np.uint64) // q.view(np.uint64)


def _tile(top: int):
    """The function of a cogroup: one block of a language's terms, with rows (a block of groups against another)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.Table.from_batches([], _arrow(_TILED))
        lang = right["lang"][0].as_py()
        group = right["gid"].to_numpy()
        order = np.argsort(group)
        group, total, mine = group[order], right["n"].to_numpy()[order], right["side"].to_numpy()[order]
        whole, v = right["whole"][0].as_py(), right["v"][0].as_py()
        encoded = left["term"].combine_chunks().dictionary_encode() if left.num_rows else pa.array([], pa.binary()).dictionary_encode()
        terms, at = np.array(encoded.dictionary.to_pylist(), object), encoded.indices.to_numpy()
        counts = np.zeros((len(group), len(terms)), np.int64)
        everywhere = np.zeros(len(terms), np.int64)
        if left.num_rows:
            gid = left["gid"].to_numpy()
            counts[np.searchsorted(group, gid), at] = left["n"].to_numpy()
            everywhere[at] = left["everywhere"].to_numpy()
        p = shares(counts, (total + v)[:, None])
        # the block's terms that none of the tile's groups use are alike: one column stands for all of them
        absent, bare = right["size"][0].as_py() - len(terms), shares(np.zeros_like(total), total + v)
        asked, others = np.flatnonzero(mine & 1), np.flatnonzero(mine & 2)
        out: list[tuple] = []
        for i in asked:
            values = divergence(np.broadcast_to(p[i], (len(others), len(terms))), p[others]).sum(axis=1)
            values = values + np.uint64(absent) * divergence(np.broadcast_to(bare[i], len(others)), bare[others])
            out += [(lang, int(group[i]), "pair", int(group[j]), b"", int(x)) for j, x in zip(others, values, strict=True) if i != j]
        if right["heaps"][0].as_py():
            q = shares(everywhere, np.int64(whole + v))
            for i in asked:
                high = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                values = divergence(p[i, high], q[high])
                if len(high) > top:  # all at or above the last value stay until ties are broken
                    high, values = (x[values >= np.partition(values, len(high) - top)[len(high) - top]] for x in (high, values))
                best = sorted(zip((-values.astype(np.int64)).tolist(), terms[high], strict=True))[:top]
                out += [(lang, int(group[i]), "term", 0, term, -value) for value, term in best]
        columns = zip(*out, strict=True) if out else ((),) * 6
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(_TILED), strict=True)], schema=_arrow(_TILED))

    return run


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def audit_sources(documents: DataFrame, least_docs: int = 3, top: int = 200, cells: int = CELLS, group_block: int = GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of each (lang, source) from the others and from its language.

    Part 'pair' has every other source of the language, part 'term' the `top` kept terms that the source
    uses more than the language. Ranks start at 1 for each group and part, by value descending, then item
    ascending by its UTF-8 bytes. Terms are runs of ASCII letters and of characters beyond ASCII; A-Z are lower-cased. A term
    is kept if `least_docs` documents of the language have it. Null text, lang and source are ''; a
    group without terms still has its pairs, 0 where its language keeps no term; repeated rows are documents
    of their own; an empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    with small_batches(spark, 16):
        counted = count_terms(documents).repartition("lang", "term")  # pre-aggregated by task; both groupings below are dealt by it
        counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        by_source = F.collect_list(F.struct("source", "n"))  # at most one entry for each source of the language
        kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere"), by_source.alias("counts"))
        kept = materialise(kept.where(F.col("docs") >= least_docs).select("lang", "term", "everywhere", "counts"), "terms")

    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("everywhere").alias("whole"))
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    named = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    named = named.join(sums, ["lang", "source"], "left").withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    n_groups = named.groupBy("lang").agg(F.count("*").alias("g"))
    langs = n_groups.join(langs, "lang", "left").na.fill(0, ["v", "whole"])
    width = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.least("g", F.lit(2 * group_block))))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / width)).cast("int"))
    langs = materialise(langs.withColumn("rows", F.ceil(F.col("g") / group_block).cast("int")), "languages")
    groups = materialise(named.na.fill(0, ["n"]), "groups")

    # every tile (block of terms, block of groups asking, block of groups asked) has the counts of its groups
    sizes = langs.select("lang", "v", "whole", "blocks", "rows")
    blocked = kept.join(langs.select("lang", "blocks", "rows"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    filled = blocked.groupBy("lang", "block").agg(F.count("*").alias("size"))
    tiles = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(filled, ["lang", "block"], "left").na.fill(0, ["size"])
    placed = groups.select("lang", "gid", "n", F.floor(F.col("gid") / group_block).cast("int").alias("own"))
    as_mine = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda k: F.struct(F.col("own").alias("mine"), k.alias("theirs")))
    as_theirs = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda k: F.struct(k.alias("mine"), F.col("own").alias("theirs")))
    meets = F.array_distinct(F.concat(as_mine, as_theirs))
    right = tiles.join(placed, "lang").select("*", F.explode(meets).alias("m")).select(
        "lang", "block", "m.mine", "m.theirs", "gid", "n", "v", "whole", "size",
        (F.when(F.col("own") == F.col("m.mine"), 1).otherwise(0) + F.when(F.col("own") == F.col("m.theirs"), 2).otherwise(0)).alias("side"),
        (F.col("m.theirs") == 0).alias("heaps"),
    )
    numbers = groups.select("lang", "source", "gid")
    cut = blocked.select("lang", "block", "rows", "term", "everywhere", F.explode("counts").alias("c"))
    cut = cut.select("lang", "block", "rows", "term", "everywhere", F.col("c.source").alias("source"), F.col("c.n").alias("n")).join(numbers, ["lang", "source"])
    cut = cut.withColumn("own", F.floor(F.col("gid") / group_block).cast("int"))
    left = cut.select("*", F.explode(meets).alias("m")).select("lang", "block", "m.mine", "m.theirs", "gid", "term", "n", "everywhere")
    keys = ["lang", "block", "mine", "theirs"]
    left = left.toDF(*left.columns)  # columns of its own: both sides come from the same tables
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(top), _TILED)
    found = materialise(found, "tiles")

    name = numbers.select("lang", F.col("gid").alias("a"), "source")
    other = numbers.select("lang", F.col("gid").alias("b"), F.col("source").alias("item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "a", "part", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.join(other, ["lang", "b"]).select("lang", "a", "part", "item", "value")
    heaps = found.where("part = 'term'").select("lang", "a", "part", F.col("term").cast("string").alias("item"), "value")
    heap = Window.partitionBy("lang", "a", "_part").orderBy(F.desc("value"), "item")
    merged = heaps.withColumn("_part", F.pmod(F.xxhash64("item"), F.lit(64)))  # a first merge within 64 parts of a group's heaps
    merged = merged.withColumn("_rank", F.row_number().over(heap)).where(F.col("_rank") <= top).drop("_part", "_rank")
    order = Window.partitionBy("lang", "a", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(merged).withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    out = materialise(ranked.join(name, ["lang", "a"]).select("lang", "source", "part", "item", "value", "rank"), "divergence")
    for used in (kept, langs, groups, found):
        release(used)
    return out
