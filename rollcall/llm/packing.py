"""Best-fit packing of documents into sequences of a fixed token capacity.

Lengths are whole numbers from 1 to the capacity, so an instance of any size is its histogram of at
most `capacity` counts. That histogram is all the driver sees. On it, dominance reduction in the
manner of Martello and Toth fixes small sets of documents (one, two or three) that are at least as
good as every other set holding the same longest document; what no rule settles is packed best-fit,
longest first. Both work on whole runs of equal lengths, so the plan is a list of patterns with
multiplicities whose size follows the capacity and not the data. Executors then number the documents
of each length and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import materialise

#: Numbered slices of a length: no more than this many documents are sorted by one task.
SLICE_ROWS = 200_000


# ---------------------------------------------------------------- tokens


_ENCODERS: dict[str, object] = {}
_LIBRARY: dict[str, object] = {}


def _encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken (the same ids, about five times as fast)."""
    if path not in _ENCODERS:
        import json

        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if i not in special.values()}
        import public_tokenizers

        _ENCODERS[path] = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _ENCODERS[path]


def encode_text(path: str, text: str) -> list[int]:
    """The ids of a text. A run of white space over the regular expression's stack, which tiktoken can't split, goes to
    the tokenizers library, which is slower and gives the same ids."""
    try:
        return _encoder(path).encode(text, allowed_special="all")
    except ValueError:
        if path not in _LIBRARY:
            from tokenizers import Tokenizer

            _LIBRARY[path] = Tokenizer.from_file(path)
            _LIBRARY[path].no_truncation()
            _LIBRARY[path].no_padding()
        return _LIBRARY[path].encode(text, add_special_tokens=False).ids


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def token_pieces(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenize whole texts and cut those over the capacity.

    A document is its ids and then end_id; a null or empty text is end_id alone. A longer one is cut
    into pieces of exactly `capacity` tokens, of which only the first may be shorter. Returns doc_id,
    piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), and the ids themselves if
    with_ids. Other columns are not kept. A run of white space of any length is encoded as the library does. Rows repeated in the input are repeated in the output.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, piece, start, length, crc, ids_out = batch.column(0), [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = encode_text(tokenizer, value.as_py() or "")
                ids.append(end_id)
                ids = np.array(ids, dtype="<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    docs.append(row)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                    if with_ids:
                        ids_out.append(ids[lo:hi].astype(np.int32))
            columns = [
                keys.take(pa.array(docs, pa.int32())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


# ---------------------------------------------------------------- the plan on a histogram


class _Sizes:
    """A histogram of lengths, with the lengths that still have documents in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.count = Counter({s: c for s, c in counts.items() if c > 0})
        self.order = sorted(self.count)

    def take(self, sizes: tuple[int, ...], times: int) -> None:
        for s in sizes:
            self.count[s] -= times
            if not self.count[s]:
                del self.count[s]
                self.order.pop(bisect.bisect_left(self.order, s))

    def at_most(self, limit: int, without: Counter) -> int:
        """The largest length up to the limit that is left once `without` is set aside; 0 if none."""
        at = bisect.bisect_right(self.order, limit) - 1
        while at >= 0 and self.count[self.order[at]] <= without[self.order[at]]:
            at -= 1
        return self.order[at] if at >= 0 else 0

    def least(self, n: int, without: Counter) -> list[int]:
        """The n shortest documents left once `without` is set aside."""
        found: list[int] = []
        for s in self.order:
            found += [s] * min(n - len(found), self.count[s] - without[s])
            if len(found) == n:
                break
        return found


def _best_pair(sizes: _Sizes, room: int, without: Counter) -> tuple[int, int]:
    """The two documents of the largest sum within the room, the longer first; (0, 0) if none fit."""
    best = (0, 0)
    at = bisect.bisect_right(sizes.order, room) - 1
    while at >= 0 and 2 * sizes.order[at] > sum(best):
        a = sizes.order[at]
        if sizes.count[a] > without[a]:
            b = sizes.at_most(min(a, room - a), without + Counter([a]))
            if b and a + b > sum(best):
                best = (a, b)
        at -= 1
    return best


def _largest_lesser(sizes: _Sizes, room: int, without: Counter) -> int:
    """The largest length that can be the shorter of two documents within the room."""
    at = bisect.bisect_right(sizes.order, room // 2) - 1
    while at >= 0:
        b = sizes.order[at]
        if sizes.count[b] > without[b]:
            spare = sizes.count[b] - without[b] >= 2
            above = at + 1 < len(sizes.order) and any(
                sizes.count[x] > without[x] for x in sizes.order[at + 1 : bisect.bisect_right(sizes.order, room - b)]
            )
            if spare or above:
                return b
        at -= 1
    return 0


def _dominant_set(sizes: _Sizes, longest: int, capacity: int) -> tuple[int, ...] | None:
    """A set with one document of the given length that dominates every other feasible one, if a rule shows it.

    With the room left beside the document: nothing fits (it goes alone); one document fills the room
    exactly; no two others fit (the longest that fits goes with it); no three fit and either one
    document is as long as any pair, or the pair of largest sum has the longest possible first and the
    longest possible second member.
    """
    room, own = capacity - longest, Counter([longest])
    mate = sizes.at_most(room, own)
    if not mate:
        return (longest,)
    if mate == room:
        return (longest, mate)
    least = sizes.least(3, own)
    if len(least) < 2 or least[0] + least[1] > room:
        return (longest, mate)
    if len(least) == 3 and sum(least) <= room:
        return None
    first, second = _best_pair(sizes, room, own)
    if mate >= first + second:
        return (longest, mate)
    if first == mate and second >= _largest_lesser(sizes, room, own):
        return (longest, first, second)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix dominating sets while any rule applies: [(lengths, times)], and the histogram that is left."""
    sizes, fixed = _Sizes(counts), []
    again = True
    while again:
        again = False
        for s in sizes.order[::-1]:
            while sizes.count.get(s):
                chosen = _dominant_set(sizes, s, capacity)
                if chosen is None:
                    break
                need = Counter(chosen)
                times = min(sizes.count[x] // n for x, n in need.items())
                if times > 1 and sum(chosen) < capacity and len(chosen) > 1:
                    # short of an exact fill the rule looked at which others are left, so keep two of each
                    times = max(1, min((sizes.count[x] - 2) // n for x, n in need.items()))
                sizes.take(chosen, times) if len(need) == len(chosen) else [sizes.take((x,), n * times) for x, n in need.items()]
                fixed.append((chosen, times))
                again = True
    return fixed, dict(sizes.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first, over runs of equal lengths and of equal sequences: [(lengths, times)]."""
    by_room: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in by_room:
            by_room[room] = Counter()
            bisect.insort(rooms, room)
        by_room[room][pattern] += times

    done: list[tuple[tuple[int, ...], int]] = []
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):  # new sequences, each filled with as many as go in
                per = capacity // s
                if left >= per:
                    put(capacity - per * s, (s,) * per, left // per)
                    left %= per
                if left:
                    put(capacity - left * s, (s,) * left, 1)
                    left = 0
                continue
            room = rooms[at]
            pattern, times = next(iter(by_room[room].items()))
            fill = min(room // s, left)
            used = min(times, left // fill)
            by_room[room][pattern] -= used
            if not by_room[room][pattern]:
                del by_room[room][pattern]
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            put(room - fill * s, pattern + (s,) * fill, used)
            left -= used * fill
    for room in rooms:
        done += by_room[room].items()
    return done


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their multiplicities, covering a histogram of lengths from 1 to capacity."""
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's second lower bound on the number of sequences."""
    best = 0
    for k in range(capacity // 2 + 1):
        large = sum(c for s, c in counts.items() if s > capacity - k)
        middle = sum(c for s, c in counts.items() if capacity - k >= s > capacity / 2)
        room = sum((capacity - s) * c for s, c in counts.items() if capacity - k >= s > capacity / 2)
        small = sum(s * c for s, c in counts.items() if capacity / 2 >= s >= k)
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


# ---------------------------------------------------------------- places


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first number, first sequence, copies per sequence, offset), by first number."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    given: Counter = Counter()
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for s, n in Counter(sorted(lengths, reverse=True)).items():
            rows.setdefault(s, []).append((given[s], sequence, n, offset))
            given[s] += n * times
            offset += s * n
        sequence += times
    return {s: np.array(r, dtype=np.int64) for s, r in rows.items()}


def best_fit_pack(items: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """Pack items into as few sequences as the method finds; adds sequence_id and offset.

    Every item has a length from 1 to capacity (null counts as an error). Items are numbered within
    their length by hashed slices: each slice is sorted by keys on its own, and the slices' sizes give
    its first number, so no length, however common, is sorted in one task. Rows equal in all keys are
    interchangeable. An empty input gives no rows. Columns named sequence_id or offset are replaced.
    """
    items = materialise(items.drop("sequence_id", "offset"), "pack")
    histogram = {int(r[0]): r[1] for r in items.groupBy(length).count().collect() if r[0] is not None}  # at most `capacity` rows
    if items.where(F.col(length).isNull()).limit(1).count():
        raise ValueError("an item has no length")
    places = _places(plan_packing(histogram, capacity))
    spread = max(1, -(-max(histogram.values(), default=0) // SLICE_ROWS))
    spread = max(spread, min(64, sum(histogram.values()) // 1000 + 1))
    slice_of = F.pmod(F.xxhash64(*keys), F.lit(spread)).cast("int")
    sliced = items.withColumn("_slice", slice_of)
    starts = sliced.groupBy(length, "_slice").agg(F.count("*").alias("_n")).withColumn(
        "_from", F.sum("_n").over(Window.partitionBy(length).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    ).select(F.col(length).alias("_length"), F.col("_slice").alias("_of"), F.coalesce("_from", F.lit(0)).alias("_from"))
    numbered = sliced.withColumn("_row", F.row_number().over(Window.partitionBy(length, "_slice").orderBy(*keys)) - 1)
    numbered = numbered.join(starts, (F.col(length) == F.col("_length")) & (F.col("_slice") == F.col("_of")))
    numbered = numbered.withColumn("_number", F.col("_from") + F.col("_row")).drop("_slice", "_row", "_length", "_of", "_from")
    shared = items.sparkSession.sparkContext.broadcast(places)  # its size follows the capacity
    at = numbered.columns.index(length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sizes = np.asarray(batch.column(at)).astype(np.int64)
            number = np.asarray(batch.column(batch.num_columns - 1)).astype(np.int64)
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for s in np.unique(sizes):
                mine, rows = sizes == s, table[int(s)]
                row = rows[np.searchsorted(rows[:, 0], number[mine], side="right") - 1]
                within = number[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + within // row[:, 2]
                offset[mine] = row[:, 3] + within % row[:, 2] * s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields[:-1]]
    return numbered.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def packed_sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """The sequences themselves: sequence_id, ids, doc_ids and starts (each document's first place).

    Needs the ids column of token_pieces(with_ids=True). A sequence is at most one capacity long, so
    the group that is put together in a task is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", F.col(ids).alias("ids"))))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.flatten(F.col("p.ids")).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("starts"),
    )


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack documents; see token_pieces and best_fit_pack for every case."""
    return best_fit_pack(token_pieces(documents, tokenizer, capacity, with_ids=with_ids), capacity)


