"""Cross-entropy difference: how much better a target model predicts a text than a background model.

Both are word bigram models, interpolated with their unigrams, over one vocabulary taken from the corpus.
The target counts come from the texts of the target, the background counts from all texts. The models are
matched: same vocabulary, order and smoothing, and the background's counts are scaled to the target's number
of tokens, which is what a random sample of that size would hold on average, without leaving texts out. No
text is judged by its own words: of every count in which a pair of the text takes part, the text's own
occurrences of the pair are left out (of the target's counts only where the text belongs to the target).
A text's score is the mean, over its tokens, of the target's loss less the background's: low is like the target.

The counts of words, of the vocabulary, and of the pairs that a sample of documents shows to be frequent are
sent to every task (all three are bounded); every other pair meets its occurrences in a shuffle by the pair,
where it is counted and scored at once. So what is gathered grows with the corpus, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.batches import small_batches
from rollcall.llm.hashing import MIX, mixed, word_hashes
from rollcall.session import materialise, release

#: Most words of the vocabulary (the rest are one unknown word), and most pairs that are scored without a shuffle.
MOST_WORDS, MOST_PAIRS = 262_144, 131_072
#: Weight of the unigram's prediction in the bigram's.
PRIOR = 4.0
#: One in so many documents shows which pairs are frequent. This decides where a pair is counted, not its count.
SAMPLE = 64
#: Most ids of the target that are sent to every task; beyond it texts are joined with them by a shuffle.
SENT_IDS = 2_000_000
#: Bytes of texts that are read at once; counts of words that a task holds.
_SLICE, _HELD = 1 << 20, 1 << 21
UNKNOWN, START = 0, 1


def _kinds() -> np.ndarray:
    """Of each byte: 0 space, 1 in a word, 2 a sign of its own, 3 begins a character that is a word of its own, 4 goes on."""
    kind = np.full(256, 2, np.uint8)
    kind[:33] = 0
    kind[127] = 0
    for a, b in ((48, 58), (65, 91), (97, 123), (0xC2, 0xE3)):
        kind[a:b] = 1
    kind[0xE3:0xF8] = 3  # scripts without spaces: from U+3000 up
    kind[0x80:0xC0] = 4
    return kind


_KIND = _kinds()


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token of the texts, in lower case, and where each text's begin (one more at the end).

    Letters and digits in a row (those of ASCII, and all characters from U+0080 to U+2FFF) are a token; every
    other visible ASCII character, and every character from U+3000 up (Chinese, Japanese and Korean write
    without spaces), is one of its own.
    """
    coded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(coded), np.uint8)
    begin = np.cumsum([0, *(len(c) + 1 for c in coded)])
    kind = _KIND[data]
    lead = np.maximum.accumulate(np.where(kind < 4, np.arange(len(data)), 0))
    own = kind[lead]
    first = kind < 4
    before = np.append(np.uint8(0), own[:-1])
    at = np.flatnonzero(first & ((own > 1) | ((own == 1) & (before != 1)))) if len(data) else np.empty(0, np.int64)
    return word_hashes(data, at, own > 0), np.searchsorted(at, begin)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a batch, about _SLICE bytes of text at a time: the first one's number, and the texts."""
    first, texts, held = 0, [], 0
    for k, value in enumerate(batch.column(column)):
        texts.append(value.as_py())
        held += len(texts[-1] or "")
        if held >= _SLICE:
            yield first, texts
            first, texts, held = k + 1, [], 0
    if texts:
        yield first, texts


def _pair_hashes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each token with the one before it; the first of a text follows the start."""
    last = np.append(np.uint64(0), h[:-1])
    last[begin[:-1][begin[:-1] < len(h)]] = MIX[2]
    return mixed(last * MIX[1] + h)


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands among the sorted ones; -1 where it doesn't."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _numbers(frame: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a bounded frame, in the order of the first (as unsigned)."""
    rows = frame.select(*names).toArrow().combine_chunks()
    out = [np.asarray(rows.column(n).combine_chunks() if rows.num_rows else [], dtype=np.int64) for n in names]
    order = np.argsort(out[0].view(np.uint64))
    return [out[0].view(np.uint64)[order], *(x[order] for x in out[1:])]


def _frequent(rows: DataFrame, count: Column, most: int) -> DataFrame:
    """The rows of the highest counts, by classes of an eighth of a doubling, of which as many are taken as fit."""
    graded = rows.withColumn("_grade", F.floor(F.log2(count) * 8).cast("int"))
    floor, room = 1 << 30, most
    for grade, n in sorted(graded.groupBy("_grade").count().collect(), reverse=True):
        if n > room:
            break
        floor, room = grade, room - n
    return graded.where(F.col("_grade") >= floor).drop("_grade")


def _counted(rows: DataFrame, listed: np.ndarray | None) -> DataFrame:
    """kind (0 word, 1 pair, 2 all tokens), hash, background, target: counts of all words and of the listed pairs
    over rows (text, target); without a list, of all pairs and nothing else."""
    shared = rows.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = n_all = n_target = 0
        known = None if pairs is None else np.zeros((2, len(pairs)), np.int64)

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, slot = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return key, *(np.bincount(slot, np.concatenate([p[i] for p in parts]), len(key)).astype(np.int64) for i in (1, 2))

        def given(kind: int, key: np.ndarray, background: np.ndarray, target: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(key), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key[part]), kind, np.int32)), pa.array(key[part].view(np.int64)), pa.array(background[part]), pa.array(target[part])],
                    ["kind", "hash", "background", "target"],
                )

        for batch in batches:
            wanted = np.asarray(batch.column(1).to_pylist(), bool)
            for first, texts in _slices(batch, 0):
                h, begin = tokens(texts)
                flag = np.repeat(wanted[first : first + len(texts)], np.diff(begin))
                n_all, n_target = n_all + len(h), n_target + int(flag.sum())
                pair = _pair_hashes(h, begin)
                if known is not None:
                    at = _in(pairs, pair)
                    known[0] += np.bincount(at[at >= 0], minlength=len(pairs))
                    known[1] += np.bincount(at[(at >= 0) & flag], minlength=len(pairs))
                key, slot = np.unique(pair if known is None else h, return_inverse=True)
                parts.append((key, np.bincount(slot, minlength=len(key)), np.bincount(slot, flag, len(key))))
                held += len(key)
                if held > _HELD:
                    parts = [summed()]
                    held = len(parts[0][0])
                    if held > _HELD // 2:
                        yield from given(1 if known is None else 0, *parts[0])
                        parts, held = [], 0
        if parts:
            yield from given(1 if known is None else 0, *summed())
        if known is not None:
            seen = known[0] > 0
            yield from given(1, pairs[seen], known[0][seen], known[1][seen])
        yield from given(2, np.zeros(1, np.uint64), np.array([n_all]), np.array([n_target]))

    counts = rows.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(run, "kind int, hash long, background long, target long")
    return counts.groupBy("kind", "hash").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class LossModels:
    """Sorted word hashes with their counts, sorted pairs (first word's number << 32 | second's) with theirs, and the
    numbers of tokens. Counts have two rows: background, target. Words are numbered from 2; 0 is unknown, 1 the start.
    """

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, n_tokens: tuple[int, int], n_texts: tuple[int, int]):
        self.words, self.pairs, self.pair_counts, self.n_tokens = words, pairs, pair_counts, n_tokens
        unknown = np.maximum(np.array(n_tokens) - word_counts.sum(axis=1), 0)
        self.counts = np.column_stack([unknown, np.array(n_texts), word_counts])
        #: what a count of each model is worth: the background's are scaled to the target's tokens
        self.worth = (n_tokens[1] / n_tokens[0] if n_tokens[0] and n_tokens[1] else 1.0, 1.0)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        at = _in(self.words, h)
        return np.where(at < 0, UNKNOWN, at + 2)

    def losses(self, pair: np.ndarray, own: np.ndarray, target: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """The target's and the background's loss of one occurrence of each pair (in nats). own: its occurrences in the
        text; target: whether that belongs to the target; counts: of the pair, background and target."""
        first, second = (pair >> 32).astype(np.int64), (pair & 0xFFFFFFFF).astype(np.int64)
        out = []
        size = len(self.words) + 1  # every word, and the unknown one
        for model in (1, 0):
            less = own if model == 0 else own * target
            worth = self.worth[model]
            left = lambda c: np.maximum(c - less, 0) * worth  # noqa: B023,E731
            p1 = (left(self.counts[model][second]) + 1.0) / (left(np.full(len(pair), self.n_tokens[model])) + size)
            p = (left(counts[model]) + PRIOR * p1) / (left(self.counts[model][first]) + PRIOR)
            out.append(-np.log(p))
        return out


def _flagged(rows: DataFrame, target_ids: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, target."""
    named = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if target_ids is None:
        return named.withColumn("target", F.lit(False))
    ids = materialise(target_ids.select(F.col(target_ids.columns[0]).alias("_id")).where("_id is not null").distinct(), "target")
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return named.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target"))


def fit(rows: DataFrame) -> LossModels:
    """Count rows (doc_id, text, target): the shared vocabulary, both models' words, and the frequent pairs."""
    shown = _counted(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), None).where("kind = 1 and background > 1")
    shown = materialise(shown, "pairs")
    listed = _numbers(_frequent(shown, F.col("background"), MOST_PAIRS), "hash")[0]
    release(shown)
    counts = materialise(_counted(rows, listed), "counts")
    totals = counts.where("kind = 2").agg(F.sum("background"), F.sum("target")).first()
    texts = rows.agg(F.count("*"), F.sum(F.col("target").cast("long"))).first()
    words, *word_counts = _numbers(_frequent(counts.where("kind = 0"), F.col("background"), MOST_WORDS), "hash", "background", "target")
    pair_hash, *pair_counts = _numbers(counts.where("kind = 1"), "hash", "background", "target")
    release(counts)
    models = LossModels(
        words, np.array(word_counts), np.empty(0, np.int64), np.empty((2, 0), np.int64),
        (totals[0] or 0, totals[1] or 0), (texts[0], texts[1] or 0),
    )
    models.listed, models.listed_counts = pair_hash, np.array(pair_counts)
    return models


def score_documents(documents: DataFrame, models: LossModels) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats per token) and score, their difference, for every row of
    documents (doc_id, text, target)."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(models)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            doc, wanted = batch.column(0), np.asarray(batch.column(2).to_pylist(), bool)
            for first, texts in _slices(batch, 1):
                h, begin = tokens(texts)
                flag = wanted[first : first + len(texts)]
                word = m.numbers(h)
                last = np.append(START, word[:-1])
                last[begin[:-1][begin[:-1] < len(h)]] = START
                which = _in(m.listed, _pair_hashes(h, begin))
                # a listed pair is frequent, and so are its words
                which[(last == UNKNOWN) | (word == UNKNOWN)] = -1
                row = np.repeat(np.arange(len(texts)), np.diff(begin))
                key = (last.astype(np.int64) << 32) | word
                order = np.lexsort((key, row))
                r, p, w = row[order], key[order], which[order]
                at = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]))) if len(r) else np.empty(0, np.int64)
                own = np.diff(np.append(at, len(r)))
                r, p, w = r[at], p[at], w[at]
                near = w >= 0
                losses = m.losses(p[near], own[near], flag[r[near]], m.listed_counts[:, w[near]])
                direct = [np.bincount(r[near], own[near] * x, len(texts)).astype(np.float64) for x in losses]  # of none it is whole numbers
                name = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass"), seed=int(f)) for t, f in zip(texts, flag, strict=True)], np.uint64).view(np.int64)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.slice(first, n), pa.array(name), pa.array(np.diff(begin).astype(np.int64)), pa.array(flag), *(pa.array(x) for x in direct),
                        _lists(p[~near], r[~near], n, pa.int64()), _lists(own[~near].astype(np.int32), r[~near], n, pa.int32()),
                    ],
                    ["doc_id", "name", "n_tokens", "target", "target_loss", "background_loss", "pair", "own"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rest = None
        for batch in batches:
            columns = [np.asarray(batch.column(i)) if i != 3 else np.asarray(batch.column(i).to_pylist(), bool) for i in range(4)]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            # rows arrive sorted: the last pair may go on in the next batch
            end = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            rest = [x[end:] for x in columns]
            if end:
                yield _scored(m, *(x[:end] for x in columns))
        if rest is not None and len(rest[0]):
            yield _scored(m, *rest)

    heads = materialise(
        documents.select("doc_id", "text", "target").mapInArrow(
            read, f"doc_id {kind}, name long, n_tokens long, target boolean, target_loss double, background_loss double, pair array<long>, own array<int>"
        ), "heads",
    )
    rows = heads.select("name", "target", F.explode(F.arrays_zip("pair", "own")).alias("x")).select(F.col("x.pair").alias("pair"), "name", F.col("x.own").alias("own"), "target")
    met = rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(count, "name long, t double, b double")
    sums = met.groupBy("name").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    # rows that repeat a text (and its part in the target) have brought their pairs as often as they occur
    copies = heads.groupBy("name").agg(F.count("*").alias("copies"))
    joined = heads.drop("pair", "own").join(copies.join(sums, "name"), "name", "left")
    per = lambda own, rest: F.when(F.col("n_tokens") > 0, (F.col(own) + F.coalesce(F.col(rest) / F.col("copies"), F.lit(0.0))) / F.col("n_tokens"))
    out = joined.select("doc_id", "n_tokens", per("target_loss", "t").alias("target_loss"), per("background_loss", "b").alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def _lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _scored(m: LossModels, pair: np.ndarray, name: np.ndarray, own: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    """The losses of whole groups of equal pairs, counted here, summed up by text."""
    begin = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    size = np.diff(np.append(begin, len(pair)))
    counts = np.array([np.repeat(np.add.reduceat(x, begin), size) for x in (own, own * target)])
    losses = m.losses(pair, own, target, counts)
    key, slot = np.unique(name, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.bincount(slot, own * x, len(key))) for x in losses)], ["name", "t", "b"])


def cross_entropy_difference(documents: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats per token) and score, their difference, per row.

    target_ids: one column, the ids of the target's documents; nulls, repetitions and ids without a document are
    left alone. A null or empty text, or one of spaces, has no tokens; its losses and score are null. Rows that
    repeat a doc_id, its text too, are texts of their own. Without a target both models are the background's
    match of nothing: the target's losses are those of the smoothing alone. Whole texts are read, some megabytes
    at a time. Other columns, whatever their names, are not read.
    """
    with small_batches(documents.sparkSession):
        rows = _flagged(documents, target_ids, doc_id, text)
        return score_documents(rows, fit(rows))
