"""Toxicity by a weighted lexicon, matched with one Aho-Corasick automaton over folded text.

Folding undoes the usual disguises: compatibility forms, look-alike letters of other scripts, digits
and signs that stand for letters, and separators inside a word. A lexicon entry is a word or the
beginning of a word. The lexicon, its weights, its exception phrases and the curve from a text's
normalised weight to a score are learned from labelled texts. A score reads the text and nothing else.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import materialise

# Letters of other scripts that look like Latin ones, and the letters they look like.
LOOK_ALIKES = dict(
    zip(
        "абвгдеёзікмнорстухцѕјԁԍһԛԝѵɑɡıαβεηικνορτυχωϲ",
        "abbrdeezikmhopctyxusjdghqwvagiabehikvoptuxwc",
        strict=False,
    )
)
# Digits and signs written in place of letters inside a word.
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Longest beginning of a word that can be an entry.
MAX_ENTRY = 14
MIN_ENTRY = 3
#: Least likelihood ratio of an entry: far beyond what chance gives among a million patterns.
MIN_GAIN = 40.0


def _fold_table() -> dict[int, str]:
    """Code point to folded text, for the code points that do not fold to themselves."""
    table: dict[int, str] = {}
    for code in range(0x20, 0x30000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        out = unicodedata.normalize("NFKC", c).casefold()
        out = "".join(LOOK_ALIKES.get(x, x) for x in out)
        if out != c:
            table[code] = out
    for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):  # invisible
        table[code] = ""
    return table


_FOLD: dict[int, str] = {}
_SIGNS = str.maketrans(DIGIT_LETTERS)


def fold(text: str) -> str:
    """The words of a text with disguises undone, each with one space before and after it.

    Digits and signs turn into letters only between or beside letters of one word, so numbers stay
    numbers; signs at a word's end are punctuation. Marks inside a word that is spelled with single
    separators (i.d.i.o.t) vanish.
    """
    if not _FOLD:
        _FOLD.update(_fold_table())
    words = []
    for word in text.translate(_FOLD).split():
        if not word.isalpha():
            core = word.strip("".join(c for c in set(word) if not c.isalnum() and c not in "@$"))
            core = core.rstrip("$@")
            if core.isalpha():
                word = core
            else:
                parts = [p for p in _split(core, ".-_*'") if p]
                if len(parts) > 2 and all(len(p) == 1 for p in parts):
                    core = "".join(parts)
                letters = sum(map(str.isalpha, core))
                if letters * 3 >= len(core):
                    core = core.translate(_SIGNS)
                word = "".join(c if c.isalnum() else " " for c in core)
        words.append(word)
    return " " + " ".join(" ".join(words).split()) + " "


def _split(word: str, marks: str) -> list[str]:
    return word.translate(str.maketrans(dict.fromkeys(marks, " "))).split(" ")


@dataclass
class ToxicityModel:
    """entries: folded pattern to weight, ' word ' or ' beginning'. exceptions: phrases whose entries do not count.
    curve: the weights of the normalised features and the constant of a logistic curve."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [1.0, 0.0, 0.0, -3.0])

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> ToxicityModel:
        return ToxicityModel(**json.loads(text))


class _Matcher:
    """One automaton of all entries and exception phrases of a model."""

    def __init__(self, model: ToxicityModel):
        self.curve = model.curve
        self.automaton = ahocorasick.Automaton()
        for pattern, weight in model.entries.items():
            self.automaton.add_word(pattern, (pattern, weight))
        for phrase in model.exceptions:
            self.automaton.add_word(fold(phrase), (fold(phrase), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str) -> list[float]:
        """Weight per root of length, distinct entries' weight, and log length. A long text needs more matches."""
        folded = fold(text)
        words = max(1, folded.count(" ") - 1)
        spans, excused = [], []
        if len(self.automaton):
            for end, (pattern, weight) in self.automaton.iter(folded):
                span = (end - len(pattern) + 1, end, pattern, weight)
                (spans if weight else excused).append(span)
        if excused:  # one sweep: of the exceptions that begin no later than a match, the one that ends last decides
            starts = np.array(sorted(e[0] for e in excused))
            ends = np.maximum.accumulate([e[1] for e in sorted(excused, key=lambda e: e[0])])
            before = np.searchsorted(starts, [s[0] for s in spans], side="right") - 1
            spans = [s for s, k in zip(spans, before, strict=True) if k < 0 or ends[k] < s[1]]
        by_start: dict[int, float] = {}
        for at, _, _, weight in spans:  # of entries that begin at one place, the heaviest counts
            by_start[at] = max(by_start.get(at, 0.0), weight)
        total = sum(by_start.values())
        distinct = sum({p: w for _, _, p, w in spans}.values())
        return [total / math.sqrt(words), math.log1p(distinct), math.log1p(100.0 * total / words), 1.0]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.features(text), self.curve, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _candidates(text: str) -> set[str]:
    """What could be an entry: each word, and each of its beginnings."""
    found = set()
    for word in set(fold(text).split()):
        found.add(f" {word} ")
        for n in range(MIN_ENTRY, min(len(word), MAX_ENTRY)):
            found.add(f" {word[:n]}")
    return found


def learn(
    documents: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "toxic",
    key: str = "doc_id",
    max_texts: int = 12_000,
    max_entries: int = 400,
    min_texts: int = 4,
    max_exceptions: int = 1000,
) -> ToxicityModel:
    """Fit a model on the documents that have labels (key, 0 or 1).

    At most max_texts labels are used (the bound on the sample: half of them toxic if there are as
    many), those of the least hashed keys; null labels and texts are left out, and of several labels
    of one key the highest counts. The curve weighs each class by all its labels over those used, so the
    scores are those of the true rate at any size. Only the sample's texts move. An entry must
    be in min_texts toxic texts and its counts' likelihood ratio at least MIN_GAIN; the largest ratios come
    first, and no entry is the beginning of another. Two-word phrases around an entry that are found in
    non-toxic texts only, in min_texts at least, become exception phrases (max_entries and max_exceptions bound
    the model, the most telling first). Without labelled texts of
    both kinds the model has no entries, and every score is low.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(label).cast("int").alias("label")
    )
    order = F.xxhash64(F.col("key").cast("string"))
    bound = {1: max_texts // 2, 0: max_texts - max_texts // 2}
    chosen = rows.where("label = 1").orderBy(order, "key").limit(bound[1]).unionByName(
        rows.where("label = 0").orderBy(order, "key").limit(bound[0])
    )
    weights = {r[0]: max(1.0, r[1] / bound[r[0]]) for r in rows.groupBy("label").count().collect() if bound[r[0]]}
    texts = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "key")  # at most max_texts keys
    sample = materialise(sample.repartition(max(8, max_texts // 500), "key"), "toxic-sample")
    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for value, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[kind].update(_candidates(value))
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([seen[k][n] for n in names], pa.int64()) for k in (1, 0))],
            ["pattern", "toxic", "clean"],
        )

    counts = (
        sample.select("text", "label").mapInArrow(count, "pattern string, toxic long, clean long")
        .groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= min_texts)
    )
    # twice the log likelihood ratio of the pattern's counts in the two kinds of texts
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (t + c) / (n1 + n0)
    gain = 2 * (t * F.log(t / n1 / share) + F.when(c > 0, c * F.log(c / n0 / share)).otherwise(0.0))
    odds = F.log((t + 0.5) / (n1 + 1.0)) - F.log((c + 0.5) / (n0 + 1.0))
    ranked = (
        counts.withColumn("weight", odds).withColumn("gain", gain).where((F.col("weight") >= 1.0) & (F.col("gain") >= MIN_GAIN))
        .orderBy(F.desc("gain"), F.length("pattern"), "pattern").limit(20 * max_entries).collect()
    )  # a bounded list
    entries: dict[str, float] = {}
    for row in ranked:
        # of patterns that tell about as much, the most specific: the whole word before its beginnings
        same = [r for r in ranked if r["pattern"].startswith(row["pattern"]) and r["gain"] >= 0.95 * row["gain"]]
        best = max(same, key=lambda r: (len(r["pattern"]), r["gain"]))
        new = best["pattern"]
        if len(entries) < max_entries and not any(new.startswith(e) or e.startswith(new) for e in entries):
            entries[new] = float(best["weight"])
    model = ToxicityModel(entries)
    model.exceptions = _learn_exceptions(sample, model, min_texts, max_exceptions)
    return _fit_curve(sample, model, weights)


def _phrases(matcher: _Matcher, text: str) -> set[str]:
    """Pairs of words in which one is, or begins with, an entry."""
    words = fold(text).split()
    hit = [any(True for _ in matcher.automaton.iter(f" {w} ")) for w in words]
    return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], hit, hit[1:], strict=False) if x or y}


def _learn_exceptions(sample: DataFrame, model: ToxicityModel, min_texts: int, most: int) -> list[str]:
    if not model.entries:
        return []
    packed = model.to_json()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(ToxicityModel.from_json(packed))
        for batch in batches:
            names, kinds = [], []
            for value, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(_phrases(matcher, value))
                names += found
                kinds += [kind] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.int32())], ["phrase", "label"])

    found = (
        sample.select("text", "label").mapInArrow(count, "phrase string, label int")
        .groupBy("phrase").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
        .where((F.col("toxic") == 0) & (F.col("n") >= min_texts)).orderBy(F.desc("n"), "phrase").limit(most).collect()
    )
    return [r["phrase"].strip() for r in found]


def _fit_curve(sample: DataFrame, model: ToxicityModel, weights: dict[int, float]) -> ToxicityModel:
    """Logistic regression on the features of the bounded sample, lightly regularised; a text of each class stands for as many as its weight."""
    packed = model.to_json()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(ToxicityModel.from_json(packed))
        for batch in batches:
            rows = [matcher.features(v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    got = sample.select("text", "label").mapInArrow(measure, "x array<double>, label int").collect()
    x = np.array([r[0] for r in got])
    y = np.array([r[1] for r in got], dtype=float)
    stands = np.where(y == 1, weights[1], weights[0])
    w, penalty = np.zeros(x.shape[1]), np.array([1e-3] * (x.shape[1] - 1) + [0.0]) * stands.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (stands * p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (stands * (y - p)) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = [float(v) for v in w]
    return model


def score_toxicity(documents: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Adds a score from 0 to 1 to every row; a null or empty text is scored like a text without words.

    Whole texts are read. An existing column of that name is replaced; all others pass unchanged.
    """
    frame = documents.drop(score)
    packed, at = model.to_json(), frame.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(ToxicityModel.from_json(packed))
        for batch in batches:
            values = pa.array([matcher.score(v.as_py() or "") for v in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, score])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields]
    return frame.mapInArrow(run, ", ".join([*fields, f"`{score}` double"]))


def held_out(key: str = "doc_id", folds: int = 5):
    """True for the rows that learning must not see: crc32 of the key as text, modulo folds, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0
