"""Byte-pair encoding by speculation: longest match first, then a check of every adjacent pair.

A sequence of tokens is the encoding of a word exactly if every two neighbours are the encoding of
their joined text. So each new word is cut greedily into the longest vocabulary entries; the adjacent
pairs of all new words of a batch are checked together against the pairs decided so far; and only words
with a pair that fails are merged exactly, rank by rank. Words and pairs are remembered per process
within fixed bounds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Words and pairs that a process remembers before it starts anew.
WORDS_KEPT, PAIRS_KEPT = 400_000, 2_000_000


class WordBpe:
    """A vocabulary file with an end-of-word suffix: normaliser, word pattern, merges and ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): n for n, (a, b) in enumerate(merges)}
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.library = Tokenizer.from_file(path).normalizer, pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}
        self.longest = max(map(len, self.ids))
        self.words: dict[str | int, tuple[int, str, str]] = {}
        self.good = np.empty(0, np.int64)  # sorted codes of pairs that are compatible
        self.bad = np.empty(0, np.int64)
        self.counts = {"words": 0, "merged": 0}

    # ------------------------------------------------------------ exact merging

    def merge(self, word: str) -> list[str]:
        """The exact encoding of a word given in byte letters, its last symbol carrying the suffix: lowest rank first, leftmost first."""
        parts: list[str | None] = [*word[:-1], word[-1] + self.suffix]
        n = len(parts)
        if n <= 48:
            return self._merge_short(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.rank[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0:
                    pair = (parts[left], parts[after[left]])
                    if pair in self.rank:
                        heapq.heappush(heap, (self.rank[pair], left, *pair))
        return [p for p in parts if p is not None]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """The same without a heap: the ranks of all neighbours, of which each merge changes two."""
        none = len(self.rank)
        rank = self.rank.get
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    # ------------------------------------------------------------ speculation

    def guess(self, word: str) -> list[int] | None:
        """The longest entries from the left; an entry with the suffix only at the end. None if they don't cover the word."""
        out, at, n = [], 0, len(word)
        while at < n:
            token = self.ids.get(word[at:] + self.suffix) if n - at <= self.longest else None
            if token is not None:
                out.append(token)
                return out
            for end in range(min(n - 1, at + self.longest), at, -1):
                token = self.ids.get(word[at:end])
                if token is not None:
                    break
            else:
                return None
            out.append(token)
            at = end
        return None

    def _compatible(self, code: int) -> bool:
        a, b = self.text_of[code >> 32], self.text_of[code & 0xFFFFFFFF]
        if not b.endswith(self.suffix):
            # inside a word: the join must merge to the two without the suffix taking part
            return self._merge_inner(a + b) == [a, b]
        return self.merge(a + b[: len(b) - len(self.suffix)]) == [a, b]

    def _merge_inner(self, text: str) -> list[str]:
        suffix, self.suffix = self.suffix, ""
        try:
            return self.merge(text)
        finally:
            self.suffix = suffix

    def learn_words(self, words: list[str]) -> None:
        """Encode new words (normalised text) and remember their ids."""
        if len(self.good) + len(self.bad) > PAIRS_KEPT:
            self.good = self.bad = np.empty(0, np.int64)
        spelled = ["".join(map(self.letters.__getitem__, w.encode())) for w in words]
        guesses = [self.guess(s) for s in spelled]
        # every adjacent pair of every guess, one array
        flat = np.fromiter((t for g in guesses if g for t in g), np.int64)
        owner = np.repeat(np.arange(len(guesses)), [len(g) if g else 0 for g in guesses])
        codes = (flat[:-1] << 32) | flat[1:]
        inner = owner[:-1] == owner[1:] if len(owner) else np.empty(0, bool)
        codes, owner = codes[inner], owner[:-1][inner] if len(owner) else owner
        unique = np.unique(codes)
        new = unique[~(np.isin(unique, self.good, assume_unique=True) | np.isin(unique, self.bad, assume_unique=True))]
        verdict = np.fromiter(map(self._compatible, new.tolist()), bool, len(new))
        self.good = np.union1d(self.good, new[verdict])
        self.bad = np.union1d(self.bad, new[~verdict])
        failing = set(owner[np.isin(codes, self.bad)].tolist())
        for k, (word, text, found) in enumerate(zip(words, spelled, guesses, strict=True)):
            if found is None or k in failing:
                found = [i for i in map(self.ids.get, self.merge(text)) if i is not None]  # a symbol outside the vocabulary has no id
                self.counts["merged"] += 1
            self.counts["words"] += 1
            self.words[word] = (len(found), " ".join(map(str, found)), " ".join(self.text_of[i] for i in found))

    # ------------------------------------------------------------ texts

    def _normal(self, text: str) -> str:
        # letters are lower-cased one by one, so a capital sigma at a word's end has no form of its own
        return regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).replace("\u03a3", "\u03c3").lower()

    def _split(self, text: str) -> list[str]:
        """The words of a text without special strings.

        Code points that this Python's tables don't know have a class of their own in each library;
        a text with one of them is normalised and split by the tokenizers library.
        """
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            normalizer, splitter = self.library
            return [w for w, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]
        return self.pattern.findall(self._normal(text))

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of its special strings."""
        if self.special and "<|" in text and (found := list(self.special_pattern.finditer(text))):
            out, at = [], 0
            for m in found:
                out += self._split(text[at : m.start()])
                out.append(self.special[m[0]])
                at = m.end()
            return out + self._split(text[at:])
        return self._split(text)

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: the number of ids, the ids in decimal joined by spaces, and the decoded text."""
        split = [self.pieces(t) for t in texts]
        new = {w for words in split for w in words if w not in self.words}
        if len(self.words) + len(new) > WORDS_KEPT:  # all of the batch's words are needed at once
            self.words.clear()
            new = {w for words in split for w in words}
        self.words |= {i: (1, str(i), s) for s, i in self.special.items()}
        if new := [w for w in new if isinstance(w, str)]:
            self.learn_words(sorted(new))
        out = []
        for words in split:
            rows = [r for r in map(self.words.__getitem__, words) if r[0]]
            out.append((sum(r[0] for r in rows), " ".join([r[1] for r in rows]), " ".join([r[2] for r in rows])))
        return out


_LOADED: dict[str, WordBpe] = {}


def _loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) for every row; with digests: n_tokens, ids_sha256, decoded_sha256.

    A null text encodes as empty: no ids, decoded ''. The special strings of the vocabulary file are
    their single ids wherever they stand. ids_sha256 is over the decimal ids joined by one space. Other
    columns are not kept. `tokenizer` is the file's path, readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = coder.encode_batch([v or "" for v in batch.column(1).to_pylist()])
                if digests:
                    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                    columns = [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([sha(r[1]) for r in rows], pa.string()),
                        pa.array([sha(r[2]) for r in rows], pa.string()),
                    ]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    ids = [np.fromstring(r[1], np.int32, sep=" ") if r[0] else np.empty(0, np.int32) for r in rows]
                    columns = [pa.array(ids, pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    kind = documents.schema[doc_id].dataType.simpleString()
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {made}")


def decode_ids(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Adds (or replaces) decoded: the tokens of an array of ids joined by one space, ids outside the vocabulary left out; null of null."""
    frame = encoded.drop("decoded")
    at = frame.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = _loaded(tokenizer).text_of
        for batch in batches:
            texts = [None if v is None else " ".join(text_of[i] for i in v if i in text_of) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields]
    return frame.mapInArrow(run, ", ".join([*fields, "decoded string"]))
