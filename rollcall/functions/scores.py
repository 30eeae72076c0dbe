"""Token-set similarity of names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(x: str, y: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of one integer."""
    places: dict[str, int] = {}
    for k, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << k
    whole = (1 << len(x)) - 1
    row = whole
    for c in y:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(x) - row.bit_count()


def _nearest(part: int, whole: int) -> int:
    """1000 * part / whole to the nearest integer, halves to even."""
    q, r = divmod(1000 * part, whole)
    return q + (2 * r > whole or (2 * r == whole and q % 2 == 1))


def _tenths(i: str, x: str, y: str) -> int:
    if not (i or x) or not (i or y):
        return 0
    if i and (not x or not y):
        return 1000
    ni, g = len(i), 1 if i else 0
    l1, l2 = ni + g + len(x), ni + g + len(y)
    # characters outside the common ones: I and its gap are common to both sides
    best = _nearest(l1 + l2 - (len(x) + len(y) - 2 * common_subsequence(x, y)), l1 + l2)
    return max(best, _nearest(2 * ni, ni + l1), _nearest(2 * ni, ni + l2)) if i else best


def set_ratio_tenths(a: frozenset[str], b: frozenset[str]) -> int:
    """token_set_tenths of two sets of words."""
    both = a & b
    return _tenths(*(" ".join(sorted(x)) for x in (both, a - both, b - both)))


#: Texts up to this length are compared many pairs at a time, the bits of one word each; this many pairs together.
_BITS, _PAIRS = 64, 2048


def _characters(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, ...]:
    """The characters of all texts of x and then of y as small numbers from 1, and for each side where its texts begin and how long they are."""
    text = "".join(x.to_pylist()) + "".join(y.to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kinds, flat = np.unique(codes, return_inverse=True)
    flat = (flat + 1).astype(np.uint8 if len(kinds) < 255 else np.uint32)
    lx, ly = (pc.utf8_length(s).to_numpy(zero_copy_only=False).astype(np.int64) for s in (x, y))
    begin = np.concatenate([[0], np.cumsum(np.concatenate([lx, ly]))])
    return flat, begin[: len(lx)], lx, begin[len(lx) : len(lx) + len(ly)], ly


def _padded(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    place = np.arange(width)
    out = flat[np.minimum(begin[:, None] + place, len(flat) - 1)]
    out[place >= size[:, None]] = 0
    return out


def common_lengths(x: pa.Array, y: pa.Array) -> np.ndarray:
    """common_subsequence of many pairs of texts."""
    n = len(x)
    out = np.zeros(n, np.int64)
    flat, bx, lx, by, ly = _characters(x, y)
    turned = lx > ly  # the shorter text lies in the bits
    bx, by, lx, ly = np.where(turned, by, bx), np.where(turned, bx, by), np.minimum(lx, ly), np.maximum(lx, ly)
    for k in np.flatnonzero(lx > _BITS):
        out[k] = common_subsequence(x[k].as_py(), y[k].as_py())
    todo = np.flatnonzero((lx > 0) & (lx <= _BITS))
    todo = todo[np.argsort(-ly[todo], kind="stable")]
    for at in range(0, len(todo), _PAIRS):
        some = todo[at : at + _PAIRS]
        short = _padded(flat, bx[some], lx[some], _BITS)
        sizes = ly[some]
        row = np.full(len(some), ~np.uint64(0))
        for j in range(int(sizes[0])):
            live = np.searchsorted(-sizes, -j, "left")  # the pairs whose longer text has a character here
            sign = flat[by[some[:live]] + j]
            hit = row[:live] & np.packbits(short[:live] == sign[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
            row[:live] = (row[:live] + hit) | (row[:live] - hit)
        out[some] = _BITS - np.bitwise_count(row).astype(np.int64)
    return out


def _nearests(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """_nearest of arrays; 0 where the whole is 0."""
    whole = np.maximum(whole, 1)
    q, r = np.divmod(1000 * part, whole)
    return q + ((2 * r > whole) | ((2 * r == whole) & (q % 2 == 1)))


def _ratios(ni: np.ndarray, nx: np.ndarray, ny: np.ndarray, l: np.ndarray) -> np.ndarray:  # noqa: E741
    """The tenths of pairs: the lengths of the common words and of either rest, and of the rests' common subsequence."""
    g = (ni > 0).astype(np.int64)
    l1, l2 = ni + g + nx, ni + g + ny
    best = _nearests(2 * (ni + g + l), l1 + l2)
    shared = np.maximum(_nearests(2 * ni, ni + l1), _nearests(2 * ni, ni + l2))
    best = np.where(ni > 0, np.maximum(best, shared), best)
    best = np.where((ni > 0) & ((nx == 0) | (ny == 0)), 1000, best)
    return np.where((ni + nx == 0) | (ni + ny == 0), 0, best).astype(np.int32)


def tenths(i: pa.Array, x: pa.Array, y: pa.Array) -> np.ndarray:
    """_tenths of many pairs."""
    ni, nx, ny = (pc.utf8_length(s).to_numpy(zero_copy_only=False).astype(np.int64) for s in (i, x, y))
    open_ = np.flatnonzero((nx > 0) & (ny > 0))
    l = np.zeros(len(ni), np.int64)  # noqa: E741
    if len(open_):
        l[open_] = common_lengths(x.take(pa.array(open_)), y.take(pa.array(open_)))
    return _ratios(ni, nx, ny, l)


#: Names up to this many words are compared many pairs at a time; entries of a table of the places of signs in texts.
_MOST_WORDS, _TABLE = 48, 1 << 22


def _shared_words(words: list[list[str]], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair the words of its first that its second has too, as bits, and those of its second."""
    number: dict[str, int] = {}
    most = max(map(len, words), default=0)
    ids = np.full((most, len(words)), -1, np.int32)
    for k, w in enumerate(words):
        ids[: len(w), k] = [number.setdefault(x, len(number)) for x in w]
    bits = np.zeros((2, len(i)), np.int64)
    for at in range(0, len(i), 65_536):
        some = slice(at, at + 65_536)
        a, b = ids[:, i[some]], ids[:, j[some]]
        for k in range(most):
            for m in range(most):
                same = (a[k] == b[m]) & (a[k] >= 0)
                if same.any():
                    bits[0, some] |= same.astype(np.int64) << k
                    bits[1, some] |= same.astype(np.int64) << m
    return bits[0], bits[1]


def common_of(texts: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """common_subsequence of many pairs of the texts, by their places."""
    out = np.zeros(len(x), np.int64)
    kinds, flat = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), return_inverse=True)
    flat = (flat + 1).astype(np.uint8 if len(kinds) < 255 else np.int32)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    turned = size[x] > size[y]  # the shorter text lies in the bits
    short, long = np.where(turned, y, x), np.where(turned, x, y)
    for k in np.flatnonzero(size[short] > _BITS):
        out[k] = common_subsequence(texts[short[k]], texts[long[k]])
    todo = np.flatnonzero((size[short] > 0) & (size[short] <= _BITS))
    used, pattern = np.unique(short[todo], return_inverse=True)
    width = len(kinds) + 1
    each = max(1, _TABLE // width)  # patterns whose table is held at a time
    for first in range(0, len(used), each):
        mine = used[first : first + each]
        signs = _padded(flat, begin[mine], size[mine], _BITS)
        places = np.zeros((len(mine), width), np.uint64)
        for k in range(int(size[mine].max())):
            places[np.arange(len(mine)), signs[:, k]] |= np.uint64(1 << k)
        places[:, 0] = 0  # the places behind a text's end
        places = places.ravel()
        here = np.flatnonzero((pattern >= first) & (pattern < first + each)) if len(used) > each else np.arange(len(todo))
        here = here[np.argsort(-size[long[todo[here]]], kind="stable")]
        at = 0
        while at < len(here):
            most = int(size[long[todo[here[at]]]])
            some = here[at : at + max(1, min(4 * _PAIRS, _TABLE // most))]
            at += len(some)
            other = long[todo[some]]
            texts_of = np.ascontiguousarray(_padded(flat, begin[other], size[other], most).T)
            base = (pattern[some] - first) * width
            row = np.full(len(some), ~np.uint64(0))
            for sign in texts_of:
                hit = row & places[base + sign]
                row = (row + hit) | (row - hit)
            out[todo[some]] = _BITS - np.bitwise_count(row).astype(np.int64)
    return out


def pair_tenths(names: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """token_set_tenths of pairs of names, by their places; a name is its sorted words with blanks between them."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    names = [names[k] for k in used.tolist()]
    i, j = at[: len(i)], at[len(i) :]
    words = [n.split(" ") if n else [] for n in names]
    out = np.zeros(len(i), np.int32)
    many = np.array([len(w) > _MOST_WORDS for w in words], bool)
    for k in np.flatnonzero(many[i] | many[j]):
        out[k] = set_ratio_tenths(frozenset(words[i[k]]), frozenset(words[j[k]]))
    few = np.flatnonzero(~(many[i] | many[j]))
    i, j = i[few], j[few]
    bits = np.concatenate(_shared_words([[] if m else w for w, m in zip(words, many.tolist(), strict=True)], i, j))
    rest = np.concatenate([i, j])  # the place of what is left of a name in the texts, which begin with the names
    some = np.flatnonzero(bits)
    left, which = np.unique(bits[some], return_inverse=True)
    cut, place = np.unique(rest[some] * max(1, len(left)) + which, return_inverse=True)
    texts = list(names)
    for n, b in zip((cut // max(1, len(left))).tolist(), left[cut % max(1, len(left))].tolist() if len(cut) else [], strict=True):
        texts.append(" ".join(w for k, w in enumerate(words[n]) if not b >> k & 1))
    rest[some] = len(names) + place
    x, y = rest[: len(i)], rest[len(i) :]
    size = np.array([len(t) for t in texts], np.int64)
    nx, ny = size[x], size[y]
    ni = np.where(bits[: len(i)] != 0, size[i] - nx - (nx > 0), 0)
    open_ = np.flatnonzero((nx > 0) & (ny > 0))
    l = np.zeros(len(i), np.int64)  # noqa: E741
    if len(open_):
        l[open_] = common_of(texts, x[open_], y[open_])
    out[few] = _ratios(ni, nx, ny, l)
    return out


@F.arrow_udf(T.IntegerType())
def _tenths_of(a: pa.Array, b: pa.Array) -> pa.Array:
    n = len(a)
    found = pc.fill_null(pa.concat_arrays([a, b]), "").dictionary_encode()
    place, names = found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
    one, two = np.minimum(place[:n], place[n:]), np.maximum(place[:n], place[n:])
    met, which = np.unique(one * len(names) + two, return_inverse=True)
    return pa.array(pair_tenths(names, met // max(1, len(names)), met % max(1, len(names)))[which], pa.int32())


def sorted_words(tokens: Column) -> Column:
    return F.sort_array(F.array_distinct(tokens))


def names_tenths(a: Column, b: Column) -> Column:
    """token_set_tenths of two names that are their sorted_words with blanks between them; a batch's two names are compared once."""
    return _tenths_of(a, b)


def words_tenths(a: Column, b: Column) -> Column:
    """token_set_tenths of two arrays of sorted_words, which aren't sorted again for each pair."""
    return names_tenths(F.array_join(a, " "), F.array_join(b, " "))


def token_set_tenths(a: Column, b: Column) -> Column:
    """Token-set ratio of two token arrays, 0 to 1000: tenths of a percent, exact halves to the even tenth.

    With I the shared tokens and D1, D2 those of one side only, each sorted and joined by spaces, the
    result is the best of the ratios of I+D1 with I+D2, of I with I+D1, and of I with I+D2; shared
    tokens and an empty rest give 1000, an empty side 0. A ratio is one less the share of characters
    outside the longest common subsequence. Sets are built and sorted by Spark; their comparison and the
    subsequence, which no built-in expression has, run in Python, on Arrow batches.
    """
    return words_tenths(sorted_words(a), sorted_words(b))
