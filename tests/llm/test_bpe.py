"""Ids and decoded texts against the tokenizers library, on odd texts and random ones."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rollcall.llm.bpe import WordBpe, decode_ids, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), WordBpe(PATH)
ODD = [
    "", "hello WORLD's  don't I'LL", "naïve café ÀÉ 123 4567", "日本語テスト 한국어", "<|startoftext|>abc<|endoftext|> x<|endoftext|>", "😀👍🏽 á é é",
    "İstanbul ΑΣ ſ ß ﬁ", "\x00\x01 a​b", "a" * 5000 + " " + "ab" * 300, "!!!???...", "it's 'S 'T 're x've", " 　 tab\t\n", "Dž ǅ ᾳ ΌΣΟΣ",
    "<|startoftext|", "<|ENDOFTEXT|>", "antidisestablishmentarianism supercalifragilistic",
]


def _same(text: str) -> None:
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    n, ids, decoded = OWN.encode_batch([text])[0]
    assert ids == " ".join(map(str, want)) and n == len(want)
    assert decoded == LIBRARY.decode(want, skip_special_tokens=False)


def test_odd_texts():
    for text in ODD:
        _same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    _same(text)


def test_made_up_words_take_both_ways():
    random.seed(8)
    words = ["".join(random.choice(["th", "er", "ing", "qu", "zx", "on", "é"]) for _ in range(random.randint(1, 7))) for _ in range(3000)]
    for k in range(0, 3000, 100):
        _same(" ".join(words[k : k + 100]))
    assert 0 < OWN.counts["merged"] < OWN.counts["words"]


def test_table(spark):
    rows = [*enumerate(ODD), (100, None), (3, ODD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = encode_documents(df, PATH)
    assert got.count() == len(rows)
    back = decode_ids(got.drop("decoded"), PATH).join(got.select("doc_id", "decoded").distinct().withColumnRenamed("decoded", "d"), "doc_id")
    assert back.where("decoded <> d or decoded is null").count() == 0
    for r in encode_documents(df, PATH, digests=True).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))
    assert encode_documents(df.where("false"), PATH).collect() == []
