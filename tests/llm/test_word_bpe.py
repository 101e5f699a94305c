"""Speculated BPE against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanmill.llm.queries import QUERIES
from spanmill.llm.word_bpe import WordCoder, byte_slices, word_codes

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endoftext|", "don't I'LL we've 's's't", "a" * 900,
    "é́ é İİ ẞ ﬁ 日本　語", "nul\x00 a\x1c b \x85 c", "ŉ ǆ 😀\U000f0000", "\t\r\n", "abc" * 2000, "12 345½",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def coder():
    with open(WORDS, "rb") as file:
        return WordCoder(file.read())


def compare(coder, library, texts):
    ids, cuts = coder.encode(pa.array(texts, pa.string()))
    decoded = coder.decode(ids, cuts)
    for k, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[cuts[k] : cuts[k + 1]].tolist() == want
        assert decoded[k].as_py() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abethingéñ İß.,'sLL1\n\t　́日\x00|<>", max_size=60), max_size=6))
def test_equals_the_library(coder, library, texts):
    compare(coder, library, [*texts, *ODD])


def test_pairs_against_merging(coder):
    """The array check of pairs against merging the symbols of both."""
    rng = np.random.default_rng(3)
    open_ended = np.flatnonzero([not t.endswith("</w>") and 1 < len(t) < 12 and i not in coder.special.values() for i, t in enumerate(coder.texts)])
    left, right = rng.choice(open_ended, 3000), rng.choice(open_ended, 3000)
    fits = coder.compatible(left, right)
    for a, b, fit in zip(left.tolist(), right.tolist(), fits.tolist()):
        symbols = [coder.symbol[c] for c in coder.texts[a] + coder.texts[b]]
        assert fit == (coder.by_rank(symbols) == [a, b])
    assert 0 < fits.mean() < 1


def test_only_failing_words_are_merged(coder, monkeypatch):
    words = [coder._written(w) for w in ("the", "people", "another", "zqxjkvbz")]
    merged = []
    monkeypatch.setattr(coder, "by_rank", lambda symbols, own=coder.by_rank: merged.append(len(symbols)) or own(symbols))
    coder.encode_words(words)
    assert set(merged) <= {8}


def test_whole_query(spark, sf, corpus, library):
    got = {r.doc_id: r for r in QUERIES["op11_word_bpe"](spark, sf).collect()}
    assert len(got) == len(corpus)
    for doc_id, text in corpus:
        ids = library.encode(text, add_special_tokens=False).ids
        row = got[doc_id]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(make_docs):
    rows = word_codes(make_docs([None, "", "a b", "a b"], [1, None, 3, 3]), WORDS).collect()
    assert sorted((r.n_tokens, r.decoded) for r in rows) == [(0, ""), (0, ""), (2, "a</w> b</w>"), (2, "a</w> b</w>")]
    assert word_codes(make_docs([]), WORDS).count() == 0


def test_slices_keep_every_row():
    batch = pa.record_batch({"text": pa.array(["x" * 30, None, "", "y" * 5, "z" * 50])})
    slices = list(byte_slices(batch, 32, 2))
    assert [s.num_rows for s in slices] == [2, 2, 1]
    assert pa.Table.from_batches(slices).column("text").to_pylist() == batch.column("text").to_pylist()
