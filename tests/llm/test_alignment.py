"""Alignment at shared cuts against a brute-force walk over the libraries' tokens."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanmill.llm import alignment
from spanmill.llm.alignment import Aligner, shared_cuts, token_groups, token_links
from spanmill.llm.queries import QUERIES

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "a", "  two  spaces ", "x <|endoftext|> <s> </s>", "▁ mark", "a▁b", "é 日本 😀\U000f0000", "nul\x00 \x85\n\n\t", "﻿ bom",
    "word " * 300, "don't 12345 ﬁ İ", "a\r\nb", "   ",
]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    # The same vocabulary as ranks gives each id's bytes without the table under test.
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        raw = {int(i): base64.b64decode(t) for t, i in (line.split() for line in file)}
    return first, raw, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute(text, libraries):
    """(a ids, b ids, groups, links)."""
    first, raw, second = libraries
    want = (" " + text).encode()
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    pieces = [second.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if not text or b"".join(raw[i] for i in a) != want or b"".join(b_bytes) != want:
        return [], [], [], []
    a_ends, b_ends = np.cumsum([len(raw[i]) for i in a]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    shared = sorted(set(a_ends) & set(b_ends))
    groups, links, x, y = [], [], 0, 0
    for end in shared:
        u, v = a_ends.index(end) + 1, b_ends.index(end) + 1
        groups.append((a[x:u], b[y:v]))
        links.append((a[u - 1], b[v - 1]))
        x, y = u, v
    return a, b, groups, links


def written_groups(groups):
    return ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abething éñ ▁.,!\n🦩日<>'", max_size=60), max_size=5))
def test_groups_against_brute_force(libraries, own_aligner, texts):
    texts = [*texts, *ODD]
    a, a_cuts, b, b_cuts = own_aligner.encode(pa.array(texts))
    at_a, at_b = own_aligner.cuts(a, a_cuts, b, b_cuts)
    groups = own_aligner.group_texts(a, b, at_a, at_b, np.searchsorted(at_a, a_cuts))
    for k, text in enumerate(texts):
        want_a, want_b, want, _ = brute(text, libraries)
        assert a[a_cuts[k] : a_cuts[k + 1]].tolist() == want_a and b[b_cuts[k] : b_cuts[k + 1]].tolist() == want_b
        assert groups[k].as_py() == written_groups(want)


def test_forgotten_units_change_nothing(own_aligner, monkeypatch):
    texts = pa.array(["some words here", "and other words", "some words here"])
    want = [x.tolist() for x in own_aligner.encode(texts)]
    monkeypatch.setattr(alignment, "KEPT_UNITS", 1)
    for _ in range(2):
        assert [x.tolist() for x in own_aligner.encode(texts)] == want


@pytest.fixture(scope="module")
def own_aligner():
    with open(BYTES, "rb") as first, open(PIECES, "rb") as second:
        return Aligner(first.read(), second.read())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 60), max_size=25), st.lists(st.integers(1, 60), max_size=25), st.integers(1, 70)), max_size=6))
def test_cuts_of_any_ends(rows):
    """Ends without tokenizers: all shared ones are found, however far from the middle."""
    base, a, b, a_cuts, b_cuts = 0, [], [], [0], [0]
    for one, two, last in rows:
        a += sorted({base + x for x in one if x < last} | {base + last})
        b += sorted({base + x for x in two if x < last} | {base + last})
        base += last
        a_cuts.append(len(a))
        b_cuts.append(len(b))
    at_a, at_b = shared_cuts(*(np.array(x, np.int64) for x in (a, a_cuts, b, b_cuts)))
    assert [a[i] for i in at_a] == [b[i] for i in at_b] == sorted(set(a) & set(b))


def test_cuts_far_from_the_middle():
    a = np.concatenate([np.arange(1, 200_000, 2), [200_000]])
    b = np.concatenate([[1, 5], np.arange(6, 200_000, 2), [200_000]])
    at_a, at_b = shared_cuts(a, np.array([0, len(a)]), b, np.array([0, len(b)]))
    assert a[at_a].tolist() == b[at_b].tolist() == [1, 5, 200_000]


def check_links(rows, corpus, libraries):
    found = {doc_id: brute(text, libraries) for doc_id, text in corpus}
    counts = Counter(link for *_, links in found.values() for link in links)
    most = Counter()
    for (_, second), n in counts.items():
        most[second] = max(most[second], n)
    assert len(rows) == len(corpus)
    for r in rows:
        a, b, groups, links = found[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links))
        assert r.n_best == sum(counts[x] == most[x[1]] for x in links) and r.count_sum == sum(counts[x] for x in links)
        assert r.groups_sha256 == (hashlib.sha256(written_groups(groups).encode()).hexdigest() if a else "")


def test_whole_query(spark, sf, corpus, libraries):
    check_links(QUERIES["op13_alignment"](spark, sf).collect(), corpus, libraries)


def test_many_blocks(make_docs, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    monkeypatch.setattr(alignment, "ENCODED_BYTES", 1000)
    texts = [*ODD, *[f"the same words {k % 7} and more" for k in range(120)]]
    check_links(token_links(make_docs(texts), BYTES, PIECES).collect(), list(enumerate(texts)), libraries)


def test_odd_rows(make_docs):
    rows = token_links(make_docs([None, "", "a b", "a b", "▁"], [1, None, 3, 3, 4]), BYTES, PIECES).collect()
    assert sorted((r.n_a, r.n_groups, r.n_best, r.count_sum) for r in rows) == [(0, 0, 0, 0)] * 3 + [(2, 2, 2, 4)] * 2
    assert sorted(r.groups for r in token_groups(make_docs(["a b", None]), BYTES, PIECES).collect()) == ["", "257|264;275|287"]
    assert token_links(make_docs([]), BYTES, PIECES).count() == 0
