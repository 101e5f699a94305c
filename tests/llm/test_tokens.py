"""Token shards, piece encoding and packing against the libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanmill.llm.packing import coordinates, hilbert_index, pack_along_curve, pair_signs
from spanmill.llm.piece_bpe import PieceCoder, piece_codes
from spanmill.llm.queries import QUERIES
from spanmill.llm.token_shards import EliasFano, read_document, read_shards, write_shards
from spanmill.llm.units import UnitEncoder
from spanmill.session import work_path

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "a", " a", "a  b", "Hello, WORLD don't  x\n\n y <|endoftext|> z é é", "İİ ẞ ﬁ 日本 語",
    "x　y", "a\n b", "b \n c", "nul\x00 a\x1c b \x85 c", "foo's 'S it'LL 12 345", "▁a a▁b ▁▁", "😀\U000f0000 " * 3,
    " " * 40 + "the" + " " * 19, "\t\r\n",
]


def tokenizer(path):
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module", params=[(WORDS, True), (BYTES, False)])
def units(request):
    with open(request.param[0], "rb") as file:
        return UnitEncoder(file.read(), request.param[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab éñ İß.,'s1\n\t　́日\x00|<>", max_size=40), max_size=6))
def test_units_equal_whole_texts(units, texts):
    ids, cuts = units.encode(pa.array([*texts, *ODD], pa.string()))
    for k, text in enumerate([*texts, *ODD]):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == units.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 5000), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64))
    coded = EliasFano.encode(values)
    assert coded.select_all().tolist() == values.tolist()
    for k in range(0, len(values), 37):
        assert coded.select(k) == values[k]
    if len(values) > 50:
        assert 8 * (len(coded.low) + len(coded.high)) <= len(values) * (3 + np.log2(max(2, values[-1] / len(values)))) + 16


def test_shards(spark, sf, corpus):
    got = {r.doc_id: r for r in QUERIES["op2_token_shards"](spark, sf).collect()}
    coder, start = tokenizer(WORDS), 0
    for doc_id, text in corpus:
        ids = [*coder.encode(text, add_special_tokens=False).ids, 2]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_shards_of_odd_rows(spark, make_docs):
    ids = [5, None, 5, 9, 1, 2, 3]
    path = work_path(spark, "odd-shards")
    write_shards(make_docs(["x", "null id", "y", None, "long " * 5000, "", "z"], ids), path, WORDS, True, 2)
    rows = read_shards(spark, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((i is not None, i or 0) for i in ids)
    assert next(r for r in rows if r.doc_id is None).start == 0
    assert next(r for r in rows if r.doc_id == 9).n_tokens == 1
    assert len(read_document(spark, path, 1)) == 5001
    empty = work_path(spark, "no-shards")
    write_shards(make_docs([]), empty, WORDS, True, 2)
    assert read_shards(spark, empty).count() == 0


@pytest.fixture(scope="module")
def pieces():
    with open(PIECES, "rb") as file:
        model = file.read()
    return PieceCoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abetheing éñ ▁.,!\n🦩日", max_size=60), max_size=6))
def test_pieces_equal_the_library(pieces, texts):
    coder, library = pieces
    texts = [*texts, *ODD]
    counts, ids, decoded = coder.code(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        want = library.encode(text)
        assert ids[k].as_py() == " ".join(map(str, want)) and counts[k] == len(want)
        assert decoded[k].as_py() == library.decode([*want, 2])


def test_every_piece_is_its_own_encoding(pieces):
    coder, _ = pieces
    assert all(coder._merge(p)[0] == [i] for p, i in list(coder.id_of.items())[::50])


def test_piece_digests(spark, sf, corpus, pieces):
    got = {r.doc_id: r for r in QUERIES["op7_sentencepiece"](spark, sf).collect()}
    for doc_id, text in corpus:
        ids = [*pieces[1].encode(text), 2]
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(pieces[1].decode(ids).encode()).hexdigest()


def test_piece_codes_of_odd_rows(make_docs):
    rows = piece_codes(make_docs([None, "", "a", "a"], [1, None, 3, 3]), PIECES).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2, 2]
    assert piece_codes(make_docs([]), PIECES).count() == 0


def check_packing(rows, corpus, size=1024):
    coder = tokenizer(BYTES)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in corpus:
        ids, at = [*coder.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size and at & (at - 1) == 0  # full, or a power of two: no padding


def test_packing(spark, sf, corpus):
    check_packing(QUERIES["op8_packing"](spark, sf).collect(), corpus)


def test_packing_of_odd_rows(make_docs):
    texts = [None, "", "word " * 3000, *["same text"] * 40]
    rows = pack_along_curve(make_docs(texts), BYTES, 64, parts=4).collect()
    check_packing(rows, list(enumerate(t or "" for t in texts)), 64)
    assert pack_along_curve(make_docs([]), BYTES).count() == 0
    assert pack_along_curve(make_docs(["a", "b"], [None, None]), BYTES).count() == 2
    with pytest.raises(ValueError):
        pack_along_curve(make_docs(["a"]), BYTES, 1000)


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = hilbert_index(grid, 3)
    assert sorted(place) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_coordinates_do_not_depend_on_neighbours():
    texts = ["abc def", "", "x", "abc def", "zz" * 700_000]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = coordinates(raw, cuts, pair_signs())
    assert (out[0] == out[3]).all() and (out[1] == 0).all() and (out[2] == 0).all()
    assert (np.abs(out[4]) == 1).all()
