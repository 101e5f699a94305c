"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both encode the same bytes. The ends of the tokens are two ascending lists per text; where an end
is in both, the text can be cut. An interval is cut at the shared end nearest to its middle, found
by bisecting the other list, and both halves go on; an interval without a shared end inside is a
group. All intervals of a batch of texts take each step together, in arrays.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import file_bytes, map_arrow, ragged_take, text_bytes, texts_of
from spanmill.llm.units import UnitEncoder
from spanmill.llm.word_bpe import byte_characters, byte_slices
from spanmill.session import written

#: Bytes of text that are encoded together, and whose links are kept in one row (a longer text is
#: a row of its own). Rows stay well below what a JVM treats as a huge object.
ENCODED_BYTES, BLOCK_BYTES = 2_000_000, 400_000
#: Units and pieces of the byte-level tokenizer kept between batches.
KEPT_UNITS = 100_000
#: Ends that are tried one after the other from the middle of an interval.
NEAR = 12


class TokenBytes:
    """Bytes of every token of a vocabulary: ``raw`` cut at ``offsets``."""

    def __init__(self, tokens: list[bytes]):
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.diff(self.offsets)


def byte_level_tokens(definition: bytes) -> TokenBytes:
    """Of a byte-level vocabulary (by id), each character being the byte that it stands for."""
    value = {c: b for b, c in enumerate(byte_characters())}
    content = json.loads(definition)
    ids = {i: t for t, i in content["model"]["vocab"].items()}
    tokens = [bytes(value[c] for c in ids.get(i, "")) for i in range(1 + max(ids))]
    return TokenBytes(tokens)


def piece_tokens(library) -> TokenBytes:
    """Of a piece model: the space mark is a space, byte pieces are their byte, control pieces
    (which stand for no text) are empty."""
    out = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        if library.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif library.is_control(i):
            out.append(b"")
        else:
            out.append(piece.replace("▁", " ").encode())
    return TokenBytes(out)


def spelled_alike(tokens: TokenBytes, ids: np.ndarray, cuts: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: are the bytes of its tokens, joined, those of ``raw``?"""
    spelled, ends = ragged_take(tokens.raw, tokens.offsets, ids)
    own = ends[cuts]
    alike = np.diff(own) == np.diff(offsets)
    if not alike.all():  # compare the others only
        rows = np.flatnonzero(alike)
        spelled, own = ragged_take(spelled, own, rows)
        raw, offsets = ragged_take(raw, offsets, rows)
    else:
        rows = np.arange(len(alike))
    wrong = np.flatnonzero(spelled != raw)
    if len(wrong):
        alike[rows[np.unique(np.searchsorted(own, wrong, side="right") - 1)]] = False
    return alike


def shared_cuts(a_ends: np.ndarray, a_cuts: np.ndarray, b_ends: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a_ends`` and in ``b_ends``) of all ends that both tokenizers share.

    Ends are ascending over all texts; ``a_cuts`` and ``b_cuts`` are where each text's begin. The
    last end of a text is shared. An interval holds the ends strictly inside a stretch between
    two cuts. Its first tokenizer's ends are tried from the middle outwards, one by one while
    NEAR are enough, then all at once.
    """
    some = np.flatnonzero((np.diff(a_cuts) > 0) & (np.diff(b_cuts) > 0))
    found_a, found_b = [a_cuts[some + 1] - 1], [b_cuts[some + 1] - 1]
    # Ends inside: from low up to and without high.
    low_a, high_a, low_b, high_b = a_cuts[some], a_cuts[some + 1] - 1, b_cuts[some], b_cuts[some + 1] - 1
    while len(low_a):
        inside = (low_a < high_a) & (low_b < high_b)
        low_a, high_a, low_b, high_b = low_a[inside], high_a[inside], low_b[inside], high_b[inside]
        cut_a, cut_b = np.full(len(low_a), -1, np.int64), np.full(len(low_a), -1, np.int64)
        middle = (low_a + high_a) >> 1
        open_ = np.arange(len(low_a))
        step = 0
        while len(open_) and step < NEAR:
            # 0, 1, -1, 2, -2 ... places from the middle.
            away = (step + 1) >> 1 if step & 1 else -(step >> 1)
            probe = middle[open_] + away
            there = (probe >= low_a[open_]) & (probe < high_a[open_])
            own = open_[there]
            value = a_ends[probe[there]]
            place = _bisect(b_ends, value, low_b[own], high_b[own])
            hit = b_ends[np.minimum(place, high_b[own] - 1)] == value
            cut_a[own[hit]], cut_b[own[hit]] = probe[there][hit], place[hit]
            step += 1
            reach = (step + 1) >> 1
            left = (cut_a[open_] < 0) & ((middle[open_] + reach < high_a[open_]) | (middle[open_] - reach >= low_a[open_]))
            open_ = open_[left]
        if len(open_):
            counts = (high_a - low_a)[open_]
            own = np.repeat(open_, counts)
            probe = low_a[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            place = _bisect(b_ends, a_ends[probe], low_b[own], high_b[own])
            hit = np.flatnonzero(b_ends[np.minimum(place, high_b[own] - 1)] == a_ends[probe])
            hit = hit[np.lexsort((np.abs(probe[hit] - middle[own[hit]]), own[hit]))]
            hit = hit[np.concatenate([[True], own[hit][1:] != own[hit][:-1]])] if len(hit) else hit
            cut_a[own[hit]], cut_b[own[hit]] = probe[hit], place[hit]
        done = np.flatnonzero(cut_a >= 0)
        cut_a, cut_b = cut_a[done], cut_b[done]
        found_a.append(cut_a)
        found_b.append(cut_b)
        low_a, high_a = np.concatenate([low_a[done], cut_a + 1]), np.concatenate([cut_a, high_a[done]])
        low_b, high_b = np.concatenate([low_b[done], cut_b + 1]), np.concatenate([cut_b, high_b[done]])
    at_a, at_b = np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))
    return at_a, at_b


def _bisect(values: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First place from ``low`` on whose value is at least ``wanted``, at most ``high``: the
    halves of all intervals at once."""
    low, high = low.copy(), high.copy()
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (values[np.minimum(middle, len(values) - 1)] < wanted) & (low < high)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    return low


class Aligner:
    """Encodes texts with both tokenizers and finds their groups and links."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.units = UnitEncoder(byte_level, False)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.a, self.b = byte_level_tokens(byte_level), piece_tokens(self.library)
        self.a_names = pa.array([str(i) for i in range(len(self.a.length))], pa.large_string())
        self.b_names = pa.array([str(i) for i in range(len(self.b.length))], pa.large_string())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and offsets of both; texts whose bytes either does not give back have no ids."""
        texts = texts.cast(pa.large_string())
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        raw, offsets = text_bytes(spaced)
        self._forget()
        a_ids, a_cuts = self.units.encode(spaced)
        lists = self.library.encode(texts.to_pylist(), num_threads=1)
        b_cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        b_ids = np.fromiter((i for x in lists for i in x), np.int64, b_cuts[-1])
        fine = spelled_alike(self.a, a_ids, a_cuts, raw, offsets) & spelled_alike(self.b, b_ids, b_cuts, raw, offsets)
        fine &= np.diff(offsets) > 1
        if not fine.all():
            counts_a, counts_b = np.where(fine, np.diff(a_cuts), 0), np.where(fine, np.diff(b_cuts), 0)
            keep = np.flatnonzero(fine)
            a_ids, b_ids = ragged_take(a_ids, a_cuts, keep)[0], ragged_take(b_ids, b_cuts, keep)[0]
            a_cuts, b_cuts = (np.concatenate([[0], np.cumsum(c)]) for c in (counts_a, counts_b))
        return a_ids.astype(np.int64), a_cuts.astype(np.int64), b_ids, b_cuts

    def _forget(self) -> None:
        units = self.units
        if max(len(units.units), len(units.pieces)) > KEPT_UNITS:
            units.units = units.pieces = pa.array([], pa.large_string())
            units.values = units.piece_values = np.zeros(0, np.int32)
            units.offsets = units.piece_offsets = np.zeros(1, np.int64)

    def cuts(self, a_ids, a_cuts, b_ids, b_cuts) -> tuple[np.ndarray, np.ndarray]:
        return shared_cuts(np.cumsum(self.a.length[a_ids]), a_cuts, np.cumsum(self.b.length[b_ids]), b_cuts)

    def group_texts(self, a_ids, b_ids, at_a, at_b, bounds) -> pa.Array:
        """Per text its groups as ``a1,a2|b1;a3|b2``; ``bounds`` cuts the groups into texts."""

        def lists(names, ids, at):
            ends = pa.array(np.concatenate([[0], at + 1]), pa.int64())
            return pc.binary_join(pa.LargeListArray.from_arrays(ends, names.take(pa.array(ids))), pa.scalar(",", pa.large_string()))

        both = pc.binary_join_element_wise(lists(self.a_names, a_ids, at_a), lists(self.b_names, b_ids, at_b), pa.scalar("|", pa.large_string()))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), both), pa.scalar(";", pa.large_string()))


_ALIGNERS: dict[tuple[bytes, bytes], Aligner] = {}


def aligner(byte_level: bytes, pieces: bytes) -> Aligner:
    """One for each worker process."""
    if (byte_level, pieces) not in _ALIGNERS:
        _ALIGNERS[byte_level, pieces] = Aligner(byte_level, pieces)
    return _ALIGNERS[byte_level, pieces]


def token_groups(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, groups): the groups of every whole text, as ``a1,a2|b1;a3|b2,b3``.

    A groups ids of the byte-level vocabulary for a space and the text, and ids of the piece model
    for the text, at the byte offsets where both have a token's end. Null and empty texts, and
    texts that either side does not spell as a space and the text, have no tokens and no groups.
    Each row gets one row; extra columns are not read.
    """
    first, second = file_bytes(docs.sparkSession, byte_level), file_bytes(docs.sparkSession, pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(first.value, second.value)
        for whole in batches:
            for batch in byte_slices(whole, ENCODED_BYTES):
                a_ids, a_cuts, b_ids, b_cuts = own.encode(batch.column("text"))
                at_a, at_b = own.cuts(a_ids, a_cuts, b_ids, b_cuts)
                bounds = np.searchsorted(at_a, a_cuts, side="left")
                groups = own.group_texts(a_ids, b_ids, at_a, at_b, bounds)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_a": pa.array(np.diff(a_cuts)), "n_b": pa.array(np.diff(b_cuts)), "groups": groups.cast(pa.string())})

    return map_arrow(texts_of(docs), work, "doc_id long, n_a long, n_b long, groups string")


BLOCKS = "block long, pairs array<bigint>, times array<bigint>, docs binary, slots binary"
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def _slot_type(n_pairs: int) -> str:
    return "<u2" if n_pairs <= 1 << 16 else "<u4"


def _packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def link_blocks(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row per BLOCK_BYTES of texts: its distinct linked id pairs (``a << 32 | b``) and how
    often each is linked, its documents' figures, and the pair of every link in order. So a pair
    that is everywhere travels once per block, not once per link or document."""
    first, second = file_bytes(docs.sparkSession, byte_level), file_bytes(docs.sparkSession, pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, k = aligner(first.value, second.value), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in byte_slices(whole, ENCODED_BYTES):
                a_ids, a_cuts, b_ids, b_cuts = own.encode(batch.column("text"))
                at_a, at_b = own.cuts(a_ids, a_cuts, b_ids, b_cuts)
                bounds = np.searchsorted(at_a, a_cuts, side="left")
                groups = own.group_texts(a_ids, b_ids, at_a, at_b, bounds).cast(pa.large_binary())
                n_links, links = np.diff(bounds), a_ids[at_a] << 32 | b_ids[at_b]
                digests = [hashlib.sha256(g.as_buffer()).hexdigest() if n else "" for g, n in zip(groups, n_links.tolist())]
                columns = [batch.column("doc_id"), np.diff(a_cuts), np.diff(b_cuts), n_links, digests]
                table = pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, _DOCS)], schema=_DOCS)
                at = 0
                for part in byte_slices(batch, BLOCK_BYTES):
                    stop = at + part.num_rows
                    pairs, slots, times = np.unique(links[bounds[at] : bounds[stop]], return_inverse=True, return_counts=True)
                    ends = pa.array([0, len(pairs)], pa.int32())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([task << 32 | k], pa.int64()),
                            "pairs": pa.ListArray.from_arrays(ends, pa.array(pairs, pa.int64())),
                            "times": pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
                            "docs": pa.array([_packed(table.slice(at, stop - at))], pa.binary()),
                            "slots": pa.array([slots.astype(_slot_type(len(pairs))).tobytes()], pa.binary()),
                        }
                    )
                    at, k = stop, k + 1

    return map_arrow(texts_of(docs), work, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): corpus-wide links of each pair, and whether no pair with the same
    second id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.times").alias("n"))
    counts = written(each.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(second.alias("second")).agg(F.max("count").alias("most"))
    return counts.join(most, second == most["second"]).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def token_links(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Per document its groups and links (see ``token_groups``), and how common the links are.

    A link joins the two tokens that end together at a shared cut. n_best counts links whose pair
    of ids is linked at least as often, over all documents, as any pair with the same second id;
    count_sum adds up the pairs' counts over the links. Documents without tokens have zeros and
    an empty groups_sha256. Each row gets one row, equal or null ids too; extra columns are not
    read. Empty input: no rows.
    """
    blocks = written(link_blocks(docs, byte_level, pieces), "link-blocks")
    counts = written(pair_counts(blocks.select("pairs", "times")), "counted-pairs")
    places = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    found = places.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("found"))
    found = found.select("block", F.col("found.place").alias("place"), F.col("found.count").alias("count"), F.col("found.best").alias("best"))
    joined = blocks.select("block", F.size("pairs").alias("n_pairs"), "docs", "slots").join(written(found, "block-counts"), "block", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                table = pa.ipc.open_stream(batch.column("docs")[k].as_buffer()).read_all()
                slots = np.frombuffer(batch.column("slots")[k].as_buffer(), _slot_type(batch.column("n_pairs")[k].as_py()))
                n_links = table.column("n_links").to_numpy()
                ends = np.concatenate([[0], np.cumsum(n_links)])
                sums = np.zeros((2, len(slots) + 1), np.int64)
                if len(slots):
                    place, count, best = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("place", "count", "best"))
                    for row, values in enumerate((best, count)):
                        table_of = np.zeros(len(place), np.int64)
                        table_of[place] = values
                        np.cumsum(table_of[slots], out=sums[row, 1:])
                columns = {n: table.column(n) for n in ("doc_id", "n_a", "n_b")} | {"n_groups": pa.array(n_links), "n_links": pa.array(n_links)}
                columns |= {n: pa.array(np.diff(s[ends])) for n, s in zip(("n_best", "count_sum"), sums)} | {"groups_sha256": table.column("groups_sha256")}
                yield from pa.table(columns).combine_chunks().to_batches()

    return map_arrow(joined, work, ALIGNED)
