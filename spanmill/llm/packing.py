"""Packing of documents into sequences along a Hilbert curve through document vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import file_bytes, map_arrow, range_of, range_starts, task_count, text_bytes, texts_of
from spanmill.llm.units import unit_encoder
from spanmill.llm.word_bpe import byte_slices

DIMENSIONS, BITS = 3, 12
_FIELD = 21
_STRETCH = 1 << 20


def pair_signs(seed: int = 7) -> np.ndarray:
    """For each pair of bytes three random bits, in fields of one 64-bit number."""
    pairs = np.arange(1 << 16, dtype=np.uint64)
    mixed = (pairs + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros(1 << 16, np.int64)
    for d in range(DIMENSIONS):
        out |= ((mixed >> np.uint64(40 + d)) & np.uint64(1)).astype(np.int64) << (_FIELD * d)
    return out


def coordinates(raw: np.ndarray, offsets: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Mean sign of the byte pairs of each text in each dimension, -1 to 1 (no pair: 0)."""
    sums = np.zeros((len(offsets) - 1, DIMENSIONS), np.int64)
    n_pairs = np.maximum(np.diff(offsets) - 1, 0)
    if len(raw) > 1:
        pairs = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        running = np.zeros(len(raw), np.int64)
        np.cumsum(signs[pairs], out=running[1:])
        # Fields hold a stretch of a text, so longer texts are summed stretch by stretch.
        stretches = np.maximum(1, -(-n_pairs // _STRETCH))
        doc = np.repeat(np.arange(len(n_pairs)), stretches)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        begin = offsets[:-1][doc] + k * _STRETCH
        end = np.minimum(begin + _STRETCH, offsets[:-1][doc] + n_pairs[doc])
        used = end > begin
        total = np.zeros(len(doc), np.int64)
        total[used] = running[end[used]] - running[begin[used]]
        for d in range(DIMENSIONS):
            np.add.at(sums[:, d], doc, (total >> (_FIELD * d)) & ((1 << _FIELD) - 1))
    return np.where(n_pairs[:, None] > 0, 2 * sums / np.maximum(n_pairs, 1)[:, None] - 1, 0.0)


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) below ``2 ** bits``: neighbouring
    places are neighbouring points. The axes are turned into the curve's bit planes, highest
    plane first (exchange and inversion of lower bits, then Gray code)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for axis in range(d):
            set_bit = (x[axis] >> plane) & 1 == 1
            swap = np.where(set_bit, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(set_bit, low, swap)
            x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for axis in range(d):
            out = out << 1 | (x[axis] >> plane) & 1
    return out


def curve_keys(docs: DataFrame, keep_text: bool) -> DataFrame:
    """(doc_id, text or not, place): place is the Hilbert index over 26 bits of a hash of
    the id, so that a large group of equal texts can be cut anywhere."""
    signs = pair_signs()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                raw, offsets = text_bytes(batch.column("text"))
                spread = 0.5 + 0.5 * np.tanh(6 * coordinates(raw, offsets, signs))
                points = np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                curve = hilbert_index(points)
                out = {"doc_id": batch.column("doc_id"), "curve": pa.array(curve, pa.int64())}
                if keep_text:
                    out["text"] = batch.column("text")
                yield pa.RecordBatch.from_pydict(out)

    placed = map_arrow(docs, place, "doc_id long, curve long" + (", text string" if keep_text else ""))
    tie = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 26))
    return placed.withColumn("place", F.col("curve") * F.lit(1 << 26) + tie).drop("curve")


#: Bytes of text that a task encodes and packs together.
PACKED_BYTES = 1_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Packer:
    """Segments of documents that are not yet in a full sequence, and their ids."""

    def __init__(self, part: int, size: int):
        self.size, self.next_id = size, part << 40
        self.ids = np.zeros(0, np.uint32)
        self.doc = pa.array([], pa.int64())
        self.begin = self.length = self.total = np.zeros(0, np.int64)

    def add(self, doc: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc = pa.concat_arrays([self.doc, doc])
        self.begin = np.concatenate([self.begin, np.zeros(len(lengths), np.int64)])
        self.length = np.concatenate([self.length, lengths])
        self.total = np.concatenate([self.total, lengths])
        self.ids = np.concatenate([self.ids, ids.astype("<u4")])

    def take(self, last: bool) -> pa.RecordBatch:
        """Pieces of all full sequences; at the end also of the rest, in powers of two."""
        n = len(self.ids) // self.size * self.size
        cuts = np.arange(0, n + 1, self.size)
        if last:
            rest = len(self.ids) - n
            powers = [1 << b for b in range(self.size.bit_length() - 1, -1, -1) if rest >> b & 1]
            cuts = np.concatenate([cuts, n + np.cumsum(np.array(powers, np.int64))])
            n = len(self.ids)
        seg = np.cumsum(self.length) - self.length
        inside = cuts[:-1]
        at = np.unique(np.concatenate([seg[seg < n], inside]))
        owner = np.searchsorted(seg, at, side="right") - 1
        sequence = np.searchsorted(cuts, at, side="right") - 1
        length = np.minimum(np.append(at[1:], n), (seg + self.length)[owner]) - at if len(at) else at
        start = self.begin[owner] + at - seg[owner]
        crc = [zlib.crc32(self.ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist())]
        out = pa.RecordBatch.from_pydict(
            {
                "doc_id": self.doc.take(pa.array(owner, pa.int64())),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(self.total[owner], pa.int64()),
                "sequence_id": pa.array(self.next_id + sequence, pa.int64()),
                "offset": pa.array(at - cuts[sequence] if len(at) else at, pa.int64()),
            }
        )
        self.next_id += len(cuts) - 1
        ends = seg + self.length
        left = np.flatnonzero(ends > n)
        cut = np.maximum(n - seg[left], 0)
        self.doc = self.doc.take(pa.array(left, pa.int64()))
        self.begin, self.length, self.total = self.begin[left] + cut, self.length[left] - cut, self.total[left]
        self.ids = self.ids[n:]
        return out


def pack_along_curve(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, parts: int | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` ids (a power of two).

    Documents are ordered by their place on the curve in ranges of about equal numbers of
    documents; each range is one task, which lays its documents end to end and cuts at every
    ``size`` ids. The rest of a range is cut into powers of two, so nothing is padded.
    Null text: empty, so only the end id. Rows with equal or null ids are packed as they are.
    No documents: no pieces. Extra columns are not read.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    definition = file_bytes(spark, tokenizer)
    parts = parts or task_count(spark)
    source = texts_of(docs)
    starts = range_starts(curve_keys(source, False).select("place"), "place", parts)
    ordered = (
        curve_keys(source, True)
        .withColumn("part", range_of(F.col("place"), starts))
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "place", "doc_id")
        .select("part", "doc_id", "text")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(definition.value, False)
        packer = None
        for whole in batches:
            for batch in byte_slices(whole, PACKED_BYTES):
                packer = packer or _Packer(batch.column("part")[0].as_py(), size)
                values, cuts = encoder.encode(batch.column("text"))
                lengths = np.diff(cuts)
                out = np.full(len(values) + len(lengths), end_id, np.uint32)
                out[np.arange(len(values)) + np.repeat(np.arange(len(lengths)), lengths)] = values
                packer.add(batch.column("doc_id"), out, lengths + 1)
                yield packer.take(False)
        if packer:
            yield packer.take(True)

    return map_arrow(ordered, pack, PIECES)
