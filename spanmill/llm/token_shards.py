"""Token ids of all documents in shards: one id array each, document ends as Elias-Fano.

Shards are rows of a Parquet table in the shared folder, so Spark's commit protocol covers
lost tasks. Documents are in ascending ``doc_id`` order over the whole table (null first).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import file_bytes, map_arrow, range_of, range_starts, ragged_take, task_count, texts_of
from spanmill.llm.units import unit_encoder
from spanmill.session import work_path

SELECT_STEP = 256
#: Ids in a shard before it is closed (a longer document still stays in one shard).
SHARD_IDS = 2_000_000
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


class EliasFano:
    """An ascending sequence of non-negative integers in about 2 + log2(last / n) bits each.

    Low bits are packed, high bits are unary. ``select(i)`` finds the i-th one of the high
    part from a sample at every ``SELECT_STEP``-th one and a count within that stretch.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("the sequence must ascend from 0 or more")
        last = int(values[-1]) if n else 0
        low_bits = max(0, ((last + 1) // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(n, low_bits, low.tobytes(), high.tobytes(), ones[::SELECT_STEP].astype("<u4").tobytes())

    def _low_of(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return out

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SELECT_STEP]), i % SELECT_STEP
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (here := int(_ONES[word])) <= left:
            left -= here
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | int(self._low_of(np.array([i]))[0])

    def select_all(self) -> np.ndarray:
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return (ones - i) << self.low_bits | self._low_of(i)


SHARDS = "part int, shard int, n_docs int, n_ids long, doc_ids array<bigint>, id_bytes int, ids binary, low_bits int, low binary, high binary, samples binary"


def _shard(part: int, shard: int, doc_ids: list[pa.Array], ids: list[np.ndarray], sizes: list[np.ndarray], id_bytes: int) -> pa.RecordBatch:
    lengths = np.concatenate(sizes)
    flat = np.concatenate(ids).astype(f"<u{id_bytes}")
    ends = EliasFano.encode(np.cumsum(lengths))
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([part], pa.int32()),
            "shard": pa.array([shard], pa.int32()),
            "n_docs": pa.array([len(lengths)], pa.int32()),
            "n_ids": pa.array([len(flat)], pa.int64()),
            "doc_ids": pa.array([pa.concat_arrays(doc_ids).to_pylist()], pa.list_(pa.int64())),
            "id_bytes": pa.array([id_bytes], pa.int32()),
            "ids": pa.array([flat.tobytes()], pa.binary()),
            "low_bits": pa.array([ends.low_bits], pa.int32()),
            "low": pa.array([ends.low.tobytes()], pa.binary()),
            "high": pa.array([ends.high.tobytes()], pa.binary()),
            "samples": pa.array([ends.samples.tobytes()], pa.binary()),
        }
    )


def write_shards(docs: DataFrame, path: str, tokenizer: str, drops_space: bool, end_id: int, parts: int | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write the shards below ``path``.

    ``tokenizer`` is a tokenizers file. Null texts count as empty, so each document has at
    least its end id. Rows with equal or null ids keep one entry each, null ids first.
    Extra columns are not read. No documents: no shards.
    """
    spark = docs.sparkSession
    definition = file_bytes(spark, tokenizer)
    parts = parts or task_count(spark)
    starts = range_starts(docs, "doc_id", parts)
    ordered = (
        texts_of(docs)
        .withColumn("part", range_of(F.col("doc_id"), starts))
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(definition.value, drops_space)
        id_bytes = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        part, shard, held, doc_ids, ids, sizes = 0, 0, 0, [], [], []
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                part = batch.column("part")[0].as_py()
                values, cuts = encoder.encode(batch.column("text"))
                lengths = np.diff(cuts)
                out = np.full(len(values) + len(lengths), end_id, np.int32)
                out[np.arange(len(values)) + np.repeat(np.arange(len(lengths)), lengths)] = values
                ends = np.cumsum(lengths + 1)
                done = 0
                while done < len(lengths):
                    before = int(ends[done - 1]) if done else 0
                    upto = max(done + 1, int(np.searchsorted(ends, before + SHARD_IDS - held, side="right")))
                    doc_ids.append(batch.column("doc_id").slice(done, upto - done))
                    ids.append(out[before : ends[upto - 1]])
                    sizes.append((lengths + 1)[done:upto])
                    held += len(ids[-1])
                    done = upto
                    if held >= SHARD_IDS or done < len(lengths):
                        yield _shard(part, shard, doc_ids, ids, sizes, id_bytes)
                        shard, held, doc_ids, ids, sizes = shard + 1, 0, [], [], []
        if ids:
            yield _shard(part, shard, doc_ids, ids, sizes, id_bytes)

    map_arrow(ordered, encode, SHARDS).write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, base): ids in all shards before. Totals per part meet in one window of
    as many rows as parts."""
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("part_base"))
    return shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_part")).join(bases, "part").select(
        "part", "shard", (F.col("part_base") + F.col("in_part")).alias("base")
    )


def read_shards(spark, path: str) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {k: batch.column(k)[row].as_py() for k in batch.schema.names}
                ends = EliasFano(one["n_docs"], one["low_bits"], one["low"], one["high"], one["samples"]).select_all()
                ids = np.frombuffer(one["ids"], f"<u{one['id_bytes']}").astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(one["doc_ids"], pa.int64()),
                        "part": pa.array(np.full(len(ends), one["part"], np.int32)),
                        "shard": pa.array(np.full(len(ends), one["shard"], np.int32)),
                        "at": pa.array(begins, pa.int64()),
                        "n_tokens": pa.array(ends - begins, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    per_doc = map_arrow(shards, read, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long")
    bases = shard_starts(shards.select("part", "shard", "n_ids"))
    return per_doc.join(bases, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_document(spark, path: str, doc_id: int) -> list[int]:
    """Ids of one document by two select calls on its shard."""
    shards = spark.read.schema(SHARDS).parquet(path)
    row = shards.withColumn("k", F.array_position("doc_ids", F.lit(doc_id))).filter("k > 0").first()
    if row is None:
        raise KeyError(doc_id)
    ends = EliasFano(row["n_docs"], row["low_bits"], bytes(row["low"]), bytes(row["high"]), bytes(row["samples"]))
    k = row["k"] - 1
    begin = ends.select(k - 1) if k else 0
    return np.frombuffer(bytes(row["ids"]), f"<u{row['id_bytes']}")[begin : ends.select(k)].tolist()


def token_shards(docs: DataFrame, tokenizer: str, drops_space: bool = True, end_id: int = 2) -> DataFrame:
    """Write the shards to the shared folder and read them back per document."""
    path = work_path(docs.sparkSession, "token-shards")
    write_shards(docs, path, tokenizer, drops_space, end_id)
    return read_shards(docs.sparkSession, path)
