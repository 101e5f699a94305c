"""What the training-data operators share: inputs, shipping, ranges, ragged arrays."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

import spanmill


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(docs: DataFrame, *extra: str) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty); other columns cannot clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per session, for Python inside tasks."""
    sc = spark.sparkContext
    if getattr(sc, "_spanmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(spanmill.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spanmill-"), "spanmill.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("spanmill", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._spanmill_shipped = True


def file_bytes(spark: SparkSession, path: str):
    """A driver's vocabulary file as a broadcast: a few MB, whatever the input."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` that gives its freed memory back to the system when a task ends: a worker waits for
    its next task beside the executor, whose stages without Python need that memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU library
            if trim:
                trim(0)

    return run


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over all batches; also where a column's name has a dot, which Spark's own
    function takes for a field."""
    ship_package(df.sparkSession)
    work = _trimmed(work)
    if not any("." in name for name in df.columns):
        return df.mapInArrow(work, schema)
    names = df.columns
    fields = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields
    plain = lambda n: [f"c{k}" for k in range(n)]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain(batch.num_columns))

    shape = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(fields)])
    return df.toDF(*plain(len(names))).mapInArrow(renamed, shape).toDF(*[f.name for f in fields])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and its n + 1 offsets."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = offsets[0] if len(offsets) else 0
    return raw[base : offsets[-1] if len(offsets) else 0], offsets - base


def ragged_take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated slices ``values[offsets[r]:offsets[r+1]]`` and their offsets."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    index = np.arange(out[-1]) + np.repeat(offsets[:-1][rows] - out[:-1], lengths)
    return values[index], out


def binary_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary array over ``raw`` bytes cut at ``offsets`` (32-bit sizes)."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]
    )


def range_starts(keys: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending inner bounds that cut the long ``key`` evenly.

    Only the bounds reach the driver: their number is ``parts``, whatever the input.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = keys.select(F.percentile_approx(key, shares, 10000).alias("at")).first()
    return sorted(set(row["at"] or []))


def range_of(key: Column, starts: list[int]) -> Column:
    """Number of bounds that are at most ``key``: its range, from 0."""
    if not starts:
        return F.lit(0)
    bounds = F.lit(starts).cast("array<bigint>")
    return F.size(F.filter(bounds, lambda b: b <= key))


def task_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
