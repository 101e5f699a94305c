"""Rows under a key for all time, in sorted runs that are merged level by level.

Each micro-batch adds one run; once FANOUT runs of a level lie side by side they become one run
of the next level, so there are few runs whatever the number of batches. A run has its rows,
sorted by the key's hash, and a Bloom filter of its keys. A lookup reads the filters (about 1.3
bytes a key); only keys that a filter may hold are looked for in the rows, where their hashes
choose row groups and pages.

A run is ``run-<first>-<last>`` and counts once its filter is written, which happens last. It
replaces the runs that it covers, so a merge that stops half-way changes nothing, and a batch
that runs again overwrites its own run.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.operators.bloom import FILTER_SCHEMA, block_of, blocks_for, bloom_filter, may_hold
from spanmill.session import written

FANOUT = 8
#: Up to so many keys are filtered for at the scan, and up to so many (narrow) are broadcast.
PUSHED_KEYS, BROADCAST_KEYS = 64, 1_000_000
_RUN = re.compile(r"run-(\d+)-(\d+)$")


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _complete(fs, status, spark: SparkSession) -> bool:
    return fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{status.getPath()}/filter/_SUCCESS"))


def live_runs(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """Complete runs (first batch, last batch) that no other complete run covers."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    found = [(m, s) for s in fs.listStatus(path) if (m := _RUN.search(s.getPath().getName())) and _complete(fs, s, spark)]
    runs, reach = [], -1
    for first, last in sorted(((int(m[1]), int(m[2])) for m, _ in found), key=lambda r: (r[0], -r[1])):
        if last > reach:
            runs.append((first, last))
            reach = last
    return runs


def _write_run(rows: DataFrame, root: str, key: str, first: int, last: int) -> None:
    spark, at = rows.sparkSession, f"{root}/run-{first}-{last}"
    fs, path = _fs(spark, f"{at}/filter")
    fs.delete(path, True)  # until it is written again the run does not count
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    hashed.repartitionByRange("_hash", key).sortWithinPartitions("_hash").write.mode("overwrite").parquet(f"{at}/rows")
    stored = spark.read.schema(hashed.schema).parquet(f"{at}/rows")
    blocks = blocks_for(stored.count())
    with_size = bloom_filter(stored, key, blocks).withColumn("blocks", F.lit(blocks).cast("bigint"))
    with_size.write.mode("overwrite").parquet(f"{at}/filter")


def record(rows: DataFrame, root: str, key: str, batch_id: int) -> None:
    """Add the rows of a micro-batch; the same batch again replaces them."""
    _write_run(rows.withColumn("ingest_batch", F.lit(batch_id).cast("bigint")), root, key, batch_id, batch_id)


def _level(run: tuple[int, int]) -> int:
    level, width = 0, run[1] - run[0] + 1
    while width >= FANOUT:
        level, width = level + 1, width // FANOUT
    return level


def _mergeable(runs: list[tuple[int, int]]) -> list[tuple[int, int]] | None:
    """The last FANOUT neighbours of one level, if there are so many."""
    tail = runs[-FANOUT:]
    return tail if len(tail) == FANOUT and len({_level(r) for r in tail}) == 1 else None


def merge(spark: SparkSession, root: str, key: str, schema: str, before: int) -> None:
    """Merge runs of the batches under ``before``, which are done and will not run again."""
    fs, _ = _fs(spark, root)
    while chosen := _mergeable(runs := [r for r in live_runs(spark, root) if r[1] < before]):
        first, last = chosen[0][0], chosen[-1][1]
        rows = _rows(spark, root, schema, chosen).drop("_hash")
        _write_run(rows, root, key, first, last)
        for a, b in runs:
            if first <= a and b <= last:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/run-{a}-{b}"), True)


def _rows(spark: SparkSession, root: str, schema: str, runs: list[tuple[int, int]]) -> DataFrame:
    return spark.read.schema(f"{schema}, ingest_batch bigint, _hash bigint").parquet(*[f"{root}/run-{a}-{b}/rows" for a, b in runs])


def lookup(spark: SparkSession, root: str, key: str, schema: str, keys: DataFrame, before: int) -> DataFrame:
    """Stored rows (``schema``) of earlier batches than ``before`` whose key is in ``keys``.

    ``keys`` is narrow and of the size of a micro-batch; it is broadcast up to BROADCAST_KEYS.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    runs = [r for r in live_runs(spark, root) if r[0] < before]
    # A relation that the planner knows to be empty, so that joins with it vanish.
    nothing = spark.range(0).select(*[F.lit(None).cast(c.strip().split()[1]).alias(c.strip().split()[0]) for c in schema.split(",")]).limit(0)
    if not runs:
        return nothing
    wanted = written(keys.select(key).filter(F.col(key).isNotNull()).distinct(), "wanted-keys")
    narrow = (lambda df, n: F.broadcast(df) if n <= BROADCAST_KEYS else df)
    n_wanted = wanted.count()
    filters = [
        spark.read.schema(f"{FILTER_SCHEMA}, blocks bigint").parquet(f"{root}/run-{a}-{b}/filter").withColumn("run", F.lit(k))
        for k, (a, b) in enumerate(runs)
    ]
    sizes = {r["run"]: r["blocks"] for r in reduce(DataFrame.unionByName, [f.select("run", "blocks").limit(1) for f in filters]).collect()}
    places = F.array(*[F.struct(F.lit(k).alias("run"), block_of(F.col(key), n).alias("block")) for k, n in sorted(sizes.items())])
    if not sizes:
        return nothing
    asked = wanted.select(key, F.explode(places).alias("at")).select(key, "at.run", "at.block")
    probed = reduce(DataFrame.unionByName, filters).join(narrow(asked, n_wanted * len(runs)), ["run", "block"])
    maybe = written(probed.filter(may_hold(F.col(key))).select(key).distinct(), "maybe-keys")
    few = [r[0] for r in maybe.limit(PUSHED_KEYS + 1).collect()]
    if not few:
        return nothing
    stored = _rows(spark, root, schema, runs).filter(F.col("ingest_batch") < before)
    if len(few) <= PUSHED_KEYS:
        # Single comparisons: a long list would reach the scan as a range only.
        stored = stored.filter(reduce(lambda a, b: a | b, [F.col("_hash") == F.xxhash64(F.lit(k)) for k in few]))
        return stored.filter(F.col(key).isin(few)).select(*names)
    return stored.join(narrow(maybe, n_wanted), key, "left_semi").select(*names)
