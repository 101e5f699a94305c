"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and each segment value leads to the codes that have it. Two
codes within Hamming distance m (r + 1) - 1 agree in one of m segments up to r bits. So the
segment radius r grows from 0, and a query is done as soon as the distance of its k-th
verified neighbour is within what r covers. Copies of a code are searched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.session import written

SEGMENT_BITS = 16


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): one bit per component, set where it is positive, in segments of
    SEGMENT_BITS bits. Null, NaN and missing components give 0 (NaN counts as positive in
    SQL order, so it is taken out); rows with a null id or vector have no code; rows equal in
    id and code are one."""
    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(
        F.col("id").isNotNull() & F.col("vector").isNotNull()
    )
    size = known.agg(F.max(F.size("vector"))).first()[0] or 0
    segments = max(1, -(-size // SEGMENT_BITS))

    def bit(k: int) -> Column:
        value = F.get("vector", F.lit(k)).cast("double")
        return F.when((value > 0) & ~F.isnan(value), 1 << (k % SEGMENT_BITS)).otherwise(0)

    def segment(s: int) -> Column:
        out = F.lit(0)
        for k in range(s * SEGMENT_BITS, min(size, (s + 1) * SEGMENT_BITS)):
            out = out + bit(k)
        return out

    return known.select("id", F.array(*[segment(s) for s in range(segments)]).alias("code")).distinct()


def _distances(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda total, part: total + part)


def _masks(radius: int) -> Column:
    """Segment values with ``radius`` set bits: at most 12 870, whatever the data. A constant
    text, which the planner turns into one array."""
    masks = [str(m) for m in range(1 << SEGMENT_BITS) if m.bit_count() == radius]
    return F.split(F.lit(",".join(masks)), ",").cast("array<int>")


def _probe(queries: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """Codes that first agree with a query at this radius, each once, with the distance."""
    values = F.transform(_masks(radius), lambda m: m.bitwiseXOR(F.col("own")))
    probes = (
        queries.select("query", F.posexplode("query").alias("segment", "own"))
        .select("query", "segment", F.explode(values).alias("value"))
    )
    parts = _distances(F.col("query"), F.col("code"))
    return (
        # Planned as a merge join: the planner takes the probes for as few as the queries, and
        # would broadcast them.
        probes.hint("merge").join(index, ["segment", "value"])
        .withColumn("parts", parts)
        # Found before at a smaller radius, or now by an earlier segment: not again.
        .filter((F.array_min("parts") == radius) & (F.array_position("parts", F.lit(radius)) == F.col("segment") + 1))
        .select("query", "code", "first_id", "n", _total(F.col("parts")).alias("distance"))
    )


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other ids of every query by
    (Hamming distance, id); fewer if there are not so many. ``queries`` are rows of ``codes``
    or of the same shape; a query's own id is left out. Empty tables: no rows.
    """
    codes = written(codes, "codes")
    need = k + 1  # one of them may be the query itself
    members = codes.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("place") <= need)
    distinct = codes.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    distinct = written(distinct, "distinct-codes")
    index = distinct.select("code", "first_id", "n", F.posexplode("code").alias("segment", "value"))
    row = codes.select(F.size("code").alias("segments")).first()
    segments = row["segments"] if row else 1
    total = distinct.agg(F.sum("n")).first()[0] or 0
    open_queries = written(queries.select(F.col("code").alias("query")).distinct(), "open-queries")
    order = Window.partitionBy("query").orderBy("distance", "first_id")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    found, done = None, []
    for radius in range(SEGMENT_BITS + 1):
        new = _probe(open_queries, index, radius)
        # Any of the first ids by (distance, id) is of one of the first codes by (distance, first id).
        best = new if found is None else found.unionByName(new)
        best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= need).drop("place")
        found = written(best, "found-codes")
        covered = segments * (radius + 1) - 1
        enough = found.withColumn("seen", F.sum("n").over(running)).filter(F.col("seen") >= min(need, total))
        finished = enough.groupBy("query").agg(F.min("distance").alias("kth")).filter(F.col("kth") <= covered).select("query")
        done.append(written(found.join(finished, "query", "left_semi"), "finished-codes"))
        left = written(open_queries.join(finished, "query", "left_anti"), "open-queries")
        found = found.join(finished, "query", "left_anti")
        open_queries = left
        if left.isEmpty():
            break
    nearest = done[0]
    for more in done[1:]:
        nearest = nearest.unionByName(more)
    answered = (
        queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
        .join(nearest.select("query", "code", "distance"), "query")
        .join(members.select("code", F.col("id").alias("neighbor_id")), "code")
        .filter("neighbor_id <> query_id")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return answered.select("query_id", rank.alias("rank"), "neighbor_id", "distance").filter(F.col("rank") <= k)
