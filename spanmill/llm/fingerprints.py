"""Bottom-k fingerprints of documents: the k smallest hashes of their word shingles.

Fingerprints merge (of parts, of documents) and estimate resemblance, containment and the
number of distinct shingles. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import range_of, range_starts, task_count, texts_of

SHINGLE_WORDS, K = 5, 128
#: Hashes are cut to so many bits; the text form has BITS / 4 hexadecimal digits of each.
BITS = 48


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``words`` words (between single spaces or newlines); a text with
    fewer words has one, a text without words none. Repeats are still in it."""
    tokens = F.filter(F.split(F.translate(text, "\n\t", "  "), " "), lambda w: w != "")
    mask = F.lit((1 << BITS) - 1)

    def hashed(own: Column) -> Column:
        n = F.greatest(F.size(own) - words + 1, F.lit(1))
        runs = F.transform(F.sequence(F.lit(1), n), lambda k: F.xxhash64(F.slice(own, k, words)).bitwiseAND(mask))
        return F.when(F.size(own) > 0, runs).otherwise(F.lit([]).cast("array<bigint>"))

    # The one-element array holds the words, so that they are made once and not per shingle.
    return F.element_at(F.transform(F.array(tokens), hashed), 1)


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, ascending."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def fingerprint_of(text: Column, k: int = K) -> Column:
    return bottom_k(shingle_hashes(text), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of the union of both shingle sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) / share of the hash range."""
    full = (k - 1) * float(1 << BITS) / F.element_at(sketch, k)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(full)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the part of the union's k smallest hashes that is in
    both. Two texts without words are alike (1), one alone is not (0)."""
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(shared / F.size(union)).cast("double")


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has (a without words: 1)."""
    both = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(sketch: Column) -> Column:
    """All hashes as lower-case hexadecimal digits of one width, ascending."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, fingerprint, n_distinct) of every whole text. Null text: empty. Equal texts
    have equal fingerprints. Each row gets one row; extra columns are not read."""
    sketched = texts_of(docs).select("doc_id", fingerprint_of(F.col("text"), k).alias("sketch"))
    return sketched.select("doc_id", as_text(F.col("sketch")).alias("fingerprint"), distinct_count(F.col("sketch"), k).alias("n_distinct"))


def with_following(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, wrap, doc_id, text, extra): documents in ranges of ascending (doc_id, text), null
    ids first. The first documents of a range are also, as ``extra`` rows, behind the last of
    the range before it, and the first of all behind the last of all, so that the document
    after any other is in its range."""
    parts = parts or task_count(docs.sparkSession)
    source = texts_of(docs)
    starts = range_starts(docs, "doc_id", parts)
    ends = docs.agg(F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    is_first = F.col("doc_id").isNull() if ends[1] else F.col("doc_id") == F.lit(ends[0]).cast("long")
    part = range_of(F.col("doc_id"), starts)
    own = F.struct(part.alias("part"), F.lit(0).alias("wrap"), F.lit(False).alias("extra"))
    before = F.struct((part - 1).alias("part"), F.lit(0).alias("wrap"), F.lit(True).alias("extra"))
    around = F.struct(F.lit(len(starts)).alias("part"), F.lit(1).alias("wrap"), F.lit(True).alias("extra"))
    copies = [own]
    if starts:
        copies.append(F.when(F.array_contains(F.lit(starts).cast("array<bigint>"), F.col("doc_id")), before))
    copies.append(F.when(is_first, around))
    held = F.filter(F.array(*copies), lambda c: c.isNotNull())
    return source.select("doc_id", "text", F.explode(held).alias("copy")).select("copy.*", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, k: int = K, parts: int | None = None) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 2) code points replaced by as many (or all)
    from the start of the next document in ascending (doc_id, text) order, null ids first; the
    last is followed by the first. Null text: empty. One document is followed by itself.
    """
    spark = docs.sparkSession
    parts = parts or task_count(spark)
    rows = with_following(docs, parts)
    order = Window.partitionBy("part").orderBy("wrap", F.asc_nulls_first("doc_id"), "text", "extra")
    # The extra rows follow all own rows of the range: their ids are as large or larger, or
    # they wrap around.
    paired = rows.withColumn("next_text", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    sketched = paired.select(
        "part", "wrap", "doc_id", "text", "extra",
        n.cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        fingerprint_of(F.col("text"), k).alias("own"),
        fingerprint_of(edited, k).alias("changed"),
    )
    compared = sketched.withColumn("next", F.lead("own").over(order)).filter(~F.col("extra"))
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")
    return compared.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(own).alias("fingerprint"),
        as_text(changed).alias("edited_fingerprint"),
        resemblance(own, changed, k).alias("near_edited"),
        resemblance(own, following, k).alias("near_next"),
        distinct_count(own, k).alias("n_distinct"),
        containment(own, changed, k).alias("kept_in_edited"),
    )
