"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Every distinct shingle of a text is a Poisson process whose rate is its count; arrivals fall
into the registers of the signature at random, and a register keeps the shingle that arrived
first. A shingle stops once its next arrival is later than all registers of its text. Equal
registers estimate the probability Jaccard similarity. Texts that agree in a band of registers
are candidates, and their exact similarity decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import map_arrow, text_bytes, texts_of
from spanmill.llm.components import components
from spanmill.session import written

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares no band with probability (1 - 0.8^7)^48 = 1.2e-5.
BANDS, ROWS = 48, 7
REGISTERS = BANDS * ROWS
#: Candidates keep a bitmap of their shingles, which bounds the exact similarity from above. It
#: fills up in texts with more shingles than bits.
BITMAP_BITS = 2048
#: Those also compare four bits of each register. Of 336 registers 63 +- 7.2 differ at 0.8; pairs
#: of such texts of which more than 96 differ (4.6 deviations) count as less than similar.
WORDS_OF_BITS, MOST_DIFFERENT = -(-REGISTERS * 4 // 64), 96
#: One bit of each register, the marks, puts pairs in order: 34 +- 5.5 differ at 0.8.
WORDS_OF_MARKS, STEPS = -(-REGISTERS // 64), (34, REGISTERS)
#: Ids of candidate texts (16 bytes each) up to this number are broadcast.
BROADCAST_ROWS = 500_000
_HASH_BITS = 52
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run without ASCII white space), and word offsets of the texts."""
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offsets[:-1][(offsets[:-1] < offsets[1:])]
    begins[first] = solid[first]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    word = np.cumsum(begins) - 1
    at = np.flatnonzero(solid)
    place = at - starts[word[at]]
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x100000001B3, np.uint64))
    values = (raw[at].astype(np.uint64) + _U(1)) * powers[place]
    return _mix(np.add.reduceat(values, np.flatnonzero(begins[at]))), bounds


def weighted_shingles(raw: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes ascending per text, counts, offsets per text). A text with fewer than ``words``
    words has one shingle of all of them; a text without words has none."""
    hashes, bounds = word_hashes(raw, offsets)
    n_texts, size = len(offsets) - 1, np.diff(bounds)
    if n_texts > 1 << (64 - _HASH_BITS):
        raise ValueError("too many texts in one call")
    n = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(n_texts), n)
    at = bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(len(text), np.uint64)
    for k in range(words):
        inside = at + k < bounds[1:][text]
        own = np.where(inside, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))], _U(0)) if len(hashes) else out
        out = out * _U(0x9E3779B97F4A7C15) + own
    out = _mix(out) >> _U(64 - _HASH_BITS)
    keyed = np.sort(text.astype(np.uint64) << _U(_HASH_BITS) | out)
    new = np.ones(len(keyed), bool)
    new[1:] = keyed[1:] != keyed[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(keyed)))
    distinct = keyed[at]
    owner = (distinct >> _U(_HASH_BITS)).astype(np.int64)
    return distinct & _U((1 << _HASH_BITS) - 1), counts, np.searchsorted(owner, np.arange(n_texts + 1))


def signatures(hashes: np.ndarray, counts: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers) of 32-bit names of the first shingle of each register; rows of texts
    without shingles stay at the largest name."""
    n_texts = len(offsets) - 1
    empty = np.iinfo(np.uint64).max
    first = np.full(n_texts * registers, empty, np.uint64)
    text = np.repeat(np.arange(n_texts), np.diff(offsets))
    name, rate, time = hashes.copy(), counts.astype(np.float64), np.zeros(len(hashes))
    latest = np.full(n_texts, np.inf)
    k = 0
    while len(name):
        drawn = _mix(name * _U(0x9E3779B97F4A7C15) + _U((k + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        time -= np.log(((drawn >> _U(24)).astype(np.float64) + 0.5) / (1 << 40)) / rate
        early = time < latest[text]
        if not early.all():
            name, rate, time, text, drawn = name[early], rate[early], time[early], text[early], drawn[early]
        slot = text * registers + ((drawn & _U(0xFFFFFF)) % _U(registers)).astype(np.int64)
        packed = time.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32) | (name & _U(0xFFFFFFFF))
        np.minimum.at(first, slot, packed)
        # Registers only fall, so the bound of a text may be looked up now and then.
        if k < 8 or k % 8 == 0:
            alive = np.unique(text)
            top = first.reshape(n_texts, registers)[alive].max(axis=1)
            times = (top >> _U(32)).astype(np.uint32).view(np.float32).astype(np.float64)
            latest[alive] = np.where(top == empty, np.inf, times)
        k += 1
    return (first & _U(0xFFFFFFFF)).astype(np.uint32).reshape(n_texts, registers)


def band_keys(names: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the registers of each band and the number of the band."""
    rows = names.reshape(len(names), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets with ascending names: the
    sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d)."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    xa, xb = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    ratio = xb / xa
    order = np.argsort(ratio, kind="stable")
    ratio, xa, xb = ratio[order], xa[order], xb[order]
    last = np.searchsorted(ratio, ratio, side="right")
    below = np.concatenate([[0.0], np.cumsum(xa)])[last] + only_a
    above = xb.sum() - np.concatenate([[0.0], np.cumsum(xb)])[last] + only_b
    return float((1 / (below / xa + above / xb)).sum())


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


SIGNED = "doc_id long, node binary, keys array<bigint>, bits array<bigint>, marks array<bigint>"


def signed_documents(docs: DataFrame) -> DataFrame:
    """Per document the digest of its text, its band keys and four bits of each register; no
    keys if the text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                raw, offsets = text_bytes(batch.column("text"))
                hashes, counts, cuts = weighted_shingles(raw, offsets)
                names = signatures(hashes, counts, cuts)
                some = np.diff(cuts) > 0
                n_keys = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                nibbles = np.zeros((len(names), WORDS_OF_BITS * 16), np.uint8)
                nibbles[:, :REGISTERS] = names & 15
                bits = np.ascontiguousarray(nibbles[:, ::2] | nibbles[:, 1::2] << 4).view("<i8")
                padded = np.zeros((len(names), WORDS_OF_MARKS * 64), np.uint8)
                padded[:, :REGISTERS] = names & 1
                marks = np.packbits(padded, axis=1, bitorder="little").view("<i8")
                n_marks = np.arange(len(names) + 1, dtype=np.int32) * marks.shape[1]
                n_bits = np.arange(len(names) + 1, dtype=np.int32) * bits.shape[1]
                cut = offsets.tolist()
                view = raw.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "node": pa.array([hashlib.md5(view[a:b]).digest() for a, b in zip(cut, cut[1:])], pa.binary()),
                        "keys": pa.ListArray.from_arrays(pa.array(n_keys), pa.array(band_keys(names)[some].ravel(), pa.int64())),
                        "bits": pa.ListArray.from_arrays(pa.array(n_bits), pa.array(bits.ravel(), pa.int64())),
                        "marks": pa.ListArray.from_arrays(pa.array(n_marks), pa.array(marks.ravel(), pa.int64())),
                    }
                )

    return map_arrow(texts_of(docs), work, SIGNED)


SHINGLED = "node binary, names binary, counts binary, bitmap array<bigint>, weight long"


def bitmaps(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, words of 64 bits): bit ``h % BITMAP_BITS`` is set for every shingle h."""
    out = np.zeros((len(offsets) - 1, BITMAP_BITS), bool)
    out[np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), (hashes % _U(BITMAP_BITS)).astype(np.int64)] = True
    return np.packbits(out, axis=1, bitorder="little").view("<i8")


def _shingled(texts: DataFrame) -> DataFrame:
    """Weighted shingles of candidate texts (empty counts: all one), bitmap and total weight."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                hashes, counts, cuts = weighted_shingles(*text_bytes(batch.column("text")))
                names, weights = [], []
                for a, b in zip(cut := cuts.tolist(), cut[1:]):
                    names.append(hashes[a:b].astype("<u8").tobytes())
                    weights.append(b"" if (counts[a:b] == 1).all() else counts[a:b].astype("<u4").tobytes())
                maps = bitmaps(hashes, cuts)
                ends = pa.array(np.arange(len(maps) + 1) * maps.shape[1], pa.int32())
                totals = np.diff(np.concatenate([[0], np.cumsum(counts)])[cuts])
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": batch.column("node"), "names": pa.array(names, pa.binary()), "counts": pa.array(weights, pa.binary()),
                        "bitmap": pa.ListArray.from_arrays(ends, pa.array(maps.ravel(), pa.int64())), "weight": pa.array(totals, pa.int64()),
                    }
                )

    return map_arrow(texts, work, SHINGLED)


def _similar(pairs: DataFrame, shingled: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity is at least ``least``."""
    left = shingled.select(F.col("node").alias("a"), F.col("names").alias("names_a"), F.col("counts").alias("counts_a"))
    right = shingled.select(F.col("node").alias("b"), F.col("names").alias("names_b"), F.col("counts").alias("counts_b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = [batch.column(c) for c in ("names_a", "counts_a", "names_b", "counts_b")]
            for row in range(batch.num_rows):
                na, ca, nb, cb = (np.frombuffer(c[row].as_buffer(), t) for c, t in zip(columns, ("<u8", "<u4", "<u8", "<u4")))
                ca, cb = (c if len(c) else np.ones(len(n), np.uint32) for n, c in ((na, ca), (nb, cb)))
                keep.append(probability_jaccard(na, ca, nb, cb) >= least)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)})

    return map_arrow(pairs.join(left, "a").join(right, "b"), work, "a binary, b binary")


def _differ(x: Column, y: Column) -> Column:
    """Number of registers whose four bits differ."""

    def changed(p: Column, q: Column) -> Column:
        d = p.bitwiseXOR(q)
        any_bit = d.bitwiseOR(F.shiftright(d, 1)).bitwiseOR(F.shiftright(d, 2)).bitwiseOR(F.shiftright(d, 3))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(x, y, changed), F.lit(0), lambda total, n: total + n)


def _may_be_similar(least: float) -> Column:
    """False only for pairs (columns ``_a`` and ``_b``) below ``least``.

    For weights x, y with totals X, Y, of which Xo and Yo are on shingles that the other lacks, a
    common shingle adds 1 / sum_e max(x_e / x, y_e / y) <= 1 / (X / x + Yo / y). That is concave
    and homogeneous in (x, y), so all of them add at most 1 / (X / (X - Xo) + Yo / (Y - Yo)).
    Every bit of one bitmap that the other lacks is such a shingle, with a weight of at least 1.
    Texts that may have filled their bitmap must be alike in their registers as well.
    """
    words = range(BITMAP_BITS // 64)

    def only(one: str, other: str) -> Column:
        bits = [F.bit_count(F.get(f"bitmap_{one}", F.lit(k)).bitwiseAND(F.bitwise_not(F.get(f"bitmap_{other}", F.lit(k))))) for k in words]
        return sum(bits[1:], bits[0]).cast("double")

    x, y = F.col("weight_a").cast("double"), F.col("weight_b").cast("double")
    rest_x, rest_y = x - only("a", "b"), y - only("b", "a")
    bounded = x * rest_y + (y - rest_y) * rest_x <= (1 / max(least, 1e-9) + 1e-9) * rest_x * rest_y
    light = F.least("weight_a", "weight_b") <= BITMAP_BITS
    return bounded & (light | (_differ(F.col("bits_a"), F.col("bits_b")) <= MOST_DIFFERENT))


def _open_pairs(members: DataFrame, labels: DataFrame, signs: DataFrame, above: int, upto: int, least: float) -> DataFrame | None:
    """Pairs of one bucket, not in one component yet, that may be similar and of which more than
    ``above`` and at most ``upto`` marks (one bit of each register) differ; None if every bucket
    is within one component.

    All members of a bucket against those outside its largest component. A pair comes from
    the least bucket that it shares, so no pair comes twice and none is looked for again.
    """
    own = written(members.join(labels, "node").select("key", "node", "label"), "labelled-members")
    mixed = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    rest = written(own.join(mixed, "key", "left_semi"), "open-members")
    if rest.isEmpty():
        return None
    sizes = rest.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("large"))
    sized = written(rest.join(sizes, "key").join(signs, "node"), "sized-members")
    # A few single columns are compared first, in compiled code; the rest of the condition is
    # only worked out for pairs that pass.
    sized = sized.withColumns({f"m{k}": F.get("marks", F.lit(k)) for k in range(WORDS_OF_MARKS)})
    carried = ("node", "label", "bits", "keys", "bitmap", "weight", *(f"m{k}" for k in range(WORDS_OF_MARKS)))
    left = sized.filter("label <> large").select("key", *[F.col(c).alias(f"{c}_a") for c in carried])
    right = sized.select("key", "large", *[F.col(c).alias(f"{c}_b") for c in carried])
    once = (F.col("label_b") == F.col("large")) | (F.col("node_a") < F.col("node_b"))
    marked = sum((F.bit_count(F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b"))) for k in range(WORDS_OF_MARKS)), F.lit(0))
    least_shared = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("l.key")
    apart = (F.col("label_a") != F.col("label_b")) & once & marked.between(above + 1, upto) & _may_be_similar(least) & least_shared
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & apart)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _pivots(members: DataFrame) -> DataFrame:
    """(key, pivot): of each bucket the member that meets most others in all its buckets. The text
    that copies were made from shares more bands with them than they share with each other."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    met = written(members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("met")), "met-texts")
    return members.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("pivot"))


def _merged_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after joining the components that ``edges`` connect."""
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = edges.join(left, "a").join(right, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    found = components(between).select(F.col("node").alias("label"), F.col("label").alias("higher"))
    return written(labels.join(found, "label", "left").select("node", F.coalesce("higher", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copies, node, class_key): class_id is the least doc_id of all documents
    that similar pairs connect, copies the number of documents with the same text. class_key
    names the class (its least text's digest, in hex); class_id does not where ids repeat or
    are null.

    Similar: probability Jaccard of counted five-word shingles of at least ``least`` (equal
    texts always). Null text: empty; texts without words are similar to equal texts only.
    A text with fewer than five words is one shingle. Each row gets one row; null ids are in
    classes too but name one only if it has no other id; extra columns are not read.
    """
    signed = written(signed_documents(docs), "signatures")
    banded = signed.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key")
    members = written(banded.join(written(shared, "shared-bands"), "key", "left_semi").distinct(), "band-members")
    nodes = written(members.select("node").distinct(), "candidate-nodes")
    few = nodes.count() <= BROADCAST_ROWS
    chosen = F.broadcast(nodes) if few else nodes
    texts = texts_of(docs).select(digest(F.col("text")).alias("node"), "text").join(chosen, "node", "left_semi").dropDuplicates(["node"])
    shingled = written(_shingled(texts), "candidate-shingles")
    signs = signed.join(chosen, "node", "left_semi").select("node", "bits", "marks", "keys").dropDuplicates(["node"])
    signs = written(signs.join(shingled.select("node", "bitmap", "weight"), "node"), "candidate-signs")
    shingled = shingled.select("node", "names", "counts")
    labels = nodes.withColumn("label", F.col("node"))
    # First every member against its bucket's pivot, which joins most of a large group.
    pivots = written(_pivots(members), "pivots")
    to_pivot = members.join(pivots, "key").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    sides = ("node", "bits", "bitmap", "weight")
    left, right = (signs.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in sides[1:]]) for x in ("a", "b"))
    to_pivot = to_pivot.join(left, "a").join(right, "b").filter(_may_be_similar(least))
    edges = written(_similar(to_pivot.select("a", "b"), shingled, least), "similar-pairs")
    labels = _merged_labels(labels, edges)
    # Then all that is still apart, most alike first: what joins early is not compared later.
    above = -1
    for upto in STEPS:
        pairs = _open_pairs(members, labels, signs, above, upto, least)
        if pairs is None:
            break
        pairs, above = written(pairs, "open-pairs"), upto
        if pairs.isEmpty():
            continue
        edges = written(_similar(pairs, shingled, least), "similar-pairs")
        if not edges.isEmpty():
            labels = _merged_labels(labels, edges)
    texts_of_class = signed.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    placed = written(texts_of_class.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed-texts")
    classes = placed.groupBy("label").agg(F.min("least_id").alias("class_id"))
    of_text = written(placed.join(written(classes, "classes"), "label").select("node", "class_id", "copies", F.lower(F.hex("label")).alias("class_key")), "text-classes")
    return signed.select("doc_id", "node").join(of_text, "node").select("doc_id", "class_id", "copies", "node", "class_key")


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one with the least id (of rows that
    repeat this id too, one with the least text digest). All columns stay as they are."""
    found = near_duplicates(docs, least)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key", "doc_id").agg(F.min("node").alias("kept"), F.count("*").alias("n"))
    kept = written(kept.select("doc_id", "kept", "n"), "kept-ids")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    rows = rows.withColumns({"id": F.col("row.doc_id"), "node": digest(F.coalesce("row.text", F.lit("")))})
    joined = rows.join(kept, rows["id"].eqNullSafe(kept["doc_id"]) & (F.col("node") == F.col("kept")))
    if not kept.filter("n > 1").isEmpty():
        joined = joined.dropDuplicates(["id", "node"])
    return joined.select("row.*")
