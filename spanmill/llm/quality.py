"""Document quality by co-training of a text view and a page-metadata view.

Two logistic classifiers see different features: hashed byte pairs of the text, and facts
about the page (language, source, length, layout). In every round each is fitted to the
labels and to what the other was confident about in the round before. Both are calibrated on
a fold of labels that neither saw, and a third fit combines the calibrated views. All fits
are Newton steps over the whole table: tasks send sums, whose size does not grow with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import map_arrow, text_bytes, texts_of
from spanmill.session import written

PAIR_BUCKETS, LANGUAGE_BUCKETS, SOURCE_BUCKETS = 128, 8, 32
SHORT_TEXT = 64.0
N_TEXT = PAIR_BUCKETS + 6
ROUNDS, STEPS, CONFIDENT, RIDGE = 3, 4, 0.95, 1.0
#: Folds by crc32 of the id: one calibrates, one is never used, the rest trains.
FOLDS, CALIBRATION_FOLD, HELD_OUT_FOLD = 5, 0, 1
_REDUCERS = 16


def _pair_buckets() -> np.ndarray:
    pairs = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((pairs >> np.uint64(40)) % np.uint64(PAIR_BUCKETS)).astype(np.int64)


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def text_view(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, N_TEXT): square roots of the shares of hashed byte pairs, how uneven they are
    (repetition), and 1. Shares of short texts are held back towards 0."""
    n = len(offsets) - 1
    out = np.ones((n, N_TEXT), np.float32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.zeros(n * PAIR_BUCKETS)
    if len(raw) > 1:
        pairs = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        inside = doc[:-1] == doc[1:]
        slot = doc[:-1] * PAIR_BUCKETS + _pair_buckets()[pairs]
        counts = np.bincount(slot[inside], minlength=n * PAIR_BUCKETS)
    counts = counts.reshape(n, PAIR_BUCKETS)
    total = counts.sum(axis=1, keepdims=True)
    shares = counts / (total + SHORT_TEXT)
    out[:, :PAIR_BUCKETS] = 4 * np.sqrt(shares)
    out[:, PAIR_BUCKETS] = -(shares * np.log(np.maximum(shares, 1e-12))).sum(axis=1) / 2
    out[:, PAIR_BUCKETS + 1] = np.log1p(np.sort(counts, axis=1)[:, -8:].sum(axis=1)) / 4
    out[:, PAIR_BUCKETS + 2] = (counts > 0).sum(axis=1) / np.maximum(np.minimum(total[:, 0], PAIR_BUCKETS), 1)
    out[:, PAIR_BUCKETS + 3] = np.log1p(total[:, 0]) / 4
    out[:, PAIR_BUCKETS + 4] = total[:, 0] / (total[:, 0] + SHORT_TEXT)
    return out


def page_view(raw: np.ndarray, offsets: np.ndarray, lang: list, source: list) -> np.ndarray:
    """(texts, features): length, lines and shares of character kinds; hashed language and
    source (null: none); and 1."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)

    def count(members: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(members)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

    lines = count(raw == 10) + 1
    shares = [count(m) / (size + SHORT_TEXT) for m in ((raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57), _PUNCTUATION[raw], raw == 32, raw >= 128)]
    dense = np.stack([np.log1p(size) / 4, np.log(lines) / 2, np.log1p(size / lines) / 4, *[4 * np.sqrt(s) for s in shares], *[10 * s for s in shares]], axis=1)
    named = np.zeros((n, LANGUAGE_BUCKETS + SOURCE_BUCKETS), np.float32)
    for r in range(n):
        if lang[r] is not None:
            named[r, zlib.crc32(lang[r].encode()) % LANGUAGE_BUCKETS] = 1
        if source[r] is not None:
            named[r, LANGUAGE_BUCKETS + zlib.crc32(source[r].encode()) % SOURCE_BUCKETS] = 1
    return np.concatenate([dense, named, np.ones((n, 1))], axis=1).astype(np.float32)


N_PAGE = 13 + LANGUAGE_BUCKETS + SOURCE_BUCKETS + 1


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, text_view, page_view) of every whole text, as 32-bit floats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                raw, offsets = text_bytes(batch.column("text"))
                page = page_view(raw, offsets, batch.column("lang").to_pylist(), batch.column("source").to_pylist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "text_view": pa.array([x.tobytes() for x in text_view(raw, offsets)], pa.binary()),
                        "page_view": pa.array([x.tobytes() for x in page], pa.binary()),
                    }
                )

    rows = texts_of(docs, F.col("lang").cast("string"), F.col("source").cast("string"))
    found = map_arrow(rows, work, "doc_id long, text_view binary, page_view binary")
    return found.withColumn("fold", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(-1)).cast("int"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


Design = Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def newton_step(table: DataFrame, design: Design, thetas: list[np.ndarray], ridge: float) -> list[np.ndarray]:
    """One Newton step of each logistic model. ``design`` gives (rows, labels, weights) per
    model. Each task sends one row of sums, and a few tasks add those up before the driver."""
    sizes = [len(t) for t in thetas]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((n, n + 1)) for n in sizes]
        for batch in batches:
            for k, (x, y, w) in enumerate(design(batch)):
                p = _sigmoid(x @ thetas[k])
                total[k][:, 0] += x.T @ (w * (y - p))
                total[k][:, 1:] += x.T @ (x * (w * p * (1 - p))[:, None])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.concatenate([t.ravel() for t in total]).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for row in batch.column("sums"):
                total = total + np.frombuffer(row.as_py())
        if not isinstance(total, int):
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    rows = map_arrow(map_arrow(table, sums, "sums binary").repartition(_REDUCERS), add, "sums binary").collect()
    flat = sum((np.frombuffer(r.sums) for r in rows), np.zeros(sum(n * (n + 1) for n in sizes)))
    out, at = [], 0
    for n, theta in zip(sizes, thetas):
        block = flat[at : at + n * (n + 1)].reshape(n, n + 1)
        at += n * (n + 1)
        penalty = np.full(n, ridge)
        penalty[-1] = 1e-3  # the constant is not held back
        step = np.linalg.solve(block[:, 1:] + np.diag(penalty), block[:, 0] - penalty * theta)
        out.append(theta + step * min(1.0, 8.0 / max(1e-9, float(np.abs(step).max()))))
    return out


def _train(table: DataFrame, rounds: int, steps: int, pseudo_weight: float) -> list[np.ndarray]:
    thetas = [np.zeros(N_TEXT), np.zeros(N_PAGE)]
    for k in range(rounds):
        teachers = [t.copy() for t in thetas] if k else None
        for _ in range(steps):

            def design(batch: pa.RecordBatch, teachers=teachers):
                views = [_matrix(batch.column("text_view"), N_TEXT), _matrix(batch.column("page_view"), N_PAGE)]
                label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                known = ~np.isnan(label)
                out = []
                for own in (0, 1):
                    y, w = np.where(known, label, 0.0), known.astype(np.float64)
                    if teachers is not None:  # what the other view is sure of
                        p = _sigmoid(views[1 - own] @ teachers[1 - own])
                        sure = ~known & (np.maximum(p, 1 - p) >= CONFIDENT)
                        y[sure], w[sure] = (p[sure] >= 0.5).astype(np.float64), pseudo_weight
                    out.append((views[own], y, w))
                return out

            thetas = newton_step(table, design, thetas, RIDGE)
    return thetas


def _calibrate(fold: DataFrame, thetas: list[np.ndarray], steps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Slope and offset for the log-odds of each view, then weights that combine both."""

    def odds(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [_matrix(batch.column("text_view"), N_TEXT) @ thetas[0], _matrix(batch.column("page_view"), N_PAGE) @ thetas[1]]

    def each(batch: pa.RecordBatch):
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        return [(np.stack([s, np.ones(len(s))], axis=1), y, np.ones(len(y))) for s in odds(batch)]

    scales = [np.array([1.0, 0.0]), np.array([1.0, 0.0])]
    for _ in range(steps):
        scales = newton_step(fold, each, scales, 0.01)

    def joint(batch: pa.RecordBatch):
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        x = np.stack([*[s * a + b for s, (a, b) in zip(odds(batch), scales)], np.ones(len(y))], axis=1)
        return [(x, y, np.ones(len(y)))]

    weights = [np.array([0.5, 0.5, 0.0])]
    for _ in range(steps):
        weights = newton_step(fold, joint, weights, 0.01)
    return scales, weights[0]


SCORED = "doc_id long, text_score double, page_score double, score double"


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, steps: int = STEPS, threshold: float = 0.35) -> DataFrame:
    """(doc_id, held_out, text_score, page_score, score, keep) of every document; scores are
    calibrated probabilities of quality 1, keep means a score of at least ``threshold``.

    ``labels`` has doc_id and quality (0 or 1); several labels of an id count as their
    majority (a tie as 1), null ids and labels are not used. Documents of the held-out fold
    are never labelled. Null text: empty. Without labels every score is 0.5. Each row gets one
    row, equal or null ids too; other columns are not read.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled_id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    table = features(docs)
    table = table.join(known, table["doc_id"] == known["labelled_id"], "left").drop("labelled_id")
    table = written(table.withColumn("label", F.when(F.col("fold") != HELD_OUT_FOLD, F.col("label"))), "quality-features")
    training = table.filter(F.col("label").isNull() | (F.col("fold") != CALIBRATION_FOLD))
    counts = training.agg(F.count("label").alias("labelled"), F.count("*").alias("all")).first()
    thetas = [np.zeros(N_TEXT), np.zeros(N_PAGE)]
    scales, weights = [np.array([1.0, 0.0])] * 2, np.array([0.5, 0.5, 0.0])
    if counts["labelled"]:
        thetas = _train(training, rounds, steps, counts["labelled"] / max(1, counts["all"] - counts["labelled"]))
        fold = table.filter(F.col("label").isNotNull() & (F.col("fold") == CALIBRATION_FOLD))
        if not fold.isEmpty():
            scales, weights = _calibrate(fold, thetas, steps)
    shared = spark.sparkContext.broadcast((thetas, scales, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thetas, scales, weights = shared.value
        for batch in batches:
            views = [_matrix(batch.column("text_view"), N_TEXT), _matrix(batch.column("page_view"), N_PAGE)]
            odds = [(v @ t) * a + b for v, t, (a, b) in zip(views, thetas, scales)]
            both = odds[0] * weights[0] + odds[1] * weights[1] + weights[2]
            out = [pa.array(_sigmoid(x), pa.float64()) for x in (*odds, both)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], names=["doc_id", "text_score", "page_score", "score"])

    scored = map_arrow(table.select("doc_id", "text_view", "page_view"), score, SCORED)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= threshold).alias("keep"))
