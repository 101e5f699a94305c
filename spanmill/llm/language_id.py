"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of
labelled documents. It labels every byte position; a document's probabilities are the mean
over all its positions. Texts are read in stretches of ``WINDOW`` bytes, each from a zero
state in both directions, so long texts cost no more per byte than short ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import map_arrow, text_bytes

WINDOW = 128
#: Bounds of the training sample: documents per language, and characters of each.
DOCS_PER_LANGUAGE, CHARS_PER_DOC = 300, 1024
STEPS, BATCH, TRAIN_WINDOW, RATE = 260, 128, 64, 0.02
HIDDEN, EMBEDDED = 8, 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Per direction d: ``embed[d]`` (E, 256) and ``gates[d]`` (4H, E + H + 1) with the rows
    of update gate, reset gate, state part and input part of the candidate; ``out`` (L, 2H),
    ``bias`` (L, 1). Column order of ``gates``: embedded byte, state, constant."""

    languages: list[str]
    embed: np.ndarray
    gates: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.gates, self.out, self.bias]


def _gate_mask(hidden: int, embedded: int) -> np.ndarray:
    """1 where ``gates`` has weights: the state part sees no byte, the input part no state."""
    mask = np.ones((4 * hidden, embedded + hidden + 1), np.float32)
    mask[2 * hidden : 3 * hidden, :embedded] = 0
    mask[3 * hidden :, embedded : embedded + hidden] = 0
    return mask


def new_network(languages: list[str], seed: int = 5, hidden: int = HIDDEN, embedded: int = EMBEDDED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    gates = draw(2, 4 * hidden, embedded + hidden + 1, scale=0.35) * _gate_mask(hidden, embedded)
    return Network(languages, draw(2, embedded, 256, scale=0.7), gates, draw(len(languages), 2 * hidden, scale=0.3), np.zeros((len(languages), 1), np.float32))


def _forward(net: Network, d: int, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, H, B) of direction ``d`` over ``codes`` (T, B), and what BPTT needs."""
    hidden = net.gates.shape[1] // 4
    embedded = net.embed.shape[1]
    x = np.ones((embedded + hidden + 1, codes.shape[1]), np.float32)
    h = np.zeros((hidden, codes.shape[1]), np.float32)
    states, kept = np.empty((len(codes), hidden, codes.shape[1]), np.float32), []
    for t, row in enumerate(codes):
        x = x.copy()
        x[:embedded] = net.embed[d][:, row]
        x[embedded : embedded + hidden] = h
        g = net.gates[d] @ x
        zr = 0.5 * np.tanh(0.5 * g[: 2 * hidden]) + 0.5
        z, r = zr[:hidden], zr[hidden:]
        n = np.tanh(g[3 * hidden :] + r * g[2 * hidden : 3 * hidden])
        h = n + z * (h - n)
        states[t] = h
        kept.append((x, z, r, n, g[2 * hidden : 3 * hidden]))
    return states, kept


def _backward(net: Network, d: int, codes: np.ndarray, kept: list, d_states: np.ndarray, d_embed: np.ndarray, d_gates: np.ndarray) -> None:
    hidden = net.gates.shape[1] // 4
    embedded = net.embed.shape[1]
    dh = np.zeros_like(d_states[0])
    for t in range(len(codes) - 1, -1, -1):
        x, z, r, n, u = kept[t]
        before = x[embedded : embedded + hidden]
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - n * n)
        g = np.concatenate([dh * (before - n) * z * (1 - z), dn * u * r * (1 - r), dn * r, dn])
        d_gates[d] += g @ x.T
        dx = net.gates[d].T @ g
        np.add.at(d_embed[d].T, codes[t], dx[:embedded].T)
        dh = dx[embedded : embedded + hidden] + dh * z


def loss_and_gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of ``codes`` (T, B), and its gradients."""
    hidden = net.gates.shape[1] // 4
    ahead, kept_a = _forward(net, 0, codes)
    back, kept_b = _forward(net, 1, codes[::-1])
    both = np.concatenate([ahead, back[::-1]], axis=1)
    logits = net.out @ both + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    count = codes.size
    at = np.arange(codes.shape[1])
    loss = float(-np.log(np.maximum(p[:, labels, at], 1e-9)).sum() / count)
    p[:, labels, at] -= 1
    p /= count
    d_out = np.einsum("tlb,thb->lh", p, both)
    d_bias = p.sum(axis=(0, 2))[:, None]
    d_both = net.out.T @ p
    d_embed, d_gates = np.zeros_like(net.embed), np.zeros_like(net.gates)
    _backward(net, 0, codes, kept_a, d_both[:, :hidden], d_embed, d_gates)
    _backward(net, 1, codes[::-1], kept_b, d_both[::-1, hidden:], d_embed, d_gates)
    return loss, [d_embed, d_gates * _gate_mask(hidden, net.embed.shape[1]), d_out, d_bias]


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 5) -> Network:
    """Fit on (language, text); every language gets the same share of each batch."""
    languages = sorted({lang for lang, _ in samples})
    net = new_network(languages, seed)
    if len(languages) < 2:
        return net
    pools = []
    for lang in languages:
        raw = np.frombuffer("\n".join(t for own, t in samples if own == lang).encode(), np.uint8)
        pools.append(np.pad(raw, (0, max(0, TRAIN_WINDOW + 1 - len(raw))), constant_values=10))
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    # More languages than places in a batch take turns, and the steps grow with their number.
    turns = -(-len(languages) // BATCH)
    steps *= turns
    for step in range(1, steps + 1):
        labels = (np.arange(BATCH) + (step - 1) % turns * BATCH) % len(languages)
        begin = [int(rng.integers(len(pools[k]) - TRAIN_WINDOW)) for k in labels]
        codes = np.stack([pools[k][b : b + TRAIN_WINDOW] for k, b in zip(labels, begin)], axis=1)
        gradients = loss_and_gradients(net, codes, labels)[1]
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), gradients, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _direction_logits(net: Network, d: int, raw: np.ndarray, at: np.ndarray, stride: int, active: list[int]) -> np.ndarray:
    """Logits (T, L, B) of one direction; step t reads ``raw[at + t * stride]`` of the first
    ``active[t]`` lanes."""
    hidden = net.gates.shape[1] // 4
    embedded = net.embed.shape[1]
    n_out = len(net.out)
    own = np.ascontiguousarray(net.out[:, d * hidden : (d + 1) * hidden])
    half = net.gates[d].copy()
    half[: 2 * hidden] *= 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
    logits = np.zeros((len(active), n_out, len(at)), np.float32)
    lanes = len(at)
    x = np.ones((embedded + hidden + 1, lanes), np.float32)
    x[embedded : embedded + hidden] = 0
    g = np.empty((4 * hidden, lanes), np.float32)
    for t, n in enumerate(active):
        if n < lanes:
            x, g, lanes = np.ascontiguousarray(x[:, :n]), np.empty((4 * hidden, n), np.float32), n
        np.take(net.embed[d], raw[at[:n] + t * stride], axis=1, out=x[:embedded], mode="clip")
        np.matmul(half, x, out=g)
        zr = g[: 2 * hidden]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        cand = g[2 * hidden : 3 * hidden]
        cand *= zr[hidden:]
        cand += g[3 * hidden :]
        np.tanh(cand, out=cand)
        h = x[embedded : embedded + hidden]
        h -= cand
        h *= zr[:hidden]
        h += cand
        logits[t, :, :n] = own @ h
    return logits


def document_probabilities(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, L): mean over all byte positions; empty texts get equal shares."""
    n_docs, n_out = len(offsets) - 1, len(net.languages)
    sums = np.zeros((n_docs, n_out))
    size = np.diff(offsets)
    n_windows = -(-size // WINDOW)
    doc = np.repeat(np.arange(n_docs), n_windows)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    begin = offsets[:-1][doc] + k * WINDOW
    length = np.minimum(WINDOW, offsets[1:][doc] - begin)
    order = np.argsort(-length, kind="stable")
    for low in range(0, len(order), 4096):
        lanes = order[low : low + 4096]
        own, at = length[lanes], begin[lanes]
        active = np.searchsorted(-own, -np.arange(1, own[0] + 1), side="right").tolist()
        logits = _direction_logits(net, 0, raw, at, 1, active)
        back = _direction_logits(net, 1, raw, at + own - 1, -1, active)
        full = active[-1] if own[0] == WINDOW else 0
        logits[:, :, :full] += back[::-1, :, :full] if len(active) == WINDOW else 0
        if full < len(lanes):
            turned = np.maximum(own[full:] - 1 - np.arange(len(active))[:, None], 0)
            logits[:, :, full:] += np.take_along_axis(back[:, :, full:], turned[:, None, :], axis=0)
        logits += net.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        for t in range(active[-1] and len(active), 0, -1):
            if active[t - 1] == len(lanes):
                break
            logits[t - 1, :, active[t - 1] :] = 0
        np.add.at(sums, doc[lanes], logits.sum(axis=0).T)
    return np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], 1 / max(n_out, 1))


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> Network:
    """Train on at most DOCS_PER_LANGUAGE labelled documents of each language that are not
    held out, and on one stretch of CHARS_PER_DOC characters of each: what reaches the driver
    is bounded by the number of languages."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out()).select(
        "doc_id", "lang", F.xxhash64("doc_id").alias("draw")
    )
    # The smallest draws of a language: rows above a mark that leaves some more than are wanted
    # do not travel, so no task gathers a language. The counts are one row per language.
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    wanted = DOCS_PER_LANGUAGE + 10 * DOCS_PER_LANGUAGE**0.5
    marks = [F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, wanted / n))]
    drawn = F.col("draw") / float(1 << 64) + 0.5
    if marks:
        labelled = labelled.filter(drawn <= F.element_at(F.create_map(*marks), F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = labelled.withColumn("k", rank).filter(F.col("k") <= DOCS_PER_LANGUAGE).select("doc_id", "lang", "draw").distinct()
    place = F.pmod(F.col("draw"), F.greatest(F.lit(1), F.length("text") - CHARS_PER_DOC)) + 1
    rows = (
        docs.select("doc_id", "text").filter(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")
        .select("lang", "doc_id", F.col("text").substr(place.cast("int"), F.lit(CHARS_PER_DOC)).alias("text"))
        .collect()
    )
    return train([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text))])


PREDICTED = "doc_id long, lang_pred string, score double"


def _predict(net: Network, batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    column = batch.column("text")
    if not net.languages:
        return pa.array([UNKNOWN] * len(column), pa.string()), pa.array([0.0] * len(column), pa.float64())
    raw, offsets = text_bytes(column.fill_null(""))
    p = document_probabilities(net, raw, offsets)
    best = p.argmax(axis=1)
    names, scores = [], []
    for r, text in enumerate(column.to_pylist()):
        if text is None or not _LETTER.search(text):
            names.append(UNKNOWN)
            scores.append(0.0)
        else:
            names.append(net.languages[best[r]])
            scores.append(float(p[r, best[r]]))
    return pa.array(names, pa.string()), pa.array(scores, pa.float64())


def predict_languages(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    ``und`` with score 0 for null texts, texts without a letter, and if nothing was labelled;
    with one learned language all others are that language. Each row gets one row, equal or
    null ids too (a null id is not held out); only doc_id, text and, for training, lang are
    read. Empty input: no rows.
    """
    net = net or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                names, scores = _predict(shared.value, batch)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores})

    predicted = map_arrow(docs.select("doc_id", "text"), work, PREDICTED)
    return predicted.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, least_score: float | None = None, net: Network | None = None) -> DataFrame:
    """``docs`` without those whose language cannot be told: null texts, texts without a letter,
    or a score below ``least_score`` (default: 1.2 times the score of a guess among the learned
    languages, at most 0.5). If no language was learned, every text with a letter stays. All
    columns and their values stay."""
    net = net or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    least = min(0.5, 1.2 / max(1, len(net.languages))) if least_score is None else least_score

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                if shared.value.languages:
                    names, scores = _predict(shared.value, batch)
                    keep = [n != UNKNOWN and s >= least for n, s in zip(names.to_pylist(), scores.to_pylist())]
                else:
                    keep = [t is not None and bool(_LETTER.search(t)) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, work, docs.schema)
