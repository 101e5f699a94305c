"""Exact SentencePiece BPE: encoding by backtracking over longest matches, and decoding.

A sequence of pieces is the library's encoding if and only if every two neighbours are
compatible, that is, merging their characters again gives the two pieces back. So a text is
read from left to right with the longest piece at each place; where it is not compatible
with the piece before, the next shorter piece is tried, then the piece before is taken back.
A bit field holds places from which no encoding can go on, so none is tried twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanmill.llm.common import file_bytes, map_arrow, texts_of

SPACE = "▁"
#: Units kept by a worker between batches.
KEPT_UNITS = 500_000
_ODD = f"^ | $|  |{SPACE}"
_NEVER = 1 << 60


class PieceCoder:
    """Units are stretches of text from one space mark to the next; no piece has a mark
    behind another character, so no merge crosses from one unit to the next."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        special = [library.is_byte(i) or library.is_control(i) or library.is_unknown(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if library.is_byte(i)}
        self.end_id = library.eos_id()
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces that cross words need another way of cutting texts")
        self.score = {p: library.get_score(i) for p, i in self.id_of.items()}
        self.length = [len(p) for p in self.pieces]
        scores = sorted({s for p, s in self.score.items() if len(p) > 1}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        #: Time at which a merge makes the piece; single characters are there before.
        self.made = [order[self.score[p]] if p in self.score and len(p) > 1 else -1 for p in self.pieces]
        self.joins: dict[int, int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.shorter = [-1] * size
        #: Pieces whose parts are not made before them: pairs with them are merged again in full.
        self.plainly = [True] * size
        for p, i in self.id_of.items():
            for k in range(len(p) - 1, 0, -1):
                if self.shorter[i] < 0 and p[:k] in self.id_of:
                    self.shorter[i] = self.id_of[p[:k]]
                if p[:k] in self.id_of and p[k:] in self.id_of:
                    self.joins[self.id_of[p[:k]] << 20 | self.id_of[p[k:]]] = self.made[i]
        for p, i in self.id_of.items():
            if len(p) > 1:
                last = self._merge(p)[1]
                self.parts[i] = last
                self.plainly[i] = last is not None and max(self.made[last[0]], self.made[last[1]]) < self.made[i] and SPACE * 2 not in p
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (i, len(p) - 1))
        self.automaton.make_automaton()
        self.byte_values = {i: b for b, i in self.byte_ids.items()}
        self.surface = [None if special[i] else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.units = pa.array([], pa.large_string())
        self.counts = np.zeros(0, np.int64)
        self.id_texts = self.decoded = pa.array([], pa.large_string())

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Pieces after all merges, best first and then leftmost; and the last merge."""
        parts, last = [*text], None
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return [self.id_of[p] for p in parts], last
            last = self.id_of[parts[at]], self.id_of[parts[at + 1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Do the characters of both merge to just these two pieces? The merges of both are
        taken back, latest first; no merge across the border may come before the next merge
        on either side (of equal ones the leftmost comes first)."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is not None:
            return known
        if not (self.plainly[left] or self.parts[left] is None) or not (self.plainly[right] or self.parts[right] is None) or self.pieces[right][0] == SPACE:
            fit = self._merge(self.pieces[left] + self.pieces[right])[0] == [left, right]
        else:
            made, joins, parts = self.made, self.joins, self.parts
            a, b, next_a, next_b, fit = left, right, _NEVER, _NEVER, True
            while True:
                across = joins.get(a << 20 | b)
                if across is not None and across < next_a and across <= next_b:
                    fit = False
                    break
                if made[a] > made[b]:
                    next_a = made[a]
                    a = parts[a][1]
                elif made[b] >= 0:
                    next_b = made[b]
                    b = parts[b][0]
                else:
                    break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = fit
        return fit

    def _backtrack(self, longest: list[int], begin: int, end: int) -> list[int]:
        """Ids of the characters from ``begin`` to ``end``; ``longest`` is -1 at unknown ones."""
        length, shorter, fits, compatible = self.length, self.shorter, self.fits, self.compatible
        tokens: list[int] = []
        failed = 0
        at, token = begin, longest[begin]
        while at < end:
            after = at + length[token]
            if not failed >> (after - begin) & 1:
                if not tokens:
                    fit = True
                else:
                    fit = fits.get(tokens[-1] << 20 | token)
                    if fit is None:
                        fit = compatible(tokens[-1], token)
                if fit:
                    tokens.append(token)
                    at = after
                    if at < end:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:
                failed |= 1 << (at - begin)
                token = tokens.pop()
                at -= length[token]
                token = shorter[token]
        return tokens

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit with its leading space mark."""
        text = "".join([SPACE + u + "\0" for u in units])  # no piece has the separator
        longest = [-1] * len(text)
        for last, (token, back) in self.automaton.iter(text):
            longest[last - back] = token  # of the matches from one place the longest comes last
        out, at = [], 0
        for unit in units:
            end = at + 1 + len(unit)
            if min(longest[at:end]) >= 0:
                out.append(self._backtrack(longest, at, end))
                at = end + 1
                continue
            ids: list[int] = []
            while at < end:
                stop = at
                while stop < end and longest[stop] >= 0:
                    stop += 1
                if stop > at:
                    ids += self._backtrack(longest, at, stop)
                if stop < end:
                    ids += [self.byte_ids[b] for b in text[stop].encode()]
                    stop += 1
                at = stop
            out.append(ids)
            at = end + 1
        return out

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of ids before the first space is taken off; byte pieces as UTF-8."""
        try:
            return "".join([self.surface[i] for i in ids])
        except TypeError:
            pass
        out = bytearray()
        for i in ids:
            if i in self.byte_values:
                out.append(self.byte_values[i])
            elif i != self.end_id:
                out += self.surface[i].encode()
        return out.decode("utf-8", "replace")

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of all texts without their first mark, and offsets of the texts."""
        lists = pc.split_pattern(texts, " ")
        flat, bounds = lists.flatten(), np.asarray(lists.offsets)
        bounds = bounds - bounds[0]
        odd = np.flatnonzero(pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(texts, "")).to_numpy(zero_copy_only=False))
        if not len(odd):
            return flat, bounds
        pieces, lengths, done = [], np.diff(bounds), 0
        for r in odd.tolist():
            text = texts[r].as_py()
            own = [u[1:] for u in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))] if text else []
            pieces += [flat.slice(bounds[done], bounds[r] - bounds[done]), pa.array(own, pa.large_string())]
            lengths[r] = len(own)
            done = r + 1
        pieces.append(flat.slice(bounds[done]))
        return pa.concat_arrays(pieces), np.concatenate([[0], np.cumsum(lengths)])

    def code(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Per text: number of ids, ids as text, decoded text (no end id)."""
        flat, bounds = self._cut(texts.cast(pa.large_string()))
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        slot = pc.fill_null(pc.index_in(distinct, value_set=self.units), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(slot < 0)
        new = distinct.take(pa.array(unknown))
        counts, id_texts, decoded = [], [], []
        for at in range(0, len(new), 20_000):
            for ids in self.encode_units(new.slice(at, 20_000).to_pylist()):
                counts.append(len(ids))
                id_texts.append(" ".join(map(str, ids)))
                decoded.append(self.decode_pieces(ids))
        if len(self.units) + len(new) > KEPT_UNITS:
            known = np.flatnonzero(slot >= 0)
            kept = pa.array(slot[known])
            self.units = distinct.take(pa.array(known))
            self.counts, self.id_texts, self.decoded = self.counts[slot[known]], self.id_texts.take(kept), self.decoded.take(kept)
            slot[known] = np.arange(len(known))
        slot[unknown] = len(self.units) + np.arange(len(new))
        self.units = pa.concat_arrays([self.units, new])
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])
        self.id_texts = pa.concat_arrays([self.id_texts, pa.array(id_texts, pa.large_string())])
        self.decoded = pa.concat_arrays([self.decoded, pa.array(decoded, pa.large_string())])
        rows = slot[coded.indices.to_numpy(zero_copy_only=False)]
        totals = np.concatenate([[0], np.cumsum(self.counts[rows])])
        take, offsets = pa.array(rows), pa.array(bounds, pa.int64())
        id_lists = pa.LargeListArray.from_arrays(offsets, self.id_texts.take(take))
        text_lists = pa.LargeListArray.from_arrays(offsets, self.decoded.take(take))
        # The mark before the first word is not part of the text.
        decoded_texts = pc.utf8_slice_codeunits(pc.binary_join(text_lists, pa.scalar("", pa.large_string())), 1)
        return totals[bounds[1:]] - totals[bounds[:-1]], pc.binary_join(id_lists, pa.scalar(" ", pa.large_string())), decoded_texts


_CODERS: dict[bytes, PieceCoder] = {}


def piece_coder(model: bytes) -> PieceCoder:
    """One coder for each worker process."""
    if model not in _CODERS:
        _CODERS[model] = PieceCoder(model)
    return _CODERS[model]


CODED = "doc_id long, n_tokens long, ids string, decoded string"


def piece_codes(docs: DataFrame, model: str) -> DataFrame:
    """Ids of every whole text (decimal, one space between, end id last) and the text that
    these ids decode to. Null text: empty, so only the end id and empty text. Each row gets
    one row, equal or null ids too; extra columns are not read."""
    return _coded(docs, model, CODED, lambda n, ids, text: {"n_tokens": n, "ids": ids, "decoded": text})


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """As ``piece_codes``, with the SHA-256 of ids and decoded text in their place."""

    def digest(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(v.as_buffer() or b"").hexdigest() for v in values.cast(pa.large_binary())])

    return _coded(docs, model, DIGESTS, lambda n, ids, text: {"n_tokens": n, "ids_sha256": digest(ids), "decoded_sha256": digest(text)})


def _coded(docs: DataFrame, model: str, schema: str, columns) -> DataFrame:
    proto = file_bytes(docs.sparkSession, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(proto.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                counts, ids, decoded = coder.code(batch.column("text"))
                gap = pa.array(np.where(counts > 0, " ", ""), pa.large_string())
                ids = pc.binary_join_element_wise(ids, pa.array([str(coder.end_id)] * len(counts), pa.large_string()), gap)
                out = columns(pa.array(counts + 1, pa.int64()), ids, decoded)
                out = {k: v.cast(pa.string()) if pa.types.is_large_string(v.type) else v for k, v in out.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out})

    return map_arrow(texts_of(docs), work, schema)
