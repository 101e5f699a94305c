"""Encoding of whole texts with a public tokenizer, each distinct unit only once.

A text is cut at spaces where the tokenizer's own pre-tokenizer always cuts, so the
ids of the text are the ids of its units in order. Within a task the distinct units
of a batch are encoded by the tokenizers library and kept for later batches.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanmill.llm.common import ragged_take

#: Units, and pieces of units, kept by a worker between batches (about 40 bytes each).
KEPT_UNITS = 400_000

# The pre-tokenizers of the two vocabularies over plain characters (ASCII and
# Latin letters, whose classes, case and normal form do not depend on a Unicode version).
_PLAIN = r"^[\t\n\r -~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]*$"
_LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ſ"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_PIECES = re.compile(rf"\0|{_ENDINGS}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9\0]+")
_BYTE_PIECES = re.compile(
    rf"\0|{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9\0]+|\s+(?![^\s\0])|\s+"
)
#: Bytes that byte-level vocabularies write as characters from 256 on, in ascending order.
_SHIFTED = [*range(0, 33), *range(127, 161), 173]
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(_SHIFTED)}


class UnitEncoder:
    """``drops_space``: the tokenizer ignores white space, so any space is a cut."""

    def __init__(self, definition: bytes, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.tokenizer.encode_special_tokens = True
        self.drops_space = drops_space
        self.pieces_of = (_WORD_PIECES if drops_space else _BYTE_PIECES).findall
        self.pieces = pa.array([], pa.large_string())
        self.piece_values = np.zeros(0, np.int32)
        self.piece_offsets = np.zeros(1, np.int64)
        self.units = pa.array([], pa.large_string())
        self.values = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def _encode_new(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units. Those of plain letters are cut here into the pieces of the
        pre-tokenizer, and each distinct piece goes through the library's model once; the
        others go through the whole tokenizer."""
        plain = pc.match_substring_regex(units, _PLAIN).to_numpy(zero_copy_only=False)
        values, counts = [], np.zeros(len(units), np.int64)
        rare = np.flatnonzero(~plain)
        whole = self.tokenizer.encode_batch_fast(units.take(pa.array(rare)).to_pylist(), add_special_tokens=False)
        counts[rare] = [len(e.ids) for e in whole]
        values.append(np.array([i for e in whole for i in e.ids], np.int32))
        common = np.flatnonzero(plain)
        joined = "\0".join(units.take(pa.array(common)).to_pylist())
        found = self.pieces_of(joined.lower() if self.drops_space else joined)
        pieces = pa.array(found, pa.large_string()).dictionary_encode()
        ids, cuts = self._encode_pieces(pieces.dictionary, pieces.indices.to_numpy(zero_copy_only=False))
        ends = np.flatnonzero(np.diff(cuts) == 1)
        ends = ends[ids[cuts[ends]] == -1]  # the mark between two units
        if len(common):
            counts[common] = np.diff(np.concatenate([[-1], cuts[ends], [len(ids)]])) - 1
        values.append(ids[ids >= 0])
        order = np.concatenate([rare, common])
        lengths = np.concatenate([[0], np.cumsum(counts[order])])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ragged_take(np.concatenate(values), lengths, back)

    def _encode_pieces(self, distinct: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = pc.fill_null(pc.index_in(distinct, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(slot < 0)
        new = distinct.take(pa.array(unknown))
        tokenize, ids, counts = self.tokenizer.model.tokenize, [], []
        for piece in new.to_pylist():
            if piece == "\0":
                ids.append(-1)
                counts.append(1)
                continue
            if not piece.isascii() or "\n" in piece or "\t" in piece or "\r" in piece:
                piece = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
            elif not self.drops_space:
                piece = piece.replace(" ", _BYTE_CHARS[32])
            tokens = tokenize(piece)
            ids.extend([t.id for t in tokens])
            counts.append(len(tokens))
        if len(self.pieces) + len(new) > KEPT_UNITS:
            known = np.flatnonzero(slot >= 0)
            self.piece_values, self.piece_offsets = ragged_take(self.piece_values, self.piece_offsets, slot[known])
            self.pieces = distinct.take(pa.array(known))
            slot[known] = np.arange(len(known))
        slot[unknown] = len(self.pieces) + np.arange(len(new))
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.piece_values = np.concatenate([self.piece_values, np.array(ids, np.int32)])
        self.piece_offsets = np.concatenate([self.piece_offsets, self.piece_offsets[-1] + np.cumsum(np.array(counts, np.int64))])
        return ragged_take(self.piece_values, self.piece_offsets, slot[rows])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their len(texts) + 1 offsets."""
        texts = texts.cast(pa.large_string())
        if self.drops_space:
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        flat, bounds = lists.flatten(), np.asarray(lists.offsets)
        bounds = bounds - bounds[0]
        if not self.drops_space:
            flat, bounds = self._with_leading_space(texts, flat, bounds)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        slot = pc.fill_null(pc.index_in(distinct, value_set=self.units), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = slot < 0
        new = distinct.filter(pa.array(unknown))
        values, offsets = self._encode_new(new)
        if len(self.units) + len(new) > KEPT_UNITS:  # keep those of this batch only
            known = np.flatnonzero(~unknown)
            kept, cuts = ragged_take(self.values, self.offsets, slot[known])
            self.units = distinct.take(pa.array(known))
            self.values, self.offsets = kept, cuts
            slot[known] = np.arange(len(known))
        slot[unknown] = len(self.units) + np.arange(len(new))
        self.units = pa.concat_arrays([self.units, new])
        self.values = np.concatenate([self.values, values])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        rows = slot[coded.indices.to_numpy(zero_copy_only=False)]
        ids, cuts = ragged_take(self.values, self.offsets, rows)
        return ids, cuts[bounds]

    def _with_leading_space(self, texts, flat, bounds):
        """Give each unit but a text's first its space; texts with other spacing stay whole."""
        first = np.zeros(len(flat), bool)
        first[bounds[:-1]] = True
        spaced = pc.binary_join_element_wise(pa.array(np.where(first, "", " "), pa.large_string()), flat, pa.scalar("", pa.large_string()))
        odd = pc.match_substring_regex(texts, r"^ | $|[\s\p{Z}\x0b\x1c-\x1f\x85] | [\s\p{Z}\x0b\x1c-\x1f\x85]")
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(rows):
            return spaced, bounds
        pieces, lengths = [], (bounds[1:] - bounds[:-1]).copy()
        done = 0
        for r in rows.tolist():
            pieces.append(spaced.slice(bounds[done], bounds[r] - bounds[done]))
            pieces.append(texts.slice(r, 1))
            lengths[r] = 1
            done = r + 1
        pieces.append(spaced.slice(bounds[done]))
        return pa.concat_arrays(pieces), np.concatenate([[0], np.cumsum(lengths)])


_ENCODERS: dict[tuple[bytes, bool], UnitEncoder] = {}


def unit_encoder(definition: bytes, drops_space: bool) -> UnitEncoder:
    """One encoder for each worker process."""
    if (definition, drops_space) not in _ENCODERS:
        _ENCODERS[definition, drops_space] = UnitEncoder(definition, drops_space)
    return _ENCODERS[definition, drops_space]
