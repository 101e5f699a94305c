"""Exact BPE with word ends by speculation: greedy tokens, checked pairs, merges only where needed.

The longest token at each place of a word is a guess. A sequence of tokens is the encoding if
and only if each token merges to itself and every two neighbours merge to just these two. So all
neighbours of all distinct words of a batch are checked together in arrays, and only words with
a pair that fails are merged by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanmill.llm.common import file_bytes, map_arrow, ragged_take, texts_of

#: Units kept by a worker between batches.
KEPT_UNITS = 400_000
#: Bytes of text that are encoded together; a longer text is a batch of its own.
BATCH_BYTES = 8_000_000
#: In a word, the character of its last byte is moved up by this much: no token that does not
#: end a word can match there, and none that ends a word can match elsewhere.
_END = 1024
_NEVER = np.int64(1) << 60
# Characters whose class, case and normal form do not depend on a version of Unicode: ASCII and
# Latin letters. Other units go through the normaliser and splitter of the tokenizers library.
_PLAIN = r"^[\t\n\r -~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]*$"
_LETTERS = r"a-z\xdf-\xf6\xf8-ſ"
# Fixed value: the splitter of the vocabulary over plain characters; \0 stands between units.
_WORDS = re.compile(rf"\0|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9\0]+")


def byte_characters() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others,
    in ascending order, as characters from 256 on."""
    shifted = [*range(0, 33), *range(127, 161), 173]
    place = {b: 256 + k for k, b in enumerate(shifted)}
    return [chr(place.get(b, b)) for b in range(256)]


class WordCoder:
    """Tokens of a vocabulary as arrays: ``parts`` of the merge that makes a token and its rank
    ``made`` (-1 for the first symbols), and the merges as ascending keys with their ranks."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition.decode())
        model = json.loads(definition)["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        size = 1 + max([*vocab.values(), *(a for a in self.library.get_added_tokens_decoder())])
        self.texts = [""] * size
        for token, i in vocab.items():
            self.texts[i] = token
        for i, token in self.library.get_added_tokens_decoder().items():
            self.texts[i] = token.content
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        chars = byte_characters()
        self.symbol = {c: vocab[c] for c in chars} | {chr(ord(c) + _END): vocab[c + suffix] for c in chars}
        self.chars = chars
        self.parts = np.full((size, 2), -1, np.int64)
        self.made = np.full(size, -1, np.int64)
        keys, ranks, made = [], [], []
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            keys.append(left << 32 | right)
            ranks.append(rank)
            made.append(whole)
            self.merges[left, right] = (rank, whole)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        for rank in range(len(made) - 1, -1, -1):  # of several merges to one token the first counts
            left, right = keys[rank] >> 32, keys[rank] & 0xFFFFFFFF
            self.parts[made[rank]], self.made[made[rank]] = (left, right), rank
        # Tokens that are made after their parts, all the way down: only for these the merges can
        # be taken back by rank. Others, and tokens that do not merge to themselves, are no guesses.
        regular = self.made < 0
        for rank in range(len(made)):
            i, (a, b) = made[rank], self.parts[made[rank]]
            if self.made[i] == rank:
                regular[i] = regular[a] and regular[b] and max(self.made[a], self.made[b]) < rank
        self.length = np.zeros(size, np.int64)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if regular[i]:
                key = token
                if suffix and token.endswith(suffix):
                    bare = token[: -len(suffix)]
                    key = bare[:-1] + chr(ord(bare[-1]) + _END)
                self.length[i] = len(key)
                if len(key) == 1 or self.by_rank([self.symbol[c] for c in key]) == [i]:
                    self.automaton.add_word(key, (i, len(key) - 1))
        self.automaton.make_automaton()
        self.units = pa.array([], pa.large_string())
        self.values, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.tokens = pa.array(self.texts, pa.large_string())
        #: Words whose greedy tokens were right and wrong so far.
        self.right = self.wrong = 0

    def by_rank(self, symbols: list[int]) -> list[int]:
        """Merge ``symbols``: the pair of least rank first, of equal ones the leftmost. A heap of
        pairs over a linked list, so a word of any length takes n log n steps."""
        n = len(symbols)
        ids, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        merges = self.merges
        heap = []
        for k in range(n - 1):
            found = merges.get((ids[k], ids[k + 1]))
            if found:
                heap.append((found[0], k, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, k, whole = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else -1
            if j < 0 or merges.get((ids[k], ids[j])) != (rank, whole):
                continue
            ids[k], ids[j] = whole, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0:
                    found = merges.get((ids[a], ids[b]))
                    if found:
                        heapq.heappush(heap, (found[0], a, found[1]))
        return [i for i in ids if i >= 0]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of regular tokens: do they stay apart when merged together?

        The merges of both are taken back, latest first; ``a`` is the last part on the left, ``b``
        the first on the right. A merge of ``a`` and ``b`` happens if it comes before the merge
        that takes ``a`` (which stands further left, so it wins ties) and not after the one that
        takes ``b``.
        """
        fits = np.ones(len(left), bool)
        at = np.arange(len(left))
        a, b = left.astype(np.int64), right.astype(np.int64)
        takes_a, takes_b = np.full(len(at), _NEVER), np.full(len(at), _NEVER)
        while len(at):
            key = a << 32 | b
            place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            rank = np.where(self.keys[place] == key, self.ranks[place], _NEVER) if len(self.keys) else np.full(len(at), _NEVER)
            across = (rank < takes_a) & (rank <= takes_b)
            fits[at[across]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~across & (np.maximum(made_a, made_b) >= 0)
            at, a, b, made_a, made_b, takes_a, takes_b = (x[go] for x in (at, a, b, made_a, made_b, takes_a, takes_b))
            back = made_a > made_b
            takes_a, takes_b = np.where(back, made_a, takes_a), np.where(back, takes_b, made_b)
            a, b = np.where(back, self.parts[a, 1], a), np.where(back, b, self.parts[b, 0])
        return fits

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (byte characters, the last one moved up), and their offsets."""
        cuts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        found = [token for _, (token, _) in self.automaton.iter_long("".join(words))]
        ids = np.array(found, np.int64)
        ends = np.cumsum(self.length[ids])
        # A word's guess holds if its tokens fill it and every pair inside fits.
        good = np.ones(len(words), bool)
        if len(ends) and ends[-1] == cuts[-1]:
            bounds = np.searchsorted(ends, cuts[1:], side="left")
            good &= ends[np.minimum(bounds, len(ends) - 1)] == cuts[1:]
            tokens = np.concatenate([[0], bounds + 1])
        else:  # some character stood alone: every word is merged
            good[:] = False
            tokens = np.zeros(len(words) + 1, np.int64)
        owner = np.repeat(np.arange(len(words)), np.diff(tokens))
        if len(owner) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pair, which = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
            fits = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
            good[owner[inner[~fits[which]]]] = False
        failed = np.flatnonzero(~good)
        self.right, self.wrong = self.right + len(words) - len(failed), self.wrong + len(failed)
        if not len(failed):
            return ids.astype(np.int32), tokens
        merged = [self.by_rank([self.symbol[c] for c in words[k]]) for k in failed.tolist()]
        kept = np.flatnonzero(good)
        kept_ids, kept_cuts = ragged_take(ids, tokens, kept)
        lengths = np.empty(len(words), np.int64)
        lengths[kept], lengths[failed] = np.diff(kept_cuts), [len(m) for m in merged]
        flat = np.concatenate([kept_ids, np.array([i for m in merged for i in m], np.int64)])
        order = np.concatenate([kept, failed])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        values, offsets = ragged_take(flat, np.concatenate([[0], np.cumsum(lengths[order])]), back)
        return values.astype(np.int32), offsets

    def _written(self, word: str) -> str:
        """A word as byte characters with its last one moved up."""
        chars = word if word.isascii() else "".join([self.chars[b] for b in word.encode()])
        return chars[:-1] + chr(ord(chars[-1]) + _END)

    def _words_of(self, unit: str) -> list[str | int]:
        """Words of a unit with any characters; an added token is its id."""
        out: list[str | int] = []
        for part in self.specials.split(unit) if self.specials else [unit]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                # The splitter has written these as byte characters already.
                out += [w[:-1] + chr(ord(w[-1]) + _END) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal) if w]
        return out

    def _encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units and their offsets; each distinct word is encoded once."""
        plain = pc.match_substring_regex(units, _PLAIN)
        if self.special:  # an added token is cut out before the text is split
            marked = pc.match_substring_regex(units, "|".join(map(re.escape, self.special)))
            plain = pc.and_(plain, pc.invert(marked))
        plain = plain.to_numpy(zero_copy_only=False)
        common, rare = np.flatnonzero(plain), np.flatnonzero(~plain)
        names: dict[str | int, int] = {}
        rows: list[int] = []
        counts = np.zeros(len(units), np.int64)
        if len(common):
            joined = "\0".join(units.take(pa.array(common)).to_pylist()).lower()
            unit, n = 0, 0
            for word in _WORDS.findall(joined):
                if word == "\0":
                    counts[common[unit]] = n
                    unit, n = unit + 1, 0
                else:
                    rows.append(names.setdefault(word, len(names)))
                    n += 1
            counts[common[unit]] = n
        slots = [self._written(w) for w in names]
        written = {w: k for k, w in enumerate(slots)}
        for r, text in zip(rare.tolist(), units.take(pa.array(rare)).to_pylist()):
            own = self._words_of(text)
            counts[r] = len(own)
            for word in own:
                if word not in written:
                    written[word] = len(slots)
                    slots.append(word)
                rows.append(written[word])
        words = [w for w in slots if isinstance(w, str)]
        ids, cuts = self.encode_words(words)
        if len(words) < len(slots):
            added = [w for w in slots if not isinstance(w, str)]
            place = np.cumsum([isinstance(w, str) for w in slots]) - 1
            extra = iter(range(len(words), len(slots)))
            place = np.array([place[k] if isinstance(w, str) else next(extra) for k, w in enumerate(slots)], np.int64)
            ids = np.concatenate([ids, np.array(added, np.int32)])
            cuts = np.concatenate([cuts, cuts[-1] + 1 + np.arange(len(added))])
        else:
            place = np.arange(len(slots))
        of_words, word_cuts = ragged_take(ids, cuts, place[np.array(rows, np.int64)])
        order = np.concatenate([common, rare])
        unit_cuts = word_cuts[np.concatenate([[0], np.cumsum(counts[order])])]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ragged_take(of_words, unit_cuts, back)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their len(texts) + 1 offsets. White space is
        dropped by the splitter, so texts are cut there and each distinct unit is encoded once."""
        texts = pc.replace_substring(texts.cast(pa.large_string()), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        flat, bounds = lists.flatten(), np.asarray(lists.offsets)
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        slot = pc.fill_null(pc.index_in(distinct, value_set=self.units), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(slot < 0)
        new = distinct.take(pa.array(unknown))
        values, offsets = self._encode_units(new)
        if len(self.units) + len(new) > KEPT_UNITS:  # keep those of this batch only
            known = np.flatnonzero(slot >= 0)
            self.values, self.offsets = ragged_take(self.values, self.offsets, slot[known])
            self.units = distinct.take(pa.array(known))
            slot[known] = np.arange(len(known))
        slot[unknown] = len(self.units) + np.arange(len(new))
        self.units = pa.concat_arrays([self.units, new])
        self.values = np.concatenate([self.values, values])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        rows = slot[coded.indices.to_numpy(zero_copy_only=False)]
        ids, cuts = ragged_take(self.values, self.offsets, rows)
        return ids, cuts[bounds]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the ids from each offset to the next. The vocabulary names no decoder, so
        these are its tokens with one space between, as the library gives them."""
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.tokens.take(pa.array(ids, pa.int64())))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


_CODERS: dict[bytes, WordCoder] = {}


def word_coder(definition: bytes) -> WordCoder:
    """One coder for each worker process."""
    if definition not in _CODERS:
        _CODERS[definition] = WordCoder(definition)
    return _CODERS[definition]


def byte_slices(batch: pa.RecordBatch, size: int = BATCH_BYTES, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``rows`` rows and, but for a single row, ``size`` bytes
    of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = min(max(int(np.searchsorted(ends, done + size, side="right")), at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def _coded(docs: DataFrame, definition: str, schema: str, columns) -> DataFrame:
    content = file_bytes(docs.sparkSession, definition)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(content.value)
        for whole in batches:
            for batch in byte_slices(whole):
                ids, cuts = coder.encode(batch.column("text"))
                own = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(cuts), pa.int64())}
                yield pa.RecordBatch.from_pydict(own | columns(coder, ids, cuts))

    return map_arrow(texts_of(docs), work, schema)


def word_codes(docs: DataFrame, definition: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids of every whole text as the library gives them
    without special tokens around the text, and the text that these ids decode to.

    The strings of added tokens inside a text are these tokens. Null text: empty; empty and
    blank texts have no ids and decode to an empty text. Each row gets one row, equal or null
    ids too; extra columns are not read. Empty input: no rows.
    """

    def columns(coder, ids, cuts):
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, pa.int32()))
        return {"ids": lists, "decoded": coder.decode(ids, cuts).cast(pa.string())}

    return _coded(docs, definition, "doc_id long, n_tokens long, ids array<int>, decoded string", columns)


def word_digests(docs: DataFrame, definition: str) -> DataFrame:
    """As ``word_codes``, with the SHA-256 of the ids (little-endian, 32 bits, unsigned) and of
    the decoded text in their place."""

    def columns(coder, ids, cuts):
        raw, ends = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
        of_ids = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
        texts = coder.decode(ids, cuts).cast(pa.large_binary())
        return {"ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array([hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in texts], pa.string())}

    return _coded(docs, definition, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
