"""Secret scan: all rules in one deterministic automaton over bytes.

The rules' regular expressions are turned into position sets (Glushkov), combined by subset
construction without an anchor, minimised, and laid out as one transition array. Texts are
scanned in many lanes at once, one byte of each lane per step. A byte that sends every state
to the start can lie in no match, so texts are cut into lanes behind such bytes, and the
stretch between two of them that holds a hit is all that the exact rule has to look at. A rule
whose matches go on behind such bytes (keys of several lines) looks on to the end of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import map_arrow, text_bytes, texts_of


@dataclass(frozen=True)
class Rule:
    """``pattern``: byte regex of classes, groups, |, ?, *, + and {n}; ``any_case`` is for
    groups of letters. ``exact`` finds the matches, leftmost and non-overlapping; group
    ``part`` (0: all) must have ``least`` characters, or the match is dropped. If ``beyond``,
    ``pattern`` is the beginning of a match, in one line, and ``exact`` goes on from there."""

    kind: str
    pattern: str
    exact: str
    part: int
    least: int
    beyond: bool = False


# The three base rules and further well-known token formats.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A private key: all up to its END line, which may be quoted, joined or escaped as in JSON; a key
# that is cut off goes as far as its header fields and base64 do.
_KEY_BEGIN = r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"
_KEY_WHOLE = r"""(?:[A-Za-z0-9+/=\x20\t\r\n\\"',:;>#*|_@]++|-(?!-)|\.(?=[A-Za-z0-9]))*+-----END\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----"""
_GAP, _BASE64 = r"""(?:[\x20\t\r\n>#"',]|\\[nrt])++""", r"[A-Za-z0-9+/]"
_KEY_CUT = (
    rf"(?:{_GAP}[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+)*(?:{_GAP}{_BASE64}{{16,}}+={{0,2}})++"
    rf"(?:{_GAP}{_BASE64}{{1,15}}+={{0,2}}(?=[\r\n\\]|\Z))?"
)
BASE = (
    Rule("assign", _ASSIGN, _ASSIGN, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16}", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", r"xox[abeprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", _KEY_BEGIN, rf"{_KEY_BEGIN}(?:{_KEY_WHOLE}|{_KEY_CUT})?", 0, 1, beyond=True),
)
RULES = BASE + MORE


class _Syntax:
    """Positions of a byte regex: which may be first, last, and follow each other."""

    def __init__(self):
        self.bytes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def parse(self, text: str) -> tuple[bool, set[int], set[int]]:
        self.text, self.at, self.any_case = text, 0, False
        out = self._either()
        if self.at != len(text):
            raise ValueError(f"cannot read {text!r} at {self.at}")
        return out

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self):
        empty, first, last = self._sequence()
        while self._peek() == "|":
            self.at += 1
            e, f, l = self._sequence()
            empty, first, last = empty or e, first | f, last | l
        return empty, first, last

    def _link(self, lasts: set[int], firsts: set[int]) -> None:
        for p in lasts:
            self.follow[p] |= firsts

    def _sequence(self):
        empty, first, last = True, set(), set()
        while self._peek() not in ("", "|", ")"):
            e, f, l = self._repeated()
            self._link(last, f)
            first, last = first | (f if empty else set()), l | (last if e else set())
            empty = empty and e
        return empty, first, last

    def _repeated(self):
        begin = self.at
        e, f, l = self._atom()
        mark = self._peek()
        if mark in ("*", "+"):
            self._link(l, f)
        if mark in ("*", "?"):
            e = True
        if mark in ("*", "+", "?") and mark:
            self.at += 1
        elif mark == "{":
            close = self.text.index("}", self.at)
            times, after = int(self.text[self.at + 1 : close]), close + 1
            for _ in range(times - 1):
                self.at = begin
                e2, f2, l2 = self._atom()
                self._link(l, f2)
                f, l, e = f | (f2 if e else set()), l2 | (l if e2 else set()), e and e2
            self.at = after
        return e, f, l

    def _position(self, members: set[int]):
        if self.any_case:
            letters = [b for b in members if chr(b).isalpha() and b < 128]
            members = members | {ord(chr(b).swapcase()) for b in letters}
        self.bytes.append(frozenset(members))
        self.follow.append(set())
        p = len(self.bytes) - 1
        return False, {p}, {p}

    def _one(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _atom(self):
        if self._peek() == "(":
            case = self.any_case
            self.at += 1
            if self.text.startswith("?i:", self.at):
                self.at, self.any_case = self.at + 3, True
            out = self._either()
            self.at, self.any_case = self.at + 1, case
            return out
        if self._peek() == "[":
            self.at += 1
            members: set[int] = set()
            while self._peek() != "]":
                low = self._one()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    members |= set(range(low, self._one() + 1))
                else:
                    members.add(low)
            self.at += 1
            return self._position(members)
        return self._position({self._one()})


@dataclass
class Automaton:
    """``step[state * n_classes + byte_class[b]]`` is the next state; ``hits[state]`` has a bit
    for each rule that a match ends in; ``resets`` are bytes that lead back to state 0."""

    byte_class: np.ndarray
    n_classes: int
    step: np.ndarray
    hits: np.ndarray
    resets: np.ndarray


def build_automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    syntax = _Syntax()
    starts: set[int] = set()
    ends: dict[int, int] = {}
    for k, rule in enumerate(rules):
        empty, first, last = syntax.parse(rule.pattern)
        if empty:
            raise ValueError(f"rule {rule.kind} matches nothing at all")
        starts |= first
        for p in last:
            ends[p] = ends.get(p, 0) | 1 << k
    # Bytes that no position tells apart share a class.
    members = [tuple(b in s for s in syntax.bytes) for b in range(256)]
    names = {m: c for c, m in enumerate(dict.fromkeys(members))}
    byte_class = np.array([names[m] for m in members], np.int64)
    n_classes = len(names)
    allowed = [{p for p, yes in enumerate(m) if yes} for m in names]
    # Subset construction; the start positions are always open, so a match may begin anywhere.
    states: dict[frozenset[int], int] = {frozenset(): 0}
    queue, table = [frozenset()], []
    for state in queue:
        reach = starts.union(*(syntax.follow[p] for p in state))
        row = []
        for c in range(n_classes):
            after = frozenset(reach & allowed[c])
            if after not in states:
                states[after] = len(states)
                queue.append(after)
            row.append(states[after])
        table.append(row)
    step = np.array(table, np.int64)
    hits = np.array([sum({1 << k for p in s for k in range(len(rules)) if ends.get(p, 0) >> k & 1}) for s in queue], np.int64)
    # Minimisation: split blocks by the blocks of all successors until nothing changes.
    block = np.unique(hits, return_inverse=True)[1]
    while True:
        signature = np.concatenate([block[:, None], block[step]], axis=1)
        finer = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first_of = np.unique(block, return_index=True)[1]
    order = np.argsort(first_of)  # the start state comes first
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    chosen = first_of[order]
    small = rank[block[step[chosen]]]
    back = (small == 0).all(axis=0)
    return Automaton(byte_class, n_classes, small.ravel().astype(np.int32), hits[chosen].astype(np.int32), back[byte_class])


def scan(raw: np.ndarray, offsets: np.ndarray, automaton: Automaton, lane_bytes: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Last bytes of all matches of all rules, and their rule bits, in ascending order."""
    resets = np.flatnonzero(automaton.resets[raw]) + 1
    # Lanes begin at texts and behind the first reset after every ``lane_bytes`` bytes.
    marks = resets[np.minimum(np.searchsorted(resets, np.arange(lane_bytes, len(raw), lane_bytes)), len(resets) - 1)] if len(resets) else resets
    begin = np.unique(np.concatenate([offsets[:-1], marks[marks < len(raw)]]))
    begin = begin[begin < len(raw)]
    length = np.diff(np.append(begin, len(raw)))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    classes = automaton.byte_class.astype(np.uint8)[raw] if automaton.n_classes <= 256 else automaton.byte_class[raw]
    state = np.zeros(len(begin), np.int32)
    found_at, found = [], []
    for i, n in enumerate(active.tolist()):
        now = automaton.step[state[:n] * automaton.n_classes + classes[begin[:n] + i]]
        state[:n] = now
        hit = automaton.hits[now]
        if hit.any():
            which = np.flatnonzero(hit)
            found_at.append(begin[which] + i)
            found.append(hit[which])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, bits = np.concatenate(found_at), np.concatenate(found).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], bits[order]


def spans_in(raw: np.ndarray, offsets: np.ndarray, automaton: Automaton, rules: tuple[Rule, ...]) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with matches: (start, rule, end) in characters, in order."""
    at, bits = scan(raw, offsets, automaton)
    if not len(at):
        return {}
    exact = [re.compile(r.exact.encode()) for r in rules]
    resets = np.flatnonzero(automaton.resets[raw])
    doc = np.searchsorted(offsets, at, side="right") - 1
    before = np.searchsorted(resets, at) - 1
    low = np.maximum(offsets[doc], np.where(before >= 0, resets[np.maximum(before, 0)] + 1, 0)) if len(resets) else offsets[doc]
    after = np.searchsorted(resets, at)
    high = np.minimum(offsets[doc + 1], np.where(after < len(resets), resets[np.minimum(after, len(resets) - 1)], len(raw))) if len(resets) else offsets[doc + 1]
    stretches: dict[tuple[int, int, int], int] = {}
    for key, b in zip(zip(doc.tolist(), low.tolist(), high.tolist()), bits.tolist()):
        stretches[key] = stretches.get(key, 0) | b
    out: dict[int, list[tuple[int, int, int]]] = {}
    counted: dict[int, tuple[int, int]] = {}  # text: bytes and characters counted so far
    whole: tuple[int, bytes] = (-1, b"")  # text, and its bytes
    reached: dict[tuple[int, int], int] = {}  # text and rule: end of the last match beyond a stretch
    for (d, a, b), mask in sorted(stretches.items()):
        data = raw[a:b].tobytes()
        spans = []
        for k, rule in enumerate(rules):
            if mask >> k & 1 and rule.beyond:
                first = int(offsets[d])
                if whole[0] != d:
                    whole = d, raw[first : offsets[d + 1]].tobytes()
                for m in exact[k].finditer(whole[1], max(a - first, reached.get((d, k), 0))):
                    if m.start() >= b - first:
                        break
                    reached[d, k] = m.end()
                    if m.end(rule.part) - m.start(rule.part) >= rule.least:
                        spans.append((m.start() + first - a, k, m.end() + first - a))
            elif mask >> k & 1:
                spans += [(m.start(), k, m.end()) for m in exact[k].finditer(data) if m.end(rule.part) - m.start(rule.part) >= rule.least]
        if not spans:
            continue
        done, chars = counted.get(d, (int(offsets[d]), 0))
        part = raw[done:a]
        chars += int(np.count_nonzero((part & 0xC0) != 0x80))
        counted[d] = (a, chars)
        # Matches are ASCII, but other bytes may stand between two of one stretch; each is
        # counted once.
        place, last = {}, 0
        for i in sorted({i for s, _, e in spans for i in (s, e)}):
            chars += int(np.count_nonzero((raw[a + last : a + i] & 0xC0) != 0x80))
            place[i], last = chars, i
        out.setdefault(d, []).extend((place[s], k, place[e]) for s, k, e in spans)
    return {d: sorted(x) for d, x in out.items()}


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def _scan_batches(docs: DataFrame, rules: tuple[Rule, ...], columns, schema: str, *kept: str) -> DataFrame:
    automaton = build_automaton(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                raw, offsets = text_bytes(batch.column("text"))
                found = spans_in(raw, offsets, automaton, rules)
                yield pa.RecordBatch.from_pydict(
                    {**{k: batch.column(k) for k in kept}, **columns([found.get(r, []) for r in range(batch.num_rows)], batch)}
                )

    return map_arrow(docs, work, schema)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): all secrets of every whole text, by start and then rule order, in
    code points, end exclusive. Null or empty text: no spans. Each row gets one row, equal
    or null ids too; extra columns are not read."""

    def columns(found, batch):
        spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return {"spans": pa.array(spans, kind)}

    return _scan_batches(texts_of(docs), rules, columns, SPANS, "doc_id")


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document counts of the base rules, a digest of their spans, and all spans as text."""

    def columns(found, batch):
        joined = lambda x: ",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e in x)
        base = [[y for y in x if y[1] < len(BASE)] for x in found]
        out = {f"n_{r.kind}": pa.array([sum(y[1] == k for y in x) for x in base], pa.int64()) for k, r in enumerate(BASE)}
        out["base_sha256"] = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base])
        out["spans"] = pa.array([joined(x) for x in found])
        return out

    return _scan_batches(texts_of(docs), RULES, columns, REPORT, "doc_id")


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]``; overlapping spans are
    replaced as one. Other columns stay as they are; null text stays null."""
    names = docs.columns

    def columns(found, batch):
        texts = batch.column("text").to_pylist()
        for r, spans in enumerate(found):
            if not spans:
                continue
            text, out, done = texts[r], [], 0
            for start, _, end in spans:
                if start >= done:
                    out += [text[done:start], "[SECRET]"]
                done = max(done, end)
            texts[r] = "".join([*out, text[done:]])
        return {"text": pa.array(texts, batch.schema.field("text").type)}

    kept = [n for n in names if n != "text"]
    ordered = docs.select(*[F.col(f"`{n}`") for n in kept], "text")
    return _scan_batches(ordered, rules, columns, ordered.schema, *kept).select(*[F.col(f"`{n}`") for n in names])
