"""A unigram vocabulary of pieces, read from a SentencePiece model file, and how texts fall into units.

The vocabulary files at hand hold BPE merge ranks, not log probabilities. ``scores="rank"`` turns the rank r of a piece
into the log score of Zipf's law, -ln(r + 1), rounded to 1/64 so that sums are exact; ``scores="file"`` takes the
file's scores. The model file is read on the driver only.

No piece has a whitespace marker after another character, and a character outside the alphabet is a piece of its own
(by byte fallback), so the best path of a text is the chain of the best paths of its units: a run of markers with the
characters that follow, cut at characters outside the alphabet. Equal units are solved once a slice.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
QUANTUM = 64
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """(number, value) of a protocol buffer message; values are ints or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str]
    score: np.ndarray  # in quanta, int64
    kind: np.ndarray
    unknown: int  # score of a character that no piece covers

    @property
    def byte_ids(self) -> np.ndarray:
        """The id of each byte's piece."""
        out = np.zeros(256, dtype=np.int64)
        for i in np.flatnonzero(self.kind == BYTE):
            out[int(self.pieces[i][3:5], 16)] = i
        return out

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(repr((self.pieces, self.score.tolist(), self.unknown)).encode()).hexdigest()

    def searchable(self) -> list[tuple[str, int]]:
        return [(p, i) for i, p in enumerate(self.pieces) if self.kind[i] in (NORMAL, USER) and p]


def load(path: str = MODEL, scores: str = "rank") -> Vocabulary:
    with open(path, "rb") as f:
        data = f.read()
    pieces, raw, kind = [], [], []
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append(own[1].decode())
            raw.append(np.frombuffer(own.get(2, b"\0\0\0\0"), dtype="<f4")[0])
            kind.append(own.get(3, NORMAL))
    found, kind = np.array(raw, dtype=np.float64), np.array(kind)
    normal = (kind == NORMAL) | (kind == USER)
    if scores == "rank":
        found = -np.log(np.maximum(-found, 0) + 1)
    score = np.where(normal, np.round(found * QUANTUM), 0).astype(np.int64)
    return Vocabulary(pieces, score, kind, int(score[normal].min()) - 10 * QUANTUM)


#: parts longer than this are cut at characters outside the alphabet
LONG = 64
#: numbers that a worker process remembers for units, by vocabulary and operator, before it starts anew
KNOWN = 300_000
BARE = "\0"  # stands before a unit without a marker


class Splitter:
    """Cuts texts into units. A unit is named by its characters after its first marker, or by BARE and all of them."""

    def __init__(self, vocabulary: Vocabulary):
        alphabet = {c for p, _ in vocabulary.searchable() for c in p}
        inner = "".join(re.escape(c) for c in sorted(alphabet - {MARK}))
        self.pattern = f"{MARK}+[{inner}]*|[{inner}]+|."
        self._find = None

    def split(self, text: str) -> list[str]:
        parts = text.replace(MARK, " ").split(" ")
        if "" in parts:  # a run of markers belongs to the word after it
            merged, run = [], 0
            for x in parts:
                if x:
                    merged.append(" " * run + x)
                    run = 0
                else:
                    run += 1
            parts = [*merged, " " * (run - 1)] if run else merged
        if len(max(parts, key=len)) > LONG or BARE in text:
            parts = [y for x in parts for y in (self._cut(x) if len(x) > LONG or x.startswith(BARE) else (x,))]
        return parts

    def _cut(self, part: str) -> list[str]:
        if self._find is None:
            self._find = re.compile(self.pattern, re.DOTALL)
        return [x[1:].replace(MARK, " ") if x[0] == MARK else BARE + x for x in self._find.findall(MARK + part.replace(" ", MARK))]

    def __getstate__(self):
        return {"pattern": self.pattern, "_find": None}


def spelled(name: str) -> str:
    """The characters of a named unit, with markers."""
    return name[1:] if name.startswith(BARE) else MARK + name.replace(" ", MARK)


class Memo:
    """Numbers units and remembers the rows that ``solve`` found for them."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64), np.zeros(8192, dtype=np.int32)
        self.used = 0

    def of(self, names: list[str], solve) -> np.ndarray:
        """The numbers of units; solve(their characters) gives all values, one unit after the other, and how many each has."""
        if len(self.number) > KNOWN:
            self.__init__()
        found = list(map(self.number.get, names))
        if None in found:
            new = list({x: None for x, n in zip(names, found, strict=True) if n is None})
            values, size = solve([spelled(x) for x in new])
            at = len(self.number)
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
            self.begin, self.size = room(self.begin, at + len(new)), room(self.size, at + len(new))
            self.flat = room(self.flat, self.used + len(values))
            self.size[at : at + len(new)] = size
            self.begin[at : at + len(new)] = self.used + np.cumsum(size) - size
            self.flat[self.used : self.used + len(values)] = values
            self.used += len(values)
            found = list(map(self.number.__getitem__, names))
        return np.array(found, dtype=np.int64)


def room(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n - len(x), len(x)), dtype=x.dtype)])


_memos: dict[str, Memo] = {}


def memo(key: str) -> Memo:
    """This process's memo for a vocabulary and an operator."""
    return _memos.setdefault(key, Memo())


def padded(units: list[str], code: np.ndarray, at_most: int = 48):
    """Groups of units of like length: (their numbers, a matrix of alphabet codes, 0 for none; lengths)."""
    size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        own = size[order[at:]]
        n = int(np.searchsorted(own, max(int(own[0]) + 4, int(own[0] * 1.25)), side="right"))
        n = max(1, min(n, 4_000_000 // max(int(own[0]) * 2, 1)))
        rows = order[at : at + n]
        width = int(size[rows[-1]])
        joined = np.frombuffer("".join(units[i].ljust(width, "\0") for i in rows).encode("utf-32-le"), dtype=np.uint32)
        yield rows, code[joined].reshape(n, width), size[rows]
        at += n
