"""Operator 3, SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Tie rule: of paths with equal scores to a place, the one whose last piece begins first. A character that no piece
covers becomes the pieces of its UTF-8 bytes. Decoding joins pieces, turns markers into spaces, byte pieces into bytes,
and drops the space that encoding put in front. Cases: null gives null ids, 0 pieces and a null round trip; the empty
text gives no ids; a text's own U+2581 decodes to a space (the encoding's markers are the same character), all other
texts come back unchanged; very long texts are read whole (memory grows with the longest); repeated rows give equal ids; other input columns are not touched; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import table, text_udf
from .pieces import MARK, MODEL, Splitter, Vocabulary, load, memo, padded


class DoubleArray:
    """A trie as two arrays: from state s, the code c leads to base[s] + c if check there is s."""

    def __init__(self, words: list[tuple[str, int]]):
        alphabet = sorted({c for w, _ in words for c in w})
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for word, value in words:
            node = 0
            for c in word:
                k = int(self.code[ord(c)])
                nxt = tree[node].get(k)
                if nxt is None:
                    nxt = tree[node][k] = len(tree)
                    tree.append({})
                node = nxt
            ends[node] = value
        top = len(alphabet) + 1
        room = len(tree) * 2 + top * 2
        used = np.zeros(room, dtype=bool)
        used[0] = True
        place: dict[int, tuple[int, np.ndarray]] = {}
        branching = sorted((i for i in range(len(tree)) if len(tree[i]) > 1), key=lambda i: -len(tree[i]))
        for node in branching:  # first place where all children fit, a block of free slots at a time
            codes = np.array(sorted(tree[node]))
            at, low = -1, int(codes[0])
            while at < 0:
                if low + 1024 + top >= len(used):
                    used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
                free = low + np.flatnonzero(~used[low : low + 1024])
                fits = ~used[(free - codes[0])[:, None] + codes].any(axis=1)
                if fits.any():
                    at = int(free[fits.argmax()] - codes[0])
                low += 1024
            used[at + codes] = True
            place[node] = (at, codes)
        chains = [i for i in range(len(tree)) if len(tree[i]) == 1]
        room = len(used) + len(chains) + 2 * top
        used = np.concatenate([used, np.zeros(room - len(used), dtype=bool)])
        free = top + np.flatnonzero(~used[top:])[: len(chains)]  # any free slot will do for a single child
        for node, slot in zip(chains, free.tolist(), strict=True):
            codes = np.array(list(tree[node]))
            place[node] = (slot - int(codes[0]), codes)
        self.base, self.check, self.value = np.zeros(room, dtype=np.int32), np.full(room, -1, dtype=np.int32), np.full(room, -1, dtype=np.int32)
        # states are known only now: a child's state is its parent's base plus its code
        todo = [(0, 0)]
        while todo:
            node, state = todo.pop()
            if node in ends:
                self.value[state] = ends[node]
            if tree[node]:
                at, codes = place[node]
                self.base[state] = at
                self.check[at + codes] = state
                todo += [(child, at + k) for k, child in tree[node].items()]
        self.depth = max((len(w) for w, _ in words), default=0)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none. States of -1 stay."""
        to = self.base[state] + code
        return np.where((state >= 0) & (code > 0) & (self.check[to] == state), to, -1)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.splitter = Splitter(vocabulary)
        self.trie = DoubleArray(vocabulary.searchable())
        self.score, self.unknown = vocabulary.score, vocabulary.unknown
        self.byte_ids, self.key = vocabulary.byte_ids, f"ids {vocabulary.fingerprint}"
        surface = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else p.replace(MARK, " ").encode() for p, k in zip(vocabulary.pieces, vocabulary.kind, strict=True)]
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_size = np.fromiter(map(len, surface), dtype=np.int64, count=len(surface))
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size

    def paths(self, codes: np.ndarray, length: np.ndarray):
        """Viterbi for the rows of a matrix of codes: for each place the best last piece (-1: an uncovered character)
        and where it begins."""
        n, width = codes.shape
        worst = np.iinfo(np.int64).min // 2
        best = np.full((n, width + 1), worst, dtype=np.int64)
        best[:, 0] = 0
        last, begin = np.full((n, width + 1), -1, dtype=np.int32), np.zeros((n, width + 1), dtype=np.int32)
        wide = np.concatenate([codes, np.zeros((n, 1), dtype=codes.dtype)], axis=1)
        for s in range(width):
            rows = np.flatnonzero(length > s)
            state = np.zeros(len(rows), dtype=np.int32)
            base = best[rows, s]
            single = np.zeros(len(rows), dtype=bool)
            here, live = rows, np.arange(len(rows))
            for k in range(min(self.trie.depth, width - s)):
                state = self.trie.step(state, wide[here, s + k])
                go = state >= 0
                here, live, state = here[go], live[go], state[go]
                if not len(here):
                    break
                piece = self.trie.value[state]
                hit = piece >= 0
                if k == 0:
                    single[live[hit]] = True
                rows_hit, p = here[hit], piece[hit]
                total = base[live[hit]] + self.score[p]
                better = total > best[rows_hit, s + k + 1]
                r = rows_hit[better]
                best[r, s + k + 1], last[r, s + k + 1], begin[r, s + k + 1] = total[better], p[better], s
            bare = ~single
            total = base[bare] + self.unknown
            r = rows[bare]
            better = total > best[r, s + 1]
            r = r[better]
            best[r, s + 1], last[r, s + 1], begin[r, s + 1] = total[better], -1, s
        return last, begin

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and how many each has."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows, codes, length in padded(units, self.trie.code):
            last, begin = self.paths(codes, length)
            at, which, depth = length.copy(), np.arange(len(rows)), 0
            while len(which):
                piece, start = last[which, at[which]].astype(np.int64), begin[which, at[which]]
                bare = piece < 0
                if bare.any():
                    parts = [(rows[w], units[rows[w]][s].encode()) for w, s in zip(which[bare].tolist(), start[bare].tolist(), strict=True)]
                    for unit, raw in parts:
                        found.append((np.full(len(raw), unit), depth + 1 - (np.arange(len(raw)) + 1) / 8, self.byte_ids[list(raw)]))
                found.append((rows[which[~bare]], np.full((~bare).sum(), depth, dtype=np.float64), piece[~bare]))
                at[which] = start
                which = which[start > 0]
                depth += 1
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        unit, depth, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-depth, unit))
        return piece[order], np.bincount(unit, minlength=len(units))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        names: list[str] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, x in enumerate(texts):
            if x:
                own = self.splitter.split(x)
                sizes[i] = len(own)
                names += own
        known = memo(self.key)
        number = known.of(names, self.units)
        many = known.size[number]
        at = np.repeat(known.begin[number] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        return known.flat[at], np.bincount(text, weights=many, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.surface_size[ids]
        begin = np.cumsum(size) - size
        at = np.repeat(self.surface_start[ids] - begin, size) + np.arange(int(size.sum()))
        raw = self.surface[at].tobytes()
        cut = np.concatenate([[0], np.cumsum(n)])
        edge = np.concatenate([begin, [len(raw)]])[cut].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def rows(self, texts: list[str | None]) -> dict[str, object]:
        ids, n = self.encode(texts)
        cut = np.concatenate([[0], np.cumsum(n)])
        ids = ids.astype(np.int32)
        back = self.decode(ids, n)
        lists = [None if x is None else ids[a:b] for x, a, b in zip(texts, cut[:-1], cut[1:], strict=True)]
        return {"ids": lists, "n_pieces": n, "decoded": [None if x is None else b for x, b in zip(texts, back, strict=True)]}


def encode(docs: DataFrame, encoder: Encoder, text_col: str = "text", into: str = "encoded") -> DataFrame:
    """docs with a struct column: ids, n_pieces and decoded, the text that the ids give back."""
    return docs.withColumn(into, text_udf("ids array<int>, n_pieces long, decoded string", encoder.rows, 1_200_000)(F.col(text_col)))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the ids, their number, the text that they give back, and whether that is the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode(docs, Encoder(load(MODEL))).select("doc_id", "encoded.ids", "encoded.n_pieces", "encoded.decoded", "text")
    return found.select("doc_id", "ids", "n_pieces", "decoded", (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("round_trip"))
