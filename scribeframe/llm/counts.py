"""Operator 4, token counts: count-only Viterbi over an Aho-Corasick automaton of the vocabulary.

The automaton reports all pieces that end at a place, longest first; dynamic programming carries the best score and its
number of pieces, no path. Tie rule as the tokenizer's: of equal scores, the piece that begins first, so the longest.
An uncovered character counts as many pieces as its UTF-8 form has bytes. Cases: null and empty texts count 0; repeated
rows give equal counts; other input columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .kernel import table, text_udf
from .pieces import MODEL, Splitter, Vocabulary, load, memo, padded
from .unigram import DoubleArray


class Automaton:
    """Aho-Corasick: goto transitions in a double array, failure links, and links to the next shorter match."""

    def __init__(self, words: list[tuple[str, int]]):
        self.trie = DoubleArray(words)
        self.code, self.piece = self.trie.code, self.trie.value
        n = len(self.trie.base)
        base, check = self.trie.base.tolist(), self.trie.check.tolist()
        below: dict[int, list[int]] = {}
        for state in np.flatnonzero(self.trie.check >= 0).tolist():
            below.setdefault(check[state], []).append(state)
        fail, shorter, size, ends = [0] * n, [0] * n, [0] * n, (self.piece >= 0).tolist()
        queue = [0]
        for node in queue:  # by depth
            for child in below.get(node, ()):
                queue.append(child)
                size[child] = size[node] + 1
                code, f = child - base[node], fail[node]
                while node:
                    to = base[f] + code
                    if to < n and check[to] == f:
                        fail[child] = to
                        break
                    if not f:
                        break
                    f = fail[f]
                f = fail[child]
                shorter[child] = f if ends[f] else shorter[f]
        self.fail, self.shorter, self.size = (np.array(x, dtype=np.int32) for x in (fail, shorter, size))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = np.zeros_like(state)
        left = np.flatnonzero(code > 0)
        s = state[left]
        while len(left):
            to = self.trie.step(s, code[left])
            done = (to >= 0) | (s == 0)
            out[left[done]] = np.maximum(to[done], 0)
            left, s = left[~done], self.fail[s[~done]]
        return out


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.splitter = Splitter(vocabulary)
        self.automaton = Automaton(vocabulary.searchable())
        self.score, self.unknown, self.key = vocabulary.score, vocabulary.unknown, f"counts {vocabulary.fingerprint}"

    def units(self, units: list[str]) -> np.ndarray:
        out = np.zeros(len(units), dtype=np.int64)
        a = self.automaton
        for rows, codes, length in padded(units, a.code):
            n, width = codes.shape
            best, count = np.zeros((n, width + 1), dtype=np.int64), np.zeros((n, width + 1), dtype=np.int64)
            state = np.zeros(n, dtype=np.int32)
            order = np.argsort(-length, kind="stable")
            running = np.searchsorted(-length[order], -np.arange(width), side="left")
            for t in range(width):
                which = order[: running[t]]
                state[which] = a.step(state[which], codes[which, t])
                node = np.where(a.piece[state[which]] >= 0, state[which], a.shorter[state[which]])
                value = np.full(len(which), np.iinfo(np.int64).min // 2)
                pieces, single = np.zeros(len(which), dtype=np.int64), np.zeros(len(which), dtype=bool)
                live = np.flatnonzero(node > 0)
                while len(live):  # longest first: a later one has to be better
                    k = node[live]
                    size = a.size[k]
                    total = best[which[live], t + 1 - size] + self.score[a.piece[k]]
                    better = total > value[live]
                    w = live[better]
                    value[w], pieces[w] = total[better], count[which[w], t + 1 - size[better]] + 1
                    single[live[size == 1]] = True
                    node[live] = a.shorter[k]
                    live = live[node[live] > 0]
                bare = np.flatnonzero(~single)
                if len(bare):
                    total = best[which[bare], t] + self.unknown
                    better = total > value[bare]
                    w = bare[better]
                    plain = [units[rows[i]][t] for i in which[w].tolist()]
                    value[w], pieces[w] = total[better], count[which[w], t] + np.fromiter((len(c.encode()) for c in plain), dtype=np.int64, count=len(plain))
                best[which, t + 1], count[which, t + 1] = value, pieces
            out[rows] = count[np.arange(n), length]
        return out

    def solved(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.units(units), np.ones(len(units), dtype=np.int64)

    def counts(self, texts: list[str | None]) -> dict[str, object]:
        names: list[str] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, x in enumerate(texts):
            if x:
                own = self.splitter.split(x)
                sizes[i] = len(own)
                names += own
        known = memo(self.key)
        number = known.of(names, self.solved)
        text = np.repeat(np.arange(len(texts)), sizes)
        return {"n_tokens": np.bincount(text, weights=known.flat[number], minlength=len(texts)).astype(np.int64)}


def count(docs: DataFrame, counter: Counter) -> DataFrame:
    found = text_udf("n_tokens long", counter.counts, 1_200_000)
    return docs.select("doc_id", found("text").alias("_found")).select("doc_id", "_found.*")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"), Counter(load(MODEL)))
