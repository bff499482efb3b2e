"""Operator 1, language identification: a linear-chain CRF labels words of code-switched text.

Features of a word are its character n-grams, its affixes and the languages in whose lexicon it stands; transitions are
learned. A line is one chain, however long. Labels of words come from forward-backward; a text's language is the one with
most expected letters. Cases: very long texts and lines are read whole (memory grows with the longest text); null texts and texts without a letter give ``und`` with score 0; ties go to the first language in code-point order;
other input columns are not looked at and not returned, so they can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U64, chain_marginals, fold, mix, powers, slices, table, text_udf

BUCKETS = 1 << 16
#: bound of the sample of labelled rows that training reads: rows a language, whole texts
SAMPLE_ROWS = 120
LEXICON_MIN = 3
AFFIX = (1, 2, 3)
GRAMS = (1, 2, 3)

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters (general category L) and the marks that continue a word."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


class Spans:
    """Words (runs of letters) of lower-cased texts as places in an array of code points; a line's words are a chain."""

    def __init__(self, texts: list[str | None]):
        lowered = [x.lower() if x else "" for x in texts]
        self.code = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lowered])]).astype(np.int64)
        inside = letter_table()[self.code]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.size = self.end - self.start
        line = np.searchsorted(np.flatnonzero(self.code == 10), self.start)
        self.text = np.searchsorted(begin, self.start, side="right") - 1
        n = len(self.start)
        self.first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if n else np.zeros(0, dtype=np.int64)
        self.length = np.diff(np.concatenate([self.first, [n]])) if n else self.first

    def words(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        begin = np.cumsum(self.size) - self.size
        within = np.arange(int(self.size.sum())) - np.repeat(begin, self.size)
        with np.errstate(over="ignore"):
            value = (self.code[np.repeat(self.start, self.size) + within].astype(U64) + U64(1)) * powers(int(self.size.max()) + 1)[within + 1]
            return mix(np.add.reduceat(value, begin) + self.size.astype(U64))

    def features(self, which: np.ndarray):
        """For some words: hashed n-grams (an array for each n, BUCKETS where there is none) with the words' first
        places, and hashed affixes."""
        start, size = self.start[which], self.size[which]
        begin = np.cumsum(size) - size
        at = np.repeat(start - begin, size) + np.arange(int(size.sum()))
        left = np.repeat(start + size, size) - at  # characters up to the word's end, itself included
        last = len(self.code) - 1
        code = lambda i: (self.code[np.minimum(i, last)].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        bucket = lambda h, tag, there: np.where(there, (mix(h + U64(tag)) & U64(BUCKETS - 1)).astype(np.int64), BUCKETS)
        with np.errstate(over="ignore"):
            gram, by_place, by_word = np.zeros(len(at), dtype=U64), [], []
            for k in GRAMS:
                gram = gram * U64(0x100000001B3) + code(at + k - 1)
                by_place.append(bucket(gram, k, left >= k))
            pre, suf = np.zeros(len(size), dtype=U64), np.zeros(len(size), dtype=U64)
            for k in AFFIX:
                pre = pre * U64(0x100000001B3) + code(start + k - 1)
                suf = suf * U64(0x100000001B3) + code(np.maximum(start + size - k, start))
                by_word += [bucket(pre, 11_000 + k, size >= k), bucket(suf, 23_000 + k, size >= k)]
        return by_place, begin, by_word


class Model:
    """Weights with a last row of zeros for absent features."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.weights = np.zeros((BUCKETS + 1, k), dtype=np.float32)
        self.lexicon_weights = np.zeros((k, k), dtype=np.float32)
        self.transition = np.zeros((k, k), dtype=np.float32)
        self.lexicon_key = np.zeros(1, dtype=U64)  # sorted
        self.lexicon_bits = np.zeros((1, k), dtype=np.float32)

    def lexicon(self, word: np.ndarray) -> np.ndarray:
        """Which languages know each word."""
        at = np.minimum(np.searchsorted(self.lexicon_key, word), len(self.lexicon_key) - 1)
        return self.lexicon_bits[at] * (self.lexicon_key[at] == word)[:, None]

    def emissions(self, spans: Spans) -> np.ndarray:
        """Of all words; the features of equal words are summed once."""
        word, which, again = np.unique(spans.words(), return_index=True, return_inverse=True)
        by_place, begin, by_word = spans.features(which)
        out = self.lexicon(word) @ self.lexicon_weights
        out += np.add.reduceat(sum(np.take(self.weights, v, axis=0) for v in by_place), begin, axis=0)
        for value in by_word:
            out += np.take(self.weights, value, axis=0)
        return out[again]

    def score(self, texts: list[str | None]) -> dict[str, object]:
        n, k = len(texts), len(self.labels)
        spans = Spans(texts)
        share = np.zeros((n, max(k, 1)))
        if len(spans.start) and k:
            marginal = chain_marginals(self.emissions(spans), self.transition, spans.first, spans.length)
            for j in range(k):
                share[:, j] = np.bincount(spans.text, weights=marginal[:, j] * spans.size, minlength=n)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        known = total > 0
        part = np.divide(share[np.arange(n), best], total, out=np.zeros(n), where=known)
        return {"lang_pred": [self.labels[b] if f else "und" for b, f in zip(best, known, strict=True)], "score": np.clip(part, 0, 1)}


def lexicon(lines: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words seen LEXICON_MIN times or more, by hash, and which languages have a fifth or more of a word's uses."""
    words, spoken = [], []
    for a, b in slices([x for x, _ in lines]):
        spans = Spans([x for x, _ in lines[a:b]])
        words.append(spans.words())
        spoken.append(np.array([y for _, y in lines[a:b]], dtype=np.int64)[spans.text])
    key, at = np.unique(np.concatenate([np.zeros(0, dtype=U64), *words]), return_inverse=True)
    seen = np.bincount(at * k + np.concatenate([np.zeros(0, dtype=np.int64), *spoken]), minlength=len(key) * k).reshape(-1, k)
    often = seen.sum(axis=1) >= LEXICON_MIN
    if not often.any():
        return np.zeros(1, dtype=U64), np.zeros((1, k), dtype=np.float32)
    return key[often], (seen >= 0.2 * seen.sum(axis=1, keepdims=True))[often].astype(np.float32)


def train(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 0.25, seed: int = 7) -> Model:
    """From (text, language) rows. Chains for training mix lines of several rows, so that changes of language occur."""
    labels = sorted({x for _, x in rows})
    model = Model(labels)
    if len(labels) < 2:
        return model
    rng = np.random.default_rng(seed)
    lines = [(line, labels.index(lang)) for text, lang in rows for line in text.split("\n") if line.strip()]
    model.lexicon_key, model.lexicon_bits = lexicon(lines, len(labels))
    squares = np.full_like(model.weights, 1e-6)
    lex_squares, move_squares = np.full_like(model.lexicon_weights, 1e-6), np.full_like(model.transition, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(lines))
        for a in range(0, len(order), 200):
            picked = [lines[i] for i in order[a : a + 200]]
            texts, spoken, at = [], [], 0
            while at < len(picked):  # a third of the chains go on in another row's line
                take = 1 + int(rng.random() < 0.33)
                texts.append(" ".join(x for x, _ in picked[at : at + take]))
                spoken.append(picked[at : at + take])
                at += take
            spans = Spans(texts)
            if not len(spans.start):
                continue
            gold = np.empty(len(spans.start), dtype=np.int64)
            per_text = np.bincount(spans.text, minlength=len(texts))
            at = 0
            for parts, n in zip(spoken, per_text.tolist(), strict=True):
                cut = n if len(parts) == 1 else len(Spans([parts[0][0]]).start)
                gold[at : at + cut], gold[at + cut : at + n] = parts[0][1], parts[-1][1]
                at += n
            word = spans.words()
            by_place, _, by_word = spans.features(np.arange(len(word)))
            gamma, expected = chain_marginals(model.emissions(spans), model.transition, spans.first, spans.length, gradient=True)
            error = -gamma
            error[np.arange(len(gold)), gold] += 1
            grad = np.zeros_like(model.weights)
            spread = np.repeat(error, spans.size, axis=0)
            for j in range(len(labels)):
                column = np.zeros(BUCKETS + 1)
                for value in by_place:
                    column += np.bincount(value, weights=spread[:, j], minlength=BUCKETS + 1)
                for value in by_word:
                    column += np.bincount(value, weights=error[:, j], minlength=BUCKETS + 1)
                grad[:, j] = column
            grad[BUCKETS] = 0
            inner = np.ones(len(gold), dtype=bool)
            inner[spans.first] = False
            here = np.flatnonzero(inner)
            seen_moves = np.zeros_like(model.transition)
            np.add.at(seen_moves, (gold[here - 1], gold[here]), 1)
            for w, g, s in ((model.weights, grad, squares), (model.lexicon_weights, model.lexicon(word).T @ error, lex_squares), (model.transition, seen_moves - expected, move_squares)):
                g = g / len(gold) - 1e-6 * w
                s += g * g
                w += rate * g / np.sqrt(s)
    model.weights[BUCKETS] = 0
    return model


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most SAMPLE_ROWS rows a language, by a hash of the text: a bounded sample of whole texts."""
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    cut = known.select("lang", "text", F.xxhash64("text").alias("h"))
    # the least hash in each of SAMPLE_ROWS slots a language: tasks keep one text a slot, so no task gathers a language
    small = cut.groupBy("lang", F.pmod("h", F.lit(SAMPLE_ROWS)).alias("slot")).agg(F.min(F.struct("h", "text")).alias("x"))
    return [(r["text"], r["lang"]) for r in small.select("lang", "x.text").orderBy("lang", "text").collect()]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = text_udf("lang_pred string, score double", model.score, 1_200_000)
    return docs.select(F.col(id_col).alias("doc_id"), found(F.col(text_col)).alias("_found")).select("doc_id", "_found.*")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(sample(docs.where(fold("doc_id", 4) != 2)))
    found = predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
