"""Operator 2, quality classifier: a linear-chain CRF labels every line good or bad.

A line's features are its own and its neighbouring lines' statistics in bins; transitions between line labels are
learned; a text is one chain of lines, however long. Forward-backward marginals, weighted by the lines' lengths, add up to a text's share of good lines, which a
logistic curve fitted on the training rows turns into the score. Cases: very long texts are read whole (memory grows with
the longest); null and empty texts are one empty line and get
that line's score; ties can't occur, since each text is scored alone; other input columns are not inputs of a score;
an empty table gives an empty result; without labelled rows of both kinds every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Words, chain_marginals, fold, mix, slices, table, text_udf, trim

#: bound of the sample of labelled rows that training reads: rows a label, whole texts
SAMPLE_ROWS = 1200
THRESHOLD = 0.3

SHARES = np.array([0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9])
SIZES = np.array([0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 1024])
LENGTHS = np.array([1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14])
EDGES = (SIZES, LENGTHS, *[SHARES] * 9, np.array([0.5]))
BINS = 16
CLASSES = np.zeros(256, dtype=np.int64)  # 0: other ASCII punctuation
CLASSES[[0x20, *range(9, 14)]] = 1
CLASSES[list(range(ord("a"), ord("z") + 1))] = 2
CLASSES[list(range(ord("A"), ord("Z") + 1))] = 3
CLASSES[list(range(ord("0"), ord("9") + 1))] = 4
CLASSES[list(b"#*$%&|<>")] = 5
CLASSES[list(b"!?")] = 6
CLASSES[128:] = 7


def bins(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every line the bins of its statistics; the line's text and weight (bytes of its words)."""
    w = Words(texts)
    lines = len(w.line_start)
    size = w.line_end - w.line_start + 1
    of = np.repeat(np.arange(lines), size)
    n = np.bincount(of * 8 + CLASSES[w.bytes], minlength=lines * 8).reshape(-1, 8).astype(np.float64)
    words = np.bincount(w.line, minlength=lines).astype(np.float64)
    chars = n.sum(axis=1) - n[:, 1]
    full = np.maximum(chars, 1)
    h = w.hash
    key = mix(h ^ (w.line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    inside = np.bincount(w.line[again], minlength=lines) / np.maximum(words, 1)
    key = mix(h ^ (w.text.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)))
    order = np.argsort(key, kind="stable")
    again[:] = False
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    before = np.bincount(w.line[again], minlength=lines) / np.maximum(words, 1)
    with np.errstate(over="ignore"):
        same = np.zeros(lines, dtype=np.uint64)
        np.add.at(same, w.line, mix(h + (np.arange(len(h)) - np.searchsorted(w.line, w.line)).astype(np.uint64)))
    same = mix(same + w.line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, many = np.unique(same, return_inverse=True, return_counts=True)
    single = np.bincount(w.line[(w.end - w.start) <= 3], minlength=lines) / np.maximum(words, 1)
    stats = [words, chars / np.maximum(words, 1), *(n[:, c] / full for c in (0, 3, 4, 5, 6, 7)), inside, before, single, (many[back] > 1) & (words > 0)]
    found = np.stack([np.searchsorted(e, x, side="right") for e, x in zip(EDGES, stats, strict=True)], axis=1)
    return found, w.line_text, np.maximum(chars, 1)


def chains(line_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each text: a text is one chain."""
    first = np.flatnonzero(np.concatenate([[True], line_text[1:] != line_text[:-1]])) if len(line_text) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.concatenate([first, [len(line_text)]])) if len(first) else first


def columns(found: np.ndarray, line_text: np.ndarray) -> np.ndarray:
    """Feature numbers of each line: its own bins, then those of the line before and after; bin 0 where there is none."""
    k = found.shape[1]
    place = np.arange(k) * BINS
    before, after = np.zeros_like(found), np.zeros_like(found)
    alike = line_text[1:] == line_text[:-1]
    before[1:][alike] = found[:-1][alike] + 1
    after[:-1][alike] = found[1:][alike] + 1
    return np.concatenate([found + place, before + place + k * BINS, after + place + 2 * k * BINS], axis=1)


class Model:
    def __init__(self):
        self.weights = np.zeros((3 * len(EDGES) * BINS, 2))
        self.transition = np.zeros((2, 2))
        self.curve = (0.0, 0.0)

    def share(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted share of good lines."""
        found, line_text, weight = bins(texts)
        first, length = chains(line_text)
        good = chain_marginals(self.weights[columns(found, line_text)].sum(axis=1), self.transition, first, length)[:, 1]
        return np.bincount(line_text, weights=good * weight, minlength=len(texts)) / np.maximum(np.bincount(line_text, weights=weight, minlength=len(texts)), 1)

    def score(self, texts: list[str | None]) -> dict[str, object]:
        if not texts:
            return {"score": np.zeros(0), "predicted": np.zeros(0, dtype=np.int32)}
        a, b = self.curve
        found = 1 / (1 + np.exp(-(a * logit(self.share(texts)) + b)))
        return {"score": found, "predicted": (found >= THRESHOLD).astype(np.int32)}


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def sliced_bins(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bins() of many texts, slice by slice: it needs some hundred bytes for each of a slice's characters."""
    parts = [(a, bins(texts[a:b])) for a, b in slices(texts)]
    found, line_text, weight = zip(*((x, at + a, w) for a, (x, at, w) in parts), strict=True)
    return np.concatenate(found), np.concatenate(line_text), np.concatenate(weight)


def train(rows: list[tuple[str, int]], epochs: int = 40, rate: float = 0.1, seed: int = 3) -> Model:
    """From (text, label) rows; a text's lines take its label."""
    model = Model()
    if len({y for _, y in rows}) < 2:
        return model
    rng = np.random.default_rng(seed)
    texts = [x for x, _ in rows]
    found, line_text, weight = sliced_bins(texts)
    first, length = chains(line_text)
    feature = columns(found, line_text)
    truth = np.array([y for _, y in rows])
    gold = truth[line_text]
    squares, moves = np.full_like(model.weights, 1e-4), np.full_like(model.transition, 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(first))
        for a in range(0, len(order), 64):
            picked = order[a : a + 64]
            n = length[picked]
            begin = np.cumsum(n) - n
            at = np.repeat(first[picked] - begin, n) + np.arange(int(n.sum()))
            gamma, expected = chain_marginals(model.weights[feature[at]].sum(axis=1), model.transition, begin, n, gradient=True)
            error = -gamma
            error[np.arange(len(at)), gold[at]] += 1
            error *= np.minimum(weight[at], 400)[:, None] / 100
            grad = np.stack([np.bincount(feature[at].ravel(), weights=np.repeat(error[:, j], feature.shape[1]), minlength=len(model.weights)) for j in (0, 1)], axis=1)
            inner = np.ones(len(at), dtype=bool)
            inner[begin] = False
            here = np.flatnonzero(inner)
            seen = np.zeros((2, 2))
            np.add.at(seen, (gold[at[here - 1]], gold[at[here]]), 1)
            for w, g, s in ((model.weights, grad, squares), (model.transition, seen - expected, moves)):
                g = g / len(picked) - 1e-3 * w
                s += g * g
                w += rate * g / np.sqrt(s)
    x = logit(np.concatenate([model.share(texts[a:b]) for a, b in slices(texts)]))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton's method, slightly shrunk
        p = 1 / (1 + np.exp(-(a * x + b)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((truth - p) * x).sum() - 0.1 * a, (truth - p).sum()])
        step = np.linalg.solve(np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]]), g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    model.curve = (max(a, 0.0), b)
    trim()
    return model


def sample(docs: DataFrame, labels: DataFrame, value: str = "quality") -> list[tuple[str, int]]:
    """A bounded sample of labelled rows, whole texts: the id with the least hash in each of SAMPLE_ROWS slots a label.
    Ids are chosen without the texts; the chosen ones, 2 * SAMPLE_ROWS at most, fetch theirs, the least text of an id
    that repeats. An id with both labels counts for either."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col(value).alias("y")).where("y in (0, 1) and id is not null")
    there = docs.where("text is not null").select(F.col("doc_id").alias("id")).join(marked, "id").withColumn("h", F.xxhash64("id"))
    chosen = there.groupBy("y", F.pmod("h", F.lit(SAMPLE_ROWS)).alias("slot")).agg(F.min(F.struct("h", "id")).alias("x")).select("y", "x.id")
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    found = texts.join(F.broadcast(chosen), "id").groupBy("y", "id").agg(F.min("text").alias("text"))
    return [(r["text"], int(r["y"])) for r in found.select("y", "text").orderBy("y", "text").collect()]


def score(docs: DataFrame, model: Model) -> DataFrame:
    found = text_udf("score double, predicted int", model.score)
    return docs.select("doc_id", found("text").alias("_found")).select("doc_id", "_found.*")


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Learned from the rows whose fold isn't held out."""
    return train(sample(docs.where(fold("doc_id", 5) != 0), labels))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text isn't rejected."""
    name = "_quality"
    while name in docs.columns:
        name += "_"
    found = text_udf("score double, predicted int", model.score)
    return docs.withColumn(name, found("text")).where(F.col(name)["predicted"] == 1).drop(name)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
