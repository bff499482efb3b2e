"""Operator 7, quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms with monotonic constraints on chosen features, then flattened into numpy node arrays that
score many rows at once. Base rules come first. Cases: null and empty texts have no words and fail the base rules;
texts are scored alone, so ties and repeated rows give equal verdicts; other input columns are not looked at and not
returned; an empty table gives an empty result; without labelled rows of both kinds the trees keep what the rules keep.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .kernel import MIX_A, MIX_B, SPACE, U64, Words, fold, mix, table, text_udf
from .quality import sample

MIN_WORDS = 50
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
MARK = np.zeros(256, dtype=bool)
MARK[list(b"!?")] = True
#: features, and the direction in which a higher value may move the verdict: -1 only down, 1 only up, 0 either
FEATURES = {"n_words": 0, "mean_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0, "mark_share": -1, "words_a_line": 0, "short_share": 0}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The base counts (long) and the features' values, by text."""
    n, w = len(texts), Words(texts)
    out = {"n_words": np.bincount(w.text, minlength=n)}
    of = np.repeat(np.arange(n), np.diff(w.begin))
    count = lambda mask: np.bincount(of[mask], minlength=n)
    out["word_chars"] = count(~SPACE[w.bytes] & ((w.bytes & 0xC0) != 0x80))
    out["n_symbols"] = count(SYMBOLS[w.bytes])
    doubled = np.zeros(n, dtype=np.int64)
    lines = np.zeros(n, dtype=np.int64)
    for i, x in enumerate(texts):
        seen: set[str] = set()
        for line in x.split("\n") if x else ():
            if line.strip(" \t\r\x0b\x0c"):
                lines[i] += 1
                doubled[i] += line in seen
                seen.add(line)
    out["n_dup_lines"] = doubled
    out["n_repeat_words"] = repeated(w, n)
    words, chars = np.maximum(out["n_words"], 1), np.maximum(out["word_chars"], 1)
    out |= {"mean_chars": chars / words, "symbol_share": out["n_symbols"] / chars, "dup_line_share": doubled / np.maximum(lines, 1), "repeat_share": out["n_repeat_words"] / words}
    out |= {"upper_share": count(UPPER[w.bytes]) / chars, "digit_share": count(DIGIT[w.bytes]) / chars, "mark_share": count(MARK[w.bytes]) / chars}
    return out | {"words_a_line": out["n_words"] / np.maximum(lines, 1), "short_share": np.bincount(w.text[(w.end - w.start) <= 3], minlength=n) / words}


def repeated(w: Words, n: int) -> np.ndarray:
    """Words that stand in a window of three words found twice or more in their text."""
    h = w.hash
    if len(h) < 3:
        return np.zeros(n, dtype=np.int64)
    whole = np.flatnonzero(w.text[:-2] == w.text[2:])
    with np.errstate(over="ignore"):
        key = mix(mix(mix(h[whole] * MIX_A + w.text[whole].astype(U64)) + h[whole + 1]) * MIX_B + h[whole + 2])
    order = np.argsort(key)
    alike = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:]] |= alike
    twice[order[:-1]] |= alike
    hit = np.zeros(len(h), dtype=bool)
    for k in range(3):
        hit[whole[twice] + k] = True
    return np.bincount(w.text[hit], minlength=n)


def matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(stats[f], dtype=np.float64) for f in FEATURES], axis=1) if len(stats["n_words"]) else np.zeros((0, len(FEATURES)))


class Forest:
    """Trees as node arrays, tree after tree; a leaf points to itself."""

    def __init__(self, base: float = 20.0):
        self.base = base
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        self.depth = 0

    def add(self, feature: int = 0, threshold: float = np.inf, value: float = 0.0) -> int:
        at = len(self.feature)
        for column, x in ((self.feature, feature), (self.threshold, threshold), (self.left, at), (self.right, at), (self.value, value)):
            column.append(x)
        return at

    def freeze(self) -> Forest:
        self.feature, self.left, self.right, self.roots = (np.asarray(x, dtype=np.int64) for x in (self.feature, self.left, self.right, self.roots))
        self.threshold, self.value = np.asarray(self.threshold), np.asarray(self.value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            row = np.arange(len(x))[:, None]
            at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at].sum(axis=1)
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 2.0) -> Forest:
    """Boosting of the logistic loss on 32 quantile bins a feature.

    A split on a constrained feature is refused if its children's values are out of order, and the middle of the two
    values bounds all that grows below, so the sum of the trees is monotone in that feature.
    """
    signs = np.array(list(FEATURES.values()))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(float(np.log(share / (1 - share))))
    forest.depth = depth
    margin = np.full(len(x), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        forest.roots.append(forest.add())
        todo = [(forest.roots[-1], np.arange(len(x)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            G, H = g[rows].sum(), h[rows].sum()
            forest.value[node] = float(np.clip(G / (H + 1), low, high)) * rate
            best = (1e-6, None)
            for j in range(x.shape[1]) if level < depth else ():
                k = len(cuts[j]) + 1
                a, b = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=k))[:-1], np.cumsum(np.bincount(binned[rows, j], weights=h[rows], minlength=k))[:-1]
                if not len(a):
                    continue
                lv, rv = np.clip(a / (b + 1), low, high), np.clip((G - a) / (H - b + 1), low, high)
                gain = a * lv - (b + 1) * lv * lv / 2 + (G - a) * rv - (H - b + 1) * rv * rv / 2 - G * G / (H + 1) / 2
                gain[(b < least) | (H - b < least) | ((rv - lv) * signs[j] < 0)] = -np.inf
                if gain.max() > best[0]:
                    at = int(gain.argmax())
                    best = (gain[at], (j, at, lv[at], rv[at]))
            if best[1] is None:
                margin[rows] += forest.value[node]
                continue
            j, at, lv, rv = best[1]
            forest.feature[node], forest.threshold[node] = j, float(cuts[j][at])
            goes = binned[rows, j] <= at
            middle = (lv + rv) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(signs[j])]
            forest.left[node], forest.right[node] = forest.add(), forest.add()
            todo += [(forest.left[node], rows[goes], level + 1, *bounds[0]), (forest.right[node], rows[~goes], level + 1, *bounds[1])]
    return forest.freeze()


def train(rows: list[tuple[str, int]]) -> Forest:
    if len({y for _, y in rows}) < 2:
        return Forest().freeze()
    return grow(matrix(statistics([x for x, _ in rows])), np.array([y for _, y in rows], dtype=np.float64))


def judge(texts: list[str | None], forest: Forest) -> dict[str, object]:
    stats = statistics(texts)
    failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
    score = 1 / (1 + np.exp(-forest.margin(matrix(stats))))
    return {k: stats[k] for k in BASE} | {"base_failed": failed, "kept": ~failed & (score >= 0.5), "score": score}


def apply(docs: DataFrame, forest: Forest) -> DataFrame:
    schema = ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, score double"
    found = text_udf(schema, lambda texts: judge(texts, forest))
    return docs.select("doc_id", found("text").alias("_found")).select("doc_id", "_found.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = train(sample(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels")))
    return apply(docs, forest)
