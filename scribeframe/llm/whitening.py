"""Operator 13, embedding whitening: hierarchical SVD merging.

A vector's entries c become whole numbers floor(256 c); vectors that are null or hold a null or non-finite entry go. The fit
list holds each different vector once. Every partition of it keeps its number of vectors, their exact sums, and all
singular values and right singular vectors of its centred rows, found a chunk of rows at a time; two such summaries merge
by stacking both triangles and one row that corrects for the difference of the means, and a new SVD of the stack. No
direction is cut off, so the last summary is that of one SVD over all rows. Merges run as a tree of ``FAN`` summaries a
task; what reaches the driver is one summary of d x d numbers, whatever the number of vectors.

Cases: vectors of several lengths are different vectors, filled up with zeros to the longest; an empty vector is one of
zeros; components without variance (constant vectors, fewer vectors than dimensions) have a null ``whitened`` and take no
part in ``identity_error``; a ``deviation`` over 2^63 - 1 is null; equal eigenvalues keep any orthogonal basis of theirs;
of the two signs the one with a positive largest entry is taken; repeated rows give equal values and count once in the
fit; rows without an id are kept; other columns, whatever their names, are not read; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import table, written

SCALE = 256
#: rows of a chunk, summaries that one task merges, components that the query returns
CHUNK, FAN, COMPONENTS = 4096, 16, 4
SUMMARY = "node long, n long, sums array<long>, values array<double>, vectors array<double>"
SAFE = float(1 << 62)


@dataclass
class Summary:
    """Of n centred vectors: their exact sums, and singular values with the right singular vectors as rows."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def widened(self, d: int) -> Summary:
        more = d - len(self.sums)
        if not more:
            return self
        return Summary(self.n, np.concatenate([self.sums, np.zeros(more, dtype=np.int64)]), self.values, np.pad(self.vectors, ((0, 0), (0, more))))


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not rows.size:
        return np.zeros(0), np.zeros((0, rows.shape[1]))
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def of_rows(x: np.ndarray) -> Summary:
    n = len(x)
    sums = x.sum(axis=0) if not x.size or np.abs(x).max() < SAFE / n else np.array([sum(c) for c in x.T.tolist()])
    return Summary(n, sums.astype(np.int64), *decomposed(x - sums / n))


def merged(a: Summary, b: Summary) -> Summary:
    d = max(len(a.sums), len(b.sums))
    a, b = a.widened(d), b.widened(d)
    n = a.n + b.n
    correction = math.sqrt(a.n * b.n / n) * (a.sums / a.n - b.sums / b.n)
    stack = np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, correction[None, :]])
    return Summary(n, np.array([int(p) + int(q) for p, q in zip(a.sums, b.sums, strict=True)], dtype=np.int64), *decomposed(stack))


def padded(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of a matrix of whole numbers, filled up with zeros."""
    d = max(map(len, vectors), default=0)
    if all(len(v) == d for v in vectors):
        return np.array(vectors, dtype=np.int64).reshape(len(vectors), d)
    return np.array([np.pad(v, (0, d - len(v))) for v in vectors], dtype=np.int64)


def whole(vector: Column) -> Column:
    """floor(256 c) of each entry as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite entries only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & finite)


def frame(node: int, s: Summary) -> pd.DataFrame:
    return pd.DataFrame({"node": [node], "n": [s.n], "sums": [s.sums], "values": [s.values], "vectors": [s.vectors.ravel()]})


def summary(row) -> Summary:
    sums = np.asarray(row.sums, dtype=np.int64)
    values = np.asarray(row.values_, dtype=np.float64)
    return Summary(int(row.n), sums, values, np.asarray(row.vectors, dtype=np.float64).reshape(len(values), len(sums)))


def summaries(fit: DataFrame) -> DataFrame:
    """A summary of each partition of a table of vectors ``x``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, rest = None, []
        for batch in batches:
            rest += list(batch["x"])
            while len(rest) >= CHUNK:
                part = of_rows(padded(rest[:CHUNK]))
                own, rest = merged(own, part) if own else part, rest[CHUNK:]
        if rest:
            part = of_rows(padded(rest))
            own = merged(own, part) if own else part
        if own:
            yield frame(TaskContext.get().partitionId(), own)

    return fit.select("x").mapInPandas(run, SUMMARY)


def merge_round(nodes: DataFrame) -> DataFrame:
    """One level of the tree: FAN summaries become one."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = None
        for row in part.sort_values("node").rename(columns={"values": "values_"}).itertuples():
            out = merged(out, summary(row)) if out else summary(row)
        return frame(int(part["node"].min()) // FAN, out)

    return nodes.groupBy(F.floor(F.col("node") / FAN)).applyInPandas(run, SUMMARY)


@dataclass
class Whitening:
    """n vectors and their sums; all components by falling variance ``e``; ``flat`` marks those without any."""

    n: int
    sums: np.ndarray
    e: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    @property
    def flat(self) -> np.ndarray:
        return self.e <= (self.e.max(initial=0.0) * (len(self.e) * np.finfo(float).eps) ** 2 + 0.0)

    @property
    def explained(self) -> np.ndarray:
        total = self.e.sum()
        return self.e / total if total > 0 else np.zeros(len(self.e))

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """Coordinates of rows of whole numbers on the first k components, NaN on those without variance."""
        scale = np.where(self.flat[:k], np.nan, np.sqrt(self.e[:k]))
        return self.centred(x)[0] @ self.components[:k].T / scale

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """x less the mean, and the exact sum of squares of n x - S for each row."""
        x = np.pad(x, ((0, 0), (0, max(0, len(self.sums) - x.shape[1]))))[:, : len(self.sums)]
        rough = np.abs(x).max(initial=0) * float(self.n) + np.abs(self.sums).max(initial=0)
        if rough < SAFE and rough * rough * max(1, x.shape[1]) < SAFE:
            apart = self.n * x - self.sums
            return apart / self.n, (apart * apart).sum(axis=1).tolist()
        sums = self.sums.tolist()
        exact = [[self.n * v - s for v, s in zip(row, sums, strict=True)] for row in x.tolist()]
        squares = [sum(v * v for v in row) for row in exact]
        return np.array([[v / self.n for v in row] for row in exact]), [s if s < 1 << 63 else None for s in squares]


def fitted(fit: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """From a table of different vectors ``x``; None where it is empty. A second pass measures how far the covariance of
    the whitened vectors on the first k components is from the identity."""
    nodes = written(summaries(fit), "svd-summaries")
    most = nodes.agg(F.max("node")).first()[0]
    if most is None:
        return None
    while most > 0:
        nodes, most = merge_round(nodes), most // FAN
    (row,) = nodes.withColumnRenamed("values", "values_").collect()
    s = summary(row)
    d = len(s.sums)
    vectors = s.vectors
    if len(vectors) < d:  # fewer vectors than dimensions: any basis of the rest
        vectors = np.vstack([vectors, np.linalg.svd(vectors, full_matrices=True)[2][len(vectors) :]]) if len(vectors) else np.eye(d)
    e = np.concatenate([s.values**2 / s.n, np.zeros(d - len(s.values))])
    sign = np.sign(vectors[np.arange(d), np.abs(vectors).argmax(axis=1)]) if d else np.ones(0)
    model = Whitening(s.n, s.sums, e, vectors * sign[:, None])
    good = int((~model.flat[:k]).sum())
    if good:
        cov = covariance(fit, model, good)
        model.identity_error = float(np.abs(cov - np.eye(good)).max())
    return model


def covariance(fit: DataFrame, model: Whitening, k: int) -> np.ndarray:
    """The covariance over the fit list of the whitened vectors, added up by Spark from the partitions' sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            if len(batch):
                w = model.whitened(padded(list(batch["x"])), k)
                total += w.T @ np.column_stack([w, np.ones(len(w))])
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": total.ravel()})

    sums = np.zeros((k, k + 1))
    for r in fit.select("x").mapInPandas(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        sums[r.i, r.j] = r.value
    mean = sums[:, k] / model.n
    return sums[:, :k] / model.n - np.outer(mean, mean)


def fit_list(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each different vector of whole numbers once, in a written table."""
    return written(usable(rows, vector).select(whole(F.col(vector)).alias("x")).distinct(), "fit-list")


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding", k: int | None = None) -> DataFrame:
    """For each usable row and component up to k (all without one): id, component, n, deviation, whitened, explained,
    identity_error."""
    k = min(len(model.e), len(model.e) if k is None else k)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            x = padded(list(vectors))
            deviation = pd.Series(model.centred(x)[1], dtype="Int64")
            yield pd.DataFrame({"deviation": deviation, "whitened": list(model.whitened(x, k))})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    own = usable(rows, vector).select(id_col, F.pandas_udf(run, "deviation long, whitened array<double>")(whole(F.col(vector))).alias("_own"))
    out = own.select(id_col, "_own.deviation", F.posexplode("_own.whitened").alias("_at", "_value"))
    explained = F.element_at(F.array(*[F.lit(float(v)) for v in model.explained[:k]]).cast("array<double>"), F.col("_at") + 1) if k else F.lit(0.0)
    whitened = F.when(~F.isnan("_value"), F.col("_value"))
    return out.select(id_col, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", whitened.alias("whitened"), explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fitted(fit_list(rows)) or Whitening(0, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, 0)))
    return whiten(rows, model, k=COMPONENTS)
