"""Operator 12, source divergence audit: how far the word use of a language's sources lies apart.

A term is a run of bytes that are ASCII letters or part of a longer UTF-8 character, with A-Z lower-cased. A numpy table
over the concatenated UTF-8 of a slice of texts finds the runs' borders; xxhash groups the runs, and every run is compared
byte by byte with its group's first, so that a collision splits off. A CSR matrix of texts and terms gives counts and
numbers of texts by language and source, which Spark adds up. Terms in at least ``least`` texts of a language are kept.

Kept counts are dealt out by language and hash of the term, a block to a task, with the totals of all the language's
sources beside them: every block is a CSR matrix of sources and terms, and reduceat over it gives its share of each
pair's distance and its best candidates for the sources' own terms. A term that a source lacks has the same probability
there whatever the term, so absent terms are counted, not enumerated. Probabilities are whole numbers of 1e-9, found by
long division, so no sum is rounded.

Cases: null text, language and source are read as empty; a source without terms, or a language that keeps none, still has
its pairs, at distance 0 for the latter; ties go by the UTF-8 order of the items; repeated rows count each time; very long
texts are read whole (memory grows with the longest); other columns, whatever their names, are not read; an empty table
gives an empty result. Sums are exact up to 9e15 occurrences of a language's kept terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import slices, table, trim, written

LEAST, PRIOR, TOP, UNIT = 30, 5, 50, 1_000_000_000
#: characters of a slice; kept rows of a block, over all languages
SLICE, BLOCK = 2_000_000, 100_000
INSIDE = np.array([b > 127 or chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class Terms:
    """The terms of some texts: ``doc`` and ``term`` of each occurrence, and the bytes of each different term."""

    def __init__(self, texts: list[str | None], digest: Callable[[bytes], int] = xxhash.xxh64_intdigest):
        encoded = [x.encode() if x else b"" for x in texts]
        size = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        data = LOWER[np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)]
        inside = np.concatenate([[False], INSIDE[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(np.cumsum(size + 1), start, side="right")
        raw = data.tobytes()
        hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(start))
        _, first, self.term = np.unique(hashes, return_index=True, return_inverse=True)
        other = np.flatnonzero(~equal(data, start, end - start, first[self.term]))
        names = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        number: dict[bytes, int] = {}
        for i in other.tolist():  # same hash as another term
            own = raw[start[i] : end[i]]
            if own not in number:
                number[own] = len(names)
                names.append(own)
            self.term[i] = number[own]
        self.names = names


def equal(data: np.ndarray, start: np.ndarray, size: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Whether each slice holds the bytes of the slice numbered ``model``."""
    same = size == size[model]
    rows = np.flatnonzero(same)
    many = size[rows]
    begin = np.cumsum(many) - many
    within = np.arange(int(many.sum())) - np.repeat(begin, many)
    differs = data[np.repeat(start[rows], many) + within] != data[np.repeat(start[model[rows]], many) + within]
    if len(rows):
        same[rows] = np.add.reduceat(differs, begin, dtype=np.int64) == 0
    return same


def summed(texts: list[str | None], group: np.ndarray) -> tuple[Terms, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and for each group and term that occur: their numbers, occurrences and texts. The counts of texts and terms
    form a CSR matrix whose rows are added up by group."""
    terms = Terms(texts)
    wide = max(len(terms.names), 1)
    cell, count = np.unique(terms.doc * wide + terms.term, return_counts=True)
    doc, column = cell // wide, cell % wide
    key = group[doc] * wide + column
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.diff(key[order], prepend=-1))
    if not len(at):
        return terms, *(np.zeros(0, dtype=np.int64),) * 4
    n = np.add.reduceat(count[order], at)
    docs = np.diff(at, append=len(order))
    return terms, key[order][at] // wide, key[order][at] % wide, n, docs


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each language, source and term; a row with the empty term for each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, sources = (batch.column(k).to_pylist() for k in ("text", "lang", "source"))
            for a, b in slices(texts, SLICE):
                number: dict[tuple[str, str], int] = {}
                group = np.array([number.setdefault(k, len(number)) for k in zip(langs[a:b], sources[a:b], strict=True)], dtype=np.int64)
                terms, at, column, n, own = summed(texts[a:b], group)
                names = np.array([*terms.names, b""], dtype=object)
                keys = list(number)
                at = np.concatenate([at, np.arange(len(keys))])
                column, zero = np.concatenate([column, np.full(len(keys), len(terms.names))]), np.zeros(len(keys), dtype=np.int64)
                pick = lambda k: pa.array(np.array([x[k] for x in keys], dtype=object)[at], pa.string())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pick(0), pick(1), pa.array(names[column], pa.binary()).cast(pa.string()), pa.array(np.concatenate([n, zero]), pa.int64()), pa.array(np.concatenate([own, zero]), pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        trim()

    text = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    partial = text.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """counted() of the terms that stand in at least ``least`` texts of their language, with ``lead``, which is 1 in one
    row of each of the language's terms; a row with the empty term for each source. A written table."""
    term = Window.partitionBy("lang", "term")
    rows = counted(docs).withColumn("of", F.sum("docs").over(term)).withColumn("lead", ((F.min("source").over(term) == F.col("source")) & (F.col("term") != "")).cast("long"))
    return written(rows.where((F.col("of") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n", "lead"), "term-counts")


def totals(kept: DataFrame) -> DataFrame:
    """(lang, source, own, all, terms): occurrences of kept terms in a source and in its language, and the language's terms."""
    by_lang = Window.partitionBy("lang")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.sum("lead").alias("lead"))
    return sums.select("lang", "source", "own", F.sum("own").over(by_lang).alias("all"), F.sum("lead").over(by_lang).alias("terms"))


def share(count: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * count / of), digit by digit; count <= of."""
    out, rest = np.zeros(len(count), dtype=np.int64), count.astype(np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def block_shares(kept: pd.DataFrame, sources: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """What one block of a language's terms adds: (part, source, item, value), pairs with source < item, and for each
    source the ``top`` terms that it uses more than the language does."""
    sources = sources.sort_values("source", kind="stable").reset_index(drop=True)
    names = sources["source"].to_numpy(dtype=object)
    own, size = sources["own"].to_numpy(dtype=np.int64), len(sources)
    every, many = int(sources["all"].iloc[0]), int(sources["terms"].iloc[0])
    kept = kept[kept["term"] != ""]
    terms, column = np.unique(kept["term"].to_numpy(dtype=object), return_inverse=True) if len(kept) else (np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64))
    row = pd.Index(names).get_indexer(kept["source"].to_numpy(dtype=object)) if len(kept) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], kept["n"].to_numpy(dtype=np.int64)[order]
    begin = np.searchsorted(row, np.arange(size + 1))
    full = np.flatnonzero(np.diff(begin))
    below = np.maximum(own + PRIOR * many, 1)
    absent = share(np.full(size, PRIOR), below) if many else np.ones(size, dtype=np.int64)
    p = share(n + PRIOR, below[row])

    def by_row(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size, dtype=np.int64)
        if len(full):
            out[full] = np.add.reduceat(x, begin[full])
        return out

    found = []
    for i in range(size if len(terms) else 0):
        a, b = begin[i], begin[i + 1]
        dense = np.full(len(terms), absent[i])
        dense[column[a:b]] = p[a:b]
        at = dense[column]
        # every term as if absent from the other source, which is put right where it isn't
        ranked = np.sort(p[a:b])
        running = np.concatenate([[0], np.cumsum(ranked)])
        k = np.searchsorted(ranked, absent)
        base = absent * k - running[k] + (running[-1] - running[k]) - absent * (len(ranked) - k) + (len(terms) - len(ranked)) * np.abs(absent - absent[i])
        value = base + by_row(np.abs(p - at) - np.abs(absent[row] - at))
        found.append(value[i + 1 :])
    if not len(terms):
        found = [np.zeros(size - i - 1, dtype=np.int64) for i in range(size)]
    left = np.repeat(np.arange(size), np.arange(size - 1, -1, -1))
    right = np.concatenate([np.arange(i + 1, size) for i in range(size)]) if size else left
    pairs = pd.DataFrame({"part": "pair", "source": names[left], "item": names[right], "value": np.concatenate(found)})
    if not len(terms):
        return pairs
    lang = np.bincount(column, minlength=len(terms))  # entries of each term
    by_term = np.argsort(column, kind="stable")
    common = share(np.add.reduceat(n[by_term], np.cumsum(lang) - lang) + PRIOR, every + PRIOR * many)
    gain = p - common[column]
    use = np.flatnonzero((n > 0) & (gain > 0))
    use = use[np.lexsort((column[use], -gain[use], row[use]))]  # columns are in the order of code points, UTF-8's order
    place = np.arange(len(use)) - np.searchsorted(row[use], row[use])
    use = use[place < top]
    return pd.concat([pairs, pd.DataFrame({"part": "term", "source": names[row[use]], "item": terms[column[use]], "value": gain[use]})], ignore_index=True)


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) over a table with text, lang and source."""
    kept = kept_counts(docs, least)
    blocks = max(1, -(-kept.count() // block))
    dealt = kept.where("term <> ''").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    sources = totals(kept).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = block_shares(left, right, top)
        out.insert(0, "lang", key[0])
        return out

    both = dealt.groupBy("lang", "block").cogroup(sources.groupBy("lang", "block")).applyInPandas(run, "lang string, part string, source string, item string, value long")
    half = both.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))  # a term stands in one block only
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    turned = half.withColumn("way", F.explode(F.slice(ways, F.lit(1), F.when(F.col("part") == "pair", 2).otherwise(1))))
    out = turned.select("lang", "way.source", "part", "way.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    return out.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
lang AS (SELECT d.lang, coalesce(any_value(v), 0) AS v, coalesce(any_value(n), 0) AS n
  FROM d LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) x USING (lang) GROUP BY d.lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(x.n), 0) AS n
  FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) x USING (lang, source) GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * lang.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (kept.n + 5)) // (lang.n + 5 * lang.v)::HUGEINT AS q
  FROM g JOIN lang USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(x.value), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT p.lang, p.source, o.source AS item, sum(abs(p.p - o.p)) AS value
    FROM p JOIN p o ON p.lang = o.lang AND p.term = o.term AND p.source <> o.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
