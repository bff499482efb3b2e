"""Phrase search over many transcripts: exact and normalised hits with times, context, and approximate hits."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribeframe.functions.text import KANA, LONG_VOWEL, fold, folded_ranges, folding
from scribeframe.operators.intervals import binned

#: characters of a bin of the join of hits and units
BIN = 64
# The work that approximate matching may take for a transcript (characters x window lengths x phrase
# length squared), the share by which a window's length may differ, its phrase's longest form.
MOST_COST, SPAN, MOST_CHARS = 300_000_000, 0.2, 64


def folded(units: DataFrame) -> DataFrame:
    """units (doc, seg, pos, idx, text, ...) with the folded text ``f``, its offset ``a`` in the transcript's stream, and
    ``after_kana``: whether the stream before ends in kana, which makes leading dashes long vowel marks."""
    before = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    lead, body = folding(F.coalesce("text", F.lit("")))
    rows = units.withColumns({"_lead": lead, "_body": body})
    kana = F.last(F.when(F.col("_body") != "", F.col("_body").rlike(f"[{KANA}]\\z")), True).over(before)
    rows = rows.withColumn("after_kana", F.coalesce(kana, F.lit(False)))
    rows = rows.withColumn("f", F.when(F.col("after_kana"), F.concat(F.repeat(F.lit(LONG_VOWEL), F.col("_lead")), "_body")).otherwise(F.col("_body")))
    return rows.drop("_lead", "_body").withColumn("a", F.coalesce(F.sum(F.length("f")).over(before), F.lit(0)))


def stream_of(units: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("idx", "f")))
    return units.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["f"]), "").alias("stream"))


def spots(units: DataFrame, phrase: str) -> DataFrame:
    """(doc, hit, p): offsets of the leftmost non-overlapping occurrences of a folded phrase."""
    parts = F.split("stream", rf"\Q{phrase}\E", -1)
    cut = stream_of(units).where(F.col("stream").contains(phrase)).select("doc", F.size(parts).alias("n"), F.posexplode(parts).alias("hit", "x"))
    before = Window.partitionBy("doc").orderBy("hit").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("p", F.sum(F.length("x")).over(before) + F.col("hit") * len(phrase)).where("hit < n - 1").select("doc", "hit", "p")


def covered_by(spans: DataFrame, units: DataFrame) -> DataFrame:
    """A row for each unit that a span (doc, p, q, ...) of the stream covers."""
    u = units.where(F.length("f") > 0).withColumn("_z", F.col("a") + F.length("f"))
    return binned(spans, u, ["doc"], ("p", "q"), ("a", "_z"), BIN).drop("_z")


def hit_units(units: DataFrame, phrase: str) -> DataFrame:
    """A row for each unit that a hit covers: (doc, hit, unit columns)."""
    if not phrase:
        raise ValueError("the folded phrase is empty")
    return covered_by(spots(units, phrase).withColumn("q", F.col("p") + len(phrase)), units).drop("q")


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, after_kana: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """The text from where its folded character ``first`` begins to where ``last`` ends; a null goes to that end of it."""

    def cut(text, kana, a, b):
        at = folded_ranges(text, bool(kana))
        return text[None if pd.isna(a) else at[int(a)][0] : None if pd.isna(b) else at[int(b)][1]]

    return pd.Series([cut(*x) for x in zip(texts, after_kana, first, last, strict=True)], dtype=object)


def stretch(u: Column, p: Column, q: Column) -> Column:
    """The raw text that the folded characters p to q of the stream come from: ``u`` holds the units in order, each with its
    text, its offset ``a``, and whether a space stands before it."""
    n, first, last = F.size(u), F.get(u, F.lit(0)), F.element_at(u, -1)
    none = F.lit(None).cast("long")
    head = _cut(first["text"], first["after_kana"], p - first["a"], F.when(n == 1, q - 1 - first["a"]))
    tail = _cut(last["text"], last["after_kana"], none, q - 1 - last["a"])
    space = lambda x: F.when(x["space"], " ").otherwise("")
    between = F.array_join(F.transform(F.slice(u, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda x: F.concat(space(x), x["text"])), "")
    return F.when(n == 1, head).otherwise(F.concat(head, between, space(last), tail))


def find(units: DataFrame, phrase: str) -> DataFrame:
    """Hits: times of the covered units, match and timing labels, word numbers, segments, speaker, the exact stretch of text.

    ``units``: (doc, seg, pos, idx, s, e, text, role, timed) and perhaps ``space``, whether white space stands before a unit,
    which holds for all but the first without that column; ``timed`` is false for segments without words.
    """
    if "space" not in units.columns:
        units = units.withColumn("space", F.lit(True))
    covered = hit_units(folded(units), fold(phrase))
    bare = "".join(phrase.split())
    row = F.array_sort(F.collect_list(F.struct("idx", "text", "seg", "role", "space", "a", "after_kana")))
    out = covered.groupBy("doc", "hit", "p").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.every("timed").alias("timed"), row.alias("u"), F.count_distinct(F.coalesce("role", F.lit("\0"))).alias("speakers"), F.min("seg").alias("seg"), F.max("seg").alias("last_seg"))
    joined = F.array_join(F.transform("u", lambda x: x["text"]), "")
    return out.select(
        "doc", "hit", "start", "end",
        F.when(F.regexp_replace(joined, r"\s", "").contains(bare), F.lit("exact")).otherwise(F.lit("normalized")).alias("match"),
        F.when(F.col("timed"), "word").otherwise("segment").alias("timing"),
        F.when(F.col("timed"), F.col("first")).alias("first_word"), F.when(F.col("timed"), F.col("last")).alias("last_word"),
        "seg", "last_seg", F.when(F.col("speakers") == 1, F.col("u")[0]["role"]).alias("speaker"),
        stretch(F.col("u"), F.col("p"), F.col("p") + len(fold(phrase))).alias("text"),
    )


def with_context(hits: DataFrame, segments: DataFrame, n: int = 1) -> DataFrame:
    """Texts of the ``n`` segments before a hit's first and after its last segment, in order. One look over the segments
    gives each its neighbours; a hit meets its first and its last segment."""
    w = Window.partitionBy("doc").orderBy("seg")
    listed = lambda frame: F.array_join(F.collect_list("text").over(frame), " | ")
    near = segments.select("doc", "seg", listed(w.rowsBetween(-n, -1)).alias("before"), listed(w.rowsBetween(1, n)).alias("after"))
    ends = hits.select("doc", "hit", F.explode(F.array(F.struct(F.col("seg"), F.lit(0).alias("side")), F.struct(F.col("last_seg").alias("seg"), F.lit(1).alias("side")))).alias("x")).select("doc", "hit", "x.seg", "x.side")
    both = ends.join(near, ["doc", "seg"])
    return both.groupBy("doc", "hit").agg(F.max(F.when(F.col("side") == 0, F.col("before"))).alias("before"), F.max(F.when(F.col("side") == 1, F.col("after"))).alias("after"))


def lengths(m: int) -> range:
    """Lengths of the windows that a phrase of m folded characters is compared with."""
    low = max(1, round(m * (1 - SPAN)))
    return range(low, max(low, round(m * (1 + SPAN))) + 1)


def cost(characters: int, m: int) -> int:
    """The work of approximate matching in a stream; a request refuses transcripts over MOST_COST."""
    return characters * len(lengths(m)) * m * m


def approximate(stream: str, phrase: str, threshold: float, exact: list[int]) -> list[tuple[int, int, float]]:
    """(start, end, ratio) of windows near the phrase's length: the best for each start, then the best that don't overlap
    each other or an exact hit. A window that doesn't share enough characters with the phrase isn't compared: counts of
    the phrase's characters in all windows of a length come from running sums and bound the ratio."""
    n, m = len(stream), len(phrase)
    free = np.ones(n, dtype=bool)
    for p in exact:
        free[p : p + m] = False
    limit = np.minimum.accumulate(np.where(free, n, np.arange(n))[::-1])[::-1] if n else np.zeros(0, dtype=np.int64)
    code = np.frombuffer(stream.encode("utf-32-le"), dtype=np.uint32)
    sums = [(phrase.count(c), np.concatenate([[0], np.cumsum(code == ord(c))])) for c in dict.fromkeys(phrase)]
    best: dict[int, tuple[float, int]] = {}
    matcher = SequenceMatcher(None, "", phrase, autojunk=False)
    for size in lengths(m):
        if size > n:
            break
        start = np.flatnonzero(np.arange(size, n + 1) <= limit[: n - size + 1])
        shared = sum((np.minimum(k, run[start + size] - run[start]) for k, run in sums), np.zeros(len(start), dtype=np.int64))
        for a in start[2.0 * shared / (size + m) >= threshold].tolist():
            matcher.set_seq1(stream[a : a + size])
            r = matcher.ratio()
            if threshold <= r < 1 and (a not in best or r > best[a][0]):
                best[a] = (r, a + size)
    out: list[tuple[int, int, float]] = []
    for a, (r, b) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
        if free[a:b].all():
            free[a:b] = False
            out.append((a, b, r))
    return sorted(out)


def find_fuzzy(units: DataFrame, phrase: str, threshold: float) -> DataFrame:
    """Approximate hits (doc, p, q, ratio, start, end, first_word, last_word, seg, last_seg, speaker, timing, text), transcript by
    transcript."""
    wanted = fold(phrase)
    if not 0.5 <= threshold <= 1 or not 0 < len(wanted) <= MOST_CHARS:
        raise ValueError(f"threshold 0.5 to 1, phrase of 1 to {MOST_CHARS} folded characters")
    u = folded(units if "space" in units.columns else units.withColumn("space", F.lit(True)))

    def run(batches):
        for part in batches:
            rows = []
            for doc, stream in zip(part["doc"], part["stream"], strict=True):
                exact, at = [], stream.find(wanted)
                while at >= 0:
                    exact.append(at)
                    at = stream.find(wanted, at + len(wanted))
                rows += [(doc, a, b, round(r, 4)) for a, b, r in approximate(stream, wanted, threshold, exact)]
            yield pd.DataFrame(rows, columns=["doc", "p", "q", "ratio"])

    spans = stream_of(u).mapInPandas(run, "doc long, p long, q long, ratio double")
    row = F.array_sort(F.collect_list(F.struct("idx", "text", "space", "a", "after_kana")))
    speaker = F.when(F.count_distinct(F.coalesce("role", F.lit("\0"))) == 1, F.min("role"))
    found = covered_by(spans, u).groupBy("doc", "p", "q", "ratio").agg(
        F.min("s").alias("start"), F.max("e").alias("end"), F.min("idx").alias("first_word"), F.max("idx").alias("last_word"), F.min("seg").alias("seg"), F.max("seg").alias("last_seg"), F.every("timed").alias("_timed"), speaker.alias("speaker"), row.alias("_u"),
    )
    return found.withColumns({"timing": F.when(F.col("_timed"), "word").otherwise("segment"), "text": stretch(F.col("_u"), F.col("p"), F.col("q"))}).drop("_u", "_timed")


def summary(units: DataFrame, hits: DataFrame) -> DataFrame:
    per_seg = units.groupBy("doc", "seg").agg(F.count(F.when(F.col("timed"), 1)).alias("n"))
    docs = per_seg.groupBy("doc").agg(F.count("*").alias("segments"), F.sum("n").alias("words"), F.every(F.col("n") > 0).alias("word_timed"))
    return docs.join(hits.groupBy("doc").agg(F.count("*").alias("hits")), "doc", "left").na.fill({"hits": 0})
