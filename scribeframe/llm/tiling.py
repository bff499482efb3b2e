"""Operator 5, benchmark decontamination: greedy string tiling of benchmark items over documents.

Seeds are windows of five words that a document shares with an item: documents' windows that pass a filter of fixed size
over the items' windows are joined with these by their hash. For the pairs whose seeds could cover enough of the item,
greedy tiling marks the longest common stretch that overlaps no tile yet, again and again; running Karp-Rabin hashes find
the longest length by halving. The share of an item's words under tiles tells leaks, in whatever order its parts stand.

Words are lower-cased runs of letters and digits, as Unicode has them. Items of fewer than five words match as a whole;
items without a word match nothing; an item without an id counts like any other, with a null id in its hits. Cases: null
and empty texts and texts without an item's words have no hits; equal stretches are marked in the order of the item, then
of the document; repeated rows get equal hits, and rows with equal id and text of the benchmark are one item; very long
texts are read whole (memory grows with the longest); all columns of the documents stay as they are, whatever their
names; an empty table or an empty benchmark gives no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import PLAIN, U64, Words, backs, mix, powers, slices, table, trim, written
from .lines import LOWEST, bits_set, unused

#: words of a seed and least words of a tile; share of an item's words under tiles that makes a leak
LEAST, COVERAGE = 5, 0.6
#: bits of a window's hash that the filter goes by, as bits_set() has them, at two places; characters of a slice of texts
TOP, SECOND, SLICE = 24, 16, 600_000
#: everything but ASCII and Unicode's letters and digits; ASCII is sorted out by its bytes
OTHER = re.compile(r"[^\w\x00-\x7f]+")


def plain(text: str | None) -> str:
    """The text with spaces for the characters beyond ASCII that are neither letters nor digits."""
    return text if not text or text.isascii() else OTHER.sub(" ", text)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin, the end included."""
    w = Words([plain(x) for x in texts], lower=True, space=PLAIN)
    return w.hash, np.concatenate([[0], np.cumsum(np.bincount(w.text, minlength=len(texts)))])


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words, from sums that run on from window to window."""
    n = len(words)
    if n < size:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(words * powers(n), dtype=U64)])
        return mix((run[size:] - run[:-size]) * backs(n)[: n - size + 1])


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows that no hash of another size equals but by chance."""
    with np.errstate(over="ignore"):
        return mix(rolling(words, size) + U64(size))


def free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(run[size:] == run[:-size])


def seeded(doc: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """The document's words that stand in a window shared with the item; runs of others become one word each that equals
    nothing. No match is lost, and what remains is as long as the shared passages."""
    hit = np.isin(rolling(doc, least), rolling(item, least))
    keep = np.zeros(len(doc) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(keep, at, 1)
    np.add.at(keep, at + least, -1)
    inside = np.cumsum(keep[:-1]) > 0
    border = ~inside & np.concatenate([[False], inside[:-1]])
    out, gap = doc.copy(), np.cumsum(border).astype(U64)
    taken = set(item.tolist())
    free = U64(next(x for x in range(0, 1 << 62, 1 << 40) if not any(x <= t < x + (1 << 40) for t in taken)))
    out[border] = free + gap[border]
    return out[inside | border]


def common(doc: np.ndarray, item: np.ndarray, in_doc: np.ndarray, in_item: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Free windows of a size: places and hashes of the document's that the item has too, and of the item's that it has."""
    i, j = free_windows(in_doc, size), free_windows(in_item, size)
    a, b = rolling(doc, size)[i], rolling(item, size)[j]
    own, other = np.isin(a, b), np.isin(b, a)
    return i[own], a[own], j[other], b[other]


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int]:
    """Words of the item under tiles, and the number of tiles, for two arrays of word hashes."""
    if len(item) < least or len(doc) < least:
        return 0, 0
    doc = seeded(doc, item, least)
    in_doc, in_item = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    tiles, high = 0, min(len(item), len(doc))
    while high >= least:
        low, best = least, None  # the longest size that has a common window: a longer one has all shorter ones
        while low <= high:
            size = (low + high + 1) // 2
            found = common(doc, item, in_doc, in_item, size)
            if len(found[2]):
                low, best = size + 1, (size, found)
            else:
                high = size - 1
        if best is None:
            break
        size, (i, a, j, b) = best
        order = np.argsort(a, kind="stable")
        i, a = i[order], a[order]
        begin, end = np.searchsorted(a, b, side="left"), np.searchsorted(a, b, side="right")
        ahead: dict[int, int] = {}  # of equal windows, the first that may be free
        for y, h, x, stop in zip(j.tolist(), b.tolist(), begin.tolist(), end.tolist(), strict=True):
            x = ahead.get(h, x)
            if not in_item[y : y + size].any():
                while x < stop and in_doc[i[x] : i[x] + size].any():
                    x += 1
                if x < stop:
                    in_item[y : y + size] = in_doc[i[x] : i[x] + size] = True
                    tiles += 1
                ahead[h] = x
        high = size - 1
    return int(in_item.sum()), tiles


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, size): different items with a word; words: their hashes, packed; size: words of their seeds."""
    schema = "item_id long, item long, words binary, size int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), batch.column("item_id")
            h, cut = words_of(texts)
            full = np.flatnonzero(np.diff(cut) > 0)
            size = np.minimum(np.diff(cut)[full], LEAST)
            yield pa.RecordBatch.from_arrays([own.take(pa.array(full)), batch.column("item").take(pa.array(full)), pa.array([h[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()), pa.array(size, pa.int32())], names=["item_id", "item", "words", "size"])

    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return written(rows.withColumn("item", F.xxhash64("item_id", "text")).mapInArrow(run, schema), "items")


def seeds_of(items: DataFrame) -> DataFrame:
    """(seed, item, place, n): the windows of items; n: the item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw, size in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), batch.column("size").to_pylist(), strict=True):
                words = np.frombuffer(raw, dtype=U64)
                seed = windows(words, size)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(len(seed), item)), pa.array(np.arange(len(seed)), pa.int32()), pa.array(np.full(len(seed), len(words)), pa.int32())], names=["seed", "item", "place", "n"])

    return written(items.mapInArrow(run, "seed long, item long, place int, n int"), "seeds")


def candidates(passes: tuple[np.ndarray, np.ndarray], sizes: list[int]):
    """(doc, tag, seeds, words) of the documents with a window that may be an item's."""

    def may_be(window: np.ndarray) -> np.ndarray:
        top, low = ((window >> U64(64 - TOP)).astype(np.int64), (window >> U64(SECOND) & U64((1 << TOP) - 1)).astype(np.int64))
        hit = np.flatnonzero((passes[0][top >> 6] >> (top & 63)) & 1 > 0)
        low = low[hit]
        return hit[(passes[1][low >> 6] >> (low & 63)) & 1 > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for a, b in slices(texts, SLICE):
                h, cut = words_of(texts[a:b])
                of = np.repeat(np.arange(b - a), np.diff(cut))
                text, seed = [], []
                for size in sizes:
                    if len(h) < size:
                        continue
                    window = windows(h, size)
                    hit = may_be(window)
                    hit = hit[of[hit] == of[hit + size - 1]]
                    text.append(of[hit])
                    seed.append(window[hit])
                if not text or not sum(map(len, text)):
                    continue
                text, seed = np.concatenate(text), np.concatenate(seed)
                order = np.lexsort((seed, text))
                text, seed = text[order], seed[order]
                new = np.concatenate([[True], (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])])
                text, seed = text[new], seed[new]
                own = np.unique(text)
                edge = np.searchsorted(text, [*own, b - a])
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(seed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[a:b][own]), pa.array(tag[a:b][own]), lists, pa.array([h[cut[k] : cut[k + 1]].tobytes() for k in own], pa.binary())], names=["doc", "tag", "seeds", "words"])
        trim()

    return run


def tiled(coverage: float):
    """(doc, tag, item_id, coverage, tiles) of the pairs whose tiles cover enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, share, many = [], [], []
            for k, (x, y, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("words", "item_words", "size")), strict=True)):
                doc, item = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                under, tiles = tile(doc, item, size)
                if under >= coverage * len(item):
                    kept.append(k)
                    share.append(under / len(item))
                    many.append(tiles)
            own = batch.select(["doc", "tag", "item_id"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(share, pa.float64()), pa.array(many, pa.int32())], names=["doc", "tag", "item_id", "coverage", "tiles"])
        trim()

    return run


def hits(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, item_id, coverage, tiles): the leaked items of each text; doc and tag as key() gives them."""
    items = items_of(benchmark)
    seeds = seeds_of(items)
    bits = (F.shiftrightunsigned("seed", 64 - TOP), F.shiftrightunsigned("seed", SECOND).bitwiseAND(F.lit((1 << TOP) - 1)))
    passes = tuple(bits_set(seeds.select(x.cast("int").alias("t"))) for x in bits)
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # LEAST values at most
    doc, tag = key(id_col, text_col)
    texts = docs.select(doc.alias("doc"), tag.alias("tag"), F.col(text_col).alias("text")).where("text is not null")
    found = written(texts.mapInArrow(candidates(passes, sizes), "doc long, tag long, seeds array<long>, words binary"), "windows")
    shared = found.select("doc", "tag", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("doc", "tag", "item").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("place")).alias("at"))
    # the words that the seeds cover: an upper bound of what tiles can cover
    size = F.least(F.col("n"), F.lit(LEAST))
    step = F.aggregate(F.slice("at", 2, F.size("at")), F.struct(size.alias("sum"), F.element_at("at", 1).alias("last")), lambda s, x: F.struct((s["sum"] + F.least(x - s["last"], size)).alias("sum"), x.alias("last")))
    pairs = shared.where(step["sum"] >= coverage * F.col("n")).select("doc", "tag", "item")
    texts = found.select("doc", "tag", "words").dropDuplicates(["doc", "tag"])
    both = texts.join(pairs, ["doc", "tag"]).join(items.select("item", "item_id", F.col("words").alias("item_words"), "size"), "item")
    return both.mapInArrow(tiled(coverage), "doc long, tag long, item_id long, coverage double, tiles int")


def key(id_col: str = "doc_id", text_col: str = "text"):
    """What names a document: its id, the least number for null, and a hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def with_hits(docs: DataFrame, benchmark: DataFrame, into: str, coverage: float = COVERAGE) -> DataFrame:
    """docs with an array of (item_id, coverage, tiles), by item: the leaked items of each text. A column ``into`` of docs is
    replaced."""
    docs = docs.drop(into)
    doc, tag = unused(docs.columns, "_doc", "_tag")
    found = hits(docs, benchmark, coverage).groupBy(F.col("doc").alias(doc), F.col("tag").alias(tag)).agg(F.array_sort(F.collect_list(F.struct("item_id", "coverage", "tiles"))).alias(into))
    keyed = docs.withColumns(dict(zip((doc, tag), key(), strict=True))).join(found, [doc, tag], "left")
    none = F.array().cast("array<struct<item_id: bigint, coverage: double, tiles: int>>")
    return keyed.select(*docs.columns, F.coalesce(F.col(into), none).alias(into))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without a leaked item."""
    doc, tag = unused(docs.columns, "_doc", "_tag")
    found = written(hits(docs, benchmark).select(F.col("doc").alias(doc), F.col("tag").alias(tag)).distinct(), "hits")
    own = key()
    return docs.join(found, (own[0] == F.col(doc)) & (own[1] == F.col(tag)), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    doc, tag = key()
    found = hits(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select("doc_id", doc.alias("doc"), tag.alias("tag")).join(found, ["doc", "tag"])
    return rows.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "tiles")
