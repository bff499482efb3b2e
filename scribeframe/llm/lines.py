"""Operator 10, line dedup: an exact set-similarity join of lines; the later of two matching lines goes.

A line is the set of its lower-cased words. Two lines match if their sets' Jaccard similarity is 0.8 or more; a line is
removed if any line before it, by (doc_id, hash of the text, line number), matches. Lines of fewer than ``least``
different words stay: with the default of 1, only lines without a word.

1. Words are counted over all documents in a table of fixed size; a word's rarity is its slot's count, ties by hash.
   Any total order of words gives an exact join; the counts only make it fast.
2. Equal sets need no join. A task removes the lines whose set it has seen before and hands on each set's earliest
   place, so a line that stands everywhere is one row a batch; the later of those places go, too.
3. Every different line puts its rarest words, as many as the prefix filter asks for, into the posting lists of those
   words, with its length, the word's position and a parity bitmap of its set. A word seen once in the corpus needs no
   list, nor does a line of under UNEQUAL words, which matches equal sets only. The lists of a word seen more than
   OFTEN times are split into bands of lengths, and a line goes into its own band and the next: lengths that can match
   are at most one band apart.
4. Within a list, pairs pass the length filter, the positional filter and the bitmap's bound on the symmetric
   difference, none of which loses a match.
5. Jaccard is verified on the whole sets of 64-bit word hashes. One earlier match removes a line, so every list first
   offers a line's closest few partners. The closest are verified first; lines that these don't remove have the others
   verified, and all partners of lists where they had more, in a second turn over those lists alone.

Cases: null and empty texts have no lines to remove; a null id counts as the least; rows with equal id and text are one
document, so their lines aren't removed for each other; a word repeated in a line counts once; very long texts and
lines are read whole, so that memory grows with the longest text; all other columns stay, whatever their names, but one
named as ``removed`` is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import MIX_A, U64, Words, mix, slices, table, trim, written

#: words of the smallest set that an unequal set can match: 4 of 5
UNEQUAL = 4
#: words of a run where whole texts are compared; runs that have about as many postings as a line
SHINGLE, LINE = 5, 15
#: the highest count that orders words, of the 24 bits that a sort key has for it
MOST_SEEN = (1 << 24) - 1
#: slots of the count table, and how many travel together
SLOTS, SHEET = 1 << 22, 1 << 16
#: postings that a bucket of lists holds on average; those a task holds before it sends them; places it holds at once
BUCKET, HELD, PLACES = 250_000, 250_000, 500_000
#: the count from which a word's lists are split into bands of lengths
OFTEN = 1_000_000
#: partitions of a table of fixed size on its way to the driver, which runs a job for each
FEW = 8
#: partners that a list offers for a line in the first turn; lists that are first compared with their earliest lines
OFFERS, LONG_LIST, PIVOTS = 4, 256, 16
#: pairs compared at once; characters of a slice of texts
PAIRS, SLICE = 200_000, 500_000
FILTER_BITS = 24
POSTING = np.dtype([("tok", "<u8"), ("key", "<u8"), ("b0", "<u8"), ("b1", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("pos", "<i4"), ("n", "<i4"), ("i", "<i4")])
PLACE = np.dtype([("key", "<u8"), ("b0", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("pos", "<i4")])
LOWEST = -(1 << 63)


def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words that two sets of these sizes need for a Jaccard similarity of 0.8: ceil(4 (a + b) / 9)."""
    return (4 * (a + b) + 8) // 9


def band(n: np.ndarray) -> np.ndarray:
    """Bands of set sizes: of two sizes of which neither is over 5/4 of the other, the bands are equal or neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.2500001) + 1e-9).astype(np.int64)


def slot(words: np.ndarray) -> np.ndarray:
    return (words >> U64(64 - 22)).astype(np.int64)


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc"), tag.alias("tag"), F.col(text_col).alias("text"))


class Shingles:
    """Texts as Words gives them, but each text is one line and its words are all runs of SHINGLE words; a shorter text
    is one run."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        w = Words(texts, lower=lower)
        h, n = w.hash, np.bincount(w.text, minlength=len(texts))
        end, at = np.cumsum(n)[w.text], np.arange(len(w.text))
        value = np.zeros(len(h), dtype=U64)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE):
                inside = at + k < end
                value[inside] = mix(value[inside] * MIX_A + h[at[inside] + k])
        own = (at + SHINGLE <= end) | (at == end - n[w.text])
        self.hash, self.line = value[own], w.text[own]
        self.line_start, self.line_text = np.zeros(len(texts), dtype=np.int64), np.arange(len(texts))

    def line_number(self) -> np.ndarray:
        return np.zeros(len(self.line_text), dtype=np.int64)


def counted(reader: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word counts of a partition in compressed sheets; sheet -1 holds the number of lines, or what counts as it."""
        total, lines, held, n = np.zeros(SLOTS, dtype=np.int64), 0, [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, SLICE):
                w = reader(texts[a:b], lower=True)
                lines += len(np.unique(w.line)) if reader is Words else -(-len(w.line) // LINE)
                held.append(slot(w.hash))
                n += len(held[-1])
                if n > SLOTS:
                    total += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=SLOTS)
        yield sheets(total, lines)
        del total, held
        trim()

    return run


def sheets(total: np.ndarray, lines: int) -> pa.RecordBatch:
    """Rows (sheet, raw): the slots in use and their counts; sheet -1 holds the number of lines."""
    number, raw = [-1], [np.int64(lines).tobytes()]
    for k in range(len(total) // SHEET):
        own = total[k * SHEET : (k + 1) * SHEET]
        used = np.flatnonzero(own)
        if len(used):
            number.append(k)
            raw.append(used.astype("<u2").tobytes() + own[used].astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(raw, pa.binary())], names=["sheet", "raw"])


def add(total: np.ndarray, raw: bytes) -> None:
    """Adds a sheet's counts to its part of a table."""
    n = len(raw) // 10
    total[np.frombuffer(raw, dtype="<u2", count=n)] += np.frombuffer(raw, dtype="<i8", offset=2 * n)


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of equal sheets."""
    lines, total = 0, np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for k, raw in zip(batch.column("sheet").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            if k < 0:
                lines += int(np.frombuffer(raw, dtype="<i8")[0])
            else:
                add(total[k * SHEET : (k + 1) * SHEET], raw)
    yield sheets(total, lines)


def rarity(rows: DataFrame, reader: type) -> tuple[np.ndarray, int]:
    """The count table and the number of lines of a corpus; SLOTS bounds what the driver gets."""
    schema = "sheet int, raw binary"
    salts = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    part = rows.select("text").mapInArrow(counted(reader), schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    half = part.repartition("sheet", "salt").select("sheet", "raw").mapInArrow(added, schema)
    total, lines = np.zeros(SLOTS, dtype=np.int64), 0
    for k, raw in half.repartition(FEW, "sheet").mapInArrow(added, schema).toLocalIterator():
        if k < 0:
            lines += int(np.frombuffer(raw, dtype="<i8")[0])
        else:
            add(total[k * SHEET : (k + 1) * SHEET], raw)
    return np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32), lines


def ordered(line: np.ndarray, seen: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by line, count and hash: one sort of what fits 64 bits, then the few ties by the whole hash.
    Counts over MOST_SEEN are equal in every slice, so all slices keep one order of words."""
    seen = np.minimum(seen, MOST_SEEN)
    if not len(h) or int(line[-1]) >= 1 << 20:
        return np.lexsort((h, seen, line))
    short = line.astype(U64) << U64(44) | seen.astype(U64) << U64(20) | h >> U64(44)
    order = np.argsort(short)
    short = short[order]
    alike = short[1:] == short[:-1]
    tied = np.flatnonzero(np.concatenate([[False], alike]) | np.concatenate([alike, [False]]))
    if len(tied):
        own = order[tied]
        order[tied] = own[np.lexsort((h[own], seen[own], short[tied]))]
    return order


class Sets:
    """The lines of some texts as ordered sets of word hashes: ``tok`` line after line, rarest first."""

    def __init__(self, texts: list[str | None], counts: np.ndarray | None, least: int = 1, reader: type = Words):
        w = reader(texts, lower=True)
        h = w.hash
        seen = counts[slot(h)] if counts is not None else np.zeros(len(h), dtype=np.uint32)
        order = ordered(w.line, seen, h)
        line, h, seen = w.line[order], h[order], seen[order]
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, dtype=bool)
        line, h, seen = line[new], h[new], seen[new]
        n = np.bincount(line, minlength=len(w.line_start))
        full = n[line] >= max(least, 1) if len(line) else np.zeros(0, dtype=bool)
        line, self.tok, self.seen = line[full], h[full], seen[full]
        own = np.flatnonzero(n >= max(least, 1))
        self.n = n[own].astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.text, self.pos = w.line_text[own], w.line_number()[own]
        self.row = np.repeat(np.arange(len(own)), self.n)
        self.place = np.arange(len(self.tok)) - np.repeat(self.first, self.n)
        with np.errstate(over="ignore"):
            m = mix(self.tok * MIX_A + U64(1))
            self.key = mix(np.add.reduceat(m, self.first) + self.n.astype(U64)) if len(own) else np.zeros(0, dtype=U64)
            bit, half = U64(1) << (m >> U64(58)), (m >> U64(57)) & U64(1)
            both = (bit * (U64(1) - half), bit * half)
            self.bits = np.stack([np.bitwise_xor.reduceat(x, self.first) for x in both], axis=1) if len(own) else np.zeros((0, 2), dtype=U64)


def posted(counts: np.ndarray, buckets: int, least: int, reader: type):
    """For each partition the postings and places of its different lines, packed by bucket, and the lines that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts, places, row, n, lines = [], [], [], 0, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for a, b in slices(texts, SLICE):
                s = Sets(texts[a:b], counts, least, reader)
                where = np.zeros(len(s.n), dtype=PLACE)
                where["key"], where["b0"], where["doc"], where["tag"], where["pos"] = s.key, s.bits[:, 0], doc[a:b][s.text], tag[a:b][s.text], s.pos
                places.append(where)
                prefix = s.n - (4 * s.n + 4) // 5 + 1
                keep = np.flatnonzero((s.place < np.repeat(prefix, s.n)) & (s.seen > 1) & np.repeat(s.n >= UNEQUAL, s.n))
                often = keep[s.seen[keep] > OFTEN]
                r = s.row[np.concatenate([keep, often])]
                post = np.zeros(len(r), dtype=POSTING)
                post["tok"] = np.concatenate([s.tok[keep], s.tok[often]])
                own = np.concatenate([np.where(s.seen[keep] > OFTEN, band(s.n[s.row[keep]]), -1), band(s.n[s.row[often]]) + 1])
                with np.errstate(over="ignore"):
                    post["tok"] = np.where(own < 0, post["tok"], mix(post["tok"] * MIX_A + own.astype(U64)))
                post["i"], post["n"], post["b1"] = s.place[np.concatenate([keep, often])], s.n[r], s.bits[r, 1]
                for name in PLACE.names:
                    post[name] = where[name][r]
                posts.append(post)
                row.append(r + lines)
                n, lines = n + len(post), lines + len(where)
                if n >= HELD:
                    yield packed(np.concatenate(posts), np.concatenate(row), np.concatenate(places), buckets)
                    posts, places, row, n, lines = [], [], [], 0, 0
        if lines:
            yield packed(np.concatenate(posts), np.concatenate(row), np.concatenate(places), buckets)
        del posts, places, row
        trim()

    return run


def by_place(x: np.ndarray) -> np.ndarray:
    """The order of rows by document, text and line number."""
    doc, tag, pos = (np.ascontiguousarray(x[c]) for c in ("doc", "tag", "pos"))
    order = np.argsort(doc)
    same = doc[order[1:]] == doc[order[:-1]]
    if (tag[order[1:]][same] != tag[order[:-1]][same]).any():
        return np.lexsort((pos, tag, doc))
    rank = np.empty(len(x), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ~same])) if len(x) else 0
    return np.argsort(rank << 32 | pos)


def earliest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places are the first of their set, one for each set; which stand after it (a repeated row is no later place)."""
    order = by_place(x)
    kind = mix(x["key"][order]) ^ x["b0"][order]
    _, at, of = np.unique(kind, return_index=True, return_inverse=True)
    first, later = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    first[order[at]] = True
    lead = order[at[of]]
    later[order] = (x["doc"][order] != x["doc"][lead]) | (x["tag"][order] != x["tag"][lead]) | (x["pos"][order] != x["pos"][lead])
    return first, later


def packed(post: np.ndarray, row: np.ndarray, place: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (kind, bucket, raw): postings and places of different lines (kinds 0 and 1) and lines that go (kind 2)."""
    first, later = earliest(place)
    kind, bucket, raw = [], [], []
    for k, (x, by) in enumerate(((post[first[row]], "tok"), (place[first], "key"))):
        b = (mix(x[by]) % U64(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        x, b = x[order], b[order]
        cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else b
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(b)], strict=False):
            kind.append(k)
            bucket.append(int(b[lo]))
            raw.append(x[lo:hi].tobytes())
    again = place[later]
    if len(again):
        kind.append(2)
        bucket.append(int(mix(again["key"][:1])[0] % U64(buckets)))
        raw.append(again.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(raw, pa.binary())], names=["kind", "bucket", "raw"])


class Lists:
    """Posting lists of one bucket as arrays, by list and length; each set once where its copies lie side by side.
    Lists of one posting are left out. ``time`` is the postings' rank by place."""

    def __init__(self, x: np.ndarray):
        tok = np.ascontiguousarray(x["tok"])
        order = np.argsort(tok)
        new = np.concatenate([[True], tok[order[1:]] != tok[order[:-1]]]) if len(x) else np.zeros(0, dtype=bool)
        number = np.cumsum(new) - 1
        some = np.bincount(number)[number] > 1 if len(x) else new
        x, number = x[order[some]], number[some]
        order = by_place(x)
        x, number = x[order], number[order]
        n, key = np.ascontiguousarray(x["n"]).astype(np.int64), np.ascontiguousarray(x["key"])
        if len(x) and (n.max() >= 1 << 21 or number[-1:].max() >= 1 << 20):
            order = np.lexsort((np.arange(len(x)), key, n, number))
        else:
            order = np.argsort(number.astype(U64) << U64(44) | n.astype(U64) << U64(23) | key >> U64(41), kind="stable")
        x, number, key = x[order], number[order], key[order]
        keep = np.concatenate([[True], (number[1:] != number[:-1]) | (key[1:] != key[:-1]) | (x["b0"][1:] != x["b0"][:-1])]) if len(x) else np.zeros(0, dtype=bool)
        self.rows, self.time, number = x[keep], order[keep], number[keep]
        self.n, self.i = (np.ascontiguousarray(self.rows[c]).astype(np.int64) for c in ("n", "i"))
        self.key, self.b0, self.b1 = (np.ascontiguousarray(self.rows[c]) for c in ("key", "b0", "b1"))
        self.begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, dtype=np.int64)
        self.ends = np.concatenate([self.begin, [len(number)]])
        self.size = np.diff(self.ends)
        self.number = np.repeat(np.arange(len(self.begin)), self.size)

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs pass the length, positional and bitmap filters; their differing bits."""
        na, nb = self.n[a], self.n[b]
        common = need(na, nb)
        ok = np.flatnonzero((np.minimum(na - self.i[a], nb - self.i[b]) >= common) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)))
        a, b = a[ok], b[ok]
        bits = np.bitwise_count(self.b0[a] ^ self.b0[b]).astype(np.int64) + np.bitwise_count(self.b1[a] ^ self.b1[b])
        good = (bits <= (na + nb)[ok] - 2 * common[ok]) & ((self.key[a] != self.key[b]) | (self.b0[a] != self.b0[b]))
        return ok[good], bits[good]


def partners(x: np.ndarray):
    """The first turn over one bucket's lists: (earlier, later, rank) of the pairs it offers, and postings of the lists in
    which a later line has more partners than those."""
    lists = Lists(x)
    x, time, begin = lists.rows, lists.time, lists.begin
    over = np.zeros(len(begin), dtype=bool)
    # lists of common size: every posting with those after it that are not too long; the positional filter on the
    # shorter of two lines alone bounds the other's length
    most = np.minimum(lists.n * 5 // 4, (9 * (lists.n - lists.i)) // 4 - lists.n)
    level = lists.number.astype(np.int64) << 32
    high = np.searchsorted(level | lists.n, level | np.maximum(most, 0), side="right")
    many = np.where((lists.size > LONG_LIST)[lists.number], 0, np.maximum(high - np.arange(len(x)) - 1, 0)) if len(x) else np.zeros(0, dtype=np.int64)
    cut = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(cut[lists.ends], cut[lists.ends[at]] + PAIRS, side="right")) - 1)
        lo, hi = lists.ends[at], lists.ends[to]
        if cut[hi] > cut[lo]:
            a = np.repeat(np.arange(lo, hi), many[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(cut[lo:hi] - cut[lo], many[lo:hi])
            ok, bits = lists.near(a, b)
            if len(ok):
                early, late, nth, more = closest(time, a[ok], b[ok], bits)
                over[lists.number[more]] = True
                yield x[early], x[late], nth, None
        at = to
    for k in np.flatnonzero(lists.size > LONG_LIST).tolist():
        # lines like one of the earliest are offered those; the others are compared with all
        own = begin[k] + np.argsort(time[begin[k] : lists.ends[k + 1]], kind="stable")
        a, b = np.repeat(own[:PIVOTS], len(own)), np.tile(own, min(PIVOTS, len(own)))
        late = time[a] < time[b]
        a, b = a[late], b[late]
        ok, bits = lists.near(a, b)
        done = np.isin(own, b[ok])
        over[k] |= done.any()
        early, late, nth, _ = closest(time, a[ok], b[ok], bits)
        yield x[early], x[late], nth, None
        for early, late, bits in against_all(lists, own, np.flatnonzero(~done)):
            early, late, nth, more = closest(time, early, late, bits)
            over[k] |= len(more) > 0
            yield x[early], x[late], nth, None
    kept = over[lists.number]
    if kept.any():
        yield x[:0], x[:0], np.zeros(0, dtype=np.int64), x[kept]


def against_all(lists: Lists, own: np.ndarray, which: np.ndarray):
    """For some lines of a list in order of place, by their numbers: all pairs with earlier lines that pass the filters."""
    at = 0
    while at < len(which):
        to = max(at + 1, int(np.searchsorted(np.cumsum(which[at:]), PAIRS, side="right")) + at)
        b = np.repeat(which[at:to], which[at:to])
        a = np.arange(len(b)) - np.repeat(np.cumsum(which[at:to]) - which[at:to], which[at:to])
        a, b = own[a], own[b]
        ok, bits = lists.near(a, b)
        yield a[ok], b[ok], bits
        at = to


def closest(time: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray):
    """The OFFERS closest earlier partners of each later line and their rank; the later lines that have more."""
    swap = time[a] > time[b]
    early, late = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((time[early], bits, late))
    early, late = early[order], late[order]
    start = np.flatnonzero(np.concatenate([[True], late[1:] != late[:-1]])) if len(late) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.concatenate([start, [len(late)]])) if len(late) else start
    nth = np.arange(len(late)) - np.repeat(start, count)
    near = nth < OFFERS
    return early[near], late[near], nth[near], late[start[count > OFFERS]]


def all_partners(x: np.ndarray, targets: np.ndarray):
    """The second turn over kept lists: (earlier, later) of all pairs whose later line is a target."""
    lists = Lists(x)
    wanted = among(targets, lists.key)
    for lo, hi in zip(lists.ends[:-1].tolist(), lists.ends[1:].tolist(), strict=True):
        if wanted[lo:hi].any():
            own = lo + np.argsort(lists.time[lo:hi], kind="stable")
            for early, late, _ in against_all(lists, own, np.flatnonzero(wanted[own])):
                yield lists.rows[early], lists.rows[late], np.zeros(len(late), dtype=np.int64), None


def top_bits(x: np.ndarray) -> np.ndarray:
    return (x >> U64(64 - FILTER_BITS)).astype(np.int64)


def place_hash(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(doc.astype(np.int64).view(U64) * MIX_A + tag.astype(np.int64).view(U64)) + pos.astype(U64) + U64(1))


NAMES = {"kind": pa.int32(), "key": pa.int64(), "other": pa.int64(), "doc": pa.int64(), "tag": pa.int64(), "pos": pa.int32(), "nth": pa.int32(), "place": pa.int64(), "other_place": pa.int64(), "raw": pa.binary(), "places": pa.binary()}
ARROW = pa.schema(list(NAMES.items()))
RESULT = "kind int, key long, other long, doc long, tag long, pos int, nth int, place long, other_place long, raw binary, places binary"
PAIR, GONE, LIST = 0, 1, 2


def result(kind: int, n: int, **columns: np.ndarray | list) -> pa.RecordBatch:
    """A batch of RESULT; columns that aren't given are null."""
    signed = lambda c: c.copy().view(np.int64) if isinstance(c, np.ndarray) and c.dtype == U64 else c
    full = {"kind": np.full(n, kind, dtype=np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(signed(full[k]), t) if k in full else pa.nulls(n, t) for k, t in NAMES.items()], schema=ARROW)


def pairs_of(found) -> Iterator[pa.RecordBatch]:
    """Rows of kind PAIR, with the later line's place, and of kind LIST for kept lists, with the places of their lines."""
    for early, late, nth, kept in found:
        if len(early):
            order = np.argsort(nth, kind="stable")
            with np.errstate(over="ignore"):
                own = order[np.unique(mix(late["key"] * MIX_A + early["key"])[order], return_index=True)[1]]
            early, late = early[own], late[own]
            yield result(PAIR, len(own), key=late["key"], other=early["key"], nth=nth[own].astype(np.int32), **{c: late[c].copy() for c in ("doc", "tag", "pos")}, place=place_hash(late["doc"], late["tag"], late["pos"]), other_place=place_hash(early["doc"], early["tag"], early["pos"]))
        if kept is not None:
            cut = np.flatnonzero(np.concatenate([[True], kept["tok"][1:] != kept["tok"][:-1]])).tolist()
            for lo, hi in zip(cut, [*cut[1:], len(kept)], strict=True):
                own = kept[lo:hi]
                bits = np.unique(top_bits(place_hash(own["doc"], own["tag"], own["pos"]))).astype("<i4")
                yield result(LIST, 1, raw=[own.tobytes()], places=[bits.tobytes()])


def gone_of(x: np.ndarray) -> pa.RecordBatch:
    return result(GONE, len(x), **{c: x[c].copy() for c in ("doc", "tag", "pos")})


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First turn, bucket after bucket: pairs, lists for the second turn, and lines that go, as their set stood before."""
    held: list[bytes] = []
    size, now = 0, (None, None)

    def flush(last: bool):
        nonlocal held, size
        if not held:
            return
        kind, raw = now[0], b"".join(held)
        held, size = [], 0
        if kind == 0:
            yield from pairs_of(partners(np.frombuffer(raw, dtype=POSTING)))
        else:  # the earliest place of each set waits for the rest of the bucket
            x = np.frombuffer(raw, dtype=PLACE)
            first, later = earliest(x)
            yield gone_of(x[later])
            if not last:
                held = [x[first].tobytes()]

    for batch in batches:
        for kind, b, raw in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            if kind == 2:
                yield gone_of(np.frombuffer(raw, dtype=PLACE))
                continue
            if (kind, b) != now:
                yield from flush(True)
                now = (kind, b)
            held.append(raw)
            size += len(raw)
            if kind == 1 and size > PLACES * PLACE.itemsize:
                yield from flush(False)
    yield from flush(True)
    trim()


def rejoined(targets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                yield from pairs_of(all_partners(np.frombuffer(raw, dtype=POSTING), targets))

    return run


def first_turn(rows: DataFrame, counts: np.ndarray, lines: int, least: int, reader: type) -> DataFrame:
    buckets = max(8, -(-lines * 9 // BUCKET))
    posts = rows.mapInArrow(posted(counts, buckets, least, reader), "kind int, bucket int, raw binary")
    dealt = posts.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    return written(dealt.mapInArrow(joined, RESULT), "pairs")


def bit_table(values: DataFrame) -> np.ndarray:
    """Which values the first bits of the column ``v`` take: a table of fixed size."""
    return bits_set(values.select(F.shiftrightunsigned("v", 64 - FILTER_BITS).cast("int").alias("t")))


def bits_set(top: DataFrame) -> np.ndarray:
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    words = top.groupBy(F.shiftright("t", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, t % 64)")).alias("x")).toArrow()
    out[words["w"].to_numpy()] = words["x"].to_numpy()
    return out


def among(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in a table of bits_set()."""
    t = top_bits(values)
    return (table[t >> 6] >> (t & 63)) & 1 > 0


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.frombuffer(x, dtype="<i4") for x in batch.column("places").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)) if own else np.zeros(0, dtype="<i4"), pa.int32())], names=["t"])


def sets_of(first: np.ndarray, second: np.ndarray, reader: type):
    """The word sets of the lines whose place is in one of two tables, and whether it is in the first; other lines aren't
    taken apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            many = np.fromiter(((x.count("\n") + 1 if reader is Words else 1) if x else 0 for x in texts), dtype=np.int64, count=len(texts))
            text = np.repeat(np.arange(len(texts)), many)
            pos = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
            place = place_hash(batch.column("doc").to_numpy()[text], batch.column("tag").to_numpy()[text], pos)
            early = among(first, place)
            hit = np.flatnonzero(early | among(second, place))
            early = early[hit]
            lines: list[str] = []
            for t, own in zip(*_grouped(text[hit], pos[hit]), strict=True):
                parts = texts[t].split("\n") if reader is Words else [texts[t]]
                lines += [parts[p] for p in own]
            for a, b in slices(lines, SLICE):
                s = Sets(lines[a:b], None, UNEQUAL, reader)
                size = np.concatenate([[0], np.cumsum(s.n)])
                yield pa.RecordBatch.from_arrays([pa.array(early[a:b][s.text]), pa.array(s.key.view(np.int64)), pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(s.tok.view(np.int64)))], names=["early", "id", "words"])
        trim()

    return run


def _grouped(text: np.ndarray, pos: np.ndarray) -> tuple[list[int], list[list[int]]]:
    if not len(text):
        return [], []
    cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    return text[cut].tolist(), [x.tolist() for x in np.split(pos, cut[1:])]


def sets_in(rows: DataFrame, pairs: DataFrame, lists: DataFrame, reader: type) -> DataFrame:
    """(early, id, words) of all lines that stand in a pair or in a kept list, and of a few others; early: those that the
    pairs of rank 0 need. A line may come twice."""
    top = lambda p: p.select(F.explode(F.array("place", "other_place")).alias("v")).select(F.shiftrightunsigned("v", 64 - FILTER_BITS).cast("int").alias("t"))
    first = bits_set(top(pairs.where("nth = 0")))
    second = bits_set(top(pairs.where("nth > 0")).union(lists.select("places").mapInArrow(unpacked, "t int")))
    return written(rows.mapInArrow(sets_of(first, second, reader), "early boolean, id long, words array<long>"), "sets")


def needed(ids: np.ndarray):
    """The sets whose id is in a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(ids, batch.column("id").to_numpy().view(U64))))

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, doc, tag, pos) of lines with an earlier line of Jaccard similarity 0.8 or more among their pairs."""
    left = pairs.select("key", "other", "doc", "tag", "pos").distinct().join(sets.select(F.col("id").alias("key"), F.col("words").alias("x")), "key")
    both = left.join(sets.select(F.col("id").alias("other"), F.col("words").alias("y")), "other")
    enough = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    return both.where(enough).select("key", "doc", "tag", "pos").distinct()


def removals(rows: DataFrame, least: int = 1, reader: type = Words) -> DataFrame:
    """(doc, tag, removed): the numbers of the lines that go, for documents that lose any; ``rows`` as from tagged().

    A pair's postings are those of the earliest place of either set, so the later line's place is the one to remove;
    a set's other places go because their set stood before."""
    counts, lines = rarity(rows, reader)
    found = first_turn(rows, counts, lines, least, reader)
    pairs, again, lists = (found.where(F.col("kind") == k) for k in (PAIR, GONE, LIST))
    sets = sets_in(rows, pairs, lists, reader)
    nearest, others = (pairs.where(c).select("key", "other", "doc", "tag", "pos") for c in ("nth = 0", "nth > 0"))
    similar = written(verified(nearest, sets.where("early")), "similar")
    gone = again.select("doc", "tag", "pos").union(similar.select("doc", "tag", "pos"))
    # lines that are still there, once their closest partners have failed: their other partners, and all of kept lists
    left = written(nearest.select("key").distinct().join(similar, "key", "left_anti"), "left")
    if not left.isEmpty():
        rest = lists.select("raw").repartition(F.xxhash64("raw")).mapInArrow(rejoined(bit_table(left.select(F.col("key").alias("v")))), RESULT)
        rest = others.union(rest.select(others.columns)).distinct().join(left, "key", "left_semi").join(nearest.select("key", "other"), ["key", "other"], "left_anti")
        rest = written(rest, "pairs")
        ids = bit_table(rest.select(F.explode(F.array("key", "other")).alias("v")))
        gone = gone.union(verified(rest, sets.mapInArrow(needed(ids), sets.schema)).select("doc", "tag", "pos"))
    return gone.groupBy("doc", "tag").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def unused(names: list[str], *wanted: str) -> list[str]:
    """Column names that aren't among ``names``."""
    low = {n.lower() for n in names}
    while low & {w.lower() for w in wanted}:
        wanted = tuple(f"_{w}" for w in wanted)
    return list(wanted)


def deduplicated(docs: DataFrame, text: str = "text", removed: str = "removed_lines", id_col: str = "doc_id", least: int = 1) -> DataFrame:
    """docs without the lines that go; ``removed``: their numbers, from 0. All other columns stay as they are; a column
    named as ``removed`` is replaced."""
    lost = written(removals(tagged(docs, id_col, text), least), "removals")
    names = [c for c in docs.columns if c.lower() != removed.lower()]
    doc, tag, numbers = unused(docs.columns, "_doc", "_tag", "_gone")
    keyed = docs.select(*names).withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)), tag: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    lost = lost.select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("removed").alias(numbers))
    gone = F.coalesce(F.col(numbers), F.array().cast("array<int>"))
    return keyed.join(lost, [doc, tag], "left").select(*[without(F.col(text), gone).alias(text) if c == text else F.col(c) for c in names], gone.alias(removed))


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text has no near copy before it by (doc_id, text): a Jaccard similarity of 0.8
    or more of the sets of runs of SHINGLE words, by the same exact join. Rows without an id stay."""
    doc, tag = unused(docs.columns, "_doc", "_tag")
    gone = removals(tagged(docs.where("doc_id is not null")), 1, Shingles).select(F.col("doc").alias(doc), F.col("tag").alias(tag))
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(tag)), "left_anti")


def without(text: Column, gone: Column) -> Column:
    """The text less some of its lines."""
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")
    return F.when(F.size(gone) == 0, text).otherwise(rest)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    found = deduplicated(docs.withColumn("n_lines", n_lines.cast("int")))
    return found.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed"))
