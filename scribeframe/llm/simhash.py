"""Operator 6, SimHash near-dedup: a binary trie self-join of 64-bit fingerprints, pruned by the Hamming error budget.

Two fingerprints with at most four differing bits agree in one of five blocks of bits, in two of six, in three of seven.
The different fingerprints are dealt out by the values of each choice of blocks, of more of them the more fingerprints
there are, so that a part stays small; every part holds a binary trie over its other bits. Pairs of nodes are walked
together: a step takes both to their children and adds one error where the bits differ; pairs over the budget go no
further. A part that has very many fingerprints all the same is split into pairs of chunks. Links become components of
the least ids.

Cases: very long texts are read whole (memory grows with the longest); null and empty texts have fingerprint zero and are linked like any other; texts with fewer than four words hash
the whole sequence; equal fingerprints link, so repeated rows share a component; other input columns are not looked at;
an empty table gives an empty result; rows without an id take part in no link but get their fingerprint's component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import labels
from .kernel import table, text_udf, trim, written

SHINGLE, SEED, BUDGET = 4, 42, 4
#: fingerprints of one part that a task handles at once; more are split into pairs of chunks
CHUNK = 20_000
#: fingerprints of a part on average, from which parts are made by one more block
PART = 5_000
#: rows that a task gathers before it walks their tries; size of a node pair that is compared directly; pairs a step
GATHER, DIRECT, STEP = 60_000, 64, 1_000_000


def fingerprints(texts: list[str | None]) -> dict[str, object]:
    """The fingerprint of each text, as a signed 64-bit integer."""
    raw = [b" ".join(x.encode().lower().split()) if x else b"" for x in texts]
    out = np.zeros(len(raw), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = np.zeros(len(raw), dtype=np.int64)
    for i, x in enumerate(raw):
        if not x:
            continue
        space = np.flatnonzero(np.frombuffer(x, dtype=np.uint8) == 32)
        if len(space) < SHINGLE - 1:
            own = [digest(x, SEED)]
        else:
            begin = [0, *(space[: len(space) - SHINGLE + 1] + 1).tolist()]
            end = [*space[SHINGLE - 1 :].tolist(), len(x)]
            own = [digest(x[a:b], SEED) for a, b in zip(begin, end, strict=True)]
        sizes[i] = len(own)
        hashes += own
    full = np.flatnonzero(sizes)
    if len(full):
        h = np.array(hashes, dtype=np.uint64)
        first = np.cumsum(sizes[full]) - sizes[full]
        ones = np.empty((len(full), 64), dtype=np.int64)
        for byte in range(8):  # one byte of the hashes at a time bounds the memory
            bits = np.unpackbits(((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        bit = 2 * ones > sizes[full][:, None]
        out[full] = (bit.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
    return {"fp": out}


def choices(agreeing: int) -> list[tuple[tuple[int, int], ...]]:
    """All choices of ``agreeing`` of BUDGET + agreeing blocks of bits: (first bit from the top, bits) of each block."""
    many = BUDGET + agreeing
    edge = [64 * k // many for k in range(many + 1)]
    return list(combinations([(a, b - a) for a, b in zip(edge[:-1], edge[1:], strict=True)], agreeing))


def enough(n: int) -> int:
    """How many blocks have to agree so that a part of n fingerprints holds PART on average."""
    agreeing = 1
    while agreeing < 4 and n >> min(sum(w for _, w in c) for c in choices(agreeing)) > PART:
        agreeing += 1
    return agreeing


def arranged(fp: np.ndarray, choice: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Fingerprints with the bits of some blocks moved to the front, the others after them."""
    edge = [0, *(x for a, w in choice for x in (a, a + w)), 64]
    rest = [(a, b - a) for a, b in zip(edge[0::2], edge[1::2], strict=True) if b > a]
    out, at = np.zeros_like(fp), 0
    for a, w in (*choice, *rest):
        at += w
        part = (fp << np.uint64(a)) >> np.uint64(64 - w)
        out |= part << np.uint64(64 - at)
    return out


def pairs(value: np.ndarray, group: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs with at most BUDGET differing bits among values with equal group, which agree in their first
    ``width`` bits. Input is sorted by group and value; ``value`` is unsigned."""
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    low, high = new, np.concatenate([new[1:], [len(value)]])
    # depth, ranges of the first and of the second node, errors so far
    todo = [(width, low, high, low, high, np.zeros(len(low), dtype=np.int8))]
    while todo:
        depth, al, ah, bl, bh, errors = todo.pop()
        if len(al) > STEP:
            half = len(al) // 2
            todo += [(depth, al[:half], ah[:half], bl[:half], bh[:half], errors[:half]), (depth, al[half:], ah[half:], bl[half:], bh[half:], errors[half:])]
            continue
        direct = ((ah - al) * (bh - bl) <= DIRECT) | (depth >= 64)
        if direct.any():
            yield from compared(value, al[direct], ah[direct], bl[direct], bh[direct])
            al, ah, bl, bh, errors = (x[~direct] for x in (al, ah, bl, bh, errors))
        if not len(al):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        am, bm = split(value, al, ah, bit), split(value, bl, bh, bit)
        same = (al == bl) & (ah == bh)
        sides = []
        for a0, a1, b0, b1, cost, keep in ((al, am, bl, bm, 0, True), (am, ah, bm, bh, 0, True), (al, am, bm, bh, 1, True), (am, ah, bl, bm, 1, ~same)):
            go = (a1 > a0) & (b1 > b0) & (errors + cost <= BUDGET) & keep
            sides.append((a0[go], a1[go], b0[go], b1[go], errors[go] + np.int8(cost)))
        todo.append((depth + 1, *(np.concatenate(x) for x in zip(*sides, strict=True))))


def split(value: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the bit turns to one in ranges whose values agree in all bits before it: binary search in all ranges at once."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        one = (value[np.minimum(mid, len(value) - 1)] & bit) != 0
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)


def compared(value, al, ah, bl, bh) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of small ranges (and of ranges of equal values at the last bit), in steps."""
    width = bh - bl
    many = (ah - al) * width
    cut = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + STEP, side="right")) - 1)
        which = np.repeat(np.arange(at, to), many[at:to])
        nth = np.arange(len(which)) - np.repeat(cut[at:to] - cut[at], many[at:to])
        i, j = al[which] + nth // width[which], bl[which] + nth % width[which]
        near = (i < j) & (np.bitwise_count(value[i] ^ value[j]) <= BUDGET) | (j < i) & (al[which] != bl[which]) & (np.bitwise_count(value[i] ^ value[j]) <= BUDGET)
        yield i[near], j[near]
        at = to


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]], rank: np.ndarray) -> np.ndarray:
    """For each of n places the place of least rank that links lead to; links are taken as they come and forgotten."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            low = np.where(rank[a] <= rank[b], a, b)
            high = a + b - low
            order = np.argsort(-rank[low], kind="stable")  # the least comes last and stays
            root[high[order]] = low[order]
            while True:  # to the roots
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def linked(agreeing: int):
    """Links between ids of one partition's fingerprints, sorted by part; as many as join them, not all pairs."""

    def solve(block, part, fp, rep):
        for b, choice in enumerate(choices(agreeing)):
            own = block == b
            if not own.any():
                continue
            v, g, r = arranged(fp[own].astype(np.int64).view(np.uint64), choice), part[own], rep[own]
            _, g = np.unique(g, return_inverse=True)
            order = np.lexsort((v, g))
            v, g, r = v[order], g[order], r[order]
            root = forest(len(v), pairs(v, g, sum(w for _, w in choice)), r)
            moved = np.flatnonzero(r[root] < r)
            yield pa.RecordBatch.from_arrays([pa.array(r[moved]), pa.array(r[root][moved])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            if not held:
                return
            whole = pa.Table.from_batches(held)
            part = whole["part"].to_numpy()
            keep = len(part) if last else int(np.searchsorted(part, part[-1]))  # sorted by part: the last may go on
            held.clear()
            if keep < len(part):
                held.extend(whole.slice(keep).to_batches())
            if keep:
                yield from solve(*(whole.slice(0, keep)[c].to_numpy() for c in ("block", "part", "fp", "rep")))

        waiting = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
            if waiting >= GATHER:
                yield from flush(False)
                waiting = 0
        yield from flush(True)
        trim()

    return run


def links(prints: DataFrame) -> DataFrame:
    """Links (a > b) between representatives of fingerprints; ``prints``: (fp, rep), each fp once."""
    known = prints.where("rep is not null").select("fp", "rep")
    agreeing = enough(known.count())

    def key(choice):
        out = F.lit(0).cast("long")
        for a, w in choice:
            out = F.shiftleft(out, w).bitwiseOR(F.shiftrightunsigned("fp", 64 - a - w).bitwiseAND(F.lit((1 << w) - 1)))
        return out

    keyed = known.select("fp", "rep", F.posexplode(F.array(*[key(c) for c in choices(agreeing)])).alias("block", "key"))
    large = keyed.groupBy("block", "key").agg(F.count("*").alias("many")).where(F.col("many") > CHUNK)
    large = large.select("block", "key", F.ceil(F.col("many") / CHUNK).cast("int").alias("chunks"))
    dealt = keyed.join(large, ["block", "key"], "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("chunk")))
    spread = dealt.select("block", "key", "fp", "rep", "chunk", F.explode(others).alias("other"))
    part = F.xxhash64("block", "key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = spread.select("block", part.alias("part"), "fp", "rep")
    ready = rows.repartition("part").sortWithinPartitions("part")
    return ready.mapInArrow(linked(agreeing), "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit) and component_id of every row."""
    found = text_udf("fp long", fingerprints, 1_000_000)
    prints = written(docs.select(F.col(id_col).alias("doc_id"), found(F.col(text_col))["fp"].alias("fp")), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    label = labels(links(first))
    of = first.join(label, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("label", "rep").alias("component_id"))
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose id is their component's least; of rows that share an id all stay or none."""
    mark = "_near"
    while mark in docs.columns:
        mark += "_"
    kept = components(docs).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
