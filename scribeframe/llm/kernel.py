"""Array kernels over batches of whole texts: words, lines, hashes, chains of labels.

Texts reach Python in Arrow batches. A batch is worked on in slices of about ``SLICE`` characters, so that memory
depends on the slice and on the longest single text, never on a partition. Null texts count as empty here; the callers
say what they return for them.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 400_000
U64 = np.uint64
MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)
#: bytes 0x20 and 0x09-0x0D: what ends a word in all contracts on words
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: every ASCII byte that is neither a letter nor a digit
PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def trim() -> None:
    """Gives freed memory back to the machine: a worker process outlives the task that made it grow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # malloc_trim is glibc's
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` characters each, one text at least."""
    at, n = 0, 0
    for i, x in enumerate(texts):
        n += len(x) if x else 0
        if n >= size:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * MIX_B
        x = (x ^ (x >> U64(29))) * MIX_A
        return x ^ (x >> U64(32))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * MIX_A)
_POWERS = [np.ones(1, dtype=U64)]


def powers(n: int) -> np.ndarray:
    """1, p, p*p, ... modulo 2**64 for an odd p."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[0] = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=U64), np.full(max(n, 4096) - 1, MIX_A, dtype=U64)]))
    return _POWERS[0][:n]


_BACKS = [np.ones(1, dtype=U64)]
INVERSE = U64(pow(int(MIX_A), -1, 1 << 64))


def backs(n: int) -> np.ndarray:
    """1, 1/p, 1/(p*p), ... modulo 2**64 for the p of powers()."""
    if len(_BACKS[0]) < n:
        with np.errstate(over="ignore"):
            _BACKS[0] = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=U64), np.full(max(n, 4096) - 1, INVERSE, dtype=U64)]))
    return _BACKS[0][:n]


class Words:
    """Words (runs of other bytes than 0x20, 0x09-0x0D) of some texts, as places in one byte buffer.

    ``text`` and ``line`` give each word's text and its global line; ``line_text`` each line's text. A text of n line
    feeds has n + 1 lines. ``hash`` is a 64-bit hash of each word's bytes.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, space: np.ndarray = SPACE):
        encoded = [((x.lower() if lower else x) if x else "").encode() for x in texts]
        self.bytes = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        inside = ~space[self.bytes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        feeds = np.flatnonzero(self.bytes == 10)
        self.line_end = feeds
        self.line_start = np.concatenate([[0], feeds[:-1] + 1]) if len(feeds) else feeds
        self.line = np.searchsorted(feeds, self.start)
        self.line_text = np.searchsorted(self.begin, self.line_start, side="right") - 1
        self.text = self.line_text[self.line] if len(self.start) else np.zeros(0, dtype=np.int64)
        self.texts = len(texts)

    def line_number(self) -> np.ndarray:
        """Each line's place in its text, from 0."""
        first = np.searchsorted(self.line_text, np.arange(self.texts))
        return np.arange(len(self.line_text)) - first[self.line_text]

    @property
    def hash(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        n = len(self.bytes)
        run = np.zeros(n + 1, dtype=U64)
        with np.errstate(over="ignore"):  # differences of one running sum, moved back to the word's start
            np.cumsum(np.take(BYTE_CODE, self.bytes) * powers(n), out=run[1:])
            value = (run[self.end] - run[self.start]) * backs(n)[self.start]
            return mix(value + (self.end - self.start).astype(U64))


def counts_by(group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, minlength=n)


def text_udf(schema: str, score: Callable[[list[str | None]], dict[str, object]], size: int = SLICE) -> Callable[[Column], Column]:
    """A column of structs from ``score``, which gets the texts of a slice and returns a sequence for each field."""

    def columns(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [x if isinstance(x, str) else None for x in texts]
            parts = [pd.DataFrame(score(values[a:b])) for a, b in slices(values, size)] or [pd.DataFrame(score([]))]
            yield pd.concat(parts, ignore_index=True)
        trim()

    columns.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # not deterministic in Catalyst's eyes only: it keeps a filter and a projection from evaluating it twice
    return F.pandas_udf(columns, schema).asNondeterministic()


#: steps between two normalisations of a chain; the clip keeps a double from running out of range between them
STEPS, CLIP = 8, 50.0
#: items of a block: a longer chain is worked on in blocks that exchange messages at their borders
BLOCK = 256


def chain_marginals(emission: np.ndarray, transition: np.ndarray, first: np.ndarray, length: np.ndarray, gradient: bool = False):
    """Forward-backward over many chains at once, of any length.

    ``emission``: (items, labels) log potentials, chain by chain; ``first`` and ``length`` place the chains, which hold
    all items. Returns the marginals and, for training, the expected transitions. A chain of over BLOCK items is cut into blocks, all of which
    run side by side; what enters a block from the left and from the right comes from the products of the other blocks'
    step matrices, so the marginals are those of the whole chain.
    """
    labels = emission.shape[1]
    local = emission.astype(np.float64)
    local -= local.max(axis=1, keepdims=True) if len(local) else 0
    np.exp(np.maximum(local, -CLIP, out=local), out=local)
    move = np.exp(np.clip(transition, -15, 15)).astype(np.float64)
    pieces = -(-length // BLOCK)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + nth * BLOCK
    size = np.minimum(np.repeat(first + length, pieces) - start, BLOCK)
    enter, leave = np.ones((len(start), labels)), np.ones((len(start), labels))
    cut = np.cumsum(pieces) - pieces
    long = np.flatnonzero(pieces > 1)
    if len(long):
        parts = np.repeat(cut[long], pieces[long]) + nth[np.repeat(pieces > 1, pieces)]
        product = dict(zip(parts.tolist(), products(local, move, start[parts], size[parts]), strict=True))
        for c in long.tolist():
            blocks = range(int(cut[c]), int(cut[c] + pieces[c]))
            for b in blocks[:-1]:
                v = enter[b] @ product[b] @ move
                enter[b + 1] = v / v.sum()
            for b in reversed(blocks[1:]):
                v = move @ (product[b] @ leave[b])
                leave[b - 1] = v / v.sum()
    out, alpha, beta, expected = block_marginals(local, move, start, size, enter, leave, gradient)
    if not gradient:
        return out
    inner = np.flatnonzero(nth > 0)  # transitions over the borders of blocks
    if len(inner):
        right = start[inner]
        pair = alpha[right - 1][:, :, None] * move[None] * (local[right] * beta[right])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return out, expected


def layout(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chains by falling length, laid out step by step: step t works on one stretch of memory, the chains that still run.
    Returns the chains' order, how many run at each step, where each step begins, and the items in this layout."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    steps = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(steps), side="left")
    off = np.concatenate([[0], np.cumsum(running)]).astype(np.int64)
    at = np.empty(off[-1], dtype=np.int64)
    for t in range(steps):
        np.add(first[: running[t]], t, out=at[off[t] : off[t + 1]])
    return order, running, off, at


def products(local: np.ndarray, move: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each block the product of its step matrices, from its first item's potentials to its last one's, each
    scaled by a number of its own."""
    order, running, off, at = layout(first, length)
    state = np.zeros((len(first), len(move), len(move)))
    for t, n in enumerate(running.tolist()):
        step = local[at[off[t] : off[t + 1]]]
        if t == 0:
            state[:n, np.arange(len(move)), np.arange(len(move))] = step
            continue
        state[:n] = (state[:n] @ move) * step[:, None, :]
        if t % STEPS == 0:
            state[:n] /= state[:n].sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(state)
    out[order] = state / np.maximum(state.sum(axis=(1, 2), keepdims=True), 1e-300)
    return out


def block_marginals(local, move, first, length, enter, leave, gradient):
    """Marginals of the items of blocks, given what enters and leaves them; for a gradient also the forward and backward
    messages by item and the expected transitions inside blocks."""
    order, running, off, at = layout(first, length)
    steps = len(running)
    local = local[at]
    one = np.ones(local.shape[1])
    alpha = np.empty_like(local)
    for t in range(steps):
        a = alpha[off[t] : off[t + 1]]
        if t == 0:
            np.multiply(local[: off[1]], enter[order], out=a)
            continue
        np.matmul(alpha[off[t - 1] : off[t - 1] + len(a)], move, out=a)
        a *= local[off[t] : off[t + 1]]
        if t % STEPS == 0:
            a /= (a @ one)[:, None]
    beta = leave[order]
    gamma, betas = alpha.copy(), np.empty_like(alpha) if gradient else None
    expected = np.zeros_like(move)
    back = np.ascontiguousarray(move.T)
    for t in range(steps - 1, -1, -1):
        k = running[t + 1] if t + 1 < steps else 0
        if k:
            ahead = local[off[t + 1] : off[t + 2]] * beta[:k]
            if gradient:
                pair = alpha[off[t] : off[t] + k][:, :, None] * move[None] * ahead[:, None, :]
                expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = ahead @ back
            if t % STEPS == 0:
                b /= (b @ one)[:, None]
            beta[:k] = b
        gamma[off[t] : off[t + 1]] *= beta[: running[t]]
        if gradient:
            betas[off[t] : off[t + 1]] = beta[: running[t]]
    gamma /= (gamma @ one)[:, None]

    def by_item(x):
        out = np.empty_like(x)
        out[at] = x
        return out

    return by_item(gamma), by_item(alpha) if gradient else None, by_item(betas) if gradient else None, expected


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session, as in tests, gets a
    folder of its own; a cluster gets an error, since its machines don't share temporary folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a table written to the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows of whole texts in an Arrow batch, where the session has Spark's default of 10,000: a worker holds a few batches
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, of: int) -> Column:
    """crc32 of the id written as text, modulo ``of``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(of))
