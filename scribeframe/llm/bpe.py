"""Operator 11, BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

A text falls into units by the pattern of byte-level tokenizers; a special token's own characters stand apart as that
token. Each unit starts as its bytes' tokens. The leaves of its segment tree hold rank and place of each adjacent pair,
every node the least leaf below it, so the root is the lowest rank, leftmost among equals. A merge changes three leaves
(the pair itself and those to its left and right) and the nodes above them, until the root holds no pair. Units of like
length are solved side by side, long or few ones each alone; a worker remembers short units.

Ids travel packed, as little-endian unsigned 32-bit integers, the form of token files; ``unpacked`` gives an array.

Cases: null gives nulls, the empty text no ids; very long texts and units are read whole (memory grows with the longest);
any string comes back unchanged from its ids; equal pairs that overlap merge from the left; repeated rows give equal ids;
other input columns are not touched, and one named like the result is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import table, text_udf

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
# The pattern of byte-level tokenizers, and code points that it takes for neither letters nor digits,
# although Unicode 17 and later have them as such.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 "
    "18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: units that a worker remembers, the longest of them in characters, and the least units that are solved side by side
KNOWN, SHORT, SIDE_BY_SIDE = 500_000, 64, 48
#: leaves of the trees that are built at once
LEAVES = 1_000_000
NONE = np.int64(1) << np.int64(62)


def byte_signs() -> str:
    """The printable character that stands for each byte in the vocabulary file: itself if it is one, else the next from
    U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


def latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def latin_pattern() -> re.Pattern:
    """PATTERN for such texts, with its classes spelled out, which the standard library reads faster."""
    own = {c: "".join(re.escape(chr(b)) for b in range(256) if regex.match(c, chr(b))) for c in (r"\p{L}", r"\p{N}", r"\s")}
    spelled = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(own.values())}]").replace(r"\S", f"[^{own[chr(92) + 's']}]")
    for c, chars in own.items():
        spelled = spelled.replace(c, f"[{chars}]")
    return re.compile(spelled)


def newer() -> str:
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())


def older_pattern() -> regex.Pattern:
    """PATTERN for texts with characters of NEWER."""
    spelled = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}][{newer()}]]")
    for c in (r"\p{L}", r"\p{N}"):
        spelled = spelled.replace(f" ?{c}+", f" ?[{c}--[{newer()}]]+")
    return regex.compile(spelled, regex.V1)


class Tokenizer:
    """A byte-level BPE: the bytes of each token, its merges by rank, and the special tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        byte_of = {c: b for b, c in enumerate(byte_signs())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.special = special
        size = max([*vocabulary.values(), *special.values()]) + 1
        self.surface = [b""] * size
        for token, i in vocabulary.items():
            self.surface[i] = raw(token)
        for token, i in special.items():
            self.surface[i] = token.encode()
        self.byte_id = np.array([vocabulary[c] for c in byte_signs()], dtype=np.int64)
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        left, right, self.result = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, dtype=np.int64),) * 3
        self.ids = size
        key = left * size + right
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.fingerprint = hashlib.sha256(repr((size, key.tolist(), sorted(special.items()))).encode()).hexdigest()
        self._ready: dict[str, object] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ready"} | {"_ready": {}}

    def _own(self, name: str, make):
        """What a process builds once."""
        if name not in self._ready:
            self._ready[name] = make()
        return self._ready[name]

    # -- units

    def pieces(self, text: str) -> list[str | int]:
        """Units of a text, special tokens as their ids."""
        if not self.special:
            return self._units(text)
        find = self._own("special", lambda: re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))))
        out, at = [], 0
        for m in find.finditer(text):
            out += self._units(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._units(text[at:]) if out else self._units(text)

    def _units(self, text: str) -> list[str]:
        if latin(text):
            return self._own("latin", latin_pattern).findall(text)
        if self._own("newer", lambda: re.compile(f"[{newer()}]")).search(text):
            return self._own("old", older_pattern).findall(text)
        return self._own("find", lambda: regex.compile(PATTERN)).findall(text)

    # -- merges

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it doesn't merge."""
        wanted = left * self.ids + right
        at = np.minimum(np.searchsorted(self.key, wanted), max(len(self.key) - 1, 0))
        return np.where(self.key[at] == wanted, self.order[at], NONE) if len(self.key) else np.full(len(wanted), NONE)

    def solve(self, units: list[str]) -> list[bytes]:
        """Packed ids of each unit."""
        raw = [x.encode() for x in units]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        width = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(size - 1, 1))).astype(np.int64))
        out: list[bytes] = [b""] * len(raw)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            step = max(1, LEAVES // w)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                if len(some) < SIDE_BY_SIDE:
                    for i in some.tolist():
                        out[i] = self.alone(raw[i])
                else:
                    for i, ids in zip(some.tolist(), self.side_by_side([raw[i] for i in some.tolist()], size[some], w), strict=True):
                        out[i] = ids
        return out

    def side_by_side(self, raw: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        """Units of at most width + 1 bytes, each with a tree of ``width`` leaves; every step merges once in each unit."""
        n, cols = len(raw), width + 1
        inside = np.arange(cols)[None, :] < size[:, None]
        symbol = np.zeros((n, cols), dtype=np.int64)
        symbol[inside] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        rank = self.ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width)
        place = np.arange(width, dtype=np.int64)
        leaf = np.where(inside[:, 1:] & (rank < NONE), rank * width + place, NONE)
        tree = np.empty((n, 2 * width), dtype=np.int64)
        tree[:, width:] = leaf
        level = width
        while level > 1:
            half = tree[:, level : 2 * level]
            tree[:, level // 2 : level] = np.minimum(half[:, 0::2], half[:, 1::2])
            level //= 2
        ahead, back = np.tile(np.arange(1, cols + 1), (n, 1)), np.tile(np.arange(-1, cols - 1), (n, 1))
        there = inside.copy()
        row = np.arange(n)
        while True:
            root = tree[row, 1]
            row, root = row[root < NONE], root[root < NONE]
            if not len(row):
                break
            i, k = root % width, root // width
            j = ahead[row, i]
            symbol[row, i] = self.result[k]
            there[row, j] = False
            after, before = ahead[row, j], back[row, i]
            ahead[row, i] = after
            has = after < size[row]
            back[row[has], after[has]] = i[has]
            # a place past the unit's end, or before its begin, has no pair: its leaf stays empty
            changed = np.full((len(row), 3), NONE)
            right, left = np.flatnonzero(has), np.flatnonzero(before >= 0)
            got = self.ranks(symbol[row[right], i[right]], symbol[row[right], after[right]])
            changed[right, 1] = np.where(got < NONE, got * width + i[right], NONE)
            got = self.ranks(symbol[row[left], before[left]], symbol[row[left], i[left]])
            changed[left, 2] = np.where(got < NONE, got * width + before[left], NONE)
            j = np.where(j < width, j, i)  # the last symbol is the left one of no pair
            for nodes, value in ((j, changed[:, 0]), (i, changed[:, 1])):
                tree[row, width + nodes] = value
            tree[row[left], width + before[left]] = changed[left, 2]
            for nodes in (j, i, np.maximum(before, 0)):
                at = (width + nodes) // 2
                for _ in range(width.bit_length() - 1):
                    tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
                    at //= 2
        packed = symbol[there].astype("<u4").tobytes()
        cut = 4 * np.concatenate([[0], np.cumsum(there.sum(axis=1))])
        return [packed[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def alone(self, raw: bytes) -> bytes:
        """The same for one unit, on plain lists."""
        size = len(raw)
        if size < 2:
            return self.byte_id[list(raw)].astype("<u4").tobytes()
        merge = self._own("merge", lambda: dict(zip(self.key.tolist(), self.order.tolist(), strict=True)))
        result = self._own("result", self.result.tolist)
        ids, none, width = self.ids, int(NONE), 1 << max(0, (size - 2).bit_length())
        symbol = self.byte_id[np.frombuffer(raw, dtype=np.uint8)].tolist()
        ahead, back = list(range(1, size + 1)), list(range(-1, size - 1))

        def leaf(a: int, b: int) -> int:
            rank = merge.get(symbol[a] * ids + symbol[b])
            return none if rank is None else rank * width + a

        tree = [none] * (2 * width)
        tree[width : width + size - 1] = [leaf(a, a + 1) for a in range(size - 1)]
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def put(place: int, value: int) -> None:
            at = width + place
            tree[at] = value
            while at > 1:
                at //= 2
                least = tree[2 * at] if tree[2 * at] < tree[2 * at + 1] else tree[2 * at + 1]
                if tree[at] == least:
                    break
                tree[at] = least

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = ahead[i]
            symbol[i], symbol[j] = result[rank], -1
            after, before = ahead[j], back[i]
            ahead[i] = after
            if after < size:
                back[after] = i
                put(j, none)
                put(i, leaf(i, after))
            else:
                put(i, none)
                if j < width:
                    put(j, none)
            if before >= 0:
                put(before, leaf(before, i))
        return np.array([x for x in symbol if x >= 0], dtype="<u4").tobytes()

    # -- texts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        known = _known.setdefault(self.fingerprint, {})
        if len(known) > KNOWN:
            known.clear()
        parts = [self.pieces(x) if x else [] for x in texts]
        new = list({u for own in parts for u in own if u not in known})
        named = [u for u in new if isinstance(u, str)]
        found = dict(zip(named, self.solve(named), strict=True)) | {u: np.array([u], dtype="<u4").tobytes() for u in new if not isinstance(u, str)}
        known.update(found)
        out = [b"".join(map(known.__getitem__, own)) for own in parts]
        for u in found:
            if isinstance(u, str) and len(u) > SHORT:
                del known[u]
        return out

    def decode(self, packed: list[bytes | None]) -> list[str | None]:
        """The texts of packed ids; bytes that are no UTF-8 become U+FFFD."""
        look = self.surface.__getitem__
        return [None if x is None else b"".join(map(look, np.frombuffer(x, dtype="<u4").tolist())).decode("utf-8", "replace") for x in packed]

    def rows(self, texts: list[str | None]) -> dict[str, object]:
        packed = [None if x is None else ids for x, ids in zip(texts, self.encode(texts), strict=True)]
        return {"ids": packed, "decoded": self.decode(packed)}


_known: dict[str, dict[str | int, bytes]] = {}


def load(path: str = MODEL) -> Tokenizer:
    """From a tokenizer file in JSON; read on the driver only."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    return Tokenizer(model["vocab"], merges, {x["content"]: x["id"] for x in spec["added_tokens"]})


def encode(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", into: str = "encoded") -> DataFrame:
    """docs with a struct column: ids (packed) and decoded, the text that the ids give back."""
    return docs.withColumn(into, text_udf("ids binary, decoded string", tokenizer.rows)(F.col(text_col)))


def n_tokens(ids: Column) -> Column:
    """How many ids are packed."""
    return (F.octet_length(ids) / 4).cast("long")


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of longs."""
    digits = F.hex(ids)
    at = F.when(F.octet_length(ids) >= 4, F.sequence(F.lit(0), F.floor(F.octet_length(ids) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i, k: F.substring(digits, i * 8 + 2 * k + 1, F.lit(2))
    return F.when(ids.isNotNull(), F.transform(at, lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("long")))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the packed ids and of the text that they give back; a null text is read as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = encode(docs, load(MODEL)).select("doc_id", "encoded.ids", "encoded.decoded")
    return found.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
