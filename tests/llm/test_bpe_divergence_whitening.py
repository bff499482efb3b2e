"""Operators 11 to 13 against the tokenizers library, DuckDB and numpy, on small tables with nulls, empties, ties and repeats."""

import hashlib
import random
import re

import numpy as np
import pytest
import tokenizers
from oracles import same
from pyspark.sql import functions as F

from scribeframe.llm import bpe, divergence, whitening

SF = "/root/testdata/sf0.001"


# -- 11


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load()


def odd_texts():
    rng = random.Random(3)
    alphabet = "ab the ing'sll\n\t  0129 !?éü日本語ひらが" + chr(0x558) + chr(0x2028) + "😀\x00" + chr(0x10940) + chr(0x33000)
    any_char = lambda: chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))
    made = ["".join(rng.choice([rng.choice(alphabet), any_char(), "<|endoftext|>" * (rng.random() < 0.05)]) for _ in range(rng.randrange(150))) for _ in range(600)]
    return ["", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "a" * 5000, " " * 3000, "ab" * 2000, "=-" * 999 + "\n" * 77, *made]


def test_bpe_equals_the_library(tokenizer):
    library, texts = tokenizers.Tokenizer.from_file(bpe.MODEL), odd_texts()
    got = tokenizer.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokenizer.decode(got) == texts == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in got]


def test_bpe_of_all_code_points(tokenizer):
    """Units as the library cuts them, for every fifth code point and all near the listed ones."""
    library = tokenizers.Tokenizer.from_file(bpe.MODEL).pre_tokenizer
    near = {int(x, 16) + d for r in bpe.NEWER.split() for x in r.split("-") for d in (-1, 0, 1)}
    for c in sorted(near | set(range(0, 0x110000, 5))):
        if not 0xD800 <= c <= 0xDFFF and c < 0x110000:
            s = "a" + chr(c) + "1" + chr(c) + "!"
            assert tokenizer._units(s) == [s[a:b] for _, (a, b) in library.pre_tokenize_str(s)]


def merged_by_hand(tokenizer, raw):
    """The definition: look for the lowest rank, leftmost, merge it, start over."""
    rank = {(int(k) // tokenizer.ids, int(k) % tokenizer.ids): int(r) for k, r in zip(tokenizer.key, tokenizer.order)}
    own = [int(tokenizer.byte_id[b]) for b in raw]
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(own, own[1:])) if p in rank), default=None)
        if best is None:
            return own
        own[best[1] : best[1] + 2] = [int(tokenizer.result[best[0]])]


def test_segment_trees_equal_the_definition(tokenizer):
    rng = random.Random(5)
    units = [bytes(rng.choice(b"aethins n") for _ in range(rng.randrange(1, 34))) for _ in range(150)]
    want = [merged_by_hand(tokenizer, x) for x in units]
    ids = lambda xs: [np.frombuffer(x, "<u4").tolist() for x in xs]
    assert ids(map(tokenizer.alone, units)) == want
    assert ids(tokenizer.side_by_side(units, np.array(list(map(len, units))), 64)) == want


def test_bpe_without_merges_and_special_tokens():
    plain = bpe.Tokenizer({c: i for i, c in enumerate(bpe.byte_signs())}, [], {})
    assert np.frombuffer(plain.encode(["é<|endoftext|>"])[0], "<u4").tolist() == list("é<|endoftext|>".encode())
    assert plain.decode([np.array([0xC3, 0x41], dtype="<u4").tobytes(), None]) == ["�A", None]


def test_bpe_tables(spark, tokenizer, tmp_path):
    rows = [(1, None, 7), (2, "", 7), (3, "Hello  world", 7), (3, "Hello  world", 7), (None, "x " * 30_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, encoded int")
    found = bpe.encode(docs, tokenizer).select("doc_id", "text", "encoded.ids", "encoded.decoded", bpe.unpacked(F.col("encoded.ids")).alias("list")).collect()
    assert len(found) == 5 and all(r.decoded == r.text for r in found)
    assert [r.list for r in found if r.doc_id == 3] == [[15496, 220, 995]] * 2 and next(r.list for r in found if r.doc_id == 1) is None and next(r.list for r in found if r.doc_id == 2) == []
    assert bpe.encode(docs.where("false"), tokenizer).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in bpe.op11_bpe(spark, str(tmp_path)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1][1:] == got[2][1:] == (0, nothing, nothing)
    assert got[3].n_tokens == 3 and got[3].ids_sha256 == hashlib.sha256(np.array([15496, 220, 995], dtype="<u4").tobytes()).hexdigest()
    assert got[None].decoded_sha256 == hashlib.sha256(b"x " * 30_000).hexdigest()


def test_op11_on_the_smallest_tables(spark):
    library = tokenizers.Tokenizer.from_file(bpe.MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op11_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# -- 12

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOW))


@pytest.mark.parametrize("digest", [None, lambda x: len(x) % 3, lambda x: 0])
def test_terms_also_under_colliding_hashes(digest):
    texts = ["Abc abc, ÄB äb 1x2", None, "", "zz" * 900 + "-zz", "日本語x 日本\x00語", "a", "a"]
    found = divergence.Terms(texts, *([digest] if digest else []))
    assert [(d, found.names[t].decode()) for d, t in zip(found.doc, found.term)] == [(i, w) for i, x in enumerate(texts) for w in terms_of(x)]
    assert len(set(found.names)) == len(found.names)


def brute_divergences(rows, least, top):
    kept, n, out = {}, {}, []
    langs = {x: sorted({s or "" for _, g, s in rows if (g or "") == x}) for x in {g or "" for _, g, _ in rows}}
    for lang, sources in langs.items():
        own = [(s or "", terms_of(t)) for t, g, s in rows if (g or "") == lang]
        kept = sorted({w for _, ws in own for w in ws if sum(w in set(o) for _, o in own) >= least})
        n = {(s, w): sum(ws.count(w) for src, ws in own if src == s) for s in sources for w in kept}
        total = {s: sum(n[s, w] for w in kept) for s in sources}
        p = {(s, w): 1 + 10**9 * (n[s, w] + 5) // (total[s] + 5 * len(kept)) for s in sources for w in kept}
        q = {w: 1 + 10**9 * (sum(n[s, w] for s in sources) + 5) // (sum(total.values()) + 5 * len(kept)) for w in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s, w] - p[o, w]) for w in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[w] - p[s, w], w.encode()) for w in kept if n[s, w] > 0 and p[s, w] > q[w])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_divergences_by_brute_force(spark):
    rng = random.Random(2)
    words = ["Uno", "dos", "tres", "été", "ÉTÉ", "x", "日本", "a'b"]
    rows = [(" ".join(rng.choice(words[: rng.randrange(1, 9)]) for _ in range(rng.randrange(9))), rng.choice(["es", "fr", None, ""]), rng.choice(["s1", "s2", "s10", None, "ü"])) for _ in range(150)]
    rows += [(None, "es", "silent"), ("...", "es", "silent"), ("once", "xx", "lonely"), ("twice", "xx", "other"), *[("uno uno dos", "es", "s1")] * 40, ("y" * 50_000 + " uno", "fr", "s1")]
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "text string, lang string, source string, n int, block string").repartition(4)
    for least, top, block in ((3, 2, 5), (1, 50, 10_000)):
        got = sorted(tuple(r) for r in divergence.divergences(docs, least, top, block).collect())
        assert got == brute_divergences(rows, least, top)
    assert divergence.divergences(docs.where("false")).count() == 0


def test_shares_are_exact():
    of = 9_000_000_000_000_000
    for count in (5, 1234567, of - 1, of):
        assert divergence.share(np.array([count]), of).tolist() == [1 + 10**9 * count // of]


def test_op12_equals_sql(spark):
    same(spark, divergence.op12_source_divergence, divergence.OP12_SQL, SF)


# -- 13


def brute_whitening(vectors):
    x = np.unique(np.floor(256 * np.array(vectors, dtype=np.float64)).astype(np.int64), axis=0)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, e[::-1], v[:, ::-1].T


def test_merged_summaries_equal_one_svd():
    rng = np.random.default_rng(4)
    x = rng.integers(-900, 900, (700, 12)) @ np.diag(np.arange(1, 13))
    for cuts in ([100, 101, 105, 650], [3], [350]):
        out = None
        for part in np.split(x, cuts):
            own = whitening.of_rows(part)
            out = whitening.merged(out, own) if out else own
        centred = x - x.mean(axis=0)
        assert out.n == 700 and (out.sums == x.sum(axis=0)).all() and len(out.values) == 12
        assert np.allclose(out.values, np.linalg.svd(centred)[1], rtol=1e-12)
        assert np.allclose((out.vectors.T * out.values**2) @ out.vectors, centred.T @ centred, rtol=1e-10)


def rows_13():
    rng = np.random.default_rng(9)
    base = (rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]).astype(np.float32)
    return [v.tolist() for v in base] + [base[0].tolist()] * 200


def check_whitened(rows, n, sums, e, v, by_id, k):
    for r in rows:
        x = np.floor(256 * np.array(by_id[r.vec_id], dtype=np.float64)).astype(np.int64)
        c = r.component - 1
        assert r.n == n and r.deviation == ((n * x - sums) ** 2).sum() and abs(r.explained - e[c] / e.sum()) < 1e-10 and r.identity_error < 1e-9
        assert abs(abs(r.whitened) - abs((x - sums / n) @ v[c] / np.sqrt(e[c]))) < 1e-9
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, c + 1) for i in by_id for c in range(k))
    for c in range(k):  # one sign for all rows
        own = [r for r in rows if r.component == c + 1]
        signs = {np.sign(r.whitened * ((np.floor(256 * np.array(by_id[r.vec_id], dtype=np.float64)) - sums / n) @ v[c])) for r in own if abs(r.whitened) > 1e-6}
        assert len(signs) == 1


def test_whitening_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    vectors = rows_13()
    bad = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5]
    table = spark.createDataFrame([(i, v, "n", 1.0) for i, v in enumerate(vectors + bad)], "vec_id long, embedding array<float>, n string, whitened double").repartition(11)
    own = spark.createDataFrame([(v,) for v in vectors], "embedding array<float>")
    by_id = {i: [float(c) for c in np.array(v, dtype=np.float32)] for i, v in enumerate(vectors)}
    model = whitening.fitted(whitening.fit_list(own).repartition(11))
    check_whitened(whitening.whiten(table, model, k=4).collect(), *brute_whitening(list(by_id.values())), by_id, 4)
    assert len(model.e) == 6 and whitening.whiten(table, model).count() == len(vectors) * 6
    assert whitening.fitted(whitening.fit_list(table.where("false"))) is None


def test_whitening_of_few_flat_and_ragged_vectors(spark):
    make = lambda vs: spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<float>")
    both = lambda t: whitening.whiten(t, whitening.fitted(whitening.fit_list(t)), k=4).collect()
    one = both(make([[1.0, 2.0]] * 3))
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, 0.0)}
    two = both(make([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]]))
    assert {(r.component, None if r.whitened is None else round(abs(r.whitened), 9)) for r in two} == {(1, 1.0), (2, None), (3, None)}
    ragged = both(make([[], [1.0], [1.0, 0.0], [0.0, 1.0]]))
    assert {r.n for r in ragged} == {4} and len(ragged) == 8
    wide = make([[3.0e12, 1.0], [-3.0e12, 0.0], [1.0, 1.0]])
    assert any(r.deviation is None for r in both(wide))
    assert whitening.whiten(make([[1.0]]), whitening.Whitening(0, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, 0)))).count() == 0


def test_op13_on_the_smallest_tables(spark):
    by_id = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check_whitened(whitening.op13_whitening(spark, SF).collect(), *brute_whitening(list(by_id.values())), by_id, 4)
