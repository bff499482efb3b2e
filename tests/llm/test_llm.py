"""Operators of the subpackage against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import itertools
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scribeframe.llm import counts, kernel, language, licenses, lines, pieces, quality, rules, simhash, tiling, unigram, urls

WORDS = "der die und nicht ein haus the of and house that with un le la maison que avec los casa para una".split()


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["ka", "to", "mi", "ren", "sol", "ta"], rng.integers(1, 4))) for _ in range(n))


TEXTS = [None, "", " ", "one", prose(1), prose(1), prose(1) + " tail", prose(2, 3000), "x" * 5000, prose(3) + "\n" + prose(4), prose(4) + "\n" + prose(3), "a\n\n\n", "Ünï ☃ 日本 \x00 end", prose(1).upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, 1.5) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "en", 0.0), (4, TEXTS[4], "en", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)


def empty(docs):
    return docs.where("false")


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    first, length = np.array([0, 4, 5]), np.array([4, 1, 4])
    got = kernel.chain_marginals(e, t, first, length)
    for a, n in zip(first, length):
        p = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(e[a + i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                p[i, y] += w
        assert np.allclose(got[a : a + n], p / p.sum(axis=1, keepdims=True))


def test_language(spark, docs):
    rng = np.random.default_rng(1)
    pools = {"de": WORDS[:6], "en": WORDS[6:12], "fr": WORDS[12:18], "es": WORDS[18:]}
    make = lambda k: " ".join(rng.choice(pools[k], 12))
    model = language.train([(make(k), k) for k in pools for _ in range(30)])
    assert model.score([make(k) for k in pools])["lang_pred"] == list(pools)
    found = model.score([None, "", "12 !", "der und haus " * 30 + "the of"])
    assert found["lang_pred"] == ["und", "und", "und", "de"] and found["score"][0] == 0 and 0.5 < found["score"][3] <= 1
    assert language.predict(docs, model).count() == docs.count() and language.predict(empty(docs), model).count() == 0
    assert language.train([]).score(["abc"])["lang_pred"] == ["und"]


def test_features_of_words():
    """Hashed n-grams and affixes of each word, against their definition letter by letter."""
    texts = ["Der Hund\nläuft 3x", None, "", "a ñb-cd é"]
    spans = language.Spans(texts)
    flat = [(i, k, w) for i, t in enumerate(texts) for k, line in enumerate((t or "").lower().split("\n")) for w in re.findall(r"[^\W\d_]+", line)]
    assert spans.text.tolist() == [i for i, _, _ in flat] and spans.size.tolist() == [len(w) for _, _, w in flat]
    assert spans.length.tolist() == [len(list(g)) for _, g in itertools.groupby(flat, key=lambda x: x[:2])]
    by_place, begin, by_word = spans.features(np.arange(len(flat)))

    def gram(x, tag, order=1):
        h = 0
        for c in x[::order]:
            h = (h * 0x100000001B3 + (ord(c) + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
        return int(kernel.mix(np.array([(h + tag) % (1 << 64)], dtype=np.uint64))[0]) & (language.BUCKETS - 1)

    for j, (_, _, w) in enumerate(flat):
        for n, at in zip(language.GRAMS, by_place):
            assert at[begin[j] : begin[j] + len(w)].tolist() == [gram(w[i : i + n], n) if i + n <= len(w) else language.BUCKETS for i in range(len(w))]
        for k, n in enumerate(language.AFFIX):
            assert by_word[2 * k][j] == (gram(w[:n], 11_000 + n) if len(w) >= n else language.BUCKETS)
            assert by_word[2 * k + 1][j] == (gram(w[-n:], 23_000 + n, -1) if len(w) >= n else language.BUCKETS)


def test_statistics_of_lines():
    texts = ["Ab ab ab! 12\n\nab #x", None, "x y z\nx y z\nq"]
    found, line_text, weight = quality.bins(texts)
    lines_ = [(i, line) for i, t in enumerate(texts) for line in (t or "").split("\n")]
    assert line_text.tolist() == [i for i, _ in lines_]
    for at, (row, (i, line), n) in enumerate(zip(found, lines_, weight)):
        own, seen = line.split(), [w for j, x in lines_[:at] if j == i for w in x.split()]
        chars = sum(map(len, own))
        share = lambda test: sum(map(test, "".join(own))) / max(chars, 1)
        before = [w in seen or w in own[:k] for k, w in enumerate(own)]
        stats = [len(own), chars / max(len(own), 1), share(lambda c: c.isascii() and not c.isalnum() and c not in "#*$%&|<>!?"), share(str.isupper), share(str.isdigit), share(lambda c: c in "#*$%&|<>"), share(lambda c: c in "!?"), 0.0,
                 (len(own) - len(set(own))) / max(len(own), 1), sum(before) / max(len(own), 1), sum(len(w) <= 3 for w in own) / max(len(own), 1), bool(own) and [x for j, x in lines_ if j == i].count(line) > 1]
        assert n == max(chars, 1) and row.tolist() == [int(np.searchsorted(e, x, side="right")) for e, x in zip(quality.EDGES, stats)]
    numbers = quality.columns(found, line_text)
    k = found.shape[1]
    for j in range(len(lines_)):
        for side, other in ((1, j - 1), (2, j + 1)):
            there = 0 <= other < len(lines_) and line_text[other] == line_text[j]
            assert (numbers[j, side * k : (side + 1) * k] - np.arange(k) * quality.BINS - side * k * quality.BINS).tolist() == ((found[other] + 1).tolist() if there else [0] * k)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with good and bad texts in two languages, nulls and repeats."""
    rng, pools, rows, marks = np.random.default_rng(3), (WORDS[:6], WORDS[6:12]), [], []
    for d in range(160):
        bad = d % 3 == 0
        own = [" ".join(rng.choice(pools[d % 2], 9)) for _ in range(8)]
        text = "\n".join(x.upper() + " !! ## |" if bad else x.capitalize() + "." for x in own)
        rows.append((d, text if d % 20 else [None, "", "7 !", text][d // 20 % 4], ["de", "en"][d % 2] if d % 7 else None))
        marks.append((d, int(not bad), 0))
    rows += [(None, rows[5][1], "en"), (5, rows[5][1], "en")]
    out = tmp_path_factory.mktemp("small")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows


def fold_of(doc_id, of):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of


def test_op1_op2_op7(spark, small):
    path, rows = small
    got = language.op1_language(spark, path).collect()
    text, lang = {r[0]: r[1] for r in rows}, {r[0]: ["de", "en"][(r[0] or 1) % 2] for r in rows}
    assert len(got) == len(rows) and all(r.held_out == (fold_of(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == (lang[r.doc_id] if re.search(r"[^\W\d_]", text[r.doc_id] or "") else "und") for r in got)
    got = quality.op2_quality(spark, path).collect()
    assert len(got) == len(rows) and all(r.held_out == (fold_of(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == int(r.doc_id % 3 != 0) for r in got if r.doc_id is not None and len(text[r.doc_id] or "") > 9)
    fit = quality.sample(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    whole = {(t, int(d % 3 != 0)) for d, t, _ in rows[:160] if t is not None}
    assert set(fit) <= whole and len(fit) > 120  # two ids may share a slot
    got = rules.op7_quality_rules(spark, path).collect()
    assert len(got) == len(rows) and all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.n_words == len((text[r.doc_id] or "").split()) for r in got)


def test_trees_are_walked_node_by_node():
    rng = np.random.default_rng(4)
    x = rng.random((300, len(rules.FEATURES)))
    forest = rules.grow(x, (x[:, 0] + x[:, 5] > 1).astype(float), trees=8)
    for row, margin in zip(x[:50], forest.margin(x[:50])):
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = (forest.left if row[forest.feature[at]] <= forest.threshold[at] else forest.right)[at]
            total += forest.value[at]
        assert margin == pytest.approx(total)


def test_op6(spark, small):
    path, rows = small
    prints = [brute_print(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min(d for (d, _, _), x in zip(rows, group) if x == g and d is not None) for g in group}
    got = sorted(map(repr, map(tuple, simhash.op6_simhash(spark, path).collect())))
    assert got == sorted(repr((d, f"{p:016x}", least[g])) for (d, _, _), p, g in zip(rows, prints, group))


def test_op3_and_op4_of_long_unspaced_texts(spark, vocabulary):
    encoder, counter = unigram.Encoder(vocabulary), counts.Counter(vocabulary)
    texts = ["日本語" * 7000, "ab" * 9000, "x" * 20_000 + " y"]
    ids, n = encoder.encode(texts)
    assert encoder.decode(ids, n) == texts and counter.counts(texts)["n_tokens"].tolist() == n.tolist()


def test_quality_trains_by_slices(monkeypatch):
    """Training in the driver never works on more characters at once than a slice's, and learns what it learns from all at once."""
    rows = [(f"some line {k} of words\n" * 400 + "\n\n" + "x" * (k % 7), k % 2) for k in range(150)]
    whole, sizes = quality.bins([x for x, _ in rows]), []
    bins = quality.bins
    monkeypatch.setattr(quality, "bins", lambda texts: sizes.append(sum(map(len, texts))) or bins(texts))
    model = quality.train(rows, epochs=1)
    assert sum(sizes) == 2 * sum(len(x) for x, _ in rows) and max(sizes) <= kernel.SLICE + max(len(x) for x, _ in rows)
    assert all((a == b).all() for a, b in zip(whole, quality.sliced_bins([x for x, _ in rows]), strict=True))
    monkeypatch.setattr(quality, "slices", lambda texts: [(0, len(texts))])
    again = quality.train(rows, epochs=1)
    assert (model.weights == again.weights).all() and np.allclose(model.curve, again.curve)


def test_quality(docs):
    good, bad = [prose(i, 60).capitalize() + "." for i in range(40)], [" ".join(w.upper() + "!!" for w in prose(i, 60).split()) for i in range(40)]
    model = quality.train([(x, 1) for x in good[:30]] + [(x, 0) for x in bad[:30]])
    assert (model.score(good[30:])["score"] > 0.9).all() and (model.score(bad[30:])["score"] < 0.1).all()
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.kept(docs, model).columns == docs.columns and quality.score(empty(docs), model).count() == 0
    assert (quality.Model().score(["a", None])["score"] == 0.5).all()


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary file here")
    return pieces.load()


def test_encoding_equals_the_library(docs, vocabulary):
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = vocabulary.score[i] / pieces.QUANTUM
    lib = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    encoder, counter = unigram.Encoder(vocabulary), counts.Counter(vocabulary)
    ids, n = encoder.encode(TEXTS)
    cut = np.concatenate([[0], np.cumsum(n)])
    for i, x in enumerate(TEXTS):
        if x and len(x) < 5000:  # the library's sums are 32-bit floats
            assert lib.encode(x) == ids[cut[i] : cut[i + 1]].tolist()
    assert encoder.decode(ids, n) == [x or "" for x in TEXTS]
    assert counter.counts(TEXTS)["n_tokens"].tolist() == n.tolist()
    out = unigram.encode(docs, encoder).select("doc_id", "text", "encoded.*").collect()
    assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in out)
    assert counts.count(empty(docs), counter).count() == 0


def brute_tiles(doc, item, least):
    """Greedy string tiling word by word."""
    d, t, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while j + k < len(item) and i + k < len(doc) and item[j + k] == doc[i + k] and not d[i + k] and not t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, j, i)
        if best[0] < least:
            return total
        for k in range(best[0]):
            t[best[1] + k] = d[best[2] + k] = True
        total += best[0]


def test_tiling(spark, docs):
    rng = np.random.default_rng(4)
    for _ in range(40):
        doc, item = rng.integers(0, 4, 40).astype(np.uint64), rng.integers(0, 4, 18).astype(np.uint64)
        assert tiling.tile(doc, item, 3)[0] == brute_tiles(doc.tolist(), item.tolist(), 3)
    w = prose(9, 40).split()
    moved = " ".join([*prose(5, 30).split(), *w[20:], "between", *w[:20], *prose(6, 30).split()])
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "Short Item"), (3, None), (4, "")], "item_id long, text string")
    table = spark.createDataFrame([(1, moved, 1), (2, prose(7, 60), 2), (3, "a short, ITEM here", 3), (4, None, 4), (5, "", 5)], "doc_id long, text string, hits int")
    found = tiling.with_hits(table, bench, "found").orderBy("doc_id").collect()
    assert [[(h.item_id, h.coverage, h.tiles) for h in r.found] for r in found] == [[(1, 1.0, 2)], [], [(2, 1.0, 1)], [], []]
    assert sorted(r.doc_id for r in tiling.clean(table, bench).collect()) == [2, 4, 5]
    assert tiling.clean(docs, bench.where("false")).count() == docs.count() and tiling.clean(empty(docs), bench).count() == 0
    named = [f"_doc{k}" for k in range(2)] + ["_doc", "_tag", "doc", "tag", "item_id"]
    clash = table.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(named)])
    assert tiling.with_hits(clash, bench, "doc").columns == [*[c for c in clash.columns if c != "doc"], "doc"] and tiling.clean(clash, bench).columns == clash.columns


def test_tiling_of_other_scripts_items_without_an_id_and_repeats(spark):
    item = "the old river\u00a0runs \u201cquietly\u201d past nine mills \u2013 and under two stone bridges at dawn"
    plain = "the old river runs quietly past nine mills and under two stone bridges at dawn"
    bench = spark.createDataFrame([(None, item), (None, item), (7, prose(20, 30)), (8, prose(20, 30))], "item_id long, text string")
    rows = [(1, f"x {plain} y"), (1, f"x {plain} y"), (None, f"{item}!"), (2, "the old river"), (3, prose(20, 30).upper()), (3, None)]
    found = sorted(((r.doc_id, h.item_id, h.coverage) for r in tiling.with_hits(spark.createDataFrame(rows, "doc_id long, text string"), bench, "h").collect() for h in r.h), key=str)
    assert found == sorted([(1, None, 1.0), (1, None, 1.0), (None, None, 1.0), (3, 7, 1.0), (3, 8, 1.0)], key=str)


@pytest.mark.parametrize("period", [1, 7, 100])
def test_tiling_of_long_repetitive_texts(period):
    doc, item = np.tile(np.arange(period), 60_000 // period).astype(np.uint64), np.tile(np.arange(period), 280)[:280].astype(np.uint64)
    assert tiling.tile(doc, item, 5) == (280, 1)


def test_op5(spark, tmp_path):
    rng = np.random.default_rng(11)
    items = [(k, prose(100 + k, 24)) for k in range(6)] + [(9, "two words")]
    docs = []
    for d in range(30):
        w = prose(200 + d, 40).split()
        own = items[d % 6][1].split()
        if d % 3:
            cut = int(rng.integers(4, 20))
            w[20:20] = [*own[cut:], "between", *own[: cut - d % 4]]
        docs.append((d, " ".join(w) + (" Two, Words" if d % 7 == 0 else "")))
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    cut = lambda x: re.findall(r"[a-z0-9]+", x.lower())
    want = {(d, k, round(c, 6)) for d, t in docs for k, x in items if (c := brute_tiles(cut(t), cut(x), min(5, len(cut(x)))) / len(cut(x))) >= 0.6}
    assert {(r.doc_id, r.item_id, r.coverage) for r in tiling.op5_decontamination(spark, str(tmp_path)).collect()} == want and len(want) > 10


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(docs):
    prints = [brute_print(x) for x in TEXTS]
    got = simhash.fingerprints(TEXTS)["fp"].view(np.uint64).tolist()
    assert got == prints
    near = {i: {j for j in range(len(TEXTS)) if (prints[i] ^ prints[j]).bit_count() <= 4} for i in range(len(TEXTS))}
    least = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least[i] = min(seen)
    rows = simhash.components(docs).collect()
    assert len(rows) == docs.count() and all(r.component_id == (least[r.doc_id] if r.doc_id is not None else least[4]) for r in rows)
    assert simhash.components(empty(docs)).count() == 0
    assert simhash.first_of_each(docs).columns == docs.columns


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for k in rng.integers(1, 7, 450)]
    value = np.unique(np.concatenate([base, np.repeat(base, 3) ^ np.array(flips, dtype=np.uint64), base[:1] ^ np.arange(200, dtype=np.uint64)]))
    want = {(i, j) for i in range(len(value)) for j in range(i + 1, len(value)) if int(value[i] ^ value[j]).bit_count() <= 4}
    found = [(min(a, b), max(a, b)) for i, j in simhash.pairs(value, np.zeros(len(value), dtype=int), 0) for a, b in zip(i.tolist(), j.tolist())]
    assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("part, agreeing", [(5000, 1), (0, 4)])
def test_links_by_any_number_of_blocks(spark, monkeypatch, part, agreeing):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in rng.integers(1, 7, 160)]
    value = np.unique(np.concatenate([base, np.repeat(base, 4) ^ np.array(flips, dtype=np.uint64)])).view(np.int64)
    monkeypatch.setattr(simhash, "PART", part)
    assert simhash.enough(1 << 40 if not part else len(value)) == agreeing
    monkeypatch.setattr(simhash, "enough", lambda n: agreeing)
    prints = spark.createDataFrame([(int(v), i) for i, v in enumerate(value)], "fp long, rep long").repartition(3)
    least = {i: i for i in range(len(value))}
    for i, j in itertools.combinations(range(len(value)), 2):
        if ((int(value[i]) ^ int(value[j])) & ((1 << 64) - 1)).bit_count() <= 4:
            a, b = sorted((least[i], least[j]))
            least = {k: a if v == b else v for k, v in least.items()}
    got = {r.node: r.label for r in simhash.labels(simhash.links(prints)).collect()}
    assert got == {k: v for k, v in least.items() if list(least.values()).count(v) > 1}
    for c in simhash.choices(agreeing):
        moved = simhash.arranged(value.view(np.uint64), c)
        assert all(int(a ^ b).bit_count() == int(x ^ y).bit_count() for a, b, x, y in zip(moved, moved[1:], value.view(np.uint64), value.view(np.uint64)[1:]))


def test_quality_rules(docs):
    def brute(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        three = list(zip(w, w[1:], w[2:]))
        hit = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)} if len(w) < 500 else set()
        own = [y for y in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(own) - len(set(own)), len(hit)]

    texts = [t for t in TEXTS if t is None or len(t.split()) < 500] + ["a b c a b c d a b c", "x\ny\nx\n \n \nx", "# $ |<>"]
    got = rules.statistics(texts)
    assert [[int(got[k][i]) for k in rules.BASE] for i in range(len(texts))] == [brute(x) for x in texts]
    x = rules.matrix(rules.statistics([prose(i, 60 + i) + " #" * (i % 30) for i in range(200)]))
    forest = rules.grow(x, (x[:, 2] < 0.05).astype(float), trees=20)
    for j, sign in enumerate(rules.FEATURES.values()):
        if sign:
            grid = np.repeat(x[:20], 30, axis=0)
            grid[:, j] = np.tile(np.linspace(0, 1, 30), 20)
            assert (np.diff(forest.margin(grid).reshape(20, 30), axis=1) * sign >= -1e-9).all()
    rows = rules.apply(docs, forest).collect()
    assert len(rows) == docs.count() and not any(r.kept for r in rows if r.base_failed) and rules.apply(empty(docs), forest).count() == 0


def test_url_filter(spark):
    listing = spark.createDataFrame([("spam.example.org/en/1",), ("spam.example.org/en/1",), (None,)], "key string")
    cases = {
        "http://www.example.com/en/9": ("www.example.com", "/en/9", "www.example.com/en/", "allow"), "https://a.example.com/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://x.com": ("x.com", "", None, "allow"), "http://X.NET/es/#a": ("x.net", "/es/", "net/es/", "block"), "http://www.spam.example.org/en/1.html?u=2": ("www.spam.example.org", "/en/1.html", None, "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listing).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(pages.where("false"), listing).count() == 0 and urls.judge(pages, listing.where("false")).where("verdict = 'block'").count() == 2
    many = spark.range(20000).selectExpr("concat('k', id) as key")
    blocks = 20000 * urls.BITS_A_KEY // urls.BLOCK_BITS
    words = urls.bloom(many, "key", blocks)
    block, places = urls.bit_places(F.col("key"), blocks)
    assert many.where(urls.maybe(words)(block, places)).count() == 20000
    others = spark.range(20000).selectExpr("concat('other', id) as key")
    assert others.where(urls.maybe(words)(block, places)).count() < 1000


@pytest.mark.parametrize("most", [32 << 20, 64])
def test_listed_urls(spark, monkeypatch, most):
    """``most`` 64 makes the filter a table of blocks."""
    monkeypatch.setattr(urls, "MOST_BYTES", most)
    listing = spark.range(0, 3000, 3).selectExpr("concat('k', id) as key")
    pages = spark.range(3000).selectExpr("id", "concat('k', id) as _key", "1 as _maybe", "2 as _entry", "3 as _w0", "4 as _block", "5 as block").union(spark.createDataFrame([(-1, None, 1, 2, 3, 4, 5)], "id long, _key string, a int, b int, c int, d int, e int"))
    got = urls.listed(pages, listing)
    assert got.columns == [*pages.columns, "_listed"] and {r.id for r in got.where("_listed").collect()} == set(range(0, 3000, 3)) and got.count() == 3001


def test_op8_equals_its_sql_where_hosts_do_not_decide(spark, tmp_path):
    import duckdb

    hosts = ["www.casino-win.example.org", "casino-win.example.org", "m.spam-farm.example.net", "fine.example.org", "a.net", "www.example.com"]
    found = [f"http{'s' * (i % 2)}://{hosts[i % 6]}/{('en', 'es', 'fr')[i % 3]}/{i % 20}{('', '.html', '?a=1', '#t', '/')[i % 5]}" for i in range(300)] + [None, "x", "HTTP://CASINO-WIN.example.org"]
    spark.createDataFrame(list(enumerate(found)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(urls.OP8_SQL).fetchall()
    got = urls.op8_url_filter(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    open_ = [r.verdict for r in got if r.rule is None and "casino-win" in r.host]
    assert "block" in open_ and "allow" in open_


def licence_by_hand(text, model):
    """(number of cued lines, family, families, confidence) by looking at every stretch around every cued line."""
    reach, found = max(len(licenses.words(t)) for ts in licenses.TEMPLATES.values() for t in ts), []
    cued = lambda x: any(c in x.lower() for c in model.cues)
    for run in re.split(licenses.BLANK, text or ""):
        units = [(licenses.words(x), cued(x)) for x in run.split("\n") if licenses.words(x)] if cued(run) else []
        for i, (w, cue) in enumerate(units):
            if not cue:
                continue
            near = [x for u, _ in units[:i] for x in u][-reach:] + w + [x for u, _ in units[i + 1 :] for x in u][:reach]
            sure = []
            for family, texts in licenses.TEMPLATES.items():
                for t in texts:
                    own, best = licenses.words(t), (0, None)
                    for p in range(max(1, len(near) - len(own) + 1)):
                        part = near[p : p + len(own)]
                        hit = len(set(part) & set(own))
                        named = all(x in part for x in own if x in licenses.NAMES[family])
                        if hit >= licenses.CONFIRM * len(set(own)) and named and (len(own) > licenses.SHORT or part == own) and hit > best[0]:
                            best = (hit, part)
                    if best[1]:
                        z = model.scores(" ".join(best[1]))
                        if z.max() >= licenses.FLOOR and model.classes[z.argmax()] == family:
                            sure.append((z.max(), family))
            found.append((model.scores(" ".join(w)).max(), sure))
    good = [x for _, sure in found for x in sure]
    if not found:
        return 0, None, "", 0.0
    top = max(good) if good else (max(x for x, _ in found), "unknown")
    return len(found), top[1], ",".join(sorted({f for _, f in good})), top[0]


#: labelled by hand; none of these lines is a template or a training phrase
LABELLED = {
    "mit": ["This project is released under the MIT License.", "Licensed under the terms of the MIT License.", "Code: MIT License, see LICENSE", "Distributed under the MIT License. See the file.", "It is available as open source under the MIT License"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the License);", "This library uses the Apache License 2.0", "SPDX: Apache-2.0", "Distributed under the Apache License, Version 2.0."],
    "bsd": ["Licensed under the BSD 3-Clause License by the authors.", "This is BSD-3-Clause software", "Use of this source is governed by the BSD License", "Available under the terms BSD-2-Clause"],
    "cc": ["Text is licensed under CC BY-SA 4.0.", "All photos: CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, except figures.", "Figures are CC BY-NC 4.0 unless noted"],
    "gpl": ["Released under GPLv3 or later", "This work is licensed under the GNU General Public License, version 2.", "Licensed under GPL-2.0", "The kernel module is GNU GPL software"],
    "mpl": ["Licensed under the Mozilla Public License 2.0, see file.", "Files under MPL 2.0", "Covered by the Mozilla Public License"],
    "unknown": ["Licensed under the Foo License.", "Released under the Zlib License.", "Available under the ISC License.", "Released under the Artistic License.", "Released under the Unlicense License.", "Licensed under the Boost Software License 1.0.", "Licensed under the Eclipse Public License 2.0.", "Released under the WTFPL License.",
                "Released under the Blue Oak Model License.", "This work is licensed under the Open Government License, version 3.", "Licensed under the Vovida Software License.", "You need a license to drive.", "The license mit dem Bild", "Permission to enter is granted by the owner.", "A work licensed under the law of this land.", "Licensed under the Eiffel Forum License, Version 2.0.", "Public License of the town", "Mozilla is a browser and has no license here"],
}


def test_licences_of_labelled_lines(spark):
    """Each labelled line alone, at the end of a one-line paragraph of any length, and before another line."""
    model = licenses.train([prose(i, 10) for i in range(60)])
    cases = [(f, put(x)) for f, xs in LABELLED.items() for x in xs for put in (lambda x: x, lambda x: f"{prose(5, 10)} {x}", lambda x: f"{prose(6, 200)} {x} {prose(7, 40)}", lambda x: f"Hello there\n{x}", lambda x: f"{prose(8, 60)}\n\n{x}\nmore")]
    cases += [("mit", f"{prose(n, n)} Released under the MIT License.") for n in (1, 5, 10, 20, 40, 80, 200)] + [("gpl", f"{prose(n, n)} This work is licensed under the GNU General Public License, version 3.") for n in (5, 40, 80, 200)]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string").repartition(8)
    rows = sorted(licenses.scan(table, model).collect(), key=lambda r: r.doc_id)
    for r, (_, t) in zip(rows, cases):
        assert (r.n_paragraphs, r.family, r.families) == licence_by_hand(t, model)[:3]
    wrong = [(f, r.family, t[-90:]) for r, (f, t) in zip(rows, cases) if (r.family or "unknown") != f]
    assert len(wrong) <= 0.02 * len(cases), wrong
    assert not [x for x in wrong if x[0] == "unknown"]


def test_licence_scores_of_very_long_lines(spark):
    """Sums of weights that no exponential of a double could hold."""
    model = licenses.train([prose(i, 10) for i in range(60)])
    heavy = licenses.Model(model.classes, model.weights * 500, model.bias, model.temperature, model.cues)
    rows = licenses.scan(spark.createDataFrame([(1, "license " + prose(3, 3000)), (2, "license")], "doc_id long, text string"), heavy).collect()
    assert all(r.family == "unknown" and 0 < r.confidence <= 1 for r in rows)


def test_licences(spark, docs):
    model = licenses.train([prose(i, 10) for i in range(60)])
    texts = [None, "", "plain", "a line\nReleased under the MIT License.\nend", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "He lost his license last year.", "license"]
    table = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    rows = sorted(licenses.scan(table, model).collect(), key=lambda r: r.doc_id)
    assert [r.family for r in rows[:5]] == [None, None, None, "mit", "gpl"] and rows[5].families == "apache,cc" and rows[6].family == rows[7].family == "unknown"
    for r, t in zip(rows, texts):
        assert (r.n_paragraphs, r.family, r.families) == licence_by_hand(t, model)[:3] and r.confidence == pytest.approx(licence_by_hand(t, model)[3], abs=1e-5)
    assert licenses.scan(empty(docs), model).count() == 0


def test_no_confirmed_stretch_is_without_a_cue():
    rng = np.random.default_rng(2)
    cues = licenses.cues_of([prose(i, 50) for i in range(20)] + ["mit mit der license"])
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            own = sorted(set(licenses.words(t)))
            least = int(np.ceil(licenses.CONFIRM * len(own)))
            named = {w for f, ts in licenses.TEMPLATES.items() if t in ts for w in licenses.naming(f, t)}
            for _ in range(20):
                part = rng.choice(own, int(rng.integers(least, len(own) + 1)), replace=False).tolist()
                part = [*part, *(named - set(part))]
                assert licenses.confirmed_by(part) and any(c in " ".join(part) for c in cues)


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "mpl": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def test_licences_of_wrapped_notices_and_names(spark):
    model = licenses.train([prose(i, 10) for i in range(60)])
    narrow = {f: "\n".join(re.sub(r"[*#/\s]+", " ", t).split()) for f, t in NOTICES.items()}
    cases = [(f, f"{prose(70)}\n{t}\n{prose(71)}") for f, t in NOTICES.items()] + [(f, f"{prose(72)}\n\n{t}") for f, t in narrow.items()]
    cases += [("unknown", "Licensed under the Foo Public License."), ("mit", "The MIT License (MIT)"), ("mit", "SPDX-License-Identifier: MIT")]
    cases += [("gpl", "Released under GPLv3."), ("cc", "CC BY-SA 4.0"), (None, "for example a simple word\nkommt mit"), ("unknown", NOTICES["mit"].replace("\n", "\n\n").replace("of this software", "x"))]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    rows = sorted(licenses.scan(table, model).collect(), key=lambda r: r.doc_id)
    assert [r.family for r in rows] == [f for f, _ in cases]


def brute_removed(rows):
    own = [(d, p, frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))) for d, t in rows for p, x in enumerate((t or "").split("\n"))]
    return {(d, p) for k, (d, p, s) in enumerate(own) if s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for _, _, o in own[:k])}


@pytest.mark.parametrize("long_list, often", [(256, 50_000), (3, 50_000), (256, 2), (3, 2)])
def test_line_dedup(spark, monkeypatch, long_list, often):
    """``long_list`` 3 sends most lists through the pivots and the second turn, ``often`` 2 splits them into bands."""
    rng = np.random.default_rng(6)
    base = [prose(i, 12).split() for i in range(6)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(4):
            w = list(base[rng.integers(0, 6)])
            for _ in range(int(rng.integers(0, 4))):
                w[rng.integers(0, len(w))] = f"v{rng.integers(0, 30)}"
            own.append(" ".join(w))
        rows.append((d, "\n".join([*own, "Of.", ""])))
    rows += [(60, None), (61, ""), (62, "\n\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, tag string").repartition(4)
    monkeypatch.setattr(lines, "LONG_LIST", long_list)
    monkeypatch.setattr(lines, "OFTEN", often)
    got = lines.deduplicated(df).collect()
    assert {(r.doc_id, p) for r in got for p in r.removed_lines} == brute_removed(rows)
    for r in got:
        old = dict(rows)[r.doc_id]
        assert r.text == (old if old is None else "\n".join(x for i, x in enumerate(old.split("\n")) if i not in r.removed_lines)) and r.tag == "x"
    assert lines.deduplicated(df.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2)], "doc_id long, text string, n int")
    assert all(r.removed_lines == [] for r in lines.deduplicated(twice).collect())
    clash = twice.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("_doc", "_tag", "_gone", "removed_lines", "_doc_r", "key", "doc", "tag"))])
    got = lines.deduplicated(clash)
    assert sorted(got.columns) == sorted(clash.columns) and {(r._doc, r._tag, r._gone, r.key, r.doc) for r in got.collect()} == {(0, 1, 2, 5, 6)}


def test_bands_of_lengths_that_can_match_are_neighbours():
    n = np.arange(1, 3000)
    low, high = lines.band(n), lines.band(n * 5 // 4)
    assert (high - low <= 1).all() and (low[1:] >= low[:-1]).all()


def test_line_dedup_of_short_lines(spark, tmp_path):
    rng = np.random.default_rng(8)
    pool = ["Of.", "of, ed", "x y z", "a b c d", "a b c d e", "a b c d f", "d c b a", "長い行には空白がない", "", "  ", "p q r s", "p q r s t u", "q r s t u", "Of. of."]
    rows = [(d, "\n".join(rng.choice(pool, 3).tolist() + [f"own{d}"])) for d in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    own = [(d, p, frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))) for d, t in rows for p, x in enumerate(t.split("\n"))]
    want = {(d, p) for k, (d, p, s) in enumerate(own) if s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for _, _, o in own[:k])}
    got = lines.op10_line_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, int(p)) for r in got for p in r.removed.split(",") if p} == want


def test_line_dedup_of_texts_alike_in_32_bits(spark):
    low = lambda x: xxhash.xxh64_intdigest(x.encode(), 42) & 0xFFFFFFFF
    shared = "some line of six words here"
    first = {low(x): x for x in (f"own{i}\n{shared}" for i in range(200_000))}
    other = next(x for x in (f"k{i}\nl{i} m{i} n{i} o{i} p{i}" for i in itertools.count()) if low(x) in first)
    rows = [(1, shared), (7, first[low(other)]), (7, other)]
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted([shared, first[low(other)].split("\n")[0], other])


def test_words_seen_very_often_have_one_order():
    rng = np.random.default_rng(3)
    h, seen = rng.integers(0, 1 << 63, 200, dtype=np.uint64), rng.integers(1 << 24, 1 << 32, 200).astype(np.uint32)
    line = np.zeros(200, dtype=np.int64)
    assert h[lines.ordered(line, seen, h)].tolist() == h[lines.ordered(line + (1 << 20), seen, h)].tolist()


@pytest.mark.parametrize("long_list", [256, 3])
def test_near_copies_by_five_words(spark, monkeypatch, long_list):
    import corpus_pipeline

    def shingles(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def left(table):
        return {i for i, s in table if not any(9 * len(s & o) >= 4 * (len(s) + len(o)) and s for j, o in table if j < i)}

    rng = np.random.default_rng(12)
    rows = []
    for i in range(8):
        base = [f"w{x}" for x in rng.integers(0, 3000, 120)]
        for _ in range(6):
            w = list(base)
            for at in rng.integers(0, 120, int(rng.integers(1, 5))):
                w[at] = f"new{rng.integers(0, 1000)}"
            rows.append((len(rows), "\n".join([" ".join(w[:50]), " ".join(w[50:])])))
    rows += [(len(rows), "one two"), (len(rows) + 1, "One\ntwo"), (len(rows) + 2, ""), (len(rows) + 3, "one two three")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, tag string").repartition(3)
    monkeypatch.setattr(lines, "LONG_LIST", long_list)
    own = {i: shingles(t) for i, t in rows}
    got = lines.first_copies(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == left(list(own.items()))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    first = sorted(r.doc_id for r in simhash.first_of_each(docs).collect())
    assert set(kept) == left([(i, own[i]) for i in first]) and len(kept) < len(first)
    assert lines.first_copies(docs.where("false")).count() == 0
    assert lines.first_copies(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")).count() == 3


def test_pipeline_stages_on_the_smallest_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables are not here")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding"]
    rows = corpus_pipeline.run(spark, sf).collect()
    n = kernel.table(spark, sf, "documents").count()
    assert 0.5 * n < len(rows) < n and len({r.doc_id for r in rows}) == len(rows) and all(len(r.ids) == r.n_pieces for r in rows)
