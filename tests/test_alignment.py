"""Token groups, aligner items, projected text and the result store."""

import time

import pytest
from pyspark.sql import functions as F

from scribeframe.operators import alignment as A
from scribeframe.operators import engines
from scribeframe.sources import cache

TOKENS = "doc long, n long, s double, e double, text string, piece string"


def groups(spark, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], TOKENS).repartition(3)
    return [(r.s, pytest.approx(r.e), r.text) for r in A.token_groups(df).orderBy("g").collect()]


def test_token_groups(spark):
    # a token without duration waits for the next one, punctuation without duration joins the group before
    assert groups(spark, [(0.0, 0.0, "a", "▁a"), (0.0, 0.4, "b", "b"), (0.4, 0.4, ",", ","), (0.5, 0.9, "c", "▁c")]) == [(0.0, 0.4, "ab,"), (0.5, 0.9, " c")]
    # punctuation after a waiting token waits too; nothing spans time at the end, so it joins the last group
    assert groups(spark, [(0.0, 0.4, "a", "▁a"), (0.4, 0.4, "b", "b"), (0.4, 0.4, ".", ".")]) == [(0.0, 0.4, "ab.")]
    assert groups(spark, [(1.0, 1.0, "a", "▁a")]) == [(1.0, 1.08, "a")]
    assert groups(spark, [(0.0, 0.2, "", "<0xC3>"), (0.2, 0.4, "", "<0xA9>")]) == [(0.0, 0.4, "é")]
    assert groups(spark, [(0.0, 0.0, "?", "?"), (0.0, 0.3, None, None), (0.3, 0.5, "x", None)]) == [(0.0, 0.3, "?"), (0.3, 0.5, "x")]
    assert A.token_groups(spark.createDataFrame([], TOKENS)).count() == 0


def test_items_in_text(spark):
    assert A.standing("Oh, (my) word.", ["Oh", "my", "word"]) == [(0, 2), (5, 7), (9, 13)]
    # a half-width sound mark composes with its base, so the item covers both characters
    assert A.standing("ｶﾞb", ["ガ", "b"]) == [(0, 2), (2, 3)] and A.standing("ＡＢ1", ["AB", "1"]) == [(0, 2), (2, 3)]
    assert A.standing("㍿", ["株式", "会社"]) is None and A.standing("a", []) is None and A.standing("a", ["", "a"]) is None
    assert A.standing("a-b", ["a-b"]) is None and A.standing("a_b", ["ab"]) == [(0, 3)] and A.standing("a b", ["a"]) is None
    df = spark.createDataFrame([("Oh, (my) word.", ["Oh", "my", "word"]), ("x", ["y"]), (None, ["y"])], "t string, i array<string>")
    rows = df.select("t", A.item_ranges("t", "i").alias("r")).select(A.parts_of(F.col("t"), F.col("r")).alias("p")).collect()
    assert [r.p for r in rows] == [["Oh,", " (my)", " word."], None, None]


def spoken(spark, parts, times, duration=1.0):
    """Words of one chunk whose items are the parts, with times of which None is not the aligner's own."""
    items = [(x.strip(" ,."), times[2 * k] or 0.0, times[2 * k + 1] or 0.0, times[2 * k] is not None, times[2 * k + 1] is not None) for k, x in enumerate(parts)]
    schema = "doc long, chunk long, text string, duration double, items array<struct<text: string, s: double, e: double, own_s: boolean, own_e: boolean>>"
    return [tuple(r)[3:] for r in A.aligned_words(spark.createDataFrame([(1, 0, "".join(parts), duration, items)], schema)).orderBy("pos").collect()]


def test_timed_groups(spark):
    assert spoken(spark, ["a,", " b"], [0.0, 0.2, 0.2, 0.5]) == [("a,", 0.0, 0.2, None), (" b", 0.2, 0.5, None)]
    assert spoken(spark, ["to", " the", " end"], [0.0, 0.2, None, 0.5, 0.5, 0.9]) == [("to", 0.0, 0.2, "interpolated"), (" the", 0.2, 0.5, "interpolated"), (" end", 0.5, 0.9, None)]
    assert spoken(spark, ["aa", " aa", " a"], [0.0, 0.2, 0.2, None, None, None]) == [("aa", 0.0, 0.08, "interpolated"), (" aa", 0.08, 0.16, "interpolated"), (" a", 0.16, 0.2, "interpolated")]
    assert spoken(spark, ["a"], [None, None]) == [] and spoken(spark, ["a"], [0.3, 0.3]) == []
    assert spoken(spark, ["a", "b"], [0.1, 0.4, 0.4, 7.0]) == [("ab", 0.1, 0.4, None)]
    assert spoken(spark, ["to", " the"], [0.0, None, None, 1.0]) == [("to", 0.0, 0.4, "interpolated"), (" the", 0.4, 1.0, "interpolated")]
    assert spoken(spark, ["東", "京"], [0.0, None, None, 1.0]) == [("東京", 0.0, 1.0, None)]
    assert spoken(spark, ["a", " b"], [0.2, 0.6, 0.6, 0.6]) == [("a", 0.2, 0.4, "interpolated"), (" b", 0.4, 0.6, "interpolated")]


def test_aligned_words(spark):
    schema = "doc long, chunk long, text string, duration double, items array<struct<text: string, s: double, e: double>>, raw array<long>, fixed array<long>"
    items = [("go", 0.0, 0.3), ("on", 0.3, 0.6)]
    rows = [(1, 0, "go on.", 1.0, items, [0, 300, 300, 600], [0, 300, 300, 600]), (1, 1, "go on", 1.0, items, [0, 999, 300, 600], [0, 300, 300, 600]), (1, 2, "go on", 1.0, items, [0, 300], [0, 300]), (1, 3, None, 1.0, None, None, None)]
    chunks = spark.createDataFrame(rows, schema).withColumn("items", A.aligned_items(F.col("items"), F.col("raw"), F.col("fixed")))
    found = [(r.chunk, r.text, r.s, r.e, r.timing) for r in A.aligned_words(chunks).orderBy("chunk", "pos").collect()]
    assert found == [(0, "go", 0.0, 0.3, None), (0, " on.", 0.3, 0.6, None), (1, "go", 0.0, 0.3, "interpolated"), (1, " on", 0.3, 0.6, "interpolated")]


def test_projection(spark):
    plain = [("he", 0.0, 0.2), (" said", 0.2, 0.5), (" aspirn", 0.5, 0.9)]
    finals = ["he said aspirin", "he aspirn", " said aspirn", "he said aspirn", None, "he said so aspirn"]
    own = spark.createDataFrame([(d, i, s, e, x) for d in range(len(finals)) for i, (x, s, e) in enumerate(plain, 1)], "doc long, g long, s double, e double, text string")
    rows = A.projected(own, spark.createDataFrame(list(enumerate(finals)), "doc long, text string")).orderBy("doc", "g").collect()
    found = [[(r.text, r.s, r.e) for r in rows if r.doc == d] for d in range(len(finals))]
    assert found[0] == [("he", 0.0, 0.2), (" said", 0.2, 0.5), (" aspirin", 0.5, 0.9)]
    assert found[1] == [("he", 0.0, 0.5), (" aspirn", 0.5, 0.9)] and found[2] == [(" said", 0.0, 0.5), (" aspirn", 0.5, 0.9)]
    assert found[3] == found[4] == plain and "".join(x for x, _, _ in found[5]) == finals[5] and len(found[5]) == 3


def test_store(spark, tmp_path):
    root, a, b = f"{tmp_path}/store", "a" * 64, "b" * 64
    ask = spark.createDataFrame([(a, "f"), (b, "f"), ("c" * 64, "f")], "key string, fingerprint string")
    assert {r.status for r in cache.get(ask, root).collect()} == {"miss"} and cache.clear(spark, root) == 0
    cache.put(spark.createDataFrame([(a, "f", "{}"), (b, "other", "{}"), ("short", "f", "{}")], "key string, fingerprint string, document string"), root)
    assert {r.key[0]: (r.status, r.document) for r in cache.get(ask, root).collect()} == {"a": ("hit", "{}"), "b": ("invalid", None), "c": ("miss", None)}
    assert tuple(cache.size(spark, root).first()) == (2, 4) and cache.entries(spark, root).count() == 2
    assert cache.clear(spark, root) == 2 and cache.size(spark, root).first().entries == 0


def test_health(spark):
    specs = engines.engines(spark)
    rows = {r.check: r.status for r in engines.health(specs, {"ffmpeg": "7", "ffprobe": None}).collect()}
    assert rows["ffprobe"] == "MISSING" and rows["engine:aligner"] == "MISSING" and rows["engine:program"] == "AVAILABLE"
    tools = {"ffmpeg": "7", "ffprobe": "7"}
    assert engines.ready(specs, tools, "fast-local") and not engines.ready(specs, tools, "aligner")
    assert not engines.ready(specs, {"ffmpeg": "7", "ffprobe": None}, "fast-local")
    assert not engines.ready(specs, tools, "fast-local", offline=True) and engines.ready(specs, tools, "fast-local", offline=True, local_models=["tiny"])


def test_long_chunks_cost_no_more_a_word(spark):
    """A chunk of 4,000 words: cuts and steps are worked out once, not at each word."""
    began, n = time.time(), 4000
    text = " ".join(f"w{k}" for k in range(n))
    items = [(f"w{k}", k * 1.0, k + 0.5, True, k % 5 != 3) for k in range(n)]
    chunks = spark.createDataFrame([(1, 1, text, 1e5, items)], "doc long, chunk long, text string, duration double, items array<struct<text: string, s: double, e: double, own_s: boolean, own_e: boolean>>")
    rows = A.aligned_words(chunks).orderBy("pos").collect()
    assert [r.text.strip() for r in rows] == text.split() and rows[2].e == 2.5 and time.time() - began < 60
