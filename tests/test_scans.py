"""Scans of documents beside a transcript, rules and reports of a run, widened words."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scribeframe.operators import builder, runs
from scribeframe.sources import scans


def documents(spark, *docs):
    return spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(docs)], "doc long, json string")


def test_speech_regions(spark):
    own = {"kind": "speech_regions", "data": {"regions": [{"start": 2, "end": 3}, {"start": 0, "end": 1.5}, {"start": 1, "end": 2, "p": 0.3}]}}
    old = {"kind": "speech_regions", "data": {"segments": [{"start": 1, "end": 2}]}}
    good, bad = scans.speech_regions(documents(spark, own, {"observation": own}, {"results": [own | {"status": "failed"}, {"kind": "speech_regions", "observation": old}]}, {"results": [own, own]}, {"kind": "x"}, {"kind": "speech_regions", "data": {"regions": [{"start": 2, "end": 1}]}}, "no json", {"kind": "speech_regions", "data": {"regions": []}}))
    assert sorted(tuple(r) for r in good.collect()) == [(0, 0.0, 3.0), (1, 0.0, 3.0), (2, 1.0, 2.0)]
    assert {r.doc: r.reason for r in bad.collect()} == {3: "shape", 4: "shape", 5: "region", 6: "shape"}


def test_slides_and_lists(spark):
    deck = {"schema": "slide-sync/deck@1", "pages": [{"text": "a"}, {"text": "b"}], "source": {"sha256": "f" * 64}}
    good, bad = scans.slides(documents(spark, deck, ["p", "q"], deck | {"pages": [{"text": "a"}, {}]}, {"schema": "x", "pages": []}))
    assert sorted(map(tuple, good.collect()), key=str) == [(0, 0, "a", "f" * 64), (0, 1, "b", "f" * 64), (1, 0, "p", None), (1, 1, "q", None)]
    assert {r.doc: r.reason for r in bad.collect()} == {2: "page", 3: "schema"}
    rows = documents(spark, None, "null", '"one"', '["a", "b"]', "5", '["a", null]', json.dumps(["x"] * 2001))
    assert [r.t for r in rows.orderBy("doc").select(scans.texts(F.col("json")).alias("t")).collect()] == [[], [], ["one"], ["a", "b"], None, None, None]


def test_turns_and_lines(spark, tmp_path):
    rows = [(1, 0, 0.0, 1.0, "SPEAKER_00"), (1, 1, 0.995, 2.0, "SPEAKER_01"), (2, 0, 0.0, 2.0, "SPEAKER_00"), (2, 1, 1.0, 3.0, "Bob"), (3, 0, 2.0, 1.0, "SPEAKER_00"), (3, 1, None, 1.0, "SPEAKER_00")]
    got = {(r.doc, r.rule) for r in scans.turn_rules(spark.createDataFrame(rows, "doc long, n int, s double, e double, speaker string")).collect()}
    assert got == {(2, "order"), (2, "speaker"), (3, "times")}
    (tmp_path / "out.txt").write_text('{"a": 1}\n\n[1]\n{broken\n {"b": {}}\n')
    good, bad = scans.json_lines(spark, str(tmp_path / "out.txt"))
    assert sorted(str(json.loads(r.json)) for r in good.collect()) == ["{'a': 1}", "{'b': {}}"] and {r.line for r in bad.collect()} == {"[1]", "{broken"}


def test_widened_words(spark):
    cases = {  # words of one segment from 0.2 to 1.0, and what they become
        ((0.2, 0.5), (0.5, 0.5), (0.6, 0.9)): ((0.2, 0.5), (0.5, 0.51), (0.6, 0.9)),
        ((0.2, 0.5), (0.5, 0.5), (0.5, 0.9)): ((0.2, 0.5), (0.5, 0.5), (0.5, 0.9)),
        ((0.2, 0.4), (0.5, 0.5), (0.5, 0.9)): ((0.2, 0.4), (0.49, 0.5), (0.5, 0.9)),
        ((0.2, 0.2), (0.3, 0.3), (1.0, 1.0)): ((0.2, 0.21), (0.3, 0.31), (0.99, 1.0)),
        ((0.2, 0.3), (0.9, 0.5), (2.0, 2.0)): ((0.2, 0.3), (0.9, 0.5), (2.0, 2.0)),
        ((0.5, 0.5), (0.505, 0.505), (0.505, 0.9)): ((0.495, 0.505), (0.505, 0.505), (0.505, 0.9)),
    }
    words = spark.createDataFrame([(1, k, i, s, e, "w") for k, own in enumerate(cases) for i, (s, e) in enumerate(own)], "doc long, seg int, pos int, s double, e double, text string")
    segments = spark.createDataFrame([(1, k, 0.2, 1.0) for k in range(len(cases))], "doc long, seg int, s double, e double")
    got = builder.widen(words, segments)
    assert got.columns[3:] == ["s", "e", "text"]
    for k, want in enumerate(cases.values()):
        assert tuple((pytest.approx(r.s), pytest.approx(r.e)) for r in got.where(F.col("seg") == k).orderBy("pos").collect()) == want


def test_rules_of_a_run(spark):
    asked = [(1, None, 1, None, False), (2, 30.0, 8, "en", True), (3, 10.0, 1, "en", False), (4, 60.0, 1, None, False), (5, 60.0, 9, "en", False), (6, None, 2, "en", False), (7, None, None, None, True)]
    got = {r.req: r.reason for r in runs.chunk_rules(spark.createDataFrame(asked, "req int, chunk_seconds double, parallel int, language string, regions boolean")).collect()}
    assert got == {3: "chunk_seconds", 4: "language_required_for_chunking", 5: "parallel", 6: "chunk_seconds_required", 7: "chunk_seconds_required"}
    assert [r.req for r in runs.over_budget(spark.createDataFrame([(1, 5.0, 4.0), (2, 4.0, 4.0), (3, 9.0, None)], "req int, duration double, most double")).collect()] == [1]
    cuts = spark.createDataFrame([(1, 0, 30.0, "level", -39.9), (1, 1, 60.0, "level", -40.0), (1, 2, 90.0, "region", None)], "doc long, chunk int, e double, source string, level double")
    assert [tuple(r) for r in runs.cut_warnings(cuts).collect()] == [(1, 0, 30.0, -39.9)]
    chunks = spark.createDataFrame([(1, 0, True, None, "en"), (1, 1, False, 1.2345, "en"), (2, 0, False, 2.0, "ja"), (2, 1, False, 1.0, "en"), (3, 0, True, None, None)], "doc long, chunk int, from_cache boolean, engine_seconds double, language string")
    assert sorted(map(tuple, runs.chunk_totals(chunks).collect())) == [(1, 2, 1, 1, 1.235), (2, 2, 0, 2, 3.0), (3, 1, 1, 0, 0.0)]
    assert sorted(map(tuple, runs.languages(chunks).collect())) == [(1, "en", None), (2, None, "en, ja")]
    indexed = spark.createDataFrame([(1, 0), (1, None), (2, 0)], "doc long, idx long")
    assert {r.doc: r.lacks for r in runs.lacks_indices(indexed).collect()} == {1: True, 2: False}


def test_small_functions(spark):
    content = bytes(44) + bytes(range(20))
    row = spark.createDataFrame([(content, "sha256:" + "ab" * 32, ["助動詞", "x"], [], ["連体詞"])], "c binary, f string, p array<string>, q array<string>, r array<string>").select(
        runs.sample_hash(F.col("c"), F.lit(2), F.lit(5)).alias("h"), runs.asset_id(F.col("f")).alias("a"), runs.coarse_pos(F.col("p")).alias("p"), runs.coarse_pos(F.col("q")).alias("q"), runs.coarse_pos(F.col("r")).alias("r"), runs.realtime_factor(F.lit(1.0), F.lit(3.0)).alias("x"), runs.realtime_factor(F.lit(1.0), F.lit(0.0)).alias("y")
    ).first()
    assert tuple(row) == (hashlib.sha256(bytes(range(4, 10))).hexdigest(), "asset_" + "ab" * 8, "auxiliary", "other", "other", 0.3333, None)
    terms = spark.createDataFrame([("  a \t b ",), ("x" * 101,), ("a\x00b",), ("hf_" + "a" * 20,)], "t string")
    text, reason = runs.clean_term(F.col("t"))
    assert [(r.x if r.y is None else None, r.y) for r in terms.select(text.alias("x"), reason.alias("y")).collect()] == [("a b", None), (None, "long"), (None, "control"), (None, "credential")]
