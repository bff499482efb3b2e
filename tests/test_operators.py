"""Operators on small documents with known results."""

import json
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribeframe.functions import text as T
from scribeframe.operators import builder, engines, export, find, intervals, select, speakers, validate, vocabulary
from scribeframe.sources import documents


def units(spark, segments, doc=1):
    rows, idx = [], 0
    for seg, words in enumerate(segments):
        for pos, (text, s, e, *role) in enumerate(words):
            rows.append((doc, seg, pos, idx, s, e, text, role[0] if role else None, True))
            idx += 1
    return spark.createDataFrame(rows, "doc long, seg int, pos int, idx long, s long, e long, text string, role string, timed boolean")


def brute_fold(text, before=""):
    """Character after character, as the contract words it."""
    out, ranges, i = "", [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.category(text[j])[0] == "M" or text[j] in "ﾞﾟ"):
            j += 1
        for c in unicodedata.normalize("NFKC", text[i:j]).casefold():
            last = (out or before)[-1:]
            if c in "-‐‑‒–—―−─━ｰ":
                c = "ー" if last and ("ぁ" <= last <= "ヿ" or "ㇰ" <= last <= "ㇿ") else ""
            elif c != "ー" and (unicodedata.category(c)[0] in "ZPC" or c.isspace()):
                c = ""
            out += c
            ranges += [(i, j)] * len(c)
        i = j
    return out, ranges


FOLDED = ["ｻｳﾝﾄﾞ", "Straße-Weg!", "コ-ヒ—", "-a", "--", "―カ―", "e\u0301a-ｶ\uff9e−x", "\u0301x", "ＦＵＬＬ ﬁne", "\ue000カ\ue000", "10\u2044x ½", "カ\u3099-", "¿Qué?", "a\tb\x1c$+", "", "İI", "ー━", "x\u200dy"]


def test_folding(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*FOLDED, None])], "i int, x string")
    got = {r.i: r.f for r in rows.select("i", T.folded(F.col("x")).alias("f")).collect()}
    for i, x in enumerate(FOLDED):
        for before in ("", "a", "カ"):
            assert (T.fold(x, before == "カ"), T.folded_ranges(x, before == "カ")) == brute_fold(x, before)
        assert got[i] == brute_fold(x)[0]
    assert got[len(FOLDED)] is None


def test_folding_across_units(spark):
    rng = np.random.default_rng(0)
    texts = [[FOLDED[k] for k in rng.integers(0, len(FOLDED), 30)] for _ in range(8)]
    u = spark.createDataFrame([(d, i, x) for d, own in enumerate(texts) for i, x in enumerate(own)], "doc long, idx long, text string")
    got = {(r.doc, r.idx): (r.f, r.a) for r in find.folded(u).collect()}
    for d, own in enumerate(texts):
        stream = ""
        for i, x in enumerate(own):
            f = brute_fold(x, stream)[0]
            assert got[d, i] == (f, len(stream))
            stream += f


def test_find_across_words_and_segments(spark):
    u = units(spark, [[("Sound-", 0, 400, "A"), ("design", 500, 900, "A")], [("matters,", 1000, 1400, "B"), ("sound", 1500, 1900, "B"), ("Design!", 2000, 2400, "B")]])
    hits = sorted(find.find(u, "sound design").collect(), key=lambda r: r.start)
    assert [(r.start, r.end, r.match, r.first_word, r.last_word, r.speaker) for r in hits] == [(0, 900, "normalized", 0, 1, "A"), (1500, 2400, "normalized", 3, 4, "B")]
    crossing = find.find(u, "design matters").collect()
    assert [(r.seg, r.last_seg, r.speaker) for r in crossing] == [(0, 1, None)]
    assert find.find(u, "Sound-design").collect()[0].match == "exact"
    # the quotation \Q of the phrase ends at no character of it
    assert find.find(units(spark, [[("aa", 0, 1), ("aa", 2, 3), ("a", 4, 5)]]), "aa").count() == 2


def test_find_folds_units_and_phrase_alike(spark):
    u = units(spark, [[("Hauptstraße", 0, 400), ("ＦＵＬＬ", 500, 900), ("コ−ヒ", 1000, 1400), ("━", 1500, 1900), ("FULL", 2000, 2400)]])
    found = lambda phrase: sorted((r.first_word, r.last_word) for r in find.find(u, phrase).collect())
    assert found("hauptSTRASSE") == [(0, 0)] and found("full") == [(1, 1), (4, 4)] and found("コーヒー") == [(2, 3)]
    assert sorted((r.first_word, r.last_word) for r in find.find_fuzzy(u, "fulx", 0.7).collect()) == [(1, 1), (4, 4)]


def brute_approximate(stream, phrase, threshold, exact):
    """All windows of all starts by the library's ratio."""
    taken, found = set(i for p in exact for i in range(p, p + len(phrase))), []
    low = max(1, round(0.8 * len(phrase)))
    for a in range(len(stream)):
        own = []
        for b in range(a + low, a + max(low, round(1.2 * len(phrase))) + 1):
            if b <= len(stream) and not taken & set(range(a, b)):
                own.append((-SequenceMatcher(None, stream[a:b], phrase, autojunk=False).ratio(), a, b))
        found += [min(x for x in own if -1 < x[0] <= -threshold)] if any(-1 < x[0] <= -threshold for x in own) else []
    out = []
    for r, a, b in sorted(found):
        if not taken & set(range(a, b)):
            taken |= set(range(a, b))
            out.append((a, b, -r))
    return sorted(out)


def test_fuzzy():
    rng = np.random.default_rng(5)
    for _ in range(60):
        stream, phrase = ("".join(rng.choice(list("abc"), n)) for n in (int(rng.integers(0, 40)), int(rng.integers(1, 9))))
        exact = [stream.find(phrase)] if phrase in stream else []
        assert find.approximate(stream, phrase, 0.7, exact) == brute_approximate(stream, phrase, 0.7, exact)
    assert find.cost(100_000, 10) == 100_000 * 5 * 100


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join(spark, width):
    rng = np.random.default_rng(6)
    rows = lambda n: [(int(k), int(s), int(s + d)) for k, s, d in zip(rng.integers(0, 2, n), rng.integers(-20, 60, n), rng.integers(0, 15, n))]
    a, b = rows(40), rows(30)
    x = spark.createDataFrame([*a, (0, None, 3)], "k int, s long, e long")
    y = spark.createDataFrame(b, "k int, ts long, te long")
    want = sorted((*p, *q[1:]) for p in a for q in b if p[0] == q[0] and q[1] < p[2] and q[2] > p[1])
    assert sorted(tuple(r) for r in intervals.binned(x, y, ["k"], width=width).select("k", "s", "e", "ts", "te").collect()) == want
    assert sorted(tuple(r) for r in intervals.touching(x, y, ["k"], width).select("k", "s", "e").collect()) == sorted(p for p in a if any(p == w[:3] for w in want))


def test_overlaps_are_included_to_the_end(spark):
    n = 70  # a staircase: each unit overlaps the next
    u = units(spark, [[(f"w{i}", 100 * i, 100 * i + 150) for i in range(n)], [("last", 100 * n + 500, 100 * n + 600)]])
    duration = spark.createDataFrame([(1, 100 * n + 1000)], "doc long, duration long")
    found = select.select(u, duration, "remove", ranges=spark.createDataFrame([(1, 0, 0)], "doc long, first long, last long"), overlap="include")
    assert [(r.first, r.last) for r in found["ranges"].collect()] == [(0, n - 1)]


def test_selection(spark):
    u = units(spark, [[("a", 100, 200), ("b", 300, 400)], [("c", 500, 600), ("d", 700, 800)]])
    duration = spark.createDataFrame([(1, 1000)], "doc long, duration long")
    ranges = spark.createDataFrame([(1, 1, 2)], "doc long, first long, last long")
    removed = select.select(u, duration, "remove", ranges=ranges)
    assert [(r.id, r.start, r.end, r.lo, r.hi, r.most, r.first, r.last) for r in removed["spans"].collect()] == [("r1", 300, 600, 200, 700, 500, 1, 2)]
    kept = sorted(select.select(u, duration, "keep", ranges=ranges)["spans"].collect(), key=lambda r: r.start)
    assert [(r.id, r.start, r.end, r.lo, r.hi) for r in kept] == [("r1", 100, 200, 0, 300), ("r2", 700, 800, 600, 1000)]
    whole = select.select(u, duration, "keep", segments=spark.createDataFrame([(1, 0), (1, 1)], "doc long, seg int"))
    assert [r.reason for r in whole["refused"].collect()] == ["nothing_removed"]
    bad = select.check_ranges(spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 3, 9)], "doc long, first long, last long"), u)
    assert sorted(r.reason or "" for r in bad.collect()) == ["", "out_of_range", "overlapping"]


def test_selection_with_crosstalk(spark):
    u = units(spark, [[("a", 0, 100), ("b", 150, 300)], [("c", 250, 400), ("d", 390, 500), ("e", 600, 700)]])
    duration = spark.createDataFrame([(1, 900)], "doc long, duration long")
    ranges = spark.createDataFrame([(1, 1, 1)], "doc long, first long, last long")
    assert [r.reason for r in select.select(u, duration, "remove", ranges=ranges)["refused"].collect()] == ["overlap"]
    grown = select.select(u, duration, "remove", ranges=ranges, overlap="include")["spans"].collect()
    assert [(r.start, r.end, r.first, r.last) for r in grown] == [(150, 500, 1, 3)]


def test_speakers(spark):
    w = units(spark, [[("a", 0, 1000), ("b", 1500, 2500), ("c", 2600, 4000)], [("gap", 9000, 9500)]])
    segs = spark.createDataFrame([(1, 0, 0, 4000), (1, 1, 9000, 9500), (1, 2, 4200, 4800)], "doc long, seg int, s long, e long")
    turns = spark.createDataFrame([(1, "SPEAKER_00", 0, 2000), (1, "SPEAKER_01", 2000, 5000)], "doc long, speaker string, s long, e long")
    words, segments = speakers.merge(w.drop("role"), segs, turns)
    assert [r.speaker for r in words.orderBy("idx").collect()] == ["SPEAKER_00", None, "SPEAKER_01", None]
    assert {r.seg: r.speaker for r in segments.collect()} == {0: "SPEAKER_01", 1: None, 2: "SPEAKER_01"}
    with pytest.raises(ValueError):
        speakers.merge(words, segments, turns)
    counts = speakers.counts(segments, words).collect()[0]
    assert (counts.assigned, counts.unassigned, counts.words_assigned) == (2, 1, 2)


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 2, 3), (1, 10, 12), (1, 13, 15)], "k long, s long, e long")
    assert sorted((r.start, r.end) for r in intervals.union(rows, ["k"]).collect()) == [(0, 12), (13, 15)]
    grouped = intervals.gap_groups(rows, ["k"], ["s"], 1).collect()
    assert max(r.g for r in grouped) == 2  # the row at 10 is compared with the end 3 of the row before it


def test_exports(spark):
    segs = spark.createDataFrame([(1, 0, 0, 1500, "Hi"), (1, 1, 3_661_001, 3_662_000, "you")], "doc long, seg int, s long, e long, text string")
    assert export.render(segs, "srt").collect()[0].content == "1\n00:00:00,000 --> 00:00:01,500\nHi\n\n2\n01:01:01,001 --> 01:01:02,000\nyou\n"
    assert export.render(segs, "vtt").collect()[0].content.startswith("WEBVTT\n\n00:00:00.000 -->")
    assert export.render(segs, "tsv").collect()[0].content == "start\tend\ttext\n0\t1500\tHi\n3661001\t3662000\tyou\n"
    with pytest.raises(ValueError):
        export.render(segs, "doc")


def test_validation_and_leaks(spark):
    segs = spark.createDataFrame([(1, 0, "a", 0.0, 2.0, "x", 5.0), (1, 1, "a", 1.0, 3.0, "x", 5.0), (1, 2, "c", 4.0, 3.0, "x", 5.0), (1, 3, "d", 2.5, 6.0, "x", 5.0)], "doc long, seg int, id string, s double, e double, text string, duration double")
    found = {(r.seg, r.rule) for r in validate.segment_rules(segs).collect()}
    assert found == {(0, "duplicate_id"), (1, "duplicate_id"), (1, "overlap"), (2, "times"), (3, "end"), (3, "overlap")}
    docs = spark.createDataFrame([(1, json.dumps({"a": {"password": 3, "text": "see /home/x/y"}, "note": "in /home/x/y", "k": ["ghp_" + "a" * 24]}))], "doc long, json string")
    assert {(r.key, r.reason) for r in validate.leaks(validate.json_strings(docs)).collect()} == {("password", "key"), ("k", "secret")}
    cases = {"C:\\Users\\x\\y": "path", "~/private/a": "path", "/data/in/x.wav": "path", "hf_" + "a" * 20: "secret", "gho_" + "a" * 20: "secret", "sk-ant-" + "a1" * 10: "secret", "ffmpeg -i a": "command", "x $(ls)": "command", "a | sh": "command", "plain /text": None, "MY_API_KEY=abc": "secret"}
    rows = spark.createDataFrame([(i, k, v) for i, v in enumerate(cases) for k in ("note", "text")], "doc long, key string, value string")
    got = {(r.doc, r.key): r.reason for r in validate.leaks(rows).collect()}
    for i, (v, reason) in enumerate(cases.items()):
        assert got.get((i, "note")) == reason and got.get((i, "text")) == (reason if reason == "secret" else None)
    keys = spark.createDataFrame([(1, k, None) for k in ("CMD", "credentials", "ApiKey", "fine", None)], "doc long, key string, value string")
    assert sorted(r.key for r in validate.leaks(keys).collect()) == ["ApiKey", "CMD", "credentials"]


def test_corrections():
    rules = vocabulary.Rules([("open ai", "OpenAI", "word"), ("open", "closed", "word")])
    assert rules.apply("Open AI is open, opener") == "OpenAI is closed, opener"
    with pytest.raises(ValueError):
        vocabulary.Rules([("a", "b", "word"), ("A", "c", "word")])


def test_engines(spark):
    req = spark.createDataFrame([(1, None, "fr", True, True, False), (2, "aligner", "en", False, False, False)], "req long, engine string, language string, offline boolean, needs_words boolean, needs_vocabulary boolean")
    got = {(r.req, r.id): r.reasons for r in engines.rejected(req, engines.engines(spark)).collect()}
    assert got[1, "cloud-large"] == "network_required" and got[1, "program"] == "" and got[1, "ja-local"] == "language_unsupported,word_timestamps_unsupported" and got[2, "aligner"] == "engine_not_installed" and got[2, "program"] == "engine_id_mismatch"
    with pytest.raises(ValueError):
        engines.Registry([engines.ENGINES[0], engines.ENGINES[0]])


def test_error_rates():
    assert T.word_errors("a b c".split(), "a x c d".split()) == 2


def test_documents(spark, tmp_path):
    doc = {"schema": "transcript/0.1", "id": "t1", "duration": 4.0, "segments": [{"id": "s1", "start": 0.0, "end": 1.0, "text": "a b", "words": [{"start": 0.0, "end": 0.4, "text": "a"}, {"start": 0.5, "end": 1.0, "text": "b"}]}, {"id": "s2", "start": 2.0, "end": 3.0, "text": "no words", "words": None}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "bad.json").write_text("{")
    docs = documents.transcripts(spark, str(tmp_path)).cache()
    assert docs.where("_corrupt_record is not null").count() == 1
    good = docs.where("_corrupt_record is null")
    assert [(r.text, r.timed, r.idx) for r in documents.units(good).orderBy("idx").collect()] == [("a", True, 0), ("b", True, 1), ("no words", False, 2)]
    back = documents.rebuilt(documents.segments(good)).collect()[0]
    assert [s.id for s in back.segments] == ["s1", "s2"] and back.segments[0].words[1].text == "b"
