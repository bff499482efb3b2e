"""Requests: each rule by a case, canonical JSON against Python's, keys and dry runs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scribeframe.operators import requests as R

REGIONS = {"kind": "speech_regions", "data": {"regions": [{"start": 0.5, "end": 2.0}, {"start": 2.0, "end": 3.25}, {"start": 9, "end": 10}]}}
SOUND = [
    {}, {"language": " JA "}, {"language": "auto", "temperature": 1}, {"temperature": 0.00001, "beam_size": 10, "audio_stream": 2}, {"initial_prompt": "a \"b\" \\ \n \u001f\u0002 é 日本 / \u007f  "}, {"initial_prompt": "  "},
    {"vocabulary": {"心房 ": ["しん", " しん", ""], "B": "b", "a": []}}, {"vocabulary": {}}, {"word_segmentation": "dictionary", "language": "ja", "word_timestamps": True}, {"word_segmentation": None, "model": None, "vad_filter": True},
    {"chunk_seconds": 30, "language": "en", "parallel": 8}, {"chunk_seconds": 45.5, "language": "en", "speech_regions": REGIONS}, {"corrections": {"a  b": "c"}}, {"corrections": [{"from": "x", "to": "y", "match": "substring"}]}, {"corrections": []},
    {"budget": {"timeout": 3, "max_audio_seconds": 20.5}}, {"domain_vocabulary": {"terms": ["SGLT2"], "max_terms": 200, "japanese": False}}, {"asset_id": "x" * 128, "allowed_input_roots": ["/a"], "cache": False, "offline": True},
]
BROKEN = [
    ("", "not_an_object", "[1]"), ("", "not_an_object", "{"), ("", "not_an_object", None), ("", "forbidden_key", {"CMD": 1}), ("", "unknown_key", {"x": 1}), ("input", "missing", {"input": " "}), ("input", "missing", {"input": 3}), ("input", "characters", {"input": "a\nb"}),
    ("language", "type", {"language": 3}), ("language", "code", {"language": "english"}), ("language", "code", {"language": "dé"}), ("engine", "id", {"engine": "a b"}), ("engine", "id", {"engine": None}), ("engine", "id", {"engine": "_-"}), ("model", "name", {"model": "a/b"}), ("model", "name", {"model": ".x"}), ("model", "name", {"model": ""}),
    ("word_timestamps", "type", {"word_timestamps": 1}), ("word_timestamps", "type", {"word_timestamps": None}), ("temperature", "range", {"temperature": 1.5}), ("temperature", "range", {"temperature": True}), ("temperature", "range", {"temperature": None}), ("beam_size", "range", {"beam_size": 5.0}), ("beam_size", "range", {"beam_size": 0}),
    ("audio_stream", "range", {"audio_stream": -1}), ("audio_stream", "range", {"audio_stream": True}), ("initial_prompt", "type", {"initial_prompt": 1}), ("initial_prompt", "long", {"initial_prompt": "x" * 501}), ("initial_prompt", "credential", {"initial_prompt": "hf_" + "a" * 20}),
    ("asset_id", "text", {"asset_id": "x" * 129}), ("asset_id", "text", {"asset_id": ""}), ("cache", "type", {"cache": "yes"}), ("offline", "type", {"offline": 0}), ("allowed_input_roots", "list", {"allowed_input_roots": []}), ("allowed_input_roots", "list", {"allowed_input_roots": [1]}), ("workspace", "text", {"workspace": " "}), ("vad_filter", "type", {"vad_filter": None}),
    ("vocabulary", "type", {"vocabulary": ["a"]}), ("vocabulary", "many", {"vocabulary": {str(i): [] for i in range(501)}}), ("vocabulary", "word", {"vocabulary": {"x" * 101: []}}), ("vocabulary", "word", {"vocabulary": {" ": []}}), ("vocabulary", "readings", {"vocabulary": {"a": 3}}), ("vocabulary", "readings", {"vocabulary": {"a": ["b"] * 21}}), ("vocabulary", "readings", {"vocabulary": {"a": [None]}}),
    ("word_segmentation", "mode", {"word_segmentation": "other"}), ("word_segmentation", "dictionary_segmentation_language", {"word_segmentation": "dictionary"}), ("word_segmentation", "word_timestamps_required", {"word_segmentation": "dictionary", "language": "ja"}),
    ("chunk_seconds", "range", {"chunk_seconds": 5, "language": "en"}), ("chunk_seconds", "language_required_for_chunking", {"chunk_seconds": 60}), ("parallel", "range", {"parallel": 9}), ("parallel", "range", {"parallel": 2.0}), ("parallel", "chunk_seconds_required", {"parallel": 2}), ("parallel", "chunk_seconds_required", {"speech_regions": REGIONS}),
    ("speech_regions", "shape", {"chunk_seconds": 60, "language": "en", "speech_regions": {"kind": "other"}}), ("speech_regions", "shape", {"chunk_seconds": 60, "language": "en", "speech_regions": {"kind": "speech_regions", "data": {"regions": [{"start": 2, "end": 1}]}}}),
    ("domain_vocabulary", "type", {"domain_vocabulary": []}), ("domain_vocabulary", "unknown_key", {"domain_vocabulary": {"x": 1}}), ("domain_vocabulary", "japanese", {"domain_vocabulary": {"japanese": "yes"}}), ("domain_vocabulary", "max_terms", {"domain_vocabulary": {"max_terms": 0}}), ("domain_vocabulary", "texts", {"domain_vocabulary": {"programme": 3}}),
    ("domain_vocabulary", "texts", {"domain_vocabulary": {"speakers": [1]}}), ("domain_vocabulary", "term", {"domain_vocabulary": {"terms": ["x" * 101]}}), ("domain_vocabulary", "long", {"domain_vocabulary": {"programme": "x" * 200_001}}),
    ("corrections", "type", {"corrections": "x"}), ("corrections", "rule", {"corrections": [{"from": "a"}]}), ("corrections", "rule", {"corrections": [{"from": "a", "to": "a"}]}), ("corrections", "rule", {"corrections": [{"from": "a", "to": "b", "match": "all"}]}), ("corrections", "rule", {"corrections": [{"from": "a", "to": "b", "x": 1}]}), ("corrections", "rule", {"corrections": ["a"]}), ("corrections", "rule", {"corrections": {"a": 3}}), ("corrections", "twice", {"corrections": {"a": "b", "A": "c"}}),
    ("budget", "type", {"budget": 3}), ("budget", "unknown_key", {"budget": {"cpu": 3}}), ("budget", "range", {"budget": {"timeout": 0}}), ("budget", "range", {"budget": {"timeout": True}}),
]


def as_table(spark, docs):
    rows = [(i, x if x is None or isinstance(x, str) else json.dumps({"input": "talk.wav", **x}, ensure_ascii=bool(i % 2))) for i, x in enumerate(docs)]
    return spark.createDataFrame(rows, "req long, json string")


def test_first_broken_rule(spark):
    got = {r.req: (r.key, r.reason) for r in R.first_broken(as_table(spark, [x for *_, x in BROKEN])).collect()}
    assert {i: got.get(i) for i in range(len(BROKEN))} == {i: (k, r) for i, (k, r, _) in enumerate(BROKEN)}
    assert R.first_broken(as_table(spark, SOUND)).collect() == [] and R.first_broken(as_table(spark, [])).count() == 0


def parameters(doc):
    """The parameters of a sound request, by hand."""
    language = (doc.get("language") or "").strip().lower()
    out = {"language": None if language in ("", "auto") else language, "word_timestamps": doc.get("word_timestamps", False), "temperature": float(doc.get("temperature", 0)), "initial_prompt": (doc.get("initial_prompt") or "") if (doc.get("initial_prompt") or "").strip() else None,
           "beam_size": doc.get("beam_size", 5), "audio_stream": doc.get("audio_stream") or 0, "vad_filter": doc.get("vad_filter", False)}
    if doc.get("vocabulary"):
        out["vocabulary"] = {k.strip(): list(dict.fromkeys(x.strip() for x in ([v] if isinstance(v, str) else v) if x.strip())) for k, v in doc["vocabulary"].items()}
    if doc.get("word_segmentation"):
        out["word_segmentation"] = doc["word_segmentation"]
    rules = doc.get("corrections")
    if rules:
        rules = [{"from": a, "to": b} for a, b in rules.items()] if isinstance(rules, dict) else rules
        out["corrections"] = [{"from": " ".join(r["from"].split()), "to": " ".join(r["to"].split()), "match": r.get("match", "word")} for r in rules]
    if "chunk_seconds" in doc:
        spans = [[0.5, 3.25], [9.0, 10.0]]
        out["chunking"] = {"chunk_seconds": float(doc["chunk_seconds"]), "speech_regions": "sha256:" + hashlib.sha256(json.dumps(spans).encode()).hexdigest() if "speech_regions" in doc else None}
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def test_canonical_parameters(spark):
    got = {r.req: r for r in R.normalised(as_table(spark, SOUND)).collect()}
    for i, doc in enumerate(SOUND):
        assert got[i].parameters == parameters(doc) and got[i].parameters_hash == hashlib.sha256(parameters(doc).encode()).hexdigest()
    assert (got[15].timeout, got[15].most_seconds, got[0].timeout, got[17].cache, got[17].offline) == (3.0, 20.5, 14400.0, False, True)


@pytest.mark.parametrize("sign", [1, -1])
def test_numbers_as_python_writes_them(spark, sign):
    values = [sign * x for x in (0.0, 1.0, 0.1, 0.5, 1e-4, 1.25e-4, 9.9e-5, 1e-5, 1.5e-7, 123456.75, 12345678.9, 1e7, 1.5e8, 1.2345678901e15, 1e16, 1.5e22, 3600.0, 1 / 3)]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(R.json_number(F.col("x")).alias("t")).collect()]
    assert got == [json.dumps(v) for v in values]


def test_dry_run(spark):
    asked = as_table(spark, [{}, {"cache": False}, {"input": "none.wav"}, {"engine": "other"}, {"budget": {"max_audio_seconds": 5}}, {"chunk_seconds": 30, "language": "en"}, {"chunk_seconds": 30, "language": "en", "speech_regions": REGIONS}, {"x": 1}])
    media = spark.createDataFrame([("talk.wav", "sha256:ab", 100.0)], "input string, fingerprint string, duration double")
    engines = spark.createDataFrame([("faster_whisper", "1.2", "local")], "engine string, version string, mode string")
    own = {"input": "sha256:ab", "engine": {"id": "faster_whisper", "version": "1.2", "execution_mode": "local"}, "model": {"name": "base", "version": None}, "parameters": json.loads(parameters({}))}
    key = hashlib.sha256(json.dumps(own, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    stored = spark.createDataFrame([(key,)], "key string")
    got = {r.req: (r.status, r.would_run, r.cuts_from, r.chunks, r.reason) for r in R.dry_run(asked, media, engines, stored).collect()}
    assert got == {0: ("hit", False, None, None, None), 1: ("disabled", True, None, None, None), 2: (None, None, None, None, "FILE_NOT_FOUND"), 3: (None, None, None, None, "ENGINE_UNAVAILABLE"), 4: (None, None, None, None, "BUDGET_EXCEEDED"), 5: ("miss", True, "level", 3, None), 6: ("miss", True, "speech_regions", 3, None)}
    takes = spark.createDataFrame([("faster_whisper", ["temperature"])], "engine string, takes array<string>")
    assert [tuple(r) for r in R.unsupported(as_table(spark, [{"temperature": 0.5, "beam_size": 3}]), takes).collect()] == [(0, "beam_size")]
