"""The request transport, the command line and the model status."""

import json

import pytest

from scribeframe.__main__ import main, word_ranges
from scribeframe.operators import engines, models
from scribeframe.plans import dispatch


def transcript(**more):
    word = lambda n, s, e, text: {"index": n, "start": s, "end": e, "text": text, "confidence": None}
    segments = [
        {"id": "seg_0001", "start": 0.0, "end": 1.0, "text": "Quiet harbour", "words": [word(0, 0.0, 0.4, "Quiet"), word(1, 0.5, 1.0, "harbour")]},
        {"id": "seg_0002", "start": 1.5, "end": 2.0, "text": "no words here", "words": None},
        {"id": "seg_0003", "start": 4.0, "end": 5.25, "text": "quiet harbuor again", "words": [word(2, 4.0, 4.5, "quiet"), word(3, 4.5, 5.0, "harbuor"), word(4, 5.0, 5.25, "again")]},
    ]
    for s in segments:
        s |= {"raw_text": s["text"], "confidence": None, "speaker_id": None}
    digest = "0123456789abcdef" * 4
    origin = {"engine": "fast", "engine_version": "1", "execution_mode": "local", "model": "base", "model_version": None, "parameters": {"beam_size": 5}, "parameters_hash": digest, "cache_key": digest, "created_at": "2026-01-01T00:00:00Z", "processing_seconds": 1.5, "skill_version": "1", "skill": "transcription", "tool": "transcription/transcribe"}
    top = {"schema": "transcript/0.1", "id": "t1", "asset_id": "a1", "duration": 6.0, "language": "en", "language_source": "requested", "language_confidence": None, "engine": "fast", "engine_version": "1", "created_at": "2026-01-01T00:00:00Z", "provenance": origin, "warnings": []}
    return top | {"segments": segments, "source": {"filename": "x.wav", "fingerprint": f"sha256:{digest}", "size_bytes": 9, "media_duration": 6.0}} | more


def ask(spark, tool, **params):
    return dispatch.respond(spark, json.dumps({"tool": f"transcription/{tool}", "params": params}))


def test_find_request(spark):
    found, code = ask(spark, "find", transcript=transcript(), phrase="QUIET-harbour", fuzzy=0.8)
    hits = found["result"]["hits"]
    assert code == 0 and [(h["match"], h["start"], h["end"], h["word_indices"], h["segment_ids"]) for h in hits] == [("normalized", 0.0, 1.0, [0, 1], ["seg_0001"]), ("approximate", 4.0, 5.0, [2, 3], ["seg_0003"])]
    assert hits[0]["context"] == {"before": [], "after": ["no words here"]} and hits[1]["context"]["before"] == ["no words here"]
    assert [h["text"] for h in hits] == ["Quiet harbour", "quiet harbuor"]
    assert found["result"]["transcripts"] == [{"transcript_id": "t1", "segments": 3, "words": 5, "word_timed": False, "hits": 2}]


def test_exact_stretch_of_hits(spark):
    """The text between the first and the last matched character, with spaces only where the transcript has them."""
    word = lambda n, text: {"index": n, "start": n / 4, "end": n / 4 + 0.25, "text": text, "confidence": None}
    texts = ["「音楽の、話」です", "(Sound-design) matters!"]
    cut = [["「音楽", "の、話」", "です"], ["(Sound-", "design)", "matters!"]]
    segments, n = [], 0
    for i, (t, ws) in enumerate(zip(texts, cut)):
        words = [word(n + k, w) for k, w in enumerate(ws)]
        n += len(ws)
        segments.append({"id": f"seg_{i + 1:04d}", "start": words[0]["start"], "end": words[-1]["end"], "text": t, "raw_text": t, "confidence": None, "words": words, "speaker_id": None})
    own = transcript(segments=segments, language="ja")
    text = lambda phrase: [h["text"] for h in ask(spark, "find", transcript=own, phrase=phrase)[0]["result"]["hits"]]
    assert text("音楽の話") == ["音楽の、話"] and text("楽の") == ["楽の"] and text("sound design") == ["Sound-design"] and text("design matter") == ["design) matter"] and text("話です sound") == ["話」です (Sound"]


def test_select_request(spark):
    found, code = ask(spark, "select", transcript=transcript(), mode="remove", words=[[2, 3]])
    (span,) = found["result"]["spans"]
    assert code == 0 and (span["start"], span["end"], span["lo"], span["hi"], span["units"]) == (4.0, 5.0, 2.0, 5.0, 2)
    assert found["result"]["sentences"] == [{"segment_id": "seg_0003", "removed_seconds": 1.0, "removed_units": 2, "units": 3, "whole": False}]
    for bad, reason in (({"words": [[3, 9]]}, "word_index_out_of_range"), ({"segments": ["seg_9"]}, "unknown_segment_id"), ({"words": [[0, 2], [2, 3]]}, "word_ranges_overlap"), ({}, "empty_selection"), ({"words": [[0, 4]], "segments": ["seg_0002"]}, "nothing_kept")):
        found, code = ask(spark, "select", transcript=transcript(), mode="remove", **bad)
        assert code == 2 and found["error"]["details"]["reason"] == reason


def test_other_requests(spark, tmp_path):
    found, _ = ask(spark, "segments", transcript=transcript(), merge_gap=0.5)
    assert [(e["id"], e["start"], e["end"], e["transcript_segment_ids"]) for e in found["result"]["events"]] == [("t1_spev_0001", 0.0, 2.0, ["seg_0001", "seg_0002"]), ("t1_spev_0002", 4.0, 5.25, ["seg_0003"])]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(transcript()))
    found, _ = ask(spark, "export", transcript=str(path), format="srt", output=str(tmp_path / "t.srt"))
    assert found["ok"] and (tmp_path / "t.srt").read_text().startswith("1\n00:00:00,000 --> 00:00:01,000\nQuiet harbour\n\n2\n")
    assert ask(spark, "export", transcript=str(path), output=str(path))[1] == 2
    named, _ = ask(spark, "speakers", transcript=transcript(), turns={"source": {"fingerprint": transcript()["source"]["fingerprint"]}, "turns": [{"start": 0, "end": 2, "speaker": "SPEAKER_00"}, {"start": 4, "end": 6, "speaker": "SPEAKER_01"}]})
    assert [s["speaker_id"] for s in named["result"]["transcript"]["segments"]] == ["SPEAKER_00", "SPEAKER_00", "SPEAKER_01"]
    assert ask(spark, "check", transcript=transcript())[0]["result"]["ok"]
    found, _ = ask(spark, "check", transcript=transcript(duration=5.0))
    assert found["result"]["errors"] == ["media_duration"]
    odd = transcript(notes={"deep": [{"Password": 1, "path": "see"}, "/home/x/y"]})
    del odd["warnings"], odd["segments"][1]["raw_text"], odd["provenance"]["skill"]
    odd["provenance"] |= {"engine": "other", "parameters": [1]}
    found, _ = ask(spark, "check", transcript=odd)
    assert found["result"]["errors"] == ["leak_key: Password", "leak_path: deep", "missing: document.warnings", "missing: provenance.skill", "missing: segments[1].raw_text", "provenance_engine: provenance", "provenance_parameters: provenance", "provenance_skill: provenance"]
    assert ask(spark, "segments", transcript=transcript(duration=-1.0))[0]["error"]["code"] == "VERIFICATION_FAILED"


def test_refusals(spark, tmp_path):
    assert dispatch.respond(spark, "{")[0]["error"]["code"] == "INVALID_INPUT"
    assert dispatch.respond(spark, '{"tool": "x"}')[1] == 2 and dispatch.respond(spark, '{"tool": "transcription/find", "more": 1}')[1] == 2
    assert ask(spark, "check", transcript=str(tmp_path / "none.json"))[0]["error"]["code"] == "FILE_NOT_FOUND"
    (tmp_path / "bad.json").write_text("{")
    found, code = ask(spark, "check", transcript=str(tmp_path / "bad.json"))
    assert found["error"]["code"] == "VERIFICATION_FAILED" and code == 1
    assert [r["ok"] for r in ask(spark, "batch", items=[{}, {}])[0]["result"]["results"]] == [False, False]
    assert ask(spark, "find", transcript=transcript(), phrase="...")[1] == 2 and ask(spark, "find", transcript=transcript(), phrase="a", fuzzy=0.2)[1] == 2


def test_command_line(spark, capsys):
    assert word_ranges("12-40, 55") == [[12, 40], [55, 55]]
    with pytest.raises(dispatch.Refusal):
        word_ranges("x")
    assert main(["engines", "--capability", "vocabulary"]) == 0
    assert {e["id"] for e in json.loads(capsys.readouterr().out)["result"]["engines"]} == {"cloud-large", "fast-local"}
    assert main(["find", "a", "/nowhere/t.json"]) == 2 and json.loads(capsys.readouterr().out)["error"]["code"] == "FILE_NOT_FOUND"


def test_model_status(spark):
    asked = [(1, "fast-local", "tiny", True), (2, "fast-local", "base", False), (3, "fast-local", "base", True), (4, "fast-local", "huge", False), (5, "aligner", "align", False), (6, "program", "one:q8", False), (7, "fast-local", "tiny.en", False), (8, None, None, None)]
    rows = models.status(spark.createDataFrame(asked, "req long, engine string, model string, offline boolean"), models.models(spark), engines.engines(spark))
    got = {r["req"]: (r["status"], r["availability"], r["download_required"]) for r in rows.collect()}
    missing, unknown = ("MISSING", "MODEL_MISSING", False), ("UNKNOWN", "MODEL_UNKNOWN", False)
    assert got == {1: ("AVAILABLE", "MODEL_AVAILABLE", False), 2: ("MISSING", "MODEL_DOWNLOAD_REQUIRED", True), 3: missing, 4: unknown, 5: missing, 6: missing, 7: missing, 8: unknown}
