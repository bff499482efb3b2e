"""Recordings: WAV ranges, chunk plans to the sample, and following while a file grows; against brute force."""

import hashlib
import json
import os
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scribeframe.operators import chunking, runs
from scribeframe.sources import wav
from scribeframe.streaming import follow

RATE = 16_000
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def wav_bytes(x, extra=b""):
    """A WAV file with another chunk before its samples."""
    head = wav.header(RATE, len(x))
    body = head[12:36] + (b"LIST" + len(extra).to_bytes(4, "little") + extra + b"\0" * (len(extra) % 2) if extra else b"") + b"data" + (2 * len(x)).to_bytes(4, "little") + x.astype("<i2").tobytes()
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WAVE" + body


def tones(sentences, pause=1.3, lead=0.6):
    """(word number, start, end) and samples: a burst a word, whose height tells its number."""
    words, t, k = [], lead, 0
    for n in sentences:
        for j in range(n):
            d = (0.22, 0.31, 0.4)[k % 3]
            words.append((k, round(t, 6), round(t + d, 6)))
            t += d + (0.12 if j + 1 < n else 0)
            k += 1
        t += pause
    x = np.zeros(round((words[-1][2] + 0.8) * RATE), dtype=np.int16)
    for k, s, e in words:
        a, b = round(s * RATE), round(e * RATE)
        x[a:b] = (3000 + 250 * (k % 100)) * np.where(np.arange(b - a) % 36 < 18, 1, -1)
    return words, x


def hear(samples, rate, gap=0.5):
    """Bursts as words, a segment a sentence: a stand-in for recognition."""
    loud = np.flatnonzero(np.diff(np.concatenate([[0], (np.abs(samples.astype(int)) > 600).astype(int), [0]])))
    words = [(a / rate, b / rate, f"w{(int(np.abs(samples[a:b].astype(int)).max()) - 3000) // 250} ") for a, b in zip(loud[0::2], loud[1::2])]
    groups = []
    for w in words:
        if groups and w[0] - groups[-1][-1][1] < gap:
            groups[-1].append(w)
        else:
            groups.append([w])
    return [follow.Segment(g[0][0], g[-1][1], "".join(t for *_, t in g), tuple(g)) for g in groups]


# -- chunk plans


def brute_quiet(x, offset, target, rate):
    size, best = round(0.02 * rate), None
    n = len(x) // size
    for i in range(n - 15 + 1):
        energy = sum(int(v) ** 2 for v in x[i * size : (i + 15) * size])
        key = (energy, abs(offset + i * size + 15 * size // 2 - target))
        if best is None or key < best[0]:
            best = (key, offset + i * size + 15 * size // 2)
    return best[1] if best else target


def test_quiet_places_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        x = rng.integers(-3, 4, rng.integers(10, 900)).astype(np.int16)
        offset, target = 1000, 1000 + len(x) // 2
        assert chunking.quiet_cut(x, offset, target, 1000)[0] == brute_quiet(x, offset, target, 1000)
        window = 7
        sums = [sum(int(v) ** 2 for v in x[i : i + window]) for i in range(len(x) - window + 1)]
        assert chunking.quietest_window(x, window) == sums.index(min(sums))
    assert chunking.quiet_cut(np.zeros(800, dtype=np.int16), 0, 400, 1000) == (390, -120.0)
    assert chunking.quiet_cut(np.full(800, 32767, dtype=np.int16), 0, 100, 1000)[1] == 0.0


def brute_region(regions, low, high, target, duration):
    found, end = [], 0.0
    for s, e in [*regions, (duration, duration)]:
        a, b = end, min(s, duration)
        end = max(end, e)
        if b > a and low <= (a + b) / 2 <= high:
            found.append((-(b - a), abs((a + b) / 2 - target), len(found), (a + b) / 2))
    return (min(found)[3], -min(found)[0]) if found else None


def test_region_cuts_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        regions = sorted((float(a), float(a + d)) for a, d in zip(rng.integers(0, 40, 6), rng.integers(1, 6, 6)))
        assert chunking.region_cut(regions, 10.0, 30.0, 20.0, 45.0) == brute_region(regions, 10.0, 30.0, 20.0, 45.0)
    assert chunking.region_cut([], 0.0, 9.0, 5.0, 9.0) is None


def test_plans_of_files(spark, tmp_path):
    words, x = tones([3, 4, 2, 5] * 12)
    path = str(tmp_path / "a.wav")
    with open(path, "wb") as f:
        f.write(wav_bytes(x, b"about this recording"))
    files = spark.createDataFrame([(path, None)], "path string, regions array<struct<s: double, e: double>>")
    rows = sorted(chunking.plan(files, 30.0).collect(), key=lambda r: r.chunk)
    assert [r.start_sample for r in rows[1:]] == [r.end_sample for r in rows[:-1]] and (rows[0].start_sample, rows[-1].end_sample) == (0, len(x)) and rows[-1].source == "end"
    at = 0
    for r in rows[:-1]:
        low, high = at + 24 * RATE, at + 36 * RATE
        assert r.end_sample == brute_quiet(x[low:high], low, at + 30 * RATE, RATE) and r.source == "level" and r.level == -120.0
        assert not any(s * RATE < r.end_sample < e * RATE for _, s, e in words)
        at = r.end_sample
    speech = [(s, e) for _, s, e in words]
    own = spark.createDataFrame([(path, speech)], files.schema)
    cut = sorted(chunking.plan(own, 30.0).collect(), key=lambda r: r.chunk)[0]
    want = brute_region(speech, 24.0, 36.0, 30.0, len(x) / RATE)
    assert (cut.source, cut.end_sample, cut.pause) == ("speech_regions", round(want[0] * RATE), round(want[1], 3))
    tight = sorted(chunking.plan(files).collect(), key=lambda r: r.chunk)
    at = 0
    for r in tight[:-1]:
        low, high = max(at + 15 * RATE, at + 28 * RATE), min(len(x) - 1600, at + 32 * RATE)
        run = np.cumsum(np.concatenate([[0], x[low : high + 1600].astype(np.int64) ** 2]))
        assert r.end_sample == low + int((run[1600:] - run[:-1600]).argmin()) + 800
        at = r.end_sample
    louder = spark.createDataFrame([("a", 0, 30.0, "level", -12.5), ("a", 1, 60.0, "level", -60.0)], "doc string, chunk int, e double, source string, level double")
    assert [r.chunk for r in runs.cut_warnings(louder).collect()] == [0]


# -- WAV ranges


def test_wav_ranges_and_frames(spark, tmp_path):
    rng = np.random.default_rng(2)
    spark.dataSource.register(wav.Pcm)
    folder = tmp_path / "audio"
    folder.mkdir()
    sound = {"long.wav": rng.integers(-30_000, 30_000, 2 * wav.ROW + 12_345).astype(np.int16), "short.wav": rng.integers(-9, 9, 700).astype(np.int16), "none.wav": np.zeros(0, dtype=np.int16)}
    for i, (name, x) in enumerate(sound.items()):
        (folder / name).write_bytes(wav_bytes(x, b"x" * (77_777 * i)))
    (folder / "notes.txt").write_text("not audio")
    rows = spark.read.format("pcm").option("part", wav.ROW).load(str(folder))
    assert rows.rdd.getNumPartitions() == 4  # three ranges of one file, one of the other
    for name, x in sound.items():
        own = sorted((r for r in rows.collect() if r.path.endswith(name)), key=lambda r: r.start)
        assert b"".join(bytes(r.pcm) for r in own) == x.tobytes() and all(r.rate == RATE for r in own)
        n = len(x) // 320
        want = (x[: n * 320].astype(np.int64).reshape(n, 320) ** 2).sum(axis=1).tolist()
        assert [r.energy for r in sorted((r for r in chunking.frames(rows).collect() if r.path.endswith(name)), key=lambda r: r.frame)] == want
    whole = spark.read.format("pcm").load(str(folder / "long.wav"))
    assert whole.rdd.getNumPartitions() == 1 and whole.count() == 3
    for bad in (b"RIFFxxxxWAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\2\0" + b"\0" * 20, b"OggS" + b"\0" * 40):
        with pytest.raises(ValueError):
            wav.layout(bad, len(bad))
    assert wav.layout(wav_bytes(sound["short.wav"])[:30], 30) is None
    growing = bytearray(wav_bytes(sound["short.wav"]))
    growing[40:44] = b"\xff" * 4
    assert wav.layout(bytes(growing), len(growing)).samples == 700


def test_chunk_files(spark, tmp_path):
    _, x = tones([3, 4] * 20)
    path = str(tmp_path / "a.wav")
    with open(path, "wb") as f:
        f.write(wav_bytes(x, b"odd"))
    files = spark.createDataFrame([(path, None)], "path string, regions array<struct<s: double, e: double>>")
    plan = chunking.plan(files, 30.0)
    out = sorted(wav.write_chunks(plan.repartition(3), str(tmp_path / "chunks")).collect(), key=lambda r: r.chunk)
    read = [open(r.file, "rb").read() for r in out]
    assert b"".join(r[44:] for r in read) == x.tobytes() and len(out) == plan.count() > 1
    for r, content in zip(out, read):
        assert wav.layout(content, len(content)) == wav.Layout(RATE, 44, r.samples) and r.fingerprint == "sha256:" + hashlib.sha256(content[44:]).hexdigest()
    assert wav.write_chunks(plan, str(tmp_path / "chunks")).count() == len(out) == len(os.listdir(tmp_path / "chunks"))


# -- following


def told(events):
    return [s for e in events if e["type"] == "final" for s in e["segments"]]


def grow(x, window, recognize=hear):
    """Rounds over growing sound without Spark, as the processor makes them."""
    spot, events, heard = follow.Spot(), [], 0
    while heard < len(x):
        heard = min(len(x), heard + round(window * RATE))
        for last in (False, True) if heard == len(x) else (False,):
            sound, begin = x[spot.committed : heard], spot.committed
            found = follow.shifted(recognize(sound, RATE), begin / RATE, len(sound) / RATE)
            events += follow.advance(spot, found, heard, lambda a, b: chunking.quiet_cut(sound[a - begin : b - begin], a, (a + b) // 2, RATE)[0], last)
    return events


@pytest.mark.parametrize("window", [5.0, 3.3, 7.0])
def test_every_word_once(window):
    words, x = tones([2 + i * 5 % 4 for i in range(14)])
    events = grow(x, window)
    got = [w for s in told(events) for w in s["words"]]
    assert [w["text"].strip() for w in got] == [f"w{k % 100}" for k, _, _ in words]
    assert all(abs(w["start"] - s) < 0.001 and abs(w["end"] - e) < 0.001 for w, (_, s, e) in zip(got, words))
    assert [s["id"] for s in told(events)] == [f"seg_{i + 1:04d}" for i in range(len(told(events)))]
    done = 0
    for e in events:
        if e["type"] == "final":
            done += 1
        else:
            assert all(int(s["id"][4:]) > done for s in e["segments"])
    assert any(e["type"] == "partial" for e in events) and any(e["type"] == "final" for e in events[:-4])


def test_long_speech_is_cut_between_words():
    words, x = tones([90])
    events = grow(x, 5.0)
    assert [w["text"].strip() for s in told(events) for w in s["words"]] == [f"w{k % 100}" for k, _, _ in words] and len(told(events)) > 1
    bare = lambda sound, rate: [follow.Segment(s.start, s.end, s.text) for s in hear(sound, rate)]
    said = [e["message"] for e in grow(x, 5.0, bare) if e["type"] == "final"]
    assert said[0] is not None and "may be split" in said[0] and said[-1] is None
    two = follow.Spot()
    follow.advance(two, [follow.Segment(0.0, 20.0, "a"), follow.Segment(20.0, 29.9, "b")], 30 * RATE, follow.middle)
    assert two.finals == 1
    spot = follow.Spot()
    events = follow.advance(spot, [follow.Segment(0.0, 14.0, "a"), follow.Segment(14.0, 29.9, "b")], 30 * RATE, follow.middle)
    assert [e["type"] for e in events] == ["final", "partial"] and spot.committed == 14 * RATE
    spot = follow.Spot()
    assert [e["type"] for e in follow.advance(spot, [], 30 * RATE, follow.middle)] == ["partial"] and spot.committed == round(28.5 * RATE)


def test_partial_events():
    spot, seg = follow.Spot(), follow.Segment
    kinds = lambda rows, heard: [e["type"] for e in follow.advance(spot, rows, round(heard * RATE), follow.middle)]
    assert kinds([seg(0.0, 1.0, "a")], 2.0) == ["partial"]
    assert kinds([seg(0.0, 1.0, "a")], 2.2) == []
    assert kinds([seg(0.0, 1.1, "a")], 2.3) == ["partial"]  # the time changed
    assert kinds([], 2.4) == ["partial"]  # it vanished
    assert kinds([seg(0.0, 1.0, "a")], 9.0) == ["final", "partial"] and spot.committed == round(4.25 * RATE)
    assert kinds([], 9.5) == []
    assert kinds([seg(9.0, 9.4, " \x00 ")], 9.6) == []


def drain(query, read, until, seconds=240):
    rows = []
    for _ in range(seconds * 2):
        if query.exception():
            raise query.exception()
        rows = read()
        if until(rows):
            return rows
        time.sleep(0.5)
    raise AssertionError([r.asDict() for r in rows])


def test_growing_files(spark, tmp_path):
    """A file is written in parts while a stream reads it; the query stops halfway and starts again from its checkpoint; the
    end comes by itself. A second recording's recognition fails."""
    spark.dataSource.register(wav.Pcm)
    words, x = tones([3, 2, 4, 3, 2])
    folder, path = tmp_path / "live", str(tmp_path / "live" / "talk.wav")
    folder.mkdir()
    data = bytearray(wav_bytes(x))
    data[40:44] = b"\xff" * 4

    def recognize(samples, rate):
        if np.abs(samples.astype(int)).max(initial=0) == 999:
            raise RuntimeError("no engine")
        return hear(samples, rate)

    def start(idle):
        rows = spark.readStream.format("pcm").option("window_seconds", 2.0).option("idle_seconds", 3.0).load(str(folder))
        out = follow.follow_audio(rows, recognize, idle_seconds=idle)
        return out.writeStream.format("parquet").option("path", str(tmp_path / "events")).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()

    def read():
        there = (tmp_path / "events" / "_spark_metadata").exists()
        return spark.read.schema(follow.events_schema("string")).parquet(str(tmp_path / "events")).orderBy("doc", "event").collect() if there else []

    half = 44 + 2 * (len(x) * 3 // 5)
    with open(path, "wb") as f:
        f.write(data[:half])
    (folder / "bad.wav").write_bytes(wav_bytes(np.full(40_000, 999, dtype=np.int16)))
    first = start(600.0)
    try:
        before = drain(first, read, lambda rows: {r.type for r in rows} >= {"error", "final"})
    finally:
        first.stop()
    with open(path, "ab") as f:
        f.write(data[half:])
    second = start(5.0)
    try:
        after = drain(second, read, lambda rows: any(r.type == "end" for r in rows))
    finally:
        second.stop()
    assert before == [r for r in after if r in before] and len(after) > len(before)  # what was said stays said
    own = [r for r in after if r.doc.endswith("talk.wav")]
    assert [r.event for r in own] == list(range(1, len(own) + 1)) and own[-1].type == "end"
    final = [s for r in own if r.type == "final" for s in r.segments]
    assert [w.text.strip() for s in final for w in s.words] == [f"w{k}" for k, _, _ in words]
    assert [s.id for s in final] == [f"seg_{i + 1:04d}" for i in range(len(final))]
    assert [(r.type, r.message) for r in after if r.doc.endswith("bad.wav")] == [("error", "TRANSCRIPTION_FAILED: no engine")]


def test_admission_of_growth(tmp_path):
    reader = wav.Growing({"path": str(tmp_path), "window_seconds": "1", "idle_seconds": "60"})
    path = tmp_path / "a.wav"
    files = lambda: json.loads(reader.latestOffset()["files"])
    put = lambda n: path.write_bytes(wav_bytes(np.zeros(n, dtype=np.int16)))
    path.write_bytes(b"RIFF")
    assert files() == {}  # its header isn't there yet
    put(RATE - 1)
    assert files() == {}
    put(RATE + 5)
    assert files() == {str(path): RATE + 5}
    put(2 * RATE)
    assert files() == {str(path): RATE + 5}
    os.utime(path, (time.time() - 90, time.time() - 90))
    assert files() == {str(path): 2 * RATE}
    parts = reader.partitions({"files": json.dumps({str(path): RATE})}, {"files": json.dumps({str(path): 2 * RATE})})
    assert [(p.start, p.end) for p in parts] == [(RATE, 2 * RATE)]
    again = wav.Growing({"path": str(tmp_path), "window_seconds": "1"})
    again.partitions({"files": json.dumps({str(path): 2 * RATE})}, {"files": json.dumps({str(path): 2 * RATE})})
    assert json.loads(again.latestOffset()["files"]) == {str(path): 2 * RATE}


def test_hypotheses_end_by_a_timer(spark, tmp_path):
    schema = "doc long, round int, audio_end long, seg int, s long, e long, text string, last boolean"
    rounds = [(1, 0, 5000, 0, 0, 2000, "one", False), (1, 0, 5000, 1, 2100, 4800, "tw", False), (1, 1, 9000, 0, 2100, 5200, "two", False), (1, 1, 9000, 1, 6000, 8800, "three", False)]
    table = spark.createDataFrame(rounds, schema)
    for k in range(2):
        table.where(f"round = {k}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = follow.follow(stream, idle_seconds=4.0).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        rows = drain(query, lambda: spark.sql("select * from idle order by event").collect(), lambda rows: any(r.type == "end" for r in rows))
    finally:
        query.stop()
    assert [s.text for r in rows if r.type == "final" for s in r.segments] == ["one", "two", "three"]
    closed = follow.replay(table.withColumn("last", F.col("round") == 1))
    assert [(r.n, r.s, r.e, r.text) for r in follow.finals(closed).orderBy("n").collect()] == [(1, 0, 2000, "one"), (2, 2100, 5200, "two"), (3, 6000, 8800, "three")]
    for bad in (0, -1):
        with pytest.raises(ValueError, match="follow_options"):
            follow.follow(stream, idle_seconds=bad)
