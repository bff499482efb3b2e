"""The request transport: one JSON request {"tool", "params"} gives one JSON document.

The tools' work is done by the DataFrame operators. Only answers come to the driver: hits, spans, events and reports of
the transcripts that a request names, 100 at most.
"""

from __future__ import annotations

import json
import math
import os
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribeframe.functions.text import fold, folded_ranges
from scribeframe.operators import engines, export, find, intervals, select, speakers, transcripts, validate
from scribeframe.sources import documents

# Fixed values of the contract: error codes, exit codes, limits.
CODES = (
    "INVALID_INPUT", "FILE_NOT_FOUND", "UNSUPPORTED_MEDIA", "ENGINE_UNAVAILABLE", "MODEL_UNAVAILABLE", "TRANSCRIPTION_FAILED",
    "TRANSCRIPTION_TIMEOUT", "BUDGET_EXCEEDED", "INVALID_RESULT", "CACHE_INVALID", "VERIFICATION_FAILED",
)
EXIT = {"INVALID_INPUT": 2, "FILE_NOT_FOUND": 2}
MOST_TRANSCRIPTS, MOST_PHRASE, MOST_CONTEXT = 100, 500, 10
MICRO = 1_000_000


class Refusal(Exception):
    """A failure with one of CODES."""

    def __init__(self, code: str, message: str, **details: Any):
        super().__init__(message)
        self.code, self.details = code, details

    @property
    def exit_code(self) -> int:
        return EXIT.get(self.code, 1)

    def document(self) -> dict:
        return {"ok": False, "error": {"code": self.code, "message": str(self), "details": self.details}}


def invalid(message: str, reason: str | None = None) -> Refusal:
    return Refusal("INVALID_INPUT", message, **({"reason": reason} if reason else {}))


_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """The rows, kept until the request is answered."""
    _held.append(df.cache())
    return _held[-1]


def loaded(spark: SparkSession, items: list[Any]) -> DataFrame:
    """The transcripts of a request, documents or paths, by their number in it: column ``id`` is that number."""
    rows, paths = [], []
    for n, x in enumerate(items):
        if isinstance(x, dict):
            rows.append((n, json.dumps(x)))
        elif isinstance(x, str):
            paths.append((n, x))
        else:
            raise invalid("a transcript must be a document or a path")
    given = spark.createDataFrame(rows, "n long, json string").select("n", F.from_json("json", documents.TRANSCRIPT).alias("d")).select("n", "d.*")
    for n, path in paths:
        try:
            read = documents.transcripts(spark, path)
        except AnalysisException as e:
            raise Refusal("FILE_NOT_FOUND", f"transcript not found: {path}") from e
        if not held(read).where("_corrupt_record is not null or segments is null").isEmpty():
            raise Refusal("VERIFICATION_FAILED", f"not a transcript: {path}")
        given = given.unionByName(read.drop("_corrupt_record").withColumn("n", F.lit(n).cast("long")))
    return given.withColumn("title", F.col("id")).withColumn("id", F.col("n")).drop("n")


def as_given(spark: SparkSession, items: list[Any]) -> DataFrame:
    """(doc, json): the transcripts of a request as they are, by their number in it."""
    given = spark.createDataFrame([(n, json.dumps(x)) for n, x in enumerate(items) if isinstance(x, dict)], "doc long, json string")
    for n, path in enumerate(items):
        if isinstance(path, str):
            given = given.union(spark.read.text(path, wholetext=True).select(F.lit(n).cast("long"), "value"))
    return given


def violations(docs: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc, seg, rule) of all rules that transcripts break, typed and as they are."""
    flat = documents.segments(docs)
    words = flat.select("doc", "seg", F.posexplode("words").alias("pos", "w")).select("doc", "seg", "pos", F.col("w.start").alias("s"), F.col("w.end").alias("e"), "w.text", F.col("w.index").alias("idx"))
    top = docs.select(F.col("id").alias("doc"), "language", "language_source", "language_confidence", "duration", "created_at", "source.fingerprint", "source.filename", "source.size_bytes", "source.media_duration", F.col("title").alias("id"), "schema", F.lit(None).cast("string").alias("cache_key"), F.lit(None).cast("double").alias("processing_seconds"))
    none = F.lit(None).cast("int").alias("seg")
    found = [validate.document_rules(top).select("doc", none, "rule"), validate.segment_rules(flat).select("doc", "seg", "rule"), validate.word_rules(words, flat).select("doc", "seg", F.concat(F.lit("word_"), "rule").alias("rule")), validate.index_rules(words).select("doc", none, "rule")]
    found.append(transcripts.broken(raw).select("doc", none, F.concat_ws(": ", "rule", "place").alias("rule")))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def report(docs: DataFrame, raw: DataFrame) -> dict:
    rows = violations(docs, raw).groupBy("seg", "rule").count().orderBy("seg", "rule").collect()
    errors = [r["rule"] if r["seg"] is None else f"segments[{r['seg']}]: {r['rule']}" for r in rows]
    return {"ok": not errors, "errors": errors, "warnings": []}


def valid(docs: DataFrame, raw: DataFrame) -> DataFrame:
    if errors := report(docs, raw)["errors"]:
        raise Refusal("VERIFICATION_FAILED", "transcript is not valid", errors=errors[:10])
    return docs


def numbered(docs: DataFrame) -> DataFrame:
    """units() with ``word``: the number among the words alone."""
    before = F.sum(F.col("timed").cast("long")).over(Window.partitionBy("doc").orderBy("idx"))
    return documents.units(docs).withColumn("word", before - 1)


def number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def only(params: dict, *names: str) -> None:
    if extra := sorted(set(params) - set(names)):
        raise invalid(f"unknown keys {extra}")


def one(spark: SparkSession, params: dict) -> DataFrame:
    if "transcript" not in params:
        raise invalid("'transcript' (document or path) is required")
    return loaded(spark, [params["transcript"]])


def find_tool(spark: SparkSession, params: dict) -> dict:
    only(params, "transcript", "transcripts", "phrase", "fuzzy", "context")
    if ("transcript" in params) == ("transcripts" in params):
        raise invalid("give exactly one of 'transcript' and 'transcripts'")
    items = [params["transcript"]] if "transcript" in params else params["transcripts"]
    if not isinstance(items, list) or not 0 < len(items) <= MOST_TRANSCRIPTS:
        raise invalid(f"'transcripts' must be a list of 1..{MOST_TRANSCRIPTS}")
    phrase, fuzzy, context = params.get("phrase"), params.get("fuzzy"), params.get("context", 1)
    if not isinstance(phrase, str) or not phrase.strip() or len(phrase) > MOST_PHRASE:
        raise invalid(f"'phrase' must have 1..{MOST_PHRASE} characters")
    wanted = fold(phrase)
    if not wanted:
        raise invalid("'phrase' has nothing to match")
    if fuzzy is not None and not (number(fuzzy) and 0.5 <= fuzzy <= 1 and len(wanted) <= find.MOST_CHARS):
        raise invalid(f"'fuzzy' must be null or 0.5 to 1, with a phrase of at most {find.MOST_CHARS} folded characters")
    if isinstance(context, bool) or not isinstance(context, int) or not 0 <= context <= MOST_CONTEXT:
        raise invalid(f"'context' must be an integer in [0, {MOST_CONTEXT}]")
    docs = valid(loaded(spark, items), as_given(spark, items))
    units = held(numbered(docs))
    hits = find.find(units.drop("word"), phrase).withColumn("ratio", F.lit(1.0))
    if fuzzy is not None:
        longest = find.folded(units).groupBy("doc").agg(F.sum(F.length("f")).alias("n")).agg(F.max("n")).first()[0] or 0
        if (work := find.cost(longest, len(wanted))) > find.MOST_COST:
            raise Refusal("INVALID_INPUT", "too much work for approximate matching: search a shorter transcript or phrase", characters=longest, window_lengths=len(find.lengths(len(wanted))), cost=work, max_cost=find.MOST_COST)
        hits = hits.unionByName(find.find_fuzzy(units.drop("word"), phrase, float(fuzzy)).select(F.col("p").alias("hit"), "*").withColumn("match", F.lit("approximate")).drop("p", "q"), allowMissingColumns=True)
    first = units.select("doc", F.col("idx").alias("first_word"), F.col("word").alias("w0"))
    rows = hits.join(first, ["doc", "first_word"], "left").orderBy("doc", "start", "end", "hit").collect()
    per_doc = {r["doc"]: r for r in docs.select(F.col("id").alias("doc"), "title", "source.filename", F.transform("segments", lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"))).alias("segments")).collect()}
    out = []
    for r in rows:
        d = per_doc[r["doc"]]
        name = os.path.basename(items[r["doc"]]) if isinstance(items[r["doc"]], str) else d["filename"]
        seg = d["segments"]
        out.append({
            "source": name, "transcript_id": d["title"], "match": r["match"], "ratio": r["ratio"], "start": r["start"], "end": r["end"], "timing": r["timing"],
            "segment_ids": [s["id"] for s in seg[r["seg"] : r["last_seg"] + 1]],
            "word_indices": list(range(r["w0"], r["w0"] + r["last_word"] - r["first_word"] + 1)) if r["timing"] == "word" else None,
            "speaker_id": r["speaker"], "text": r["text"], "segment_text": " ".join(s["text"] for s in seg[r["seg"] : r["last_seg"] + 1]),
            "context": {"before": [s["text"] for s in seg[max(0, r["seg"] - context) : r["seg"]]], "after": [s["text"] for s in seg[r["last_seg"] + 1 : r["last_seg"] + 1 + context]]},
        })
    totals = [{"transcript_id": per_doc[r["doc"]]["title"]} | {k: r[k] for k in ("segments", "words", "word_timed", "hits")} for r in find.summary(units, hits).orderBy("doc").collect()]
    return {"phrase": phrase, "normalized_phrase": wanted, "fuzzy": fuzzy, "context": context, "count": len(out), "hits": out, "transcripts": totals}


def word_ranges(value: Any, words: int) -> list[tuple[int, int]]:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not isinstance(value, list) or not all(isinstance(r, list) and len(r) == 2 and all(map(whole, r)) for r in value):
        raise invalid("'words' must be [[first, last], ...]", "bad_word_ranges")
    ranges = sorted((a, b) for a, b in value)
    if not all(0 <= a <= b < words for a, b in ranges):
        raise invalid(f"word ranges must run forward inside 0..{words - 1}", "word_index_out_of_range")
    if any(b >= c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False)):
        raise invalid("word ranges overlap", "word_ranges_overlap")
    return ranges


def select_tool(spark: SparkSession, params: dict) -> dict:
    only(params, "transcript", "mode", "words", "segments", "overlap")
    mode, overlap = params.get("mode"), params.get("overlap", "refuse")
    if mode not in ("remove", "keep") or overlap not in ("refuse", "include"):
        raise invalid("'mode' must be remove or keep, 'overlap' refuse or include")
    if params.get("words") is None and params.get("segments") is None:
        raise invalid("give 'words' and / or 'segments'", "empty_selection")
    docs = valid(one(spark, params), as_given(spark, [params["transcript"]]))
    scaled = lambda c: F.bround(F.col(c) * MICRO, 0).cast("long")
    units = held(numbered(docs).withColumns({"s": scaled("s"), "e": scaled("e")}))
    ranges, chosen, ids = None, None, {r["id"]: r["seg"] for r in documents.segments(docs).select("id", "seg").collect()}
    if params.get("words") is not None:
        pairs = word_ranges(params["words"], units.where("timed").count())
        asked = spark.createDataFrame(pairs, "a long, b long")
        ranges = units.where("timed").join(asked, F.col("word").between(F.col("a"), F.col("b"))).select("doc", F.col("idx").alias("first"), F.col("idx").alias("last"))
    if params.get("segments") is not None:
        names = params["segments"]
        if not isinstance(names, list) or not all(isinstance(x, str) and x for x in names):
            raise invalid("'segments' must be a list of ids", "bad_segment_ids")
        if len(set(names)) < len(names):
            raise invalid("'segments' names a segment twice", "duplicate_segment_id")
        if unknown := [x for x in names if x not in ids]:
            raise Refusal("INVALID_INPUT", "unknown segment ids", reason="unknown_segment_id", unknown=unknown[:20])
        chosen = spark.createDataFrame([(0, ids[x]) for x in names], "doc long, seg int")
    duration = docs.select(F.col("id").alias("doc"), scaled("duration").alias("duration"))
    found = select.select(units.drop("word"), duration, mode, ranges, chosen, overlap)
    if refused := found["refused"].collect():
        reason = refused[0]["reason"]
        raise invalid(f"selection refused: {reason}", "selection_overlaps_kept_speech" if reason == "overlap" else reason)
    seconds = lambda row, names: {k: (v / MICRO if k in names and v is not None else v) for k, v in row.asDict().items() if k != "doc"}
    spans = [seconds(r, ("start", "end", "lo", "hi", "speech", "most")) for r in found["spans"].orderBy("start", "end").collect()]
    whole = [seconds(r, ("removed_ms",)) for r in found["sentences"].orderBy("seg").collect()]
    name = {n: x for x, n in ids.items()}
    return {"mode": mode, "spans": spans, "sentences": [{"segment_id": name[r.pop("seg")], "removed_seconds": r.pop("removed_ms")} | r for r in whole], "counts": [seconds(r, ("speech", "most")) for r in found["counts"].collect()][0]}


def segments_tool(spark: SparkSession, params: dict) -> dict:
    only(params, "transcript", "merge_gap")
    gap = params.get("merge_gap", 0.0)
    if not number(gap) or gap < 0:
        raise invalid("'merge_gap' must be a number of seconds, 0 at least")
    docs = valid(one(spark, params), as_given(spark, [params["transcript"]]))
    grouped = intervals.gap_groups(documents.segments(docs), ["doc"], ["seg"], gap)
    row = F.array_sort(F.collect_list(F.struct("seg", "id", "text", "e")))
    named = docs.select(F.col("id").alias("doc"), "title", "asset_id", "language")
    found = grouped.groupBy("doc", "g").agg(F.min("s").alias("start"), row.alias("r")).join(named, "doc").orderBy("g").collect()
    return {"events": [{"id": f"{r['title']}_spev_{r['g']:04d}", "type": "SpeechEvent", "start": r["start"], "end": r["r"][-1]["e"], "asset_id": r["asset_id"], "transcript_id": r["title"], "transcript_segment_ids": [x["id"] for x in r["r"]], "metadata": {"language": r["language"], "segment_texts": [x["text"] for x in r["r"]], "merge_gap": float(gap)}} for r in found]}


def export_tool(spark: SparkSession, params: dict) -> dict:
    """One file, written whole beside its place and then renamed; never over the transcript it comes from."""
    only(params, "transcript", "format", "output")
    form, out = params.get("format", "json"), params.get("output")
    if form not in export.FORMATS or not isinstance(out, str) or not out:
        raise invalid(f"'output' is required and 'format' must be one of {sorted(export.FORMATS)}")
    if isinstance(params.get("transcript"), str) and os.path.realpath(out) == os.path.realpath(params["transcript"]):
        raise invalid("'output' is the input")
    docs = valid(one(spark, params), as_given(spark, [params["transcript"]]))
    scaled = lambda c: F.bround(F.col(c) * 1000, 0).cast("long")
    rows = export.render(documents.segments(docs).withColumns({"s": scaled("s"), "e": scaled("e")}), form).collect()
    with open(f"{out}.part", "w", encoding="utf-8", newline="") as f:
        f.write(rows[0]["content"] if rows else "")
    os.replace(f"{out}.part", out)
    return {"output": out, "format": form}


def speakers_tool(spark: SparkSession, params: dict) -> dict:
    only(params, "transcript", "turns", "allow_source_mismatch", "replace")
    given, turns = params.get("transcript"), params.get("turns")
    if not isinstance(given, dict) or not isinstance(turns, dict) or not isinstance(turns.get("turns"), list):
        raise invalid("'transcript' and 'turns' must be documents")
    rows = [(0, float(t["start"]), float(t["end"]), str(t["speaker"])) for t in turns["turns"]]
    if any(not 0 <= s < e for _, s, e, _ in rows) or any(b[1] < a[2] - 0.01 for a, b in zip(rows, rows[1:], strict=False)):
        raise invalid("turns must be in order and must not overlap", "bad_turns")
    ours, theirs = ((x.get("source") or {}).get("fingerprint") for x in (given, turns))
    if ours != theirs and params.get("allow_source_mismatch") is not True:
        raise invalid("transcript and turns come from different files", "SOURCE_MISMATCH")
    if not params.get("replace") and any(s.get("speaker_id") is not None for s in given.get("segments", [])):
        raise invalid("the transcript has speakers", "SPEAKERS_ALREADY_SET")
    docs = valid(loaded(spark, [given]), as_given(spark, [given]))
    who = spark.createDataFrame(rows, "doc long, s double, e double, speaker string")
    words, segments = speakers.merge(documents.units(docs).where("timed"), documents.segments(docs), who)
    of_word = {(r["seg"], r["pos"]): r["speaker"] for r in words.select("seg", "pos", "speaker").collect()}
    of_segment = {r["seg"]: r["speaker"] for r in segments.select("seg", "speaker").collect()}
    named = [s | {"speaker_id": of_segment[k], "words": s.get("words") and [w | {"speaker_id": of_word[k, j]} for j, w in enumerate(s["words"])]} for k, s in enumerate(given["segments"])]
    return {"transcript": given | {"segments": named}}


def check_tool(spark: SparkSession, params: dict) -> dict:
    only(params, "transcript")
    return report(one(spark, params), as_given(spark, [params["transcript"]]))


def engines_tool(spark: SparkSession, params: dict) -> dict:
    only(params, "capability")
    specs = engines.engines(spark)
    able = engines.capabilities(specs).groupBy("id").agg(F.array_sort(F.collect_set("capability")).alias("capabilities"))
    wanted = F.lit(True) if params.get("capability") is None else F.array_contains("capabilities", F.lit(params["capability"]))
    return {"engines": [r.asDict() for r in specs.join(able, "id").where(wanted).orderBy("id").collect()]}


def transcribe_tool(spark: SparkSession, params: dict) -> dict:
    raise Refusal("ENGINE_UNAVAILABLE", "recognition models are not part of this engine", reason="engine_not_installed")


def batch_tool(spark: SparkSession, params: dict) -> dict:
    """Every item's own outcome, in order."""
    only(params, "items")
    items = params.get("items")
    if not isinstance(items, list) or not items:
        raise invalid("'items' must be a non-empty list")
    out = []
    for x in items:
        try:
            out.append({"ok": True, "result": transcribe_tool(spark, x)})
        except Refusal as e:
            out.append(e.document())
    return {"results": out}


TOOLS = {f"transcription/{k}": f for k, f in {"transcribe": transcribe_tool, "segments": segments_tool, "export": export_tool, "speakers": speakers_tool, "find": find_tool, "select": select_tool, "check": check_tool, "batch": batch_tool, "engines": engines_tool}.items()}


def run(spark: SparkSession, request: Any) -> dict:
    """{"ok": true, "tool", "result"}, or a Refusal."""
    if not isinstance(request, dict) or set(request) - {"tool", "params"}:
        raise invalid("a request is an object of 'tool' and 'params'")
    name, params = request.get("tool"), request.get("params", {})
    if not isinstance(name, str) or name not in TOOLS or not isinstance(params, dict):
        raise Refusal("INVALID_INPUT", "'tool' must be known and 'params' an object", tools=list(TOOLS))
    try:
        return {"ok": True, "tool": name, "result": TOOLS[name](spark, params)}
    finally:
        while _held:
            _held.pop().unpersist()


def respond(spark: SparkSession, raw: str) -> tuple[dict, int]:
    """The document that answers a request's text, and the exit code."""
    try:
        try:
            request = json.loads(raw)
        except ValueError as e:
            raise invalid(f"not valid JSON: {e}") from e
        return run(spark, request), 0
    except Refusal as e:
        return e.document(), e.exit_code
