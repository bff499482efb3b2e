"""Whole transcripts from raw recognition output: cleaned segments, accepted words, provenance and warnings in one document,
and everything that a document breaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.functions.text import normalize_text
from scribeframe.operators import builder, validate
from scribeframe.operators.runs import asset_id

SCHEMA, SKILL, TOOL = "transcript/0.1", "transcription", "transcription/transcribe"


def documents(recordings: DataFrame, raw: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, json): the transcript of each recording.

    ``recordings``: (doc, id, filename, fingerprint, size_bytes, duration, audio_channels, sample_rate, container, has_video, engine,
    engine_version, mode, model, model_version, parameters as JSON, parameters_hash, cache_key, created_at, processing_seconds,
    skill_version, requested, detected, probability, warnings); ``raw``: segments (doc, n, s, e, text, confidence) as they came,
    in seconds; ``words``: (doc, n, pos, s, e, text, confidence, timing). Every document keeps a word list of a segment whole or
    not at all. A recording without segments has a transcript without any."""
    length = recordings.select("doc", "duration")
    own = raw.join(length, "doc")
    segs = builder.clean_segments(own)
    at = Window.partitionBy("doc").orderBy("s", "e", "n")
    order = own.withColumn("_at", F.row_number().over(at)).select("doc", "n", "_at", F.col("s").alias("_s"), F.col("e").alias("_e"), "duration", normalize_text(F.col("text")).alias("_t"))

    limit = F.col("duration")
    late = (F.col("s") < limit) & (F.col("e") > limit) & (F.col("e") <= limit + builder.OVERRUN)
    placed = words.join(segs.select("doc", "n", F.col("pos").alias("seg"), "duration"), ["doc", "n"]).withColumn("e", F.when(late, limit).otherwise(F.col("e"))).withColumn("text", normalize_text(F.col("text"))).drop("duration")
    spans = segs.select("doc", F.col("pos").alias("seg"), "s", "e")
    wide = builder.widen(placed, spans)
    refused = builder.accept_words(wide, spans)
    good = builder.number_words(wide.join(refused, ["doc", "seg"], "left_anti"))
    word = F.struct(F.col("idx").alias("index"), F.col("s").alias("start"), F.col("e").alias("end"), "text", "confidence", F.lit(None).cast("string").alias("speaker_id"), "timing")
    lists = good.groupBy("doc", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", word.alias("w")))), lambda x: x["w"]).alias("words"))
    segment = F.struct("id", F.col("s").alias("start"), F.col("e").alias("end"), "text", "raw_text", "confidence", "words", F.lit(None).cast("string").alias("speaker_id"))
    rows = segs.join(lists.withColumnRenamed("seg", "pos"), ["doc", "pos"], "left")
    bodies = rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", segment.alias("x")))), lambda r: r["x"]).alias("segments"))

    said = lambda df, place, text: df.select("doc", F.struct(place.cast("long").alias("at"), text.alias("text")).alias("w"))
    name = F.format_string("seg_%04d", "seg")
    dropped = F.when(F.col("_t") == "", F.format_string("dropped empty segment at %.2f-%.2f", "_s", "_e")).when(F.col("_e") <= F.col("_s"), F.format_string("dropped zero-length segment at %.2f", "_s"))
    clamped = F.when((F.col("_e") > limit) & (F.col("_e") <= limit + builder.OVERRUN) & (F.col("_s") < limit), F.format_string("%s: end %.2f clamped to media duration %.3f", "id", "_e", "duration"))
    told = order.join(segs.select("doc", "n", "id"), ["doc", "n"], "left")
    place = segs.select("doc", F.col("pos").alias("seg"), "n").join(order.select("doc", "n", "_at"), ["doc", "n"]).select("doc", "seg", "_at")
    moved = wide.select("doc", "seg", "pos", "s", "e").join(placed.select("doc", "seg", "pos", F.col("s").alias("_s"), F.col("e").alias("_e")), ["doc", "seg", "pos"]).where("s <> _s or e <> _e").join(place, ["doc", "seg"])
    unsure = recordings.where(F.col("requested").isNull() & ~F.coalesce(F.col("detected").isNotNull() & (F.col("probability") >= builder.DETECTED), F.lit(False)))
    warnings = [
        said(recordings.select("doc", F.posexplode("warnings").alias("i", "t")), F.col("i") - (1 << 40), F.col("t")), said(unsure, F.lit(-1), F.lit("language could not be detected with confidence; recorded as unknown")),
        said(order.withColumn("_back", F.col("n") < F.max("n").over(Window.partitionBy("doc").orderBy("_at"))).where("_back").select("doc").distinct(), F.lit(0), F.lit("engine returned segments out of order; sorted by start")),
        said(told.where(dropped.isNotNull()), F.col("_at") * 4, dropped), said(told.where(dropped.isNull() & clamped.isNotNull()), F.col("_at") * 4 + 1, clamped),
        said(moved, F.col("_at") * 4 + 2, F.format_string("%s: zero-length word at %.2f s widened to 0.01 s ([%.2f, %.2f])", name, F.col("_s"), F.col("s"), F.col("e"))),
        said(refused.join(place, ["doc", "seg"]), F.col("_at") * 4 + 3, F.format_string("%s: word timestamps discarded (%s at %.2f)", name, F.col("reason"), F.col("at"))),
    ]
    notes = reduce(lambda a, b: a.union(b), warnings).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list("w")), lambda x: x["text"]).alias("notes"))

    language, source = builder.language_decision(F.col("requested"), F.col("detected"), F.col("probability"))
    origin = F.struct("filename", "fingerprint", "size_bytes", F.col("duration").alias("media_duration"), "audio_channels", "sample_rate", "container", "has_video")
    detection = F.when(F.col("requested").isNull(), F.struct(F.col("detected").alias("candidate"), "probability", F.lit(builder.DETECTED).alias("min_probability")))
    provenance = F.struct(
        "engine", "engine_version", F.col("mode").alias("execution_mode"), "model", "model_version", F.parse_json("parameters").alias("parameters"), "parameters_hash", "cache_key", "created_at", F.round("processing_seconds", 3).alias("processing_seconds"), "skill_version",
        F.lit(SKILL).alias("skill"), F.lit(TOOL).alias("tool"), detection.alias("language_detection"),
    )
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    both = recordings.join(bodies, "doc", "left").join(notes, "doc", "left")
    document = F.struct(
        F.lit(SCHEMA).alias("schema"), "id", asset_id(F.col("fingerprint")).alias("asset_id"), language.alias("language"), source.alias("language_source"), F.when(source == "detected", F.col("probability")).alias("language_confidence"), "duration",
        empty("segments", bodies.schema["segments"].dataType).alias("segments"), origin.alias("source"), "engine", "engine_version", "created_at", provenance.alias("provenance"), empty("notes", "array<string>").alias("warnings"),
    )
    return both.select("doc", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def broken(docs: DataFrame) -> DataFrame:
    """(doc, rule, place) of what whole documents (doc, json) break beside the rules on typed segments and words: keys that
    are missing, provenance, and leaks in any string at any depth."""
    g = lambda path: F.get_json_object("json", f"$.{path}")
    missing = validate.required_keys(docs).select("doc", F.lit("missing").alias("rule"), F.concat_ws(".", "place", "key").alias("place"))
    names = ("engine", "engine_version", "execution_mode", "parameters_hash", "cache_key", "skill", "skill_version", "tool", "model", "parameters")
    flat = docs.where(g("provenance").isNotNull()).select("doc", g("engine").alias("engine"), g("engine_version").alias("engine_version"), *[g(f"provenance.{k}").alias(f"p_{k}") for k in names], g("provenance.processing_seconds").try_cast("double").alias("p_processing_seconds"))
    origin = validate.provenance_rules(flat).select("doc", F.concat(F.lit("provenance_"), "rule").alias("rule"), F.lit("provenance").alias("place"))
    leaked = validate.leaks(validate.json_strings(docs)).select("doc", F.concat(F.lit("leak_"), "reason").alias("rule"), F.col("key").alias("place"))
    return missing.unionByName(origin).unionByName(leaked)
