"""Readers and writers of transcript documents, speaker turns and speech regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "struct<index: int, start: double, end: double, text: string, confidence: double, speaker_id: string, timing: string, pos: string>"
SEGMENT = f"struct<id: string, start: double, end: double, text: string, raw_text: string, confidence: double, words: array<{WORD}>, speaker_id: string>"
SOURCE = "struct<filename: string, fingerprint: string, size_bytes: bigint, media_duration: double, audio_channels: int, sample_rate: int, container: string, has_video: boolean>"
TRANSCRIPT = f"`schema` string, id string, asset_id string, language string, language_source string, language_confidence double, duration double, segments array<{SEGMENT}>, source {SOURCE}, engine string, engine_version string, created_at string, warnings array<string>"
TURNS = "`schema` string, source struct<fingerprint: string>, turns array<struct<start: double, end: double, speaker: string>>, overlap struct<available: boolean, regions array<struct<start: double, end: double>>>".replace("regions array", "regions: array")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON document; unreadable ones have the text in ``_corrupt_record``."""
    return spark.read.schema(TRANSCRIPT + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def segments(docs: DataFrame) -> DataFrame:
    flat = docs.select(F.col("id").alias("doc"), "duration", F.posexplode("segments").alias("seg", "x"))
    return flat.select("doc", "duration", "seg", "x.id", F.col("x.start").alias("s"), F.col("x.end").alias("e"), "x.text", "x.raw_text", "x.words", F.col("x.speaker_id").alias("role"))


def spaces(text, words):
    """For each of a segment's words, whether white space stands before it in the segment's text, where the words are
    looked for one after the other."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<boolean>").alias("found"))

    def step(out, w):
        hit = F.call_function("locate", w["text"], text, out["at"])
        gap = F.substring(text, out["at"], hit - out["at"])
        before = (hit > out["at"]) & (F.regexp_replace(gap, r"(?U)[\s\x1C-\x1F]", "") == "")
        return F.struct(F.when(hit > 0, hit + F.length(w["text"])).otherwise(out["at"]).alias("at"), F.concat(out["found"], F.array(F.coalesce(before, F.lit(False)))).alias("found"))

    return F.aggregate(words, start, step)["found"]


def units(docs: DataFrame) -> DataFrame:
    """Words, and whole segments where there are none, numbered in order. ``space``: white space stands before a unit, as it
    does between segments."""
    flat = segments(docs)
    none = F.coalesce("words", F.array().cast(f"array<{WORD}>"))
    word = flat.where(F.size(none) > 0).select("doc", "seg", F.posexplode(F.arrays_zip(F.col("words").alias("w"), spaces(F.col("text"), F.col("words")).alias("space"))).alias("pos", "x"), "role").select("doc", "seg", "pos", "role", F.col("x.w").alias("w"), F.col("x.space").alias("space"))
    rows = word.select("doc", "seg", "pos", F.col("w.start").alias("s"), F.col("w.end").alias("e"), "w.text", F.coalesce("w.speaker_id", "role").alias("role"), F.lit(True).alias("timed"), ((F.col("pos") == 0) | F.col("space")).alias("space"))
    bare = flat.where(F.size(none) <= 0).select("doc", "seg", F.lit(0).alias("pos"), "s", "e", "text", "role", F.lit(False).alias("timed"), F.lit(True).alias("space"))
    return rows.union(bare).withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("seg", "pos")).cast("long") - 1)


def rebuilt(flat: DataFrame) -> DataFrame:
    """Documents' segment arrays from segments(): (doc, segments)."""
    row = F.struct("seg", F.struct("id", F.col("s").alias("start"), F.col("e").alias("end"), "text", "raw_text", "words", F.col("role").alias("speaker_id")).alias("x"))
    return flat.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]).alias("segments"))


def turns(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint, n, s, e, speaker, ok) of speaker documents; ``ok``: a well-formed turn, in order within 0.01 s."""
    flat = spark.read.schema(TURNS).option("multiLine", True).json(path).select("source.fingerprint", F.posexplode("turns").alias("n", "t"))
    rows = flat.select("fingerprint", "n", F.col("t.start").alias("s"), F.col("t.end").alias("e"), "t.speaker")
    before = F.lag("e").over(Window.partitionBy("fingerprint").orderBy("n"))
    return rows.withColumn("ok", F.col("speaker").rlike(r"^SPEAKER_\d{2,}$") & (F.col("s") >= 0) & (F.col("e") > F.col("s")) & F.coalesce(F.col("s") >= before - 0.01, F.lit(True)))


def overlap_regions(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(TURNS).option("multiLine", True).json(path).where("overlap.available")
    return docs.select("source.fingerprint", F.explode("overlap.regions").alias("r")).select("fingerprint", F.col("r.start").alias("s"), F.col("r.end").alias("e")).where("s >= 0 and e > s")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("fingerprint"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("text"))


def canonical_hash(column: str):
    """sha256 of a JSON text in canonical form: sorted keys, ``", "`` and ``": "``, no escapes of other scripts."""
    import hashlib
    import json

    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False).encode()).hexdigest())

    return run(F.col(column))
