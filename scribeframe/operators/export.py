"""Timed-text exports: one text a transcript from its segments (doc, seg, s, e in milliseconds, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.functions.text import clock


def _texts(segments: DataFrame, line: Column, head: str, between: str, tail: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc").orderBy("seg")).cast("long")
    rows = segments.withColumn("n", n).withColumn("line", line)
    ordered = F.array_sort(F.collect_list(F.struct("n", "line")))
    return rows.groupBy("doc").agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda x: x["line"]), between), F.lit(tail)).alias("content"))


def _times(separator: str) -> Column:
    return F.concat(clock(F.col("s"), separator), F.lit(" --> "), clock(F.col("e"), separator))


def srt(segments: DataFrame) -> DataFrame:
    return _texts(segments, F.concat(F.col("n").cast("string"), F.lit("\n"), _times(","), F.lit("\n"), F.col("text"), F.lit("\n")), "", "\n", "")


def vtt(segments: DataFrame) -> DataFrame:
    return _texts(segments, F.concat(_times("."), F.lit("\n"), F.col("text"), F.lit("\n")), "WEBVTT\n\n", "\n", "")


def tsv(segments: DataFrame) -> DataFrame:
    return _texts(segments, F.concat_ws("\t", F.col("s").cast("string"), F.col("e").cast("string"), "text"), "start\tend\ttext\n", "\n", "\n")


def txt(segments: DataFrame) -> DataFrame:
    return _texts(segments, F.col("text"), "", "\n", "\n")


def json(segments: DataFrame) -> DataFrame:
    row = F.array_sort(F.collect_list(F.struct("seg", "s", "e", "text")))
    return segments.groupBy("doc").agg(F.to_json(F.struct(F.col("doc"), row.alias("segments"))).alias("content"))


FORMATS = {"srt": srt, "vtt": vtt, "tsv": tsv, "txt": txt, "json": json}


def render(segments: DataFrame, form: str, report: DataFrame | None = None) -> DataFrame:
    """The texts of valid transcripts; ``report`` (doc, ok) leaves the others out."""
    if form not in FORMATS:
        raise ValueError(f"INVALID_INPUT: unknown format {form}")
    good = segments if report is None else segments.join(report.where("ok").select("doc"), "doc", "left_semi")
    return FORMATS[form](good)


def write(contents: DataFrame, path: str) -> None:
    """One text row a transcript, partitioned by transcript; the commit protocol makes the write atomic."""
    contents.select("doc", F.col("content").alias("value")).write.mode("errorifexists").partitionBy("doc").text(path)
