"""Speaker attribution: units take the speaker whose turns overlap them longest; ties and gaps stay null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.operators.intervals import overlaps, touching


def pick(scores: DataFrame, keys: list[str], tie: float = 1e-9) -> DataFrame:
    """(keys, speaker): the strict maximum of ``score``; null speaker where the best two are equal."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("speaker").desc())
    ranked = scores.where(F.col("score") > tie).withColumn("_next", F.lead("score").over(w)).withColumn("_rank", F.row_number().over(w))
    return ranked.where("_rank = 1").select(*keys, F.when(F.col("_next").isNull() | (F.col("score") - F.col("_next") > tie), F.col("speaker")).alias("speaker"))


def of_words(words: DataFrame, turns: DataFrame) -> DataFrame:
    """words with ``speaker``."""
    t = turns.select("doc", "speaker", F.col("s").alias("ts"), F.col("e").alias("te"))
    scores = overlaps(words.select("doc", "idx", "s", "e"), t, ["doc"]).groupBy("doc", "idx", "speaker").agg(F.sum("common").alias("score"))
    return words.join(pick(scores, ["doc", "idx"]), ["doc", "idx"], "left")


def of_segments(segments: DataFrame, assigned: DataFrame, turns: DataFrame) -> DataFrame:
    """segments with ``speaker``: the vote of their words by duration, or their own overlap where they have no words."""
    votes = assigned.where("speaker is not null").groupBy("doc", "seg", "speaker").agg(F.sum(F.col("e") - F.col("s")).alias("score"))
    worded = assigned.select("doc", "seg").distinct()
    t = turns.select("doc", "speaker", F.col("s").alias("ts"), F.col("e").alias("te"))
    bare = segments.join(worded, ["doc", "seg"], "left_anti").select("doc", "seg", "s", "e")
    own = overlaps(bare, t, ["doc"]).groupBy("doc", "seg", "speaker").agg(F.sum("common").alias("score"))
    return segments.join(pick(votes.union(own), ["doc", "seg"]), ["doc", "seg"], "left")


def counts(segments: DataFrame, words: DataFrame) -> DataFrame:
    by_doc = segments.groupBy("doc").agg(F.count("*").alias("segments"), F.count("speaker").alias("assigned"), F.count(F.when(F.col("speaker").isNull(), 1)).alias("unassigned"))
    return by_doc.join(words.groupBy("doc").agg(F.count("*").alias("words"), F.count("speaker").alias("words_assigned")), "doc", "left").na.fill(0)


def per_speaker(segments: DataFrame) -> DataFrame:
    return segments.where("speaker is not null").groupBy("doc", "speaker").agg(F.count("*").alias("segments"))


def in_overlap(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """Segments that touch a region where speakers overlap."""
    return touching(segments, regions.select("doc", F.col("s").alias("ts"), F.col("e").alias("te")), ["doc"])


def merge(words: DataFrame, segments: DataFrame, turns: DataFrame, sources: DataFrame | None = None, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(words, segments) with speakers. ``sources``: documents whose turns come from the same recording; others keep null.
    Input that already names speakers is refused unless ``replace``."""
    if "speaker" in segments.columns or "speaker" in words.columns:
        if not replace:
            raise ValueError("speakers_present")
        words, segments = words.drop("speaker"), segments.drop("speaker")
    if sources is not None:
        turns = turns.join(sources.select("doc").distinct(), "doc", "left_semi")
    assigned = of_words(words, turns)
    return assigned, of_segments(segments, assigned, turns)
