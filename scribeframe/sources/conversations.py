"""Transcripts from a table of conversation turns: a transcript a conversation, a segment a turn, words by white space.

Times are integer milliseconds on the transcript's own timeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seg"), "role", "text")


def words(turns: DataFrame) -> DataFrame:
    """(doc, seg, pos, role, text, idx, s, e): words with their number in the transcript and their times.

    Turns are dealt out by transcript before they become words, which take ten times the room; the number of partitions
    is the session's, since partitions put together by the size of turns would be too large as words."""
    turns = turns.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")
    parts = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    flat = turns.select("doc", "seg", "role", F.posexplode(parts).alias("pos", "text")).where("text <> ''")
    idx = F.row_number().over(Window.partitionBy("doc").orderBy("seg", "pos")).cast("long") - 1
    s = F.col("idx") * 400 + F.col("seg") * 1000
    return flat.withColumn("idx", idx).withColumn("s", s).withColumn("e", F.col("s") + 300 + 20 * (F.length("text") % 4))


def lists(turns: DataFrame) -> DataFrame:
    """(doc, seg, s, e, text, words): a row for each segment with its words (pos, text, idx, s, e) in order, as words() and
    segments() have them. Words are numbered by the counts of the segments before, so only turns are dealt out and sorted.
    Turns of one number are one segment, whose words stand by place."""
    turns = turns.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc").groupBy("doc", "seg").agg(F.sort_array(F.collect_list("text")).alias("t"))
    parts = lambda t: F.filter(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), lambda x: x != "")
    count = F.aggregate("t", F.lit(0), lambda n, t: n + F.size(parts(t)))
    before = Window.partitionBy("doc").orderBy(F.asc_nulls_last("seg")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("n", count).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0")
    placed = lambda t: F.transform(parts(t), lambda x, i: F.struct(i.alias("pos"), x.alias("text")))
    listed = turns.withColumn("w", F.when(F.size("t") == 1, placed(F.get("t", 0))).otherwise(F.array_sort(F.flatten(F.transform("t", placed)))))

    def word(x, i):
        idx = F.col("first") + i
        s = idx * 400 + F.col("seg") * 1000
        return F.struct(x["pos"].alias("pos"), x["text"].alias("text"), idx.alias("idx"), s.alias("s"), (s + 300 + 20 * (F.length(x["text"]) % 4)).alias("e"))

    text = F.array_join(F.transform("w", lambda x: x["text"]), " ")
    out = listed.select("doc", "seg", text.alias("text"), F.transform("w", word).alias("words"))
    return out.select("doc", "seg", F.get("words", 0)["s"].alias("s"), F.element_at("words", -1)["e"].alias("e"), "text", "words")


def segments(words: DataFrame) -> DataFrame:
    """(doc, seg, role, s, e, text, words): a row for each segment, its words in order."""
    row = F.array_sort(F.collect_list(F.struct("pos", "text")))
    grouped = words.groupBy("doc", "seg", "role").agg(F.min("s").alias("s"), F.max("e").alias("e"), row.alias("w"))
    return grouped.select("doc", "seg", "role", "s", "e", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), F.size("w").cast("long").alias("words"))


def turns(segments: DataFrame) -> DataFrame:
    """Speaker turns that don't quite fit the segments: shifted, cut short, and halved every fifth segment, so that
    words lie across turns, in gaps and in ties."""
    speaker = F.concat(F.lit("SPEAKER_"), F.lpad((F.hash("role") * 0 + F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)).cast("string"), 2, "0"))
    base = segments.select("doc", "seg", speaker.alias("speaker"), (F.col("s") - 150).alias("s"), F.when(F.col("seg") % 3 == 1, F.col("e") - 900).otherwise(F.col("e") - 250).alias("e"))
    whole = base.where("seg % 5 <> 2")
    middle = F.expr("s + 550")
    first = base.where("seg % 5 = 2").select("doc", "seg", "speaker", "s", middle.alias("e"))
    second = base.where("seg % 5 = 2").select("doc", "seg", F.lit("SPEAKER_09").alias("speaker"), middle.alias("s"), "e")
    return whole.union(first).union(second).where("e > s and s >= 0")
