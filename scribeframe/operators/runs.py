"""Rules and reports of a recognition run: chunk parameters, budget, cut warnings, chunk totals, languages, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeframe.operators.validate import CREDENTIALS

# Fixed values of the contract: chunk lengths in seconds, chunks side by side, the level of a pause, a term's length.
CHUNK_SECONDS, MOST_PARALLEL, PAUSE_LEVEL, MOST_TERM = (30.0, 3600.0), 8, -40.0, 100
# The coarse names of a dictionary's parts of speech.
COARSE = {
    "名詞": "noun", "代名詞": "pronoun", "動詞": "verb", "形容詞": "adjective", "形状詞": "adjective", "副詞": "adverb", "助詞": "particle", "助動詞": "auxiliary",
    "接続詞": "conjunction", "感動詞": "interjection", "接頭辞": "prefix", "接尾辞": "suffix", "補助記号": "symbol", "記号": "symbol", "空白": "symbol",
}


def chunk_rules(requests: DataFrame) -> DataFrame:
    """(req, reason): the first rule that a request (req, chunk_seconds, parallel, language, regions) breaks; ``regions``:
    whether speech regions are given."""
    c = F.col
    reason = (
        F.when(~c("chunk_seconds").between(*CHUNK_SECONDS) | F.isnan("chunk_seconds"), "chunk_seconds").when(c("chunk_seconds").isNotNull() & c("language").isNull(), "language_required_for_chunking")
        .when(~c("parallel").between(1, MOST_PARALLEL), "parallel").when(c("chunk_seconds").isNull() & ((F.coalesce("parallel", F.lit(1)) != 1) | c("regions")), "chunk_seconds_required")
    )
    return requests.select("req", reason.alias("reason")).where("reason is not null")


def over_budget(media: DataFrame) -> DataFrame:
    """(req, duration, most) of media longer than their request allows: refused before any work."""
    return media.where("duration > most").select("req", "duration", "most")


def cut_warnings(chunks: DataFrame) -> DataFrame:
    """(doc, chunk, e, level) of chunks cut by level where even the quietest place is louder than a pause."""
    return chunks.where((F.col("source") == "level") & (F.col("level") > PAUSE_LEVEL)).select("doc", "chunk", "e", "level")


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """(doc, chunks, from_cache, recognized, engine_seconds) of chunks (doc, chunk, from_cache, engine_seconds)."""
    cached = F.count(F.when(F.col("from_cache"), 1))
    return chunks.groupBy("doc").agg(F.count("*").alias("chunks"), cached.alias("from_cache"), (F.count("*") - cached).alias("recognized"), F.round(F.sum(F.coalesce("engine_seconds", F.lit(0.0))), 3).alias("engine_seconds"))


def realtime_factor(wall: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.round(wall / duration, 4))


def languages(chunks: DataFrame) -> DataFrame:
    """(doc, language, several): the one language that a recording's chunks were recognised as, or all of them, by name."""
    found = chunks.where("language is not null").groupBy("doc").agg(F.array_sort(F.collect_set("language")).alias("l"))
    return found.select("doc", F.when(F.size("l") == 1, F.get("l", 0)).alias("language"), F.when(F.size("l") > 1, F.array_join("l", ", ")).alias("several"))


def lacks_indices(words: DataFrame) -> DataFrame:
    """(doc, lacks): whether any word of a transcript has no number."""
    return words.groupBy("doc").agg(F.some(F.col("idx").isNull()).alias("lacks"))


def coarse_pos(part_of_speech: Column) -> Column:
    """The coarse name of the first of a dictionary's parts of speech; ``other`` for none and unknown ones."""
    names = F.create_map(*[F.lit(x) for pair in COARSE.items() for x in pair])
    return F.coalesce(F.element_at(names, F.get(part_of_speech, 0)), F.lit("other"))


def sample_hash(content: Column, first: Column, last: Column, header: int = 44) -> Column:
    """SHA-256 of the 16-bit samples first to last, the last not included, of a PCM file's content."""
    return F.sha2(F.substring(content, header + 1 + 2 * first, 2 * (last - first)), 256)


def asset_id(fingerprint: Column) -> Column:
    return F.concat(F.lit("asset_"), F.substring(F.substring_index(fingerprint, ":", -1), 1, 16))


def clean_term(x: Column) -> tuple[Column, Column]:
    """A vocabulary term with single spaces, and why it is refused (null if it isn't)."""
    text = F.trim(F.regexp_replace(x, r"(?U)[\s\x1C-\x1F]+", " "))
    secret = F.lit(False)
    for p in CREDENTIALS:
        secret = secret | text.rlike(p)
    return text, F.when(F.length(text) > MOST_TERM, "long").when(text.rlike(r"[\x00-\x1F]"), "control").when(secret, "credential")
