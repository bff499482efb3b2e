"""Transcripts from raw recognition output: clean, clamp, widen, check words, number; words from tokens; segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.functions.text import clip_confidence, normalize_text, segment_id, strip_ws

# Fixed values in seconds: overrun that is cut, least word, tolerance around a segment, pause between segments.
OVERRUN, LEAST_WORD, TOLERANCE, PAUSE = 2.0, 0.01, 0.01, 1.0
DETECTED = 0.5
# Languages that an aligner joins without spaces; seconds of a frame of token offsets.
ALIGNED_BY_CHARACTER, FRAME_SECONDS = ("ja",), 0.08


def clean_segments(raw: DataFrame) -> DataFrame:
    """raw (doc, n, s, e, text, duration) in time order, without empty or zero-length rows, ends cut at the duration,
    numbered anew: adds raw_text, pos and id."""
    text = normalize_text(F.col("text"))
    end = F.when((F.col("e") > F.col("duration")) & (F.col("e") <= F.col("duration") + OVERRUN) & (F.col("s") < F.col("duration")), F.col("duration")).otherwise(F.col("e"))
    rows = raw.withColumns({"raw_text": F.col("text"), "text": text, "e": end}).where("text <> '' and e > s")
    pos = F.row_number().over(Window.partitionBy("doc").orderBy("s", "e", "n")).cast("long")
    return rows.withColumn("pos", pos).withColumn("id", segment_id(pos))


def dropped_segments(raw: DataFrame) -> DataFrame:
    """(doc, n, reason) of the rows that clean_segments() leaves out."""
    reason = F.when(normalize_text(F.col("text")) == "", "empty_text").when(~(F.col("e") > F.col("s")), "zero_length")
    return raw.select("doc", "n", reason.alias("reason")).where("reason is not null")


def widen(words: DataFrame, segments: DataFrame) -> DataFrame:
    """words (doc, seg, pos, s, e, ...) in which a word that lacks less than LEAST_WORD to a duration gets LEAST_WORD: it
    ends at the next word or the segment's end at the latest and reaches back into the gap before it, but not into the
    word before, as that one is now, nor before the segment. A word without room, or outside the segment, stays as it is."""
    ends = segments.select("doc", "seg", F.col("s").alias("_ss"), F.col("e").alias("_se"))
    lists = words.join(ends, ["doc", "seg"]).groupBy("doc", "seg", "_ss", "_se").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "e"))).alias("w"))
    start = F.array().cast("array<struct<pos: bigint, s: double, e: double>>")

    def step(out, x):
        i, ss, se = F.size(out), F.col("_ss"), F.col("_se")
        near = (x["e"] <= x["s"]) & (x["s"] - x["e"] < LEAST_WORD) & x["s"].between(ss - TOLERANCE, se + TOLERANCE)
        low = F.when(i > 0, F.greatest(ss, F.element_at(out, -1)["e"])).otherwise(ss)
        high = F.when(i + 1 < F.size("w"), F.least(se, F.get(F.col("w"), i + 1)["s"])).otherwise(se)
        e = F.round(F.least(x["s"] + LEAST_WORD, high), 6)
        s = F.round(e - LEAST_WORD, 6)
        fits = near & (s >= low - 1e-9)
        return F.concat(out, F.array(F.struct(x["pos"].cast("long").alias("pos"), F.when(fits, s).otherwise(x["s"]).cast("double").alias("s"), F.when(fits, e).otherwise(x["e"]).cast("double").alias("e"))))

    new = lists.select("doc", "seg", F.explode(F.aggregate("w", start, step)).alias("x")).select("doc", "seg", "x.pos", F.col("x.s").alias("_s"), F.col("x.e").alias("_e"))
    return words.join(new, ["doc", "seg", "pos"]).withColumns({"s": F.col("_s"), "e": F.col("_e")}).drop("_s", "_e")


def accept_words(words: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc, seg, reason, at): segments whose whole word list is refused, with the first reason in word order and its word's
    start."""
    ends = segments.select("doc", "seg", F.col("s").alias("ss"), F.col("e").alias("se"))
    rows = words.join(ends, ["doc", "seg"]).withColumn("_p", F.lag("e").over(Window.partitionBy("doc", "seg").orderBy("pos")))
    reason = F.when(F.trim("text") == "", "empty").when(~(F.col("e") > F.col("s")), "not_positive").when((F.col("s") < F.col("ss") - TOLERANCE) | (F.col("e") > F.col("se") + TOLERANCE), "outside").when(F.col("s") < F.col("_p") - TOLERANCE, "order")
    bad = rows.withColumn("reason", reason).where("reason is not null")
    return bad.groupBy("doc", "seg").agg(F.min_by(F.struct("reason", F.col("s").alias("at")), "pos").alias("x")).select("doc", "seg", "x.*")


def language_decision(requested: Column, detected: Column, probability: Column) -> tuple[Column, Column]:
    """(language, source)."""
    sure = detected.isNotNull() & (probability >= DETECTED)
    return F.when(requested.isNotNull(), requested).when(sure, detected).otherwise("unknown"), F.when(requested.isNotNull(), "requested").when(sure, "detected").otherwise("unknown")


def build_segments(words: DataFrame, pause: float = PAUSE, marks: str = "[.!?。！？][\"'”’)\\]」』]*$") -> DataFrame:
    """words with ``g``: a new segment after a pause, or after a word that ends a sentence."""
    w = Window.partitionBy("doc").orderBy("idx")
    new = F.coalesce((F.col("s") - F.lag("e").over(w) >= pause) | F.lag("text").over(w).rlike(marks), F.lit(True))
    return words.withColumn("g", F.sum(new.cast("int")).over(w).cast("long"))


def tokens_to_words(tokens: DataFrame) -> DataFrame:
    """(doc, word, s, e, text) of tokens (doc, n, s, e, text): a word begins at a token led by a space, and at or after
    a character of a script without spaces."""
    unspaced = r"[⺀-鿿豈-﫿ｦ-ﾟ]"
    w = Window.partitionBy("doc").orderBy("n")
    before = F.lag("text").over(w)
    new = before.isNull() | F.col("text").startswith(" ") | F.trim("text").rlike("^" + unspaced) | F.rtrim(before).rlike(unspaced + "$")
    g = tokens.withColumn("g", F.sum(new.cast("int")).over(w).cast("long"))
    row = F.array_sort(F.collect_list(F.struct("n", "text")))
    return g.groupBy("doc", F.col("g").alias("word")).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.trim(F.array_join(F.transform(row, lambda x: x["text"]), "")).alias("text"))


def merge_zero_length(words: DataFrame) -> DataFrame:
    """Words without duration join the word before, or the next at the start: (doc, g, s, e, text)."""
    w = Window.partitionBy("doc").orderBy("n")
    g = F.greatest(F.sum((F.col("e") > F.col("s")).cast("int")).over(w), F.lit(1))
    row = F.array_sort(F.collect_list(F.struct("n", "text")))
    return words.withColumn("g", g.cast("long")).groupBy("doc", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_join(F.transform(row, lambda x: x["text"]), "").alias("text"))


def dictionary_words(segments: DataFrame, words: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Times for a dictionary's tokens from recognised words: (doc, seg, pos, text, s, e, confidence, timing, tag) of segments
    that fit, and (doc, seg, reason) of those that don't and keep their own words.

    ``segments``: (doc, seg, text); ``words``: (doc, seg, pos, text, s, e, confidence, timing), times in seconds; ``tokens``: (doc, seg,
    pos, text, tag), in the text's order. Both sides are laid over the segment's characters without white space. The
    begins of words and tokens cut a segment into pieces, and a running last value tells each piece's word and token. A
    token's limit on a word's own edge is measured, unless that word's time is an estimate; inside a word it is
    interpolated by characters. A segment is refused if a word is empty, if either side doesn't give its text, without
    tokens, or if a token would have no duration."""
    keys = ["doc", "seg"]
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)

    def laid(rows: DataFrame, *columns: str) -> DataFrame:
        own = rows.withColumn("t", strip_ws(F.col("text"))).select(*keys, "pos", "t", *columns)
        return own.withColumn("a", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0)).cast("long")).withColumn("n", F.length("t").cast("long"))

    units, pieces = laid(words, "s", "e", "confidence", "timing"), laid(tokens.withColumnRenamed("tag", "_tag"), "_tag").where("n > 0")
    spelled = lambda rows, name: rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias(name), F.min("n").alias(f"{name}_least"))
    texts = segments.select(*keys, strip_ws(F.col("text")).alias("target")).join(spelled(units, "heard"), keys).join(spelled(pieces, "read"), keys, "left")
    reason = (
        F.when(F.col("heard_least") == 0, "empty_word").when(F.col("heard") != F.col("target"), "words_differ").when(F.coalesce("read", F.lit("")) != F.col("target"), "tokens_differ").when(F.col("read").isNull(), "no_tokens")
    )
    checked = texts.select(*keys, reason.alias("reason"))

    good = checked.where("reason is null").select(*keys)
    word = F.struct("pos", "a", "n", "s", "e", "confidence", (F.coalesce("timing", F.lit("")) == "interpolated").alias("guess"))
    token = F.struct("pos", "a", "n", F.col("t").alias("text"), F.col("_tag").alias("tag"))
    kind = lambda df, name: df.schema[name].dataType
    left, right = units.select(*keys, "a", word.alias("word")), pieces.select(*keys, "a", token.alias("token"))
    starts = left.withColumn("token", F.lit(None).cast(kind(right, "token"))).unionByName(right.withColumn("word", F.lit(None).cast(kind(left, "word")))).join(good, keys, "left_semi")
    upto = Window.partitionBy(*keys).orderBy("a").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = starts.select(*keys, "a", F.last("word", True).over(upto).alias("word"), F.last("token", True).over(upto).alias("token"))
    conf = F.when(F.count("word.confidence") == F.count(F.lit(1)), F.min("word.confidence"))
    timed = cut.groupBy(*keys, "token").agg(F.min_by("word", "a").alias("first"), F.max_by("word", "a").alias("last"), conf.alias("confidence"))
    t = F.col("token")
    inside = lambda w, at: F.round(w["s"] + (w["e"] - w["s"]) * (at - w["a"]) / w["n"], 6)
    first, last, end = F.col("first"), F.col("last"), t["a"] + t["n"]
    s = F.when(t["a"] == first["a"], first["s"]).otherwise(inside(first, t["a"]))
    e = F.when(end == last["a"] + last["n"], last["e"]).otherwise(inside(last, end))
    sure = (t["a"] == first["a"]) & ~first["guess"] & (end == last["a"] + last["n"]) & ~last["guess"]
    new = timed.select(*keys, t["pos"].alias("pos"), t["text"].alias("text"), s.alias("s"), e.alias("e"), "confidence", F.when(sure, "measured").otherwise("interpolated").alias("timing"), t["tag"].alias("tag"))
    still = new.groupBy(*keys).agg(F.every(F.col("e") > F.col("s")).alias("moves"))
    refused = checked.where("reason is not null").unionByName(still.where("not coalesce(moves, false)").select(*keys, F.lit("no_duration").alias("reason")))
    return new.join(still.where("moves").select(*keys), keys, "left_semi"), refused


def merge_untimed(words: DataFrame) -> DataFrame:
    """(doc, seg, pos, text, s, e, confidence, merged): words (doc, seg, pos, text, s, e, score, language) of which an aligner
    couldn't time some, those without both times as numbers: they join the timed word before, or at the start the next, with
    a space if the language has spaces; no time is made up. Segments without any timed word give none."""
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    w = Window.partitionBy("doc", "seg").orderBy("pos")
    own = words.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))).where("text <> ''").withColumn("timed", real("s") & real("e"))
    g = F.greatest(F.sum(F.col("timed").cast("int")).over(w), F.lit(1))
    grouped = own.withColumn("g", g).groupBy("doc", "seg", "g").agg(
        F.min(F.when(F.col("timed"), F.col("pos"))).alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("w"), F.max(F.when(F.col("timed"), F.col("s"))).alias("s"), F.max(F.when(F.col("timed"), F.col("e"))).alias("e"),
        F.max(F.when(F.col("timed"), F.col("score"))).alias("score"), F.max("language").alias("language"), F.count(F.when(~F.col("timed"), 1)).alias("merged"),
    )
    text = F.array_join(F.transform("w", lambda x: x["text"]), "\0")
    joined = F.when(F.col("language").isin(*ALIGNED_BY_CHARACTER), F.replace(text, F.lit("\0"), F.lit(""))).otherwise(F.replace(text, F.lit("\0"), F.lit(" ")))
    return grouped.where("s is not null").select("doc", "seg", "pos", joined.alias("text"), "s", "e", clip_confidence(F.col("score")).alias("confidence"), "merged")


def hypothesis_tokens(hypotheses: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """(doc, n, text, s, e, id, piece) of the timed entries of hypotheses (doc, json). An entry's text is a string, a list of
    strings, or missing; its times are seconds, or offsets in frames. Ids belong to entries only if there are as many;
    ``pieces`` (id, piece) names them, and a hypothesis with an unknown id gets no pieces. Without a list of entries, or
    with broken JSON, a hypothesis gives no row."""
    v = F.try_parse_json("json")
    got = lambda x, path, kind: F.try_variant_get(x, path, kind)
    rows = hypotheses.select("doc", v.alias("v")).select("doc", got(F.col("v"), "$.timestamp.char", "array<variant>").alias("entries"), got(F.col("v"), "$.y_sequence", "array<long>").alias("ids"))
    flat = rows.select("doc", "ids", F.size("entries").alias("many"), F.posexplode("entries").alias("n", "x"))
    listed = got(F.col("x"), "$.char", "array<string>")
    text = F.when(listed.isNotNull(), F.array_join(listed, "")).otherwise(F.coalesce(got(F.col("x"), "$.char", "string"), F.lit("")))
    seconds = got(F.col("x"), "$.start", "double").isNotNull() & got(F.col("x"), "$.end", "double").isNotNull()
    time = lambda name: F.when(seconds, got(F.col("x"), f"$.{name}", "double")).otherwise(got(F.col("x"), f"$.{name}_offset", "double") * FRAME_SECONDS)
    out = flat.select("doc", F.col("n").cast("long").alias("n"), text.alias("text"), time("start").alias("s"), time("end").alias("e"), F.when(F.size("ids") == F.col("many"), F.get("ids", F.col("n"))).alias("id"))
    if pieces is None:
        return out.withColumn("piece", F.lit(None).cast("string"))
    named = out.join(pieces.select("id", "piece"), "id", "left")
    known = F.every(F.col("piece").isNotNull()).over(Window.partitionBy("doc"))
    return named.select("doc", "n", "text", "s", "e", F.when(known, F.col("id")).alias("id"), F.when(known, F.col("piece")).alias("piece"))


def number_words(words: DataFrame) -> DataFrame:
    return words.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("seg", "pos")).cast("long") - 1)
