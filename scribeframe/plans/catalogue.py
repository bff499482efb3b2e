"""Queries by name and their SQL: each operator over whole driver tables, in both dialects.

``conversations`` are read as transcripts (see sources.conversations); all times are integer milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribeframe.functions import text as T
from scribeframe.operators import alignment, builder, chunking, engines, export, find, intervals, requests, runs, select, speakers, transcripts, validate, vocabulary
from scribeframe.plans.oracle import SQL  # noqa: F401
from scribeframe.sources import conversations as C
from scribeframe.sources import documents, scans
from scribeframe.streaming import follow

PHRASE = "then th"
FUZZY = "thention"


def _words(spark, d) -> DataFrame:
    return C.words(C.load(spark, d))


def _units(spark, d) -> DataFrame:
    return _words(spark, d).withColumn("timed", F.lit(True))


def _segments(spark, d) -> DataFrame:
    return C.segments(_words(spark, d))


def _duration(units: DataFrame) -> DataFrame:
    return units.groupBy("doc").agg((F.max("e") + 2000).alias("duration"))


def words_index(spark, d):
    return _words(spark, d).select("doc", "seg", "pos", "idx", "text", "s", "e")


def segments_view(spark, d):
    return _segments(spark, d).select("doc", "seg", "role", "s", "e", "words", F.length("text").alias("chars"))


def normalize(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("hash"))


def fold_text(spark, d):
    text = T.folded(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.length(text).alias("chars"), F.md5(text).alias("hash"))


def find_exact(spark: SparkSession, d: str) -> DataFrame:
    return find.find(_units(spark, d), PHRASE).select("doc", "hit", "start", "end", "match", "timing", "first_word", "last_word", "seg", "last_seg", "speaker", "text")


def find_summary(spark, d):
    units = _units(spark, d)
    return find.summary(units, find.find(units, PHRASE))


def find_context(spark, d):
    return find.with_context(find.find(_units(spark, d), PHRASE), _segments(spark, d), 1)


def find_fuzzy(spark, d):
    return find.find_fuzzy(_units(spark, d), FUZZY, 0.85)


def speech_events(spark, d, gap=0):
    return intervals.speech_events(_segments(spark, d), gap)


def speech_events_gap(spark, d):
    return speech_events(spark, d, 800)


def _busy(spark, d) -> DataFrame:
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return spark.read.parquet(f"{d}/events.parquet").select("user_id", ms.alias("s"), (ms + 60_000 * (1 + F.col("event_id") % 90)).alias("e"))


def interval_union(spark, d):
    return intervals.union(_busy(spark, d), ["user_id"])


def event_gaps(spark, d):
    out = intervals.gap_groups(_busy(spark, d).withColumn("k", F.col("e")), ["user_id"], ["s", "k"], 3_600_000)
    return out.groupBy("user_id", "g").agg(F.min("s").alias("start"), F.count("*").alias("n"))


def speaker_words(spark, d):
    return speakers.of_words(_words(spark, d), C.turns(_segments(spark, d))).select("doc", "idx", "speaker")


def _attributed(spark, d):
    segments = _segments(spark, d)
    return speakers.merge(_words(spark, d), segments, C.turns(segments))


def speaker_segments(spark, d):
    return _attributed(spark, d)[1].select("doc", "seg", "speaker")


def speaker_counts(spark, d):
    words, segments = _attributed(spark, d)
    return speakers.counts(segments, words)


def speaker_totals(spark, d):
    return speakers.per_speaker(_attributed(spark, d)[1])


def overlap_semi(spark, d):
    segments = _segments(spark, d)
    regions = segments.where("seg % 4 = 1").select("doc", (F.col("e") - 100).alias("s"), (F.col("e") + 900).alias("e"))
    return speakers.in_overlap(segments, regions).select("doc", "seg")


def _remove(spark, d, mode):
    units = _units(spark, d)
    top = units.groupBy("doc").agg(F.max("idx").alias("m"))
    ranges = top.where("m >= 12").select("doc", F.lit(3).cast("long").alias("first"), F.lit(7).cast("long").alias("last")).union(top.where("m >= 12").select("doc", F.lit(10).cast("long"), F.col("m") - 1))
    own = units.join(top.where("m >= 12").select("doc"), "doc", "left_semi")
    return select.select(own, _duration(own), mode, ranges=ranges)


SPAN = ("doc", "id", "start", "end", "lo", "hi", "after_kept", "before_kept", "speech", "units", "first", "last", "most")


def select_remove_words(spark, d):
    return _remove(spark, d, "remove")["spans"].select(*SPAN)


def select_sentences(spark, d):
    return _remove(spark, d, "remove")["sentences"]


def select_index_runs(spark, d):
    return _remove(spark, d, "keep")["ranges"]


def select_keep_segments(spark, d):
    units = _units(spark, d)
    chosen = units.where("seg % 3 = 1").select("doc", "seg").distinct()
    own = units.join(chosen.select("doc").distinct(), "doc", "left_semi")
    return select.select(own, _duration(own), "keep", segments=chosen)["spans"].select(*SPAN)


def _flawed(spark, d) -> DataFrame:
    """Segments of which some have been spoilt: shifted back, turned around, or given another's id."""
    base = _segments(spark, d)
    s = F.when(F.col("seg") % 5 == 3, F.col("s") - 4000).otherwise(F.col("s"))
    e = F.when(F.col("seg") % 7 == 4, F.col("s") - 10).otherwise(F.col("e"))
    n = F.when(F.col("seg") % 6 == 5, F.col("seg") - 1).otherwise(F.col("seg"))
    return base.select("doc", "seg", F.format_string("seg_%04d", n).alias("id"), s.alias("s"), e.alias("e"), "text", F.lit(60_000).cast("long").alias("duration"))


def validate_segments(spark, d):
    return validate.segment_rules(_flawed(spark, d), 1000)


def validate_words(spark, d):
    return validate.word_rules(_words(spark, d), _flawed(spark, d), 1000)


def leakage_scan(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), F.lit("note").alias("key"), F.col("text").alias("value"))
    return validate.leaks(docs).select("doc", "reason")


def required_keys(spark, d):
    """Documents of one segment and one word each, some without a key here and there."""
    turn, none = F.col("turn"), F.lit(None).cast("string")
    some = lambda bad, x: F.when(~bad, x)
    zero, text = F.lit(0.5), F.lit("x")
    word = F.struct(zero.alias("start"), zero.alias("end"), text.alias("text"), some(turn % 4 == 1, zero).alias("confidence"))
    segment = F.struct(*[x.alias(k) for k, x in (("id", text), ("start", zero), ("end", zero), ("text", text), ("raw_text", text), ("confidence", zero), ("words", some(turn % 3 == 0, F.array(word))), ("speaker_id", text))])
    source = F.struct(text.alias("filename"), some(turn % 5 == 2, text).alias("fingerprint"), F.lit(1).alias("size_bytes"), zero.alias("media_duration"))
    doc = F.struct(text.alias("schema"), text.alias("id"), zero.alias("duration"), F.array(segment).alias("segments"), source.alias("source"), some(turn % 2 == 1, F.array(text)).alias("warnings"), none.alias("language"))
    return validate.required_keys(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc"), F.to_json(doc).alias("json")))


def provenance_rules(spark, d):
    n, digest = F.col("doc_id"), F.lit("0123456789abcdef" * 4)
    wrong = lambda by, at, good, bad: F.when(n % by == at, bad).otherwise(good)
    docs = spark.read.parquet(f"{d}/documents.parquet").select(
        n.alias("doc"), F.lit("fast").alias("engine"), F.lit("1").alias("engine_version"), F.lit("fast").alias("p_engine"), wrong(3, 0, F.lit("1"), F.lit("2")).alias("p_engine_version"), wrong(4, 1, F.lit("local"), F.lit("cloud")).alias("p_execution_mode"),
        wrong(5, 2, digest, F.lit("0123")).alias("p_parameters_hash"), digest.alias("p_cache_key"), wrong(7, 3, F.lit(1.5), F.lit(-1.0)).alias("p_processing_seconds"), F.lit("s").alias("p_skill"), F.lit("1").alias("p_skill_version"),
        wrong(6, 5, F.lit("transcription/find"), F.lit("find")).alias("p_tool"), wrong(11, 4, F.lit("m"), F.lit("")).alias("p_model"), wrong(8, 6, F.lit("{}"), F.lit("[1]")).alias("p_parameters"),
    )
    return validate.provenance_rules(docs)


def turn_rules(spark, d):
    n = F.col("doc_id")
    s = (n % 10 * 10).cast("double")
    speaker = F.when(n % 13 == 0, "Bob").otherwise(F.concat(F.lit("SPEAKER_0"), (n % 3).cast("string")))
    return scans.turn_rules(spark.read.parquet(f"{d}/documents.parquet").select(F.expr("doc_id div 10").alias("doc"), n.alias("n"), s.alias("s"), (s + n * 7 % 13 - 1).alias("e"), speaker.alias("speaker")))


def chunk_rules(spark, d):
    n = F.col("o_orderkey")
    asked = spark.read.parquet(f"{d}/orders.parquet").select(n.alias("req"), F.when(n % 3 > 0, (n % 4000).cast("double")).alias("chunk_seconds"), (n % 10).cast("int").alias("parallel"), F.when(n % 5 > 0, "en").alias("language"), (n % 7 == 0).alias("regions"))
    return runs.chunk_rules(asked)


def _run_chunks(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("chunk"), (F.col("l_returnflag") == "R").alias("from_cache"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber") / 8).alias("engine_seconds"))


def chunk_totals(spark, d):
    return runs.chunk_totals(_run_chunks(spark, d))


def chunk_languages(spark, d):
    return runs.languages(spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") % 60).alias("doc"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")).when(F.col("doc_id") % 60 > 20, "en").alias("language")))


def _export(form):
    def query(spark, d):
        return export.render(_segments(spark, d), form).select("doc", F.md5("content").alias("hash"), F.length("content").alias("chars"))

    return query


def term_counts(spark, d):
    found = vocabulary.term_counts(vocabulary.tokens(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")))
    return found.select("doc", "key", "term", "kind", "n")


def terms(spark, d):
    return vocabulary.terms(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), "text"))


def prompts(spark, d):
    return vocabulary.prompts(terms(spark, d))


RULES = [("the", "le", "word"), ("tion", "ción", "substring"), ("and the", "et le", "word")]


def corrections(spark, d):
    found = vocabulary.corrected(_segments(spark, d).select("doc", "seg", "text"), RULES)
    return found.select("doc", "seg", F.size("applied").alias("n"), F.md5("corrected").alias("hash"))


def corrections_substring(spark, d):
    found = vocabulary.corrected(_segments(spark, d).select("doc", "seg", "text"), RULES[1:2])
    return found.select("doc", "seg", F.size("applied").alias("n"), F.md5("corrected").alias("hash"))


CROSSING = [("e th", "e-t", "substring"), ("tion", "ción", "substring"), ("n a", "n-a", "substring")]


def _judged(idx):
    """A word's confidence, which some don't have, and the kind of its time, estimated here and there."""
    conf = F.when(idx % 13 != 0, (idx % 10) / 10)
    return conf.alias("confidence"), F.when(idx % 5 == 0, "interpolated").otherwise("measured").alias("timing")


def _judged_words(spark, d) -> DataFrame:
    return _words(spark, d).select("doc", "seg", "pos", "idx", "text", "s", "e", *_judged(F.col("idx")))


def _corrected(spark, d):
    words = F.transform("words", lambda x: F.struct(*[x[k].alias(k) for k in ("pos", "text", "s", "e")], *_judged(x["idx"])))
    return vocabulary.corrected_lists(C.lists(C.load(spark, d)).withColumn("words", words), CROSSING)


def corrected_words(spark, d):
    """Words after corrections that reach over white space, with their new times."""
    return _corrected(spark, d).words.select("doc", "seg", "pos", "text", "s", "e", F.round(F.col("confidence") * 10).cast("long").alias("confidence"), "timing")


def corrections_applied(spark, d):
    return _corrected(spark, d).applied.select("doc", "seg", "k", "rule", "from", "to", "s", "e", "timing")


def _dictionary(spark, d):
    """Every four characters of a segment are a token; some segments lack their last one, in some words have no duration."""
    words = _judged_words(spark, d).withColumns({"s": F.col("s") / 1000, "e": F.when(F.col("seg") % 11 == 5, F.col("s")).otherwise(F.col("e")) / 1000})
    segments = _segments(spark, d).select("doc", "seg", "text")
    cut = F.regexp_extract_all(T.strip_ws(F.col("text")), F.lit(".{1,4}"), F.lit(0))
    tokens = segments.withColumn("l", cut).withColumn("l", F.when((F.col("seg") % 7 == 3) & (F.size("l") > 0), F.slice("l", F.lit(1), F.size("l") - 1)).otherwise(F.col("l")))
    rows = tokens.select("doc", "seg", F.posexplode("l").alias("pos", "text")).withColumn("tag", F.when(F.col("pos") % 2 == 0, "noun").otherwise("other"))
    return builder.dictionary_words(segments, words, rows)


def dictionary_words(spark, d):
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    return _dictionary(spark, d)[0].select("doc", "seg", "pos", "text", micro("s").alias("s"), micro("e").alias("e"), F.round(F.col("confidence") * 10).cast("long").alias("confidence"), "timing", "tag")


def dictionary_refused(spark, d):
    return _dictionary(spark, d)[1]


def untimed_words(spark, d):
    """Every fourth word without times, and whole segments; a third of the transcripts in a language without spaces."""
    words = _words(spark, d)
    lost = (F.col("idx") % 4 == 1) | (F.col("seg") % 5 == 2)
    rows = words.select("doc", "seg", "pos", "text", F.when(~lost, F.col("s") / 1000).alias("s"), F.when(F.col("idx") % 8 != 3, F.col("e") / 1000).otherwise(float("nan")).alias("e"), (F.col("idx") % 7 / 4 - 0.25).alias("score"), F.when(F.col("doc") % 3 == 0, "ja").otherwise("en").alias("language"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return builder.merge_untimed(rows).select("doc", "seg", "pos", "text", ms("s").alias("s"), ms("e").alias("e"), F.round(F.col("confidence") * 100).cast("long").alias("confidence"), "merged")


def hypothesis_tokens(spark, d):
    """Words as entries of three shapes; some hypotheses lack times or an id."""
    words = _words(spark, d)
    kind, n = F.col("idx") % 3, F.col("idx")
    seconds, offsets = [(F.col("s") / 1000).alias("start"), (F.col("e") / 1000).alias("end")], [n.alias("start_offset"), (n + 2).alias("end_offset")]
    entry = F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("char"), *seconds))).when(kind == 1, F.to_json(F.struct(F.array(F.substring("text", 1, 1), F.expr("substring(text, 2)")).alias("char"), *offsets))).otherwise(F.to_json(F.struct(*offsets)))
    lists = words.select("doc", "idx", entry.alias("x")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("l"))
    entries = F.array_join(F.transform("l", lambda x: x["x"]), ",")
    ids = F.array_join(F.transform(F.when(F.col("doc") % 5 == 3, F.slice("l", F.lit(2), F.size("l"))).otherwise(F.col("l")), lambda x: (x["idx"] * 7 + 1).cast("string")), ",")
    json = F.when(F.col("doc") % 5 == 4, F.lit('{"timestamp": null}')).when(F.col("doc") % 7 == 6, F.lit("{broken")).otherwise(F.concat(F.lit('{"timestamp":{"char":['), entries, F.lit(']},"y_sequence":['), ids, F.lit("]}")))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return builder.hypothesis_tokens(lists.select("doc", json.alias("json"))).select("doc", "n", "text", ms("s").alias("s"), ms("e").alias("e"), "id")


def _requests(spark, d) -> DataFrame:
    """A request for each document, some of them with a broken rule."""
    n = F.col("doc_id")
    some = lambda by, at, x: F.when(n % by == at, x)
    fields = {
        "cmd": some(29, 6, F.lit("ls")), "input": F.when(n % 17 == 3, F.lit(" ")).otherwise(F.concat(F.lit("talk_"), n.cast("string"), F.lit(".wav"))), "language": F.when(n % 19 == 4, "english").when(n % 6 > 0, F.col("lang")), "temperature": F.when(n % 23 == 5, 1.5).otherwise(n % 10 / 10),
        "beam_size": (n % 12).cast("int"), "chunk_seconds": some(5, 0, (30 + n % 40).cast("double")), "initial_prompt": some(7, 1, F.substring("text", 1, 60)), "budget": some(13, 2, F.struct(F.lit(50).alias("max_audio_seconds"))),
    }
    return spark.read.parquet(f"{d}/documents.parquet").select(n.alias("req"), F.to_json(F.struct(*[x.alias(k) for k, x in fields.items()])).alias("json"))


def request_rules(spark, d):
    return requests.first_broken(_requests(spark, d))


def request_parameters(spark, d):
    return requests.normalised(_requests(spark, d)).select("req", "input", "language", "parameters_hash")


def dry_run(spark, d):
    """A third of the results are there already; some recordings are missing or too long."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.lit("talk_"), F.col("doc_id").cast("string"), F.lit(".wav"))
    media = docs.where("doc_id % 11 > 0").select(name.alias("input"), F.concat(F.lit("sha256:"), F.col("doc_id").cast("string")).alias("fingerprint"), (F.col("n_chars") / 100).alias("duration"))
    specs = spark.createDataFrame([(requests.ENGINE, "1.2", "local")], "engine string, version string, mode string")
    asked = _requests(spark, d)
    done = requests.normalised(asked.where("req % 3 = 0")).join(media, "input").select(requests.identity(F.col("fingerprint"), F.col("engine"), F.lit("1.2"), F.lit("local"), F.col("model"), F.lit(None).cast("string"), F.col("parameters")).alias("key"))
    return requests.dry_run(asked, media, specs, done)


def _built(spark, d) -> DataFrame:
    """Whole transcripts of conversations: some segments without a duration, some with words outside of them."""
    doc, digest = F.col("doc"), F.lit("0123456789abcdef" * 4)
    segments = _segments(spark, d)
    fields = {
        "id": F.concat(F.lit("tr_"), doc.cast("string")), "filename": F.lit("talk.wav"), "fingerprint": F.concat(F.lit("sha256:"), digest), "size_bytes": F.lit(1000), "audio_channels": F.lit(1), "sample_rate": F.lit(16000), "container": F.lit("wav"), "has_video": F.lit(False), "engine": F.lit("fast-local"),
        "engine_version": F.lit("1"), "mode": F.lit("local"), "model": F.lit("tiny"), "model_version": F.lit(None).cast("string"), "parameters": F.lit('{"beam_size": 5}'), "parameters_hash": digest, "cache_key": digest, "created_at": F.lit("2026-01-01T00:00:00Z"), "processing_seconds": F.lit(1.5), "skill_version": F.lit("1"),
        "requested": F.when(doc % 3 > 0, "en"), "detected": F.lit("en"), "probability": F.when(doc % 2 == 1, 0.75).otherwise(0.25), "warnings": F.array().cast("array<string>"),
    }
    recordings = segments.groupBy("doc").agg((F.max("e") / 1000).alias("duration")).select("doc", "duration", *[x.alias(k) for k, x in fields.items()])
    raw = segments.select("doc", F.col("seg").alias("n"), (F.col("s") / 1000).alias("s"), F.when(F.col("seg") % 4 == 2, F.col("s")).otherwise(F.col("e")).alias("e"), F.concat(F.lit(" "), "text").alias("text"), F.lit(0.5).alias("confidence")).withColumn("e", F.col("e") / 1000)
    away = F.when(F.col("seg") % 5 == 3, 500).otherwise(0)
    words = _words(spark, d).select("doc", F.col("seg").alias("n"), "pos", (F.col("s") / 1000 + away).alias("s"), (F.col("e") / 1000 + away).alias("e"), "text", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("timing"))
    return transcripts.documents(recordings, raw, words)


def transcripts_built(spark, d):
    """What whole transcripts hold, read back from their JSON."""
    read = _built(spark, d).withColumn("t", F.from_json("json", documents.TRANSCRIPT))
    words = F.aggregate("t.segments", F.lit(0), lambda n, x: n + F.coalesce(F.size(x["words"]), F.lit(0)))
    return read.select("doc", F.size("t.segments").cast("long").alias("segments"), words.cast("long").alias("words"), F.array_join("t.warnings", "|").alias("warnings"), F.md5(F.array_join(F.transform("t.segments", lambda x: x["text"]), "|")).alias("hash"), F.col("t.language_source").alias("language_source"))


def segment_builder(spark, d):
    out = builder.build_segments(_words(spark, d), 90)
    return out.groupBy("doc", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("words"))


def token_groups(spark, d):
    """Words as tokens, of which half have no duration and some are commas."""
    zero, comma = F.col("idx") % 4, F.col("idx") % 11
    rows = _words(spark, d).select("doc", F.col("idx").alias("n"), "s", F.when(zero.isin(1, 2), F.col("s")).otherwise(F.col("e")).alias("e"), F.when((zero == 2) | (comma == 1), F.lit(",")).otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("piece"))
    return alignment.token_groups(rows, ("doc",), 80).withColumns({"s": F.col("s").cast("long"), "e": F.col("e").cast("long")})


def aligned_words(spark, d):
    """Segments as chunks, their words as an aligner's items of which every fifth time was repaired."""
    words = _words(spark, d).withColumn("t", F.regexp_replace("text", r"[^\p{L}\p{N}']", "")).where("t <> ''")
    item = F.struct("pos", F.col("t").alias("text"), ((F.col("s") - F.col("seg") * 1000) / 1000).alias("s"), ((F.col("e") - F.col("seg") * 1000) / 1000).alias("e"), (F.col("idx") % 5 != 0).alias("own_s"), (F.col("idx") % 5 != 3).alias("own_e"))
    items = words.groupBy("doc", "seg").agg(F.array_sort(F.collect_list(item)).alias("items"))
    chunks = _segments(spark, d).join(items, ["doc", "seg"]).select("doc", F.col("seg").cast("long").alias("chunk"), "text", F.lit(86_400.0).alias("duration"), "items")
    return alignment.aligned_words(chunks)


def clamp_clean(spark, d):
    raw = _segments(spark, d).select("doc", F.col("seg").alias("n"), (F.col("s") / 1000).alias("s"), F.when(F.col("seg") % 4 == 2, F.col("s") / 1000).otherwise(F.col("e") / 1000).alias("e"), F.concat(F.lit("  "), "text", F.lit(" \t")).alias("text"), F.lit(15.0).alias("duration"))
    out = builder.clean_segments(raw)
    return out.select("doc", "n", "id", F.bround(F.col("s") * 1000, 0).cast("long").alias("s"), F.bround(F.col("e") * 1000, 0).cast("long").alias("e"), F.length("text").alias("chars"))


def language_decision(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    language, source = builder.language_decision(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 5 != 0, F.col("lang")), (F.col("doc_id") % 10) / 10)
    return docs.select("doc_id", language.alias("language"), source.alias("source"))


def _requirements(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("req"), F.when(F.col("doc_id") % 7 == 0, "fast-local").alias("engine"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("language"), (F.col("doc_id") % 2 == 0).alias("offline"), (F.col("doc_id") % 3 == 0).alias("needs_words"), (F.col("doc_id") % 5 == 0).alias("needs_vocabulary"))


def engine_filter(spark, d):
    return engines.rejected(_requirements(spark, d), engines.engines(spark))


def _chunks(spark, d) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("chunk"), (F.col("o_orderkey") * 30_000).alias("s"), (F.col("o_orderkey") * 30_000 + 30_000).alias("e"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("key"))


def cache_antijoin(spark, d):
    done = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag = 'R'").select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("key"))
    return chunking.work_list(_chunks(spark, d), done).select("doc", "chunk")


def chunk_join(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_linenumber") * 6000 - 7000).cast("long").alias("s"), (F.col("l_linenumber") * 6000 + F.col("l_suppkey") % 50 * 100).cast("long").alias("e"), F.col("l_shipdate").cast("string").alias("text"))
    chunks = _chunks(spark, d)
    return chunking.join_chunks(chunks, items.join(chunks.select("doc", "chunk"), "chunk")).select("doc", "chunk", "n", "s", "e")


def quiet_window(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), (F.col("l_partkey") * 17 % 1009).alias("energy"))
    framed = rows.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("k", "energy")).cast("long") - 1).alias("frame"), "energy", F.lit(50).cast("long").alias("target"))
    return chunking.quietest(framed, ["path"], "target")


def cer(spark, d):
    a = spark.read.parquet(f"{d}/benchmark.parquet")
    guess = F.regexp_replace(F.col("text"), "tion", "sion")
    rate = T.character_error_rate(F.col("text"), guess)
    return a.select("item_id", F.bround(rate * 1_000_000, 0).cast("long").alias("cer"))


def wer(spark, d):
    a = spark.read.parquet(f"{d}/benchmark.parquet")
    return a.select("item_id", F.bround(T.word_error_rate(F.col("text"), F.regexp_replace("text", "tion", "sion")) * 1_000_000, 0).cast("long").alias("wer"))


def batch_outcomes(spark, d):
    items = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("item"))
    results = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("item")).agg(F.max(F.when(F.col("l_linenumber") < 6, F.col("l_partkey"))).alias("result"), F.max(F.when(F.col("l_returnflag") == "R", F.lit("TIMEOUT"))).alias("error"))
    return engines.outcomes(items, results)


def _rounds(spark, d) -> DataFrame:
    """Rounds that have heard a transcript's first r + 1 segments, each once more 0.7 s later; the last of them ends the
    recording."""
    base = _segments(spark, d).select("doc", "seg", "s", "e", "text")
    order = Window.partitionBy("doc").orderBy("seg")
    ranked = base.withColumn("k", F.row_number().over(order) - 1).withColumn("m", F.count("*").over(Window.partitionBy("doc")) - 1)
    ends = ranked.select("doc", F.col("k").alias("r"), "m", F.col("e").alias("heard"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    heard = ends.join(ranked.drop("m"), "doc").where("k <= r")
    return heard.select("doc", (F.col("r") * 2 + F.col("half")).alias("round"), (F.col("heard") + F.col("half") * 700).alias("audio_end"), "seg", "s", "e", "text", ((F.col("r") == F.col("m")) & (F.col("half") == 1)).alias("last"))


def follow_events(spark, d):
    """All events of followed transcripts: finals, partials, ends."""
    out = follow.replay(_rounds(spark, d))
    ms = lambda x: F.round(x * 1000).cast("long")
    texts = F.array_join(F.transform("segments", lambda x: x["text"]), " ")
    committed = F.when(F.col("type") != "final", F.round(F.col("committed") * 16000).cast("long"))
    return out.select("doc", "event", "type", F.size("segments").cast("long").alias("segments"), F.get("segments", 0)["id"].alias("first"), ms(F.get("segments", 0)["start"]).alias("start"), ms(F.try_element_at("segments", F.lit(-1))["end"]).alias("end"), F.md5(texts).alias("hash"), committed.alias("committed"))


def follow_replay(spark, d):
    return follow.finals(follow.replay(_rounds(spark, d))).select("doc", "n", "s", "e", F.md5("text").alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        words_index, segments_view, normalize, fold_text, find_exact, find_summary, find_context, find_fuzzy, speech_events, speech_events_gap,
        interval_union, event_gaps, speaker_words, speaker_segments, speaker_counts, speaker_totals, overlap_semi, select_remove_words, select_sentences,
        select_index_runs, select_keep_segments, validate_segments, validate_words, required_keys, provenance_rules, turn_rules, chunk_rules, chunk_totals, chunk_languages, leakage_scan, term_counts, terms, prompts, corrections,
        corrections_substring, segment_builder, token_groups, aligned_words, clamp_clean, language_decision, engine_filter, cache_antijoin, chunk_join, quiet_window, cer, wer,
        batch_outcomes, follow_replay, follow_events,
        corrected_words, corrections_applied, dictionary_words, dictionary_refused, untimed_words, hypothesis_tokens, request_rules, request_parameters, dry_run, transcripts_built,
    )
} | {f"export_{k}": _export(k) for k in ("srt", "vtt", "tsv", "txt", "json")}
