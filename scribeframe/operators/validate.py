"""Validation of transcripts as queries that return violations, and the scan for leaked data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the document contract (seconds and patterns).
END_TOLERANCE, CONTAINMENT = 0.5, 0.01
LANGUAGE = r"^([a-z]{2,3}|unknown)$"
FINGERPRINT = r"^sha256:[0-9a-f]{64}$"
HASH = r"^[0-9a-f]{64}$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
MODES = ("local", "remote")
REQUIRED = {
    "document": ("schema", "id", "asset_id", "language", "language_source", "language_confidence", "duration", "segments", "source", "engine", "engine_version", "created_at", "provenance", "warnings"),
    "segment": ("id", "start", "end", "text", "raw_text", "confidence", "words", "speaker_id"),
    "word": ("start", "end", "text", "confidence"),
    "source": ("filename", "fingerprint", "size_bytes", "media_duration"),
    "provenance": ("engine", "engine_version", "execution_mode", "model", "model_version", "parameters", "parameters_hash", "cache_key", "created_at", "processing_seconds", "skill_version", "skill", "tool"),
}
# Keys that no document may have; values that look like credentials, commands and absolute paths; fields of
# spoken text, which may sound like a command or a path.
FORBIDDEN_KEYS = ("command", "argv", "cmd", "shell", "api_key", "apikey", "token", "secret", "password", "authorization", "access_key", "secret_key", "credential", "credentials")
CREDENTIALS = (
    r"\bsk-[A-Za-z0-9_\-]{16,}", r"\bsk-ant-[A-Za-z0-9_\-]{16,}", r"\bAKIA[0-9A-Z]{16}\b", r"\bhf_[A-Za-z0-9]{20,}", r"\bBearer\s+[A-Za-z0-9._\-]{16,}",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"\b[A-Z_]*(API_KEY|SECRET|TOKEN|PASSWORD)[A-Z_]*=\S+",
)
COMMANDS = (r"^\s*(ffmpeg|ffprobe|whisper|whisper-cli|whisper-cpp|python3?|sh|bash|cmd\.exe|powershell)\b\s+-", r"\$\(|`[^`]+`|\|\s*(sh|bash)\b")
PATHS = (r"^(/|~/)[^\s]+/[^\s]*", r"^[A-Za-z]:\\[^\s]+")
SPOKEN = ("text", "raw_text")


def _violations(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row for each rule that a row breaks."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return rows.select(*keys, F.explode(found).alias("rule"))


def document_rules(docs: DataFrame) -> DataFrame:
    """docs: one row a transcript with the contract's fields flattened."""
    c = F.col
    return _violations(
        docs,
        {
            "schema": c("schema") != "transcript/0.1", "id": c("id").isNull() | (c("id") == ""), "language": ~c("language").rlike(LANGUAGE),
            "language_source": ~c("language_source").isin("requested", "detected", "unknown") | ((c("language") == "unknown") != (c("language_source") == "unknown")),
            "requested_confidence": (c("language_source") == "requested") & c("language_confidence").isNotNull(),
            "duration": ~(c("duration") > 0) | F.isnan("duration"), "media_duration": F.abs(c("duration") - c("media_duration")) > 1e-6,
            "fingerprint": ~c("fingerprint").rlike(FINGERPRINT), "created_at": ~c("created_at").rlike(TIMESTAMP),
            "filename": c("filename").rlike(r"[/\\]"), "size": c("size_bytes") < 0, "cache_key": ~c("cache_key").rlike(HASH), "seconds": c("processing_seconds") < 0,
        },
        ["doc"],
    )


def well_formed(rows: DataFrame) -> Column:
    return F.col("s").isNotNull() & F.col("e").isNotNull() & ~F.isnan(F.col("s").cast("double")) & ~F.isnan(F.col("e").cast("double")) & (F.col("s") >= 0) & (F.col("e") > F.col("s"))


def segment_rules(segments: DataFrame, unit: float = 1.0) -> DataFrame:
    """(doc, seg, rule). ``unit``: how many time units a second has. The row before is the last well-formed one."""
    w = Window.partitionBy("doc").orderBy("seg")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("_ok", well_formed(segments))
    rows = rows.withColumn("_s", F.last(F.when(F.col("_ok"), F.col("s")), True).over(before)).withColumn("_e", F.last(F.when(F.col("_ok"), F.col("e")), True).over(before))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("doc", "id")))
    return _violations(
        rows,
        {
            "times": ~F.col("_ok"), "end": F.col("_ok") & (F.col("e") > F.col("duration") + END_TOLERANCE * unit), "order": F.col("_ok") & (F.col("s") < F.col("_s")),
            "overlap": F.col("_ok") & (F.col("s") < F.col("_e") - CONTAINMENT * unit), "duplicate_id": F.col("_n") > 1, "text": F.col("text").isNull(),
        },
        ["doc", "seg"],
    )


def word_rules(words: DataFrame, segments: DataFrame, unit: float = 1.0) -> DataFrame:
    """(doc, seg, pos, rule): finite times, containment in the segment, order within it."""
    ends = segments.select("doc", "seg", F.col("s").alias("_s"), F.col("e").alias("_e"))
    rows = words.join(ends, ["doc", "seg"]).withColumn("_before", F.lag("e").over(Window.partitionBy("doc", "seg").orderBy("pos")))
    return _violations(
        rows,
        {
            "times": ~well_formed(rows), "outside": (F.col("s") < F.col("_s") - CONTAINMENT * unit) | (F.col("e") > F.col("_e") + CONTAINMENT * unit),
            "overlap": F.col("s") < F.col("_before") - CONTAINMENT * unit, "text": F.trim(F.coalesce("text", F.lit(""))) == "",
        },
        ["doc", "seg", "pos"],
    )


def index_rules(words: DataFrame) -> DataFrame:
    """(doc, rule): numbers on some words only, or not 0..N-1 in order."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("seg", "pos")) - 1
    rows = words.withColumn("_place", place)
    per = rows.groupBy("doc").agg(F.count("idx").alias("_i"), F.count("*").alias("_n"), F.some(F.col("idx") != F.col("_place")).alias("_bad"))
    return _violations(per, {"index_partial": (F.col("_i") > 0) & (F.col("_i") < F.col("_n")), "index_order": F.col("_bad")}, ["doc"])


def report(violations: list[DataFrame], docs: DataFrame) -> DataFrame:
    """(doc, ok, errors, rules) from violation tables."""
    every = reduce(lambda a, b: a.unionByName(b), [v.select("doc", "rule") for v in violations])
    bad = every.groupBy("doc").agg(F.count("*").alias("errors"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    return docs.select("doc").distinct().join(bad, "doc", "left").select("doc", F.col("errors").isNull().alias("ok"), F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.coalesce("rules", F.lit("")).alias("rules"))


def required_keys(docs: DataFrame, column: str = "json") -> DataFrame:
    """(doc, place, key) of keys that JSON documents lack: in the document itself, its source and provenance, its segments
    (place ``segments[3]``) and their words. A key with a null value is there."""
    raw = docs.select("doc", F.col(column).alias("_j"))
    inside = lambda rows, key, name: rows.select("doc", F.concat("_p", F.lit(name)).alias("_p"), F.posexplode(F.from_json(F.get_json_object("_j", f"$.{key}"), "array<string>")).alias("_i", "_j")).select("doc", F.format_string("%s[%d]", "_p", "_i").alias("_p"), "_j")
    top = raw.withColumn("_p", F.lit(""))
    segments = inside(top, "segments", "segments")
    found = {"document": raw.select("doc", F.lit("document").alias("_p"), "_j"), "segment": segments, "word": inside(segments, "words", ".words")}
    found |= {k: raw.select("doc", F.lit(k).alias("_p"), F.get_json_object("_j", f"$.{k}").alias("_j")).where("_j is not null") for k in ("source", "provenance")}
    lack = lambda rows, kind: rows.select("doc", F.col("_p").alias("place"), F.explode(F.array_except(F.array(*map(F.lit, REQUIRED[kind])), F.coalesce(F.json_object_keys("_j"), F.array().cast("array<string>")))).alias("key"))
    return reduce(lambda a, b: a.union(b), [lack(rows, kind) for kind, rows in found.items()])


def provenance_rules(docs: DataFrame) -> DataFrame:
    """(doc, rule) of transcripts with the provenance's fields as ``p_`` columns beside the document's own engine."""
    c = F.col
    empty = lambda name: c(name).isNull() | (c(name) == "")
    no_object = F.coalesce(~c("p_parameters").rlike(r"^\s*\{") | F.json_object_keys("p_parameters").isNull(), F.lit(True))
    return _violations(
        docs,
        {
            "engine": ~(c("p_engine").eqNullSafe(c("engine")) & c("p_engine_version").eqNullSafe(c("engine_version"))), "execution_mode": c("p_execution_mode").isNull() | ~c("p_execution_mode").isin(*MODES),
            "parameters_hash": c("p_parameters_hash").isNull() | ~c("p_parameters_hash").rlike(HASH), "cache_key": c("p_cache_key").isNull() | ~c("p_cache_key").rlike(HASH),
            "processing_seconds": c("p_processing_seconds").isNull() | (c("p_processing_seconds") < 0) | F.isnan("p_processing_seconds"), "skill": empty("p_skill"), "tool": empty("p_tool") | ~c("p_tool").startswith("transcription/"),
            "skill_version": empty("p_skill_version"), "model": empty("p_model"), "parameters": no_object,
        },
        ["doc"],
    )


def leaks(strings: DataFrame) -> DataFrame:
    """(doc, key, reason) of (doc, key, value) rows: a forbidden key, and of a value the first of: a credential, and
    outside spoken text a command or an absolute path."""
    value = F.coalesce("value", F.lit(""))
    secret, command, path = (reduce(lambda a, b: a | b, [value.rlike(p) for p in group]) for group in (CREDENTIALS, COMMANDS, PATHS))
    spoken = F.coalesce(F.col("key").isin(*SPOKEN), F.lit(False))
    of_value = F.when(secret, "secret").when(~spoken & command, "command").when(~spoken & path, "path")
    reasons = F.array_compact(F.array(F.when(F.lower("key").isin(*FORBIDDEN_KEYS), "key"), of_value))
    return strings.select("doc", "key", F.explode(reasons).alias("reason"))


def json_strings(docs: DataFrame, column: str = "json") -> DataFrame:
    """(doc, key, value) of all strings in JSON documents, at any depth."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="key string, value string")
    class Strings:
        def eval(self, raw: str):
            import json

            todo = [("", json.loads(raw))] if raw else []
            while todo:
                key, x = todo.pop()
                if isinstance(x, dict):
                    for k, v in x.items():
                        todo.append((k, v))
                        if not isinstance(v, str):
                            yield k, None
                elif isinstance(x, list):
                    todo += [(key, v) for v in x]
                elif isinstance(x, str):
                    yield key, x

    return docs.lateralJoin(Strings(F.col(column).outer())).select("doc", "key", "value")
