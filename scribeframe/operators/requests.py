"""Recognition requests as a table: the first rule that each breaks, its parameters in canonical form, and a dry run.

A request is a JSON text, read as a VARIANT; every rule is an expression over it, in the contract's order. Canonical JSON
(sorted keys at any depth, ``", "`` and ``": "``, no escapes of other scripts, numbers as Python writes them) is put together by
built-in functions, so that its hash is the same wherever it is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeframe.functions.text import casefold
from scribeframe.operators.runs import CHUNK_SECONDS, MOST_PARALLEL, clean_term
from scribeframe.operators.validate import CREDENTIALS
from scribeframe.sources import scans

# Fixed values of the contract: keys, limits, defaults.
KEYS = (
    "input", "language", "engine", "model", "word_timestamps", "temperature", "initial_prompt", "beam_size", "audio_stream", "asset_id", "budget", "cache", "workspace", "offline", "allowed_input_roots", "vad_filter", "vocabulary",
    "word_segmentation", "chunk_seconds", "parallel", "speech_regions", "domain_vocabulary", "corrections",
)
REFUSED_KEYS = ("command", "argv", "cmd", "shell", "exec", "args", "script", "binary", "api_key", "apikey", "token", "secret", "password", "credentials", "env")
DOMAIN_KEYS, BUDGET_KEYS = ("programme", "slides", "speakers", "terms", "max_terms", "japanese"), ("timeout", "max_audio_seconds")
MOST_PROMPT, MOST_ASSET, MOST_WORDS, MOST_READINGS, MOST_WORD, MOST_RULES, MOST_ITEMS, MOST_TERMS, MOST_MATERIAL = 500, 128, 500, 20, 100, 500, 2000, 200, 200_000
ENGINE, MODEL, HOURS = "faster_whisper", "base", 4 * 3600.0
WHITE = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def at(x: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(x, path, kind)


def kind(x: Column) -> Column:
    """text, flag, whole, real, list, object, null; null where there is nothing."""
    t = F.schema_of_variant(x)
    named = F.when(t == "STRING", "text").when(t == "BOOLEAN", "flag").when(t == "BIGINT", "whole").when(t == "VOID", "null").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object")
    return F.when(x.isNotNull(), named.when(t.isin("DOUBLE", "FLOAT") | t.startswith("DECIMAL"), "real").otherwise("other"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, WHITE, "")


def secret(x: Column) -> Column:
    return any_of([x.rlike(p) for p in CREDENTIALS])


def texts_or_text(x: Column, most: int = MOST_ITEMS) -> Column:
    """Whether a value is missing, a text, or a list of at most so many texts."""
    items = at(x, "$", "array<variant>")
    return x.isNull() | kind(x).isin("null", "text") | ((kind(x) == "list") & (F.size(items) <= most) & F.forall(items, lambda v: kind(v) == "text"))


def texts(x: Column) -> Column:
    return F.when(kind(x) == "text", F.array(at(x, "$", "string"))).when(kind(x) == "list", at(x, "$", "array<string>")).otherwise(F.array().cast("array<string>"))


def correction_rules(x: Column) -> Column:
    """The rules of a list or of an object, as (from, to, match, keys) of variants."""
    pairs = F.transform(F.map_entries(at(x, "$", "map<string,variant>")), lambda e: F.struct(F.parse_json(F.to_json(F.array(e["key"]))).alias("f"), e["value"].alias("t"), F.lit(None).cast("variant").alias("m"), F.array().cast("array<string>").alias("keys"), F.lit("object").alias("kind")))
    pairs = F.transform(pairs, lambda r: F.struct(at(r["f"], "$[0]").alias("f"), r["t"].alias("t"), r["m"].alias("m"), r["keys"].alias("keys"), r["kind"].alias("kind")))
    rows = F.transform(at(x, "$", "array<variant>"), lambda v: F.struct(at(v, "$.from").alias("f"), at(v, "$.to").alias("t"), at(v, "$.match").alias("m"), F.map_keys(at(v, "$", "map<string,variant>")).alias("keys"), kind(v).alias("kind")))
    return F.when(kind(x) == "object", pairs).when(kind(x) == "list", rows)


def parsed(requests: DataFrame) -> DataFrame:
    """requests (req, json) with ``v`` and what several rules look at."""
    rows = requests.select("req", "json", F.try_parse_json("json").alias("v"))
    language = F.lower(stripped(at(F.col("v"), "$.language", "string")))
    regions = at(F.col("v"), "$.speech_regions")
    return rows.withColumns({
        "keys": F.map_keys(at(F.col("v"), "$", "map<string,variant>")),
        "language": F.when(~language.isin("", "auto"), language),
        "regions": F.when(regions.isNotNull() & (kind(regions) != "null"), F.to_json(regions)),
        "rules": correction_rules(at(F.col("v"), "$.corrections")),
        "written": at(F.col("v"), "$.vocabulary", "map<string,variant>"),
    })


def rules(row: Column) -> list[tuple[str, str, Column]]:
    """(key, reason, broken) of every rule, in order, over a row of parsed() as a struct."""
    v, language, keys, written = row["v"], row["language"], row["keys"], row["written"]
    get = lambda key: at(v, f"$.{key}")
    text = lambda key: at(v, f"$.{key}", "string")
    there = lambda key: get(key).isNotNull() & (kind(get(key)) != "null")
    is_a = lambda key, *kinds: kind(get(key)).isin(*kinds)
    flag = lambda key: (key, "type", get(key).isNotNull() & ~is_a(key, "flag"))
    within = lambda key, low, high: at(v, f"$.{key}", "double").between(low, high)
    blank = lambda key: stripped(text(key)) == ""
    dictionary = text("word_segmentation") == "dictionary"
    roots = at(v, "$.allowed_input_roots", "array<variant>")
    word_bad = lambda x: (F.length(stripped(x)) > MOST_WORD) | stripped(x).rlike(r"[\x00-\x1F]") | secret(stripped(x))
    readings = lambda x: F.when(kind(x) == "text", F.array(x)).otherwise(at(x, "$", "array<variant>"))
    listed = F.coalesce(F.map_values(written), F.array().cast("array<variant>"))
    forms = F.coalesce(F.map_keys(written), F.array().cast("array<string>"))
    clean = lambda x: clean_term(at(x, "$", "string"))
    of_rules = F.coalesce(row["rules"], F.array().cast("array<struct<f:variant,t:variant,m:variant,keys:array<string>,kind:string>>"))
    rule_bad = lambda r: F.coalesce(
        (r["kind"] != "object") | (F.size(F.array_except(r["keys"], F.array(F.lit("from"), F.lit("to"), F.lit("match")))) > 0) | (F.coalesce(kind(r["f"]), F.lit("")) != "text") | (F.coalesce(kind(r["t"]), F.lit("")) != "text")
        | clean(r["f"])[1].isNotNull() | clean(r["t"])[1].isNotNull() | (clean(r["f"])[0] == "") | (clean(r["t"])[0] == "") | (clean(r["f"])[0] == clean(r["t"])[0])
        | (r["m"].isNotNull() & ((kind(r["m"]) != "text") | ~F.coalesce(at(r["m"], "$", "string"), F.lit("")).isin("word", "substring"))), F.lit(True))
    folded_rules = F.transform(of_rules, lambda r: casefold(clean(r["f"])[0]))
    domain = lambda key: at(v, f"$.domain_vocabulary.{key}")
    material = F.concat(*[F.when(texts_or_text(domain(k)), texts(domain(k))).otherwise(F.array().cast("array<string>")) for k in ("programme", "slides", "speakers", "terms")])
    budget = at(v, "$.budget", "map<string,variant>")
    lower_keys = F.transform(keys, F.lower)
    return [
        ("", "not_an_object", v.isNull() | (kind(v) != "object")),
        ("", "forbidden_key", F.arrays_overlap(lower_keys, F.array(*[F.lit(k) for k in REFUSED_KEYS]))),
        ("", "unknown_key", F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS]))) > 0),
        ("input", "missing", ~is_a("input", "text") | get("input").isNull() | blank("input")),
        ("input", "characters", text("input").rlike(r"[\x00\n]")),
        ("language", "type", there("language") & ~is_a("language", "text")),
        ("language", "code", language.isNotNull() & ~language.rlike("^[a-z]{2,3}$")),
        ("engine", "id", get("engine").isNotNull() & (~is_a("engine", "text") | ~text("engine").rlike(r"^[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*\z"))),
        ("model", "name", there("model") & (~is_a("model", "text") | (text("model") == "") | text("model").rlike(r"[/\\ \t\n]|^\."))),
        flag("word_timestamps"),
        ("temperature", "range", get("temperature").isNotNull() & (~is_a("temperature", "whole", "real") | ~within("temperature", 0, 1))),
        ("beam_size", "range", get("beam_size").isNotNull() & (~is_a("beam_size", "whole") | ~within("beam_size", 1, 10))),
        ("audio_stream", "range", there("audio_stream") & (~is_a("audio_stream", "whole") | (at(v, "$.audio_stream", "double") < 0))),
        ("initial_prompt", "type", there("initial_prompt") & ~is_a("initial_prompt", "text")),
        ("initial_prompt", "long", F.length(text("initial_prompt")) > MOST_PROMPT),
        ("initial_prompt", "characters", text("initial_prompt").contains("\0")),
        ("initial_prompt", "credential", secret(text("initial_prompt"))),
        ("asset_id", "text", there("asset_id") & (~is_a("asset_id", "text") | blank("asset_id") | (F.length(text("asset_id")) > MOST_ASSET))),
        flag("cache"),
        flag("offline"),
        ("allowed_input_roots", "list", there("allowed_input_roots") & (~is_a("allowed_input_roots", "list") | (F.size(roots) == 0) | ~F.forall(roots, lambda r: (kind(r) == "text") & (stripped(at(r, "$", "string")) != "") & ~at(r, "$", "string").contains("\0")))),
        ("workspace", "text", there("workspace") & (~is_a("workspace", "text") | blank("workspace"))),
        flag("vad_filter"),
        ("vocabulary", "type", there("vocabulary") & ~is_a("vocabulary", "object")),
        ("vocabulary", "many", F.size(forms) > MOST_WORDS),
        ("vocabulary", "word", F.exists(forms, lambda w: (stripped(w) == "") | word_bad(w))),
        ("vocabulary", "readings", F.exists(listed, lambda x: ~kind(x).isin("text", "list") | (F.size(readings(x)) > MOST_READINGS) | F.exists(readings(x), lambda r: (kind(r) != "text") | word_bad(at(r, "$", "string"))))),
        ("word_segmentation", "mode", there("word_segmentation") & (~is_a("word_segmentation", "text") | ~text("word_segmentation").isin("engine", "dictionary"))),
        ("word_segmentation", "dictionary_segmentation_language", dictionary & (F.coalesce(language, F.lit("")) != "ja")),
        ("word_segmentation", "word_timestamps_required", dictionary & ~F.coalesce(at(v, "$.word_timestamps", "boolean"), F.lit(False))),
        ("chunk_seconds", "range", there("chunk_seconds") & (~is_a("chunk_seconds", "whole", "real") | ~within("chunk_seconds", *CHUNK_SECONDS))),
        ("chunk_seconds", "language_required_for_chunking", there("chunk_seconds") & language.isNull()),
        ("parallel", "range", get("parallel").isNotNull() & (~is_a("parallel", "whole") | ~within("parallel", 1, MOST_PARALLEL))),
        ("parallel", "chunk_seconds_required", ~there("chunk_seconds") & ((F.coalesce(at(v, "$.parallel", "double"), F.lit(1.0)) != 1) | row["regions"].isNotNull())),
        ("speech_regions", "shape", row["regions_reason"].isNotNull()),
        ("domain_vocabulary", "type", there("domain_vocabulary") & ~is_a("domain_vocabulary", "object")),
        ("domain_vocabulary", "unknown_key", F.size(F.array_except(F.map_keys(at(v, "$.domain_vocabulary", "map<string,variant>")), F.array(*[F.lit(k) for k in DOMAIN_KEYS]))) > 0),
        ("domain_vocabulary", "japanese", domain("japanese").isNotNull() & (kind(domain("japanese")) != "flag")),
        ("domain_vocabulary", "max_terms", domain("max_terms").isNotNull() & ((kind(domain("max_terms")) != "whole") | ~at(v, "$.domain_vocabulary.max_terms", "double").between(1, MOST_TERMS))),
        ("domain_vocabulary", "texts", any_of([~texts_or_text(domain(k)) for k in ("programme", "speakers", "terms")])),
        ("domain_vocabulary", "slides", domain("slides").isNotNull() & ~kind(domain("slides")).isin("null", "list", "object", "text")),
        ("domain_vocabulary", "term", F.exists(F.concat(texts(domain("speakers")), texts(domain("terms"))), lambda t: clean_term(t)[1].isNotNull())),
        ("domain_vocabulary", "long", F.aggregate(material, F.lit(0), lambda n, t: n + F.length(t)) > MOST_MATERIAL),
        ("corrections", "type", there("corrections") & ~is_a("corrections", "list", "object")),
        ("corrections", "many", F.size(of_rules) > MOST_RULES),
        ("corrections", "rule", F.exists(of_rules, rule_bad)),
        ("corrections", "twice", F.size(F.array_distinct(folded_rules)) < F.size(folded_rules)),
        ("budget", "type", there("budget") & ~is_a("budget", "object")),
        ("budget", "unknown_key", F.size(F.array_except(F.map_keys(budget), F.array(*[F.lit(k) for k in BUDGET_KEYS]))) > 0),
        ("budget", "range", F.exists(F.coalesce(F.map_values(budget), F.array().cast("array<variant>")), lambda x: F.coalesce(~kind(x).isin("whole", "real") | (at(x, "$", "double") <= 0), F.lit(True)))),
    ]


def checked(requests: DataFrame) -> DataFrame:
    """requests (req, json) with ``key`` and ``reason`` of the first rule they break, and merged speech ``spans``."""
    rows = parsed(requests)
    given = rows.where("regions is not null").select(F.col("req").alias("doc"), F.col("regions").alias("json"))
    spans, refused = scans.speech_regions(given)
    merged = spans.groupBy(F.col("doc").alias("req")).agg(F.array_sort(F.collect_list(F.array("start", "end"))).alias("spans"))
    rows = rows.join(refused.select(F.col("doc").alias("req"), F.col("reason").alias("regions_reason")), "req", "left").join(merged, "req", "left")
    held = F.array(F.struct("v", "keys", "language", "regions", "rules", "written", "regions_reason"))

    def first(row: Column) -> Column:
        return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(key).alias("key"), F.lit(reason).alias("reason"))) for key, reason, bad in rules(row)])

    # inside a lambda a row's values are read once for all rules, not put together anew for each
    return rows.withColumn("_first", F.transform(held, first)[0]).withColumns({"key": F.col("_first.key"), "reason": F.col("_first.reason")}).drop("_first", "regions_reason")


def first_broken(requests: DataFrame) -> DataFrame:
    """(req, key, reason); sound requests give no row."""
    return checked(requests).where("reason is not null").select("req", "key", "reason")


# -- canonical JSON

#: control characters whose escape has letters: JSON writers differ in their case
ESCAPED = [f"{n:02X}" for n in range(32) if f"{n:02X}" != f"{n:02x}"]


def json_text(x: Column) -> Column:
    out = F.regexp_replace(F.to_json(F.struct(x.alias("x"))), r'^\{"x":|\}$', "")
    for code in ESCAPED:
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(x.isNull(), "null").otherwise(out)


def json_number(x: Column) -> Column:
    """A double as Python writes it: shortest digits, without an exponent from 1e-4 on and below 1e16."""
    raw = x.cast("string")
    digits = F.replace(F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), "^-", ""), F.lit("."), F.lit(""))
    digits = F.when(digits.rlike("^.0$"), F.substring(digits, 1, 1)).otherwise(digits)
    e = F.split_part(raw, F.lit("E"), F.lit(2)).cast("int")
    sign = F.when(x < 0, "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    large = F.concat(sign, F.rpad(digits, e + 1, "0"), F.lit(".0"))
    fraction = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 32))).otherwise("")
    scientific = F.concat(sign, F.substring(digits, 1, 1), fraction, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    broken = F.concat(sign, F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(32)))
    return F.when(x.isNull(), "null").when(~raw.contains("E"), raw).when(e < -4, scientific).when(e < 0, small).when(e >= 16, scientific).when(F.length(digits) <= e + 1, large).otherwise(broken)


def json_flag(x: Column) -> Column:
    return F.when(x.isNull(), "null").when(x, "true").otherwise("false")


def json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def json_object(fields: list[tuple[str, Column, Column | None]]) -> Column:
    """Fields (name, JSON, present) in the order of their names."""
    parts = [F.concat(F.lit(f'"{name}": '), x) if here is None else F.when(here, F.concat(F.lit(f'"{name}": '), x)) for name, x, here in sorted(fields, key=lambda f: f[0])]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def written_forms() -> Column:
    """The vocabulary with forms and readings stripped, equal forms together, each reading once, forms in order; as JSON."""
    readings = lambda x: F.filter(F.transform(texts(x), stripped), lambda r: r != "")
    pairs = F.transform(F.map_entries("written"), lambda e: F.struct(stripped(e["key"]).alias("k"), readings(e["value"]).alias("r")))
    forms = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    own = lambda k: F.array_distinct(F.flatten(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["r"])))
    lines = F.transform(forms, lambda k: F.concat(json_text(k), F.lit(": "), json_list(F.transform(own(k), json_text))))
    return F.concat(F.lit("{"), F.array_join(lines, ", "), F.lit("}"))


def normalised(requests: DataFrame) -> DataFrame:
    """Sound requests with defaults filled in, ``parameters`` in canonical JSON and their hash: (req, input, language, engine,
    model, cache, offline, chunk_seconds, parallel, most_seconds, timeout, spans, parameters, parameters_hash, domain).
    Parameters that a request doesn't give and that came later stay out, so that older keys hold."""
    v = F.col("v")
    text, real, flag = (lambda k: at(v, f"$.{k}", "string")), (lambda k: at(v, f"$.{k}", "double")), (lambda k: F.coalesce(at(v, f"$.{k}", "boolean"), F.lit(False)))
    whole = lambda k, default: F.coalesce(at(v, f"$.{k}", "long"), F.lit(default))
    prompt = F.when(stripped(text("initial_prompt")) != "", text("initial_prompt"))
    rule = lambda r: json_object([("from", json_text(clean_term(at(r["f"], "$", "string"))[0]), None), ("match", json_text(F.coalesce(at(r["m"], "$", "string"), F.lit("word"))), None), ("to", json_text(clean_term(at(r["t"], "$", "string"))[0]), None)])
    spans = json_list(F.transform("spans", lambda x: json_list(F.transform(x, json_number))))
    chunking = json_object([("chunk_seconds", json_number(real("chunk_seconds")), None), ("speech_regions", F.coalesce(json_text(F.when(F.col("regions").isNotNull(), F.concat(F.lit("sha256:"), F.sha2(F.coalesce(spans, F.lit("[]")), 256)))), F.lit("null")), None)])
    parameters = json_object([
        ("language", json_text(F.col("language")), None), ("word_timestamps", json_flag(flag("word_timestamps")), None), ("temperature", json_number(F.coalesce(real("temperature"), F.lit(0.0))), None), ("initial_prompt", json_text(prompt), None),
        ("beam_size", whole("beam_size", 5).cast("string"), None), ("audio_stream", whole("audio_stream", 0).cast("string"), None), ("vad_filter", json_flag(flag("vad_filter")), None),
        ("vocabulary", written_forms(), F.coalesce(F.size("written") > 0, F.lit(False))), ("word_segmentation", F.lit('"dictionary"'), F.coalesce(text("word_segmentation") == "dictionary", F.lit(False))),
        ("corrections", json_list(F.transform("rules", rule)), F.coalesce(F.size("rules") > 0, F.lit(False))), ("chunking", chunking, real("chunk_seconds").isNotNull()),
    ])
    out = checked(requests).where("reason is null").withColumn("parameters", parameters)
    return out.select(
        "req", text("input").alias("input"), "language", F.coalesce(text("engine"), F.lit(ENGINE)).alias("engine"), F.coalesce(text("model"), F.lit(MODEL)).alias("model"), F.coalesce(at(v, "$.cache", "boolean"), F.lit(True)).alias("cache"), flag("offline").alias("offline"),
        real("chunk_seconds").alias("chunk_seconds"), whole("parallel", 1).alias("parallel"), F.coalesce(real("budget.max_audio_seconds"), F.lit(HOURS)).alias("most_seconds"), F.coalesce(real("budget.timeout"), F.lit(HOURS)).alias("timeout"), "spans",
        "parameters", F.sha2("parameters", 256).alias("parameters_hash"), F.to_json(at(v, "$.domain_vocabulary")).alias("domain"),
    )


def identity(fingerprint: Column, engine: Column, version: Column, mode: Column, model: Column, model_version: Column, parameters: Column) -> Column:
    """The key of a result: the hash of the canonical JSON of what shapes it."""
    own = json_object([("id", json_text(engine), None), ("version", json_text(version), None), ("execution_mode", json_text(mode), None)])
    named = json_object([("name", json_text(model), None), ("version", json_text(model_version), None)])
    return F.sha2(json_object([("input", json_text(fingerprint), None), ("engine", own, None), ("model", named, None), ("parameters", parameters, None)]), 256)


def dry_run(requests: DataFrame, media: DataFrame, engines: DataFrame, stored: DataFrame) -> DataFrame:
    """What would happen to each sound request, without running it: (req, status, key, would_run, cuts_from, chunks, reason).

    ``media``: (input, fingerprint, duration); ``engines``: (engine, version, mode); ``stored``: keys of results. ``reason`` is
    why it would be refused: no such file, no such engine, a recording over the budget. Media and engines hold each key
    once."""
    rows = normalised(requests).join(media, "input", "left").join(engines, "engine", "left")
    key = identity(F.col("fingerprint"), F.col("engine"), F.coalesce("version", F.lit("unknown")), F.col("mode"), F.col("model"), F.lit(None).cast("string"), F.col("parameters"))
    reason = F.when(F.col("fingerprint").isNull(), "FILE_NOT_FOUND").when(F.col("mode").isNull(), "ENGINE_UNAVAILABLE").when(F.col("duration") > F.col("most_seconds"), "BUDGET_EXCEEDED")
    rows = rows.withColumn("key", key).withColumn("reason", reason).join(stored.select("key", F.lit(1).alias("_hit")).distinct(), "key", "left")
    status = F.when(~F.col("cache"), "disabled").when(F.col("_hit").isNotNull(), "hit").otherwise("miss")
    chunks = F.when(F.col("chunk_seconds").isNotNull() & F.col("duration").isNotNull(), F.greatest(F.lit(1), F.bround(F.col("duration") / F.col("chunk_seconds")).cast("long")))
    cuts = F.when(F.col("chunk_seconds").isNotNull(), F.when(F.col("spans").isNotNull(), "speech_regions").otherwise("level"))
    sound = F.col("reason").isNull()
    return rows.select("req", F.when(sound, status).alias("status"), F.when(sound, F.col("key")).alias("key"), F.when(sound, status != "hit").alias("would_run"), cuts.alias("cuts_from"), chunks.alias("chunks"), "reason")


def unsupported(requests: DataFrame, specs: DataFrame) -> DataFrame:
    """(req, parameter) of parameters that a request's engine doesn't take: ``specs`` (engine, takes array<string>)."""
    given = F.map_keys(at(F.col("v"), "$", "map<string,variant>"))
    rows = parsed(requests).select("req", F.coalesce(at(F.col("v"), "$.engine", "string"), F.lit(ENGINE)).alias("engine"), F.explode(given).alias("parameter"))
    shaping = rows.where(F.col("parameter").isin("temperature", "beam_size", "initial_prompt", "vad_filter", "vocabulary", "word_timestamps"))
    return shaping.join(specs, "engine").where(~F.array_contains("takes", F.col("parameter"))).select("req", "parameter")
