"""Scans of the documents that come beside a transcript: speech regions, slide decks, speaker turns, lists, JSON lines.

Documents are rows (doc, json); their shape is read by JSON path functions, and a document that isn't as it should be gives
a row of its own with the reason, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribeframe.operators import intervals

# Fixed values of the contracts: kinds, schemas, limits, names, seconds that turns may overlap.
REGIONS_KIND, DECK_SCHEMA, SPEAKER = "speech_regions", "slide-sync/deck@1", r"^SPEAKER_\d{2,}$"
MOST_REGIONS, MOST_TURNS, MOST_LIST, OVERLAP = 200_000, 200_000, 2000, 0.01


def _at(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def speech_regions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc, start, end) merged where they touch, (doc, reason) of refused documents). A document is an observation of
    REGIONS_KIND, a result with one, or a response with exactly one such result that went well."""
    results = F.from_json(_at(F.col("json"), "$.results"), "array<string>")
    good = F.filter(results, lambda r: (_at(r, "$.kind") == REGIONS_KIND) & (F.coalesce(_at(r, "$.status"), F.lit("ok")) == "ok"))
    rows = docs.withColumn("_one", F.when(results.isNull(), F.col("json")).when(F.size(good) == 1, F.get(good, 0)))
    rows = rows.withColumn("_seen", F.coalesce(_at(F.col("_one"), "$.observation"), "_one"))
    raw = F.coalesce(_at(F.col("_seen"), "$.data.regions"), _at(F.col("_seen"), "$.data.segments"))
    rows = rows.withColumn("_r", F.when(_at(F.col("_seen"), "$.kind") == REGIONS_KIND, F.from_json(raw, "array<struct<start: double, end: double>>")))
    sound = lambda x: F.coalesce((x["start"] >= 0) & (x["end"] > x["start"]) & (x["end"] < float("inf")), F.lit(False))
    reason = F.when(F.col("_r").isNull(), "shape").when(F.size("_r") > MOST_REGIONS, "too_many").when(~F.forall("_r", sound), "region")
    rows = rows.select("doc", "_r", reason.alias("reason"))
    flat = rows.where("reason is null").select("doc", F.explode("_r").alias("x")).select("doc", F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    return intervals.union(flat, ["doc"]), rows.where("reason is not null").select("doc", "reason")


def slides(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc, page, text, sha256), (doc, reason)): the pages of slide decks, or of plain lists of page texts."""
    plain = F.col("json").rlike(r"^\s*\[")
    pages = F.when(plain, F.from_json("json", "array<string>")).when(_at(F.col("json"), "$.schema") == DECK_SCHEMA, F.transform(F.from_json(_at(F.col("json"), "$.pages"), "array<string>"), lambda p: _at(p, "$.text")))
    rows = docs.select("doc", pages.alias("_p"), F.when(~plain, _at(F.col("json"), "$.source.sha256")).alias("sha256"))
    reason = F.when(F.col("_p").isNull(), "schema").when(F.exists("_p", lambda x: x.isNull()), "page")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("doc", F.posexplode("_p").alias("page", "text"), "sha256"), rows.where("reason is not null").select("doc", "reason")


def texts(json: Column) -> Column:
    """A JSON value as a list: null gives none, a string one, a list of at most MOST_LIST strings its own; else null."""
    items = F.from_json(json, "array<string>")
    listed = F.when((F.size(items) <= MOST_LIST) & F.forall(items, lambda x: x.isNotNull()), items)
    none = F.array().cast("array<string>")
    return F.when(json.isNull() | json.rlike(r"^\s*null\s*$"), none).when(json.rlike(r'^\s*"'), F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>")).when(json.rlike(r"^\s*\["), listed)


def turn_rules(turns: DataFrame) -> DataFrame:
    """(doc, rule) of turns (doc, n, s, e, speaker), in the order n: what breaks the contract of exclusive turns."""
    before = F.lag("e").over(Window.partitionBy("doc").orderBy("n"))
    many = F.count(F.lit(1)).over(Window.partitionBy("doc"))
    good = F.coalesce((F.col("s") >= 0) & (F.col("e") > F.col("s")) & (F.col("e") < float("inf")), F.lit(False))
    rules = {"times": ~good, "order": F.coalesce(F.col("s") < before - OVERLAP, F.lit(False)), "speaker": ~F.coalesce(F.col("speaker").rlike(SPEAKER), F.lit(False)), "too_many": many > MOST_TURNS}
    broken = turns.select("doc", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])).alias("_rules"))
    return broken.select("doc", F.explode("_rules").alias("rule")).distinct()


def json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((json) of a program's output lines, (line) of those that are no JSON object); blank lines are neither."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.coalesce(F.col("value").rlike(r"^\s*\{") & F.json_object_keys("value").isNotNull(), F.lit(False))
    return lines.where(parsed).select(F.col("value").alias("json")), lines.where(~parsed).select(F.col("value").alias("line"))
