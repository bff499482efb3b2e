"""The engine catalogue as data: constraint filter, gates, batches and cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPEC = "id string, mode string, available boolean, network boolean, deterministic boolean, vocabulary boolean, words boolean, detection boolean, languages array<string>, models array<string>"
#: a catalogue for queries and tests; a deployment passes its own rows
ENGINES = [
    ("cloud-large", "remote", True, True, False, True, True, True, [], ["large"]),
    ("fast-local", "local", True, False, True, True, True, True, [], ["tiny", "base"]),
    ("ja-local", "local", True, False, True, False, False, False, ["ja"], ["ja-v1"]),
    ("aligner", "local", False, False, True, False, True, False, ["en", "ja", "zh"], ["align"]),
    ("program", "program", True, False, True, False, True, False, ["en", "fr", "de"], ["one"]),
]


class Registry:
    """Engines by unique id; nothing is loaded dynamically."""

    MODES = ("local", "remote", "program")

    def __init__(self, rows=()):
        self._rows: dict[str, tuple] = {}
        for row in rows:
            self.register(row)

    def register(self, row: tuple) -> None:
        if row[0] in self._rows or row[1] not in self.MODES:
            raise ValueError(f"INVALID_INPUT: {row[0]}")
        self._rows[row[0]] = row

    def get(self, name: str) -> tuple:
        return self._rows[name]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self._rows[k] for k in sorted(self._rows)], SPEC)


#: engines that a catalogue may have
MOST_ENGINES = 1000


def engines(spark: SparkSession) -> DataFrame:
    return Registry(ENGINES).table(spark)


def capabilities(specs: DataFrame) -> DataFrame:
    """(id, capability): the mode, and of available engines what their flags say."""
    flag = lambda name: F.when(F.col("available") & F.col(name), F.lit(name))
    return specs.select("id", F.explode(F.array_compact(F.array(F.col("mode"), flag("words"), flag("vocabulary"), flag("detection"), flag("deterministic")))).alias("capability"))


def rejected(requirements: DataFrame, specs: DataFrame) -> DataFrame:
    """(req, id, reasons) of every requirement (req, engine, language, offline, needs_words, needs_vocabulary) against
    every engine; an empty list is a candidate. Every requirement is answered for every engine, so the list of engines
    must be short: MOST_ENGINES is checked."""
    if specs.limit(MOST_ENGINES + 1).count() > MOST_ENGINES:
        raise ValueError(f"a catalogue has at most {MOST_ENGINES} engines")
    both = requirements.crossJoin(F.broadcast(specs))
    c = F.col
    reasons = F.array_compact(
        F.array(
            F.when(c("offline") & c("network"), "network_required"),
            F.when(c("language").isNotNull() & (F.size("languages") > 0) & ~F.array_contains("languages", F.coalesce("language", F.lit(""))), "language_unsupported"),
            F.when(c("language").isNull() & ~c("detection"), "language_detection_unsupported"),
            F.when(c("needs_words") & ~c("words"), "word_timestamps_unsupported"),
            F.when(c("needs_vocabulary") & ~c("vocabulary"), "custom_vocabulary_unsupported"),
        )
    )
    only = lambda x: F.array(F.lit(x))
    found = F.when(c("engine").isNotNull() & (c("engine") != c("id")), only("engine_id_mismatch")).when(~c("available"), F.array_compact(F.array(F.when(c("offline") & c("network"), "network_required"), F.lit("engine_not_installed")))).otherwise(reasons)
    return both.select("req", "id", F.array_join(found, ",").alias("reasons"))


def first_error(requests: DataFrame) -> DataFrame:
    """The gate's first error of requests (offline, network, installed, language_ok, words_ok, detection_ok, vocabulary_ok)."""
    c = F.col
    code = F.when(c("offline") & c("network"), "ENGINE_UNAVAILABLE").when(~c("installed"), "ENGINE_UNAVAILABLE").when(~c("language_ok"), "INVALID_INPUT").when(~c("words_ok"), "INVALID_INPUT").when(~c("detection_ok"), "INVALID_INPUT").when(~c("vocabulary_ok"), "INVALID_INPUT")
    return requests.withColumn("error", code)


def outcomes(items: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each item of a batch, with its result or the error of its own: (item, ok, result, error)."""
    joined = items.join(results, "item", "left")
    return joined.select("item", (F.col("result").isNotNull() & F.col("error").isNull()).alias("ok"), "result", F.when(F.col("result").isNull(), F.coalesce("error", F.lit("NO_RESULT"))).alias("error"))


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (key, fingerprint) with ``status``: hit, miss, or invalid where the entry is of another recording."""
    c = cache.where(F.col("key").rlike("^[0-9a-f]{64}$")).groupBy("key").agg(F.max("fingerprint").alias("_f"))
    return requests.join(c, "key", "left").withColumn("status", F.when(F.col("_f").isNull(), "miss").when(F.col("_f") == F.col("fingerprint"), "hit").otherwise("invalid")).drop("_f")


def health(specs: DataFrame, tools: dict[str, str | None], offline: bool = False) -> DataFrame:
    """(check, status, detail) of a deployment: the programs by name and version (None: not there), and every engine."""
    programs = specs.sparkSession.createDataFrame([(k, "AVAILABLE" if v else "MISSING", v or "not found") for k, v in sorted(tools.items())], "check string, status string, detail string")
    detail = F.when(F.col("available"), F.concat(F.col("mode"), F.when(F.col("network"), F.lit(", needs a network")).otherwise(F.lit("")))).otherwise("not installed")
    usable = F.col("available") & ~(F.lit(offline) & F.col("network"))
    return programs.union(specs.select(F.concat(F.lit("engine:"), "id"), F.when(usable, "AVAILABLE").otherwise("MISSING"), detail))


def ready(specs: DataFrame, tools: dict[str, str | None], default: str, offline: bool = False, local_models: tuple[str, ...] | list[str] = ()) -> bool:
    """Whether work can begin: both media programs and the default engine, and offline one of its models on this host."""
    models = F.lit(not offline) | F.arrays_overlap("models", F.array(*[F.lit(x) for x in local_models]).cast("array<string>"))
    return all(tools.get(x) for x in ("ffmpeg", "ffprobe")) and not specs.where(F.col("id") == default).where("available").where(models).isEmpty()
