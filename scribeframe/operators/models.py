"""Whether the models of engines can be used: a status for each request from catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``present``: on this host; ``companion``: a second file the engine needs with it is there (null: needs none);
#: ``known``: the installed version knows the model; ``fetches``: the engine gets it on first use
SPEC = "engine string, model string, present boolean, companion boolean, known boolean, fetches boolean, languages array<string>"
MODELS = [
    ("cloud-large", "large", True, None, True, False, None),
    ("fast-local", "base", False, None, True, True, None),
    ("fast-local", "tiny", True, None, True, True, None),
    ("fast-local", "tiny.en", True, None, False, True, ["en"]),
    ("ja-local", "ja-v1", False, None, True, False, ["ja"]),
    ("aligner", "align", True, True, True, False, None),
    ("program", "one", True, False, True, False, ["en", "fr"]),
]


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, SPEC)


def status(requests: DataFrame, catalogue: DataFrame, specs: DataFrame) -> DataFrame:
    """requests (req, engine, model, offline) with ``status``, ``availability``, ``download_required``, ``languages``.

    A model may carry a weight type after a colon. An unknown model comes first, then an engine that isn't installed,
    then what the host has; without a network nothing can be fetched. A null model or engine is unknown. Both
    catalogues hold a row for each model and engine that is deployed; requests may be of any number.
    """
    known = catalogue.select("engine", F.col("model").alias("_name"), "present", "companion", "known", "fetches", "languages", F.lit(True).alias("_listed"))
    engines = specs.select(F.col("id").alias("engine"), F.col("available").alias("_available"))
    rows = requests.withColumn("_name", F.split_part("model", F.lit(":"), F.lit(1))).join(known, ["engine", "_name"], "left").join(engines, "engine", "left")
    here = F.col("present") & F.coalesce("companion", F.lit(True))
    usable = F.coalesce("_available", F.lit(False)) & F.col("known")
    fetched = F.col("fetches") & ~F.coalesce("offline", F.lit(False))
    availability = F.when(F.col("_listed").isNull(), "MODEL_UNKNOWN").when(~usable, "MODEL_MISSING").when(here, "MODEL_AVAILABLE").when(fetched, "MODEL_DOWNLOAD_REQUIRED").otherwise("MODEL_MISSING")
    out = rows.select("req", "engine", "model", "offline", availability.alias("availability"), "languages")
    short = F.when(F.col("availability").isin("MODEL_UNKNOWN", "MODEL_AVAILABLE"), F.substring_index("availability", "_", -1)).otherwise("MISSING")
    return out.withColumns({"status": short, "download_required": F.col("availability") == "MODEL_DOWNLOAD_REQUIRED"})


def language_refused(rows: DataFrame) -> DataFrame:
    """Rows of status() with ``language`` and ``refused``: the model is limited to other languages, or, where none is
    asked for, to some (it can't detect one)."""
    limited = F.col("languages").isNotNull()
    other = F.col("language").isNull() | ~F.array_contains("languages", F.coalesce("language", F.lit("")))
    return rows.withColumn("refused", F.coalesce(limited & other, F.lit(False)))
