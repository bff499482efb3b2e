"""A store of results by key: an append-only table, so that Spark's commit protocol makes a put whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, fingerprint string, document string, created_at timestamp"
KEY = "^[0-9a-f]{64}$"


def put(results: DataFrame, root: str) -> None:
    """Adds results (key, fingerprint, document as JSON); rows without a proper key are refused."""
    good = results.where(F.col("key").rlike(KEY)).select("key", "fingerprint", "document", F.current_timestamp().alias("created_at"))
    good.write.mode("append").parquet(root)


def table(spark: SparkSession, root: str) -> DataFrame:
    """The newest entry of each key; an empty table where nothing has been put."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ENTRY)
    newest = F.max_by(F.struct("fingerprint", "document", "created_at"), F.struct("created_at", "document")).alias("x")
    return spark.read.schema(ENTRY).parquet(root).groupBy("key").agg(newest).select("key", "x.*")


def get(requests: DataFrame, root: str) -> DataFrame:
    """requests (key, fingerprint) with ``status`` (hit, miss, invalid for another recording's entry or one that isn't
    JSON) and the ``document`` of hits."""
    own = table(requests.sparkSession, root).select("key", F.col("fingerprint").alias("_f"), F.col("document").alias("_d"))
    status = F.when(F.col("_f").isNull() & F.col("_d").isNull(), "miss").when((F.col("_f") == F.col("fingerprint")) & F.get_json_object("_d", "$").isNotNull(), "hit").otherwise("invalid")
    return requests.join(own, "key", "left").withColumn("status", status).withColumn("document", F.when(F.col("status") == "hit", F.col("_d"))).drop("_f", "_d")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(key, size_bytes, created_at)."""
    return table(spark, root).select("key", F.octet_length("document").cast("long").alias("size_bytes"), "created_at")


def size(spark: SparkSession, root: str) -> DataFrame:
    """(entries, size_bytes), one row."""
    return entries(spark, root).agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def clear(spark: SparkSession, root: str) -> int:
    """Removes all entries, and says how many there were."""
    n = table(spark, root).count()
    if n:
        spark.createDataFrame([], ENTRY).write.mode("overwrite").parquet(root)
    return n
