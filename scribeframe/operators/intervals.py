"""Operators on intervals: gap merge, union, overlap joins, neighbours in time, islands and index runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_groups(rows: DataFrame, keys: list[str], order: list[str], gap: int) -> DataFrame:
    """Column ``g``: a new group where a row starts more than ``gap`` after the row before it ends (not the latest end)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.col("s") - F.lag("e").over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("g", F.sum("_new").over(w).cast("long")).drop("_new")


def speech_events(segments: DataFrame, gap: int) -> DataFrame:
    """(doc, event, start, end, segments, text): merged segments; the end is the last segment's, ids in order."""
    grouped = gap_groups(segments, ["doc"], ["seg"], gap)
    row = F.array_sort(F.collect_list(F.struct("seg", "e", "text")))
    out = grouped.groupBy("doc", "g").agg(F.min("s").alias("start"), row.alias("r"))
    texts = F.array_join(F.transform("r", lambda x: x["text"]), " ")
    return out.select("doc", F.concat(F.col("doc").cast("string"), F.format_string("_spev_%04d", F.col("g"))).alias("event"), "start", F.element_at("r", -1)["e"].alias("end"), F.size("r").cast("long").alias("segments"), texts.alias("text"))


def null_min(x: Column) -> Column:
    """The least value; null if any value is null."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.min(x))


def union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Merged intervals: a row joins when it starts at or before the latest end so far."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    latest = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = rows.withColumn("_n", F.coalesce((F.col("s") > latest).cast("int"), F.lit(1))).withColumn("_g", F.sum("_n").over(w))
    return grouped.groupBy(*keys, "_g").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("_g")


#: time units of a bin of an interval join: ten seconds in milliseconds; bins that one interval goes into at most
BIN, MOST_BINS = 10_000, 64
LONG_OWN, LONG_OTHER = 1, 2


def binned(a: DataFrame, b: DataFrame, keys: list[str], own: tuple[str, str] = ("s", "e"), other: tuple[str, str] = ("ts", "te"), width: int = BIN) -> DataFrame:
    """Pairs of rows that overlap strictly, by an equality join: either side goes into all bins that it touches, and a
    pair is kept in the first bin that both touch, so a key's rows aren't compared with each other at large. Intervals that
    touch more than MOST_BINS bins go into none; every row also stands in a place where it meets the other side's long
    intervals alone. So no interval, however long, becomes more than MOST_BINS + 1 rows. Rows with a null limit match
    nothing."""
    first = lambda span: F.floor(F.col(span[0]) / width)
    last = lambda span: F.greatest(first(span), F.floor(F.col(span[1]) / width))
    long = lambda span: last(span) - first(span) >= MOST_BINS
    place = lambda kind, bin: F.struct(F.lit(kind).alias("kind"), bin.cast("long").alias("bin"))

    def into(df: DataFrame, span: tuple[str, str], mine: int, others: int) -> DataFrame:
        bins = F.transform(F.sequence(first(span), F.when(long(span), first(span)).otherwise(last(span))), lambda x: place(0, x))
        far = F.array(place(others, F.lit(0)))
        # a long interval of the left side meets all of the right, one of the right the left's short ones
        alone = F.array(*[place(k, F.lit(0)) for k in ((LONG_OTHER, LONG_OWN) if mine == LONG_OTHER else (LONG_OWN,))])
        places = F.when(long(span), alone).otherwise(F.concat(bins, far))
        return df.where(F.col(span[0]).isNotNull() & F.col(span[1]).isNotNull()).withColumn("_bin", F.explode(places))

    both = into(a, own, LONG_OWN, LONG_OTHER).join(into(b, other, LONG_OTHER, LONG_OWN), [*keys, "_bin"])
    near = (F.col(other[0]) < F.col(own[1])) & (F.col(other[1]) > F.col(own[0]))
    once = (F.col("_bin.kind") > 0) | (F.col("_bin.bin") == F.greatest(first(own), first(other)))
    return both.where(near & once).drop("_bin")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs that overlap strictly, with their common length; ``b`` has columns ts and te."""
    return binned(a, b, keys, width=width).withColumn("common", F.least("e", "te") - F.greatest("s", "ts"))


def touching(a: DataFrame, b: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Rows of a that overlap any row of b (semi join)."""
    hit = binned(a.select(*keys, "s", "e").distinct(), b.select(*keys, "ts", "te"), keys, width=width).select(*keys, "s", "e").distinct()
    return a.join(hit, [*keys, "s", "e"], "left_semi")


def index_runs(rows: DataFrame, keys: list[str], index: str = "idx") -> DataFrame:
    """Maximal runs of consecutive integers: (keys, first, last)."""
    w = Window.partitionBy(*keys).orderBy(index)
    return rows.withColumn("_g", F.col(index) - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("_g")
