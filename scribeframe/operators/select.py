"""Selection: words or segments to remove or keep become time spans with the gaps around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.operators.intervals import binned, index_runs


#: word numbers of a bin of the join of words and ranges
RANGE = 64


class Refused(ValueError):
    """A selection that can't be done; ``reason`` says why."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def selected(units: DataFrame, ranges: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """(doc, idx) of units in a word range (doc, first, last) or of a listed segment (doc, seg)."""
    parts = []
    if ranges is not None:
        r = ranges.select("doc", F.col("first").alias("_a"), (F.col("last") + 1).alias("_b"))
        own = units.select("doc", "idx", (F.col("idx") + 1).alias("_z"))
        parts.append(binned(own, r, ["doc"], ("idx", "_z"), ("_a", "_b"), RANGE).select("doc", "idx"))
    if segments is not None:
        parts.append(units.join(segments.select("doc", "seg").distinct(), ["doc", "seg"], "left_semi").select("doc", "idx"))
    if not parts:
        raise Refused("empty")
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.distinct()


def check_ranges(ranges: DataFrame, units: DataFrame) -> DataFrame:
    """Ranges with the reason they are refused: backward, outside the transcript, or overlapping the range before."""
    n = units.groupBy("doc").agg(F.max("idx").alias("_top"))
    w = Window.partitionBy("doc").orderBy("first", "last")
    r = ranges.join(n, "doc", "left").withColumn("_before", F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    reason = F.when(F.col("first") > F.col("last"), "backward").when((F.col("first") < 0) | F.col("_top").isNull() | (F.col("last") > F.col("_top")), "out_of_range").when(F.col("first") <= F.col("_before"), "overlapping")
    return r.withColumn("reason", reason).drop("_top", "_before")


def marked(units: DataFrame, chosen: DataFrame, mode: str) -> DataFrame:
    """units with ``removed``: the chosen ones, or in keep mode all others."""
    hit = F.col("_hit").isNotNull()
    flagged = units.join(chosen.select("doc", "idx", F.lit(1).alias("_hit")), ["doc", "idx"], "left")
    return flagged.withColumn("removed", hit if mode == "remove" else ~hit).drop("_hit")


def runs(units: DataFrame) -> DataFrame:
    """Removed units with their run: stretches in time order between kept units."""
    w = Window.partitionBy("doc").orderBy("s", "e", "idx")
    island = F.sum((~F.col("removed")).cast("int")).over(w)
    return units.withColumn("_island", island).where("removed").withColumn("run", F.dense_rank().over(Window.partitionBy("doc").orderBy("_island")).cast("long")).drop("_island")


def crossing(units: DataFrame) -> DataFrame:
    """Kept units that overlap a removed run in time."""
    spans = runs(units).groupBy("doc", "run").agg(F.min("s").alias("rs"), F.max("e").alias("re"))
    return binned(units.where("not removed").select("doc", "idx", "s", "e"), spans, ["doc"], other=("rs", "re")).select("doc", "idx").distinct()


def include_overlaps(units: DataFrame) -> DataFrame:
    """Adds kept units that overlap a removed run, then those that overlap what was added, to the end. A unit overlaps a
    run if and only if it overlaps one of its units, since a kept unit that starts in between ends the run; so whole
    groups of units that hang together by overlaps go, which one look along the time finds."""
    w = Window.partitionBy("doc").orderBy("s", "e", "idx")
    latest = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = units.withColumn("_new", F.coalesce((F.col("s") >= latest).cast("int"), F.lit(1))).withColumn("_group", F.sum("_new").over(w))
    return grouped.withColumn("removed", F.some("removed").over(Window.partitionBy("doc", "_group"))).drop("_new", "_group")


def spans(units: DataFrame, duration: DataFrame, mode: str) -> DataFrame:
    """A row for each removed run of transcripts where no kept unit overlaps one, and in keep mode for the silence at either end: times, the kept neighbours' limits,
    speech and most seconds (milliseconds here), words and segments."""
    # no kept unit overlaps a run, so the kept ones before it in the order of time end by its start, and the later ones
    # start from its end: one look back and one ahead over the units give its neighbours
    w = Window.partitionBy("doc").orderBy("s", "e", "idx")
    lo = F.max(F.when(~F.col("removed"), F.col("e"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    hi = F.min(F.when(~F.col("removed"), F.col("s"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    limits = [F.min("_lo").alias("lo"), F.max("_hi").alias("hi")]
    run = runs(units.withColumns({"_lo": lo, "_hi": hi})).groupBy("doc", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.sum(F.col("e") - F.col("s")).alias("speech"), F.count("*").alias("units"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.count_distinct("seg").alias("segments"), *limits)
    out = run.join(duration, "doc")
    out = out.select("doc", "run", "start", "end", F.coalesce("lo", F.lit(0)).cast("long").alias("lo"), F.col("lo").isNotNull().alias("after_kept"), F.coalesce("hi", "duration").cast("long").alias("hi"), F.col("hi").isNotNull().alias("before_kept"), "speech", "units", "first", "last", "segments")
    if mode == "keep":
        edge = units.groupBy("doc").agg(F.min(F.when(~F.col("removed"), F.col("s"))).alias("k0"), F.max(F.when(~F.col("removed"), F.col("e"))).alias("k1"), F.min(F.when(F.col("removed"), F.col("s"))).alias("r0"), F.max(F.when(F.col("removed"), F.col("e"))).alias("r1")).join(duration, "doc")
        empty = [F.lit(0).cast("long").alias(c) for c in ("speech", "units")] + [F.lit(None).cast("long").alias(c) for c in ("first", "last")] + [F.lit(0).cast("long").alias("segments")]
        zero, none = F.lit(0).cast("long"), F.lit(False)
        lead = edge.where("k0 > 0 and (r0 is null or r0 >= k0)").select("doc", zero.alias("run"), zero.alias("start"), zero.alias("end"), zero.alias("lo"), none.alias("after_kept"), F.col("k0").alias("hi"), F.lit(True).alias("before_kept"), *empty)
        tail = edge.where("k1 < duration and (r1 is null or r1 <= k1)").select("doc", F.lit(1 << 40).alias("run"), F.col("duration").alias("start"), F.col("duration").alias("end"), F.col("k1").alias("lo"), F.lit(True).alias("after_kept"), F.col("duration").alias("hi"), none.alias("before_kept"), *empty)
        out = out.union(lead).union(tail)
    number = F.row_number().over(Window.partitionBy("doc").orderBy("run"))
    return out.withColumn("id", F.concat(F.lit("r"), number.cast("string"))).withColumn("most", F.col("hi") - F.col("lo")).drop("run")


def sentences(units: DataFrame) -> DataFrame:
    """Segments that lose units: whether all of them, how many, and how much time."""
    hit = F.when(F.col("removed"), 1)
    out = units.groupBy("doc", "seg").agg(F.count(hit).alias("removed_units"), F.count("*").alias("units"), F.coalesce(F.sum(F.when(F.col("removed"), F.col("e") - F.col("s"))), F.lit(0)).alias("removed_ms"))
    return out.where("removed_units > 0").withColumn("whole", F.col("removed_units") == F.col("units"))


def select(units: DataFrame, duration: DataFrame, mode: str, ranges: DataFrame | None = None, segments: DataFrame | None = None, overlap: str = "refuse") -> dict[str, DataFrame]:
    """spans, sentences, word ranges and counts of a selection; refused transcripts come back with their reason."""
    if mode not in ("remove", "keep") or overlap not in ("refuse", "include"):
        raise Refused("mode")
    flagged = marked(units, selected(units, ranges, segments), mode)
    n = flagged.groupBy("doc").agg(F.every("removed").alias("_all"), F.some("removed").alias("_any"))
    reason = n.select("doc", F.when(~F.col("_any"), "nothing_removed").when(F.col("_all"), "nothing_kept").alias("reason")).where("reason is not null")
    if overlap == "include":
        flagged = include_overlaps(flagged)
    else:
        reason = reason.union(crossing(flagged).select("doc", F.lit("overlap").alias("reason")).distinct())
    good = flagged.join(reason.select("doc"), "doc", "left_anti")
    found = spans(good, duration, mode)
    totals = found.groupBy("doc").agg(F.count("*").alias("spans"), F.sum("speech").alias("speech"), F.sum("most").alias("most"))
    counts = good.groupBy("doc").agg(F.count("*").alias("units"), F.count(F.when(F.col("removed"), 1)).alias("removed")).join(totals, "doc", "left")
    return {"spans": found, "sentences": sentences(good), "ranges": index_runs(good.where("removed").select("doc", "idx"), ["doc"]), "counts": counts, "refused": reason}
