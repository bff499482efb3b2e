"""Chunks of long recordings: frame energies, quiet places, cut planning, and joining of chunk results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.sources import wav

RATE, FRAME, QUIET_FRAMES = 16_000, 320, 15
# Seconds of a level frame and of a pause; how far from its target a cut may lie, as a share and in seconds;
# the level of no sound; seconds of a bounded engine's chunk, of its search either way and of its quiet window.
FRAME_SECONDS, PAUSE_SECONDS, SEARCH_SHARE, SEARCH_SECONDS, SILENCE = 0.02, 0.3, 0.2, 60.0, -120.0
ENGINE_CHUNK, ENGINE_SEARCH, ENGINE_WINDOW = 30.0, 2.0, 0.1


def frames(rows: DataFrame) -> DataFrame:
    """(path, frame, energy): exact sums of squares of 20 ms frames of PCM rows (path, start, rate, pcm) of ``sources.wav``;
    rows begin at whole frames, so that every row is summed on its own. A recording's last, broken frame has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, start, rate, pcm in zip(part["path"], part["start"], part["rate"], part["pcm"], strict=True):
                size = frame_of(rate)
                if start % size:
                    raise ValueError(f"rows of {path} don't begin at whole frames")
                energy = energies(np.frombuffer(pcm, dtype="<i2"), size)
                yield pd.DataFrame({"path": path, "frame": start // size + np.arange(len(energy)), "energy": energy})

    return rows.select("path", "start", "rate", "pcm").mapInPandas(run, "path string, frame long, energy long")


def frame_of(rate: int) -> int:
    return max(1, round(FRAME_SECONDS * rate))


def energies(samples: np.ndarray, size: int) -> np.ndarray:
    n = len(samples) // size
    return (samples[: n * size].astype(np.int64).reshape(n, size) ** 2).sum(axis=1)


def quiet_cut(samples: np.ndarray, offset: int, target: int, rate: int) -> tuple[int, float]:
    """The middle of the quietest pause-long stretch of frames in samples that begin at ``offset``, and its level in dBFS; of
    equal ones the nearest to ``target``, then the first. Samples shorter than a pause are cut at the target."""
    size, span = frame_of(rate), max(1, round(PAUSE_SECONDS / FRAME_SECONDS))
    run = np.concatenate([[0], np.cumsum(energies(samples, size))])
    if len(run) <= span:
        return target, 0.0
    sums = run[span:] - run[:-span]
    middle = offset + np.arange(len(sums)) * size + span * size // 2
    best = np.flatnonzero(sums == sums.min())
    at = best[np.abs(middle[best] - target).argmin()]
    loud = math.sqrt(int(sums[at]) / (span * size)) / 32768
    return int(middle[at]), round(20 * math.log10(loud), 1) if loud > 0 else SILENCE


def quietest_window(samples: np.ndarray, window: int) -> int:
    """Where the first window of samples with the least energy begins, to the sample; exact in whole numbers."""
    run = np.concatenate([[0], np.cumsum(samples.astype(np.int64) ** 2)])
    return int((run[window:] - run[:-window]).argmin())


def region_cut(regions: list[tuple[float, float]], low: float, high: float, target: float, duration: float) -> tuple[float, float] | None:
    """The middle of the longest pause between speech regions whose middle lies from low to high, and its length; of equal
    ones the nearest to the target, then the first. The recording's begin and end bound pauses, too."""
    if not regions:
        return None
    start, end = np.array([*regions, (duration, duration)], dtype=float).T
    before = np.concatenate([[0.0], np.maximum.accumulate(end)[:-1]])
    after = np.minimum(start, duration)
    middle, length = (before + after) / 2, after - before
    fits = np.flatnonzero((length > 0) & (middle >= low) & (middle <= high))
    if not len(fits):
        return None
    at = fits[np.lexsort((np.abs(middle[fits] - target), -length[fits]))[0]]
    return float(middle[at]), float(length[at])


def planned(n: int, rate: int, seconds: float, regions: list[tuple[float, float]], read: Callable[[int, int], np.ndarray]) -> list[tuple]:
    """(start_sample, end_sample, source, level, pause) of the chunks of n samples; source, level and pause tell how a
    chunk's end was found. ``read`` gives a range of samples, and only ranges around targets are read."""
    step, reach = round(seconds * rate), round(min(seconds * SEARCH_SHARE, SEARCH_SECONDS) * rate)
    out, at = [], 0
    while n - at > step + reach:
        target = at + step
        low, high = target - reach, target + reach
        found = region_cut(regions, low / rate, high / rate, target / rate, n / rate)
        if found:
            out.append((at, min(max(round(found[0] * rate), low), high), "speech_regions", None, round(found[1], 3)))
        else:
            cut, level = quiet_cut(read(low, high), low, target, rate)
            out.append((at, cut, "level", level, None))
        at = out[-1][1]
    return [*out, (at, n, "end", None, None)]


def bounded(n: int, rate: int, read: Callable[[int, int], np.ndarray], seconds: float = ENGINE_CHUNK, search: float = ENGINE_SEARCH, quiet: float = ENGINE_WINDOW) -> list[tuple]:
    """(start_sample, end_sample, source, level, pause) of chunks for engines that hear a bounded stretch: each cut is the
    middle of the quietest window within ``search`` of its target, to the sample, and at least half a chunk after the last."""
    step, reach, window = int(seconds * rate), int(search * rate), int(quiet * rate)
    if step <= 0 or window <= 0:
        raise ValueError("seconds and quiet must be positive")
    out, at = [], 0
    while n - at > step:
        low, high = max(at + step // 2, at + step - reach), min(n - window, at + step + reach)
        cut = low + quietest_window(read(low, high + window), window) + window // 2 if high > low else at + step
        out.append((at, cut, "quiet", None, None))
        at = cut
    return [*out, (at, n, "end", None, None)] if at < n else out


PLAN = "path string, chunk int, start_sample long, end_sample long, start double, end double, source string, level double, pause double"


def plan(recordings: DataFrame, seconds: float | None = None) -> DataFrame:
    """(path, chunk, start_sample, end_sample, start, end, source, level, pause) of WAV files (path, regions
    array<struct<s,e>>, which may be null): chunks of about ``seconds``, or, without it, of a bounded engine. A row a
    recording, since each cut depends on the cut before it; of its samples only the ranges around targets are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for path, regions in zip(part["path"], part["regions"], strict=True):
                own = wav.look(path)
                read = lambda a, b, path=path, own=own: np.frombuffer(wav.samples(path, own, a, b), dtype="<i2")
                speech = sorted((float(r["s"]), float(r["e"])) for r in regions) if regions is not None else []
                cuts = bounded(own.samples, own.rate, read) if seconds is None else planned(own.samples, own.rate, seconds, speech, read)
                out += [(path, i, a, b, round(a / own.rate, 6), round(b / own.rate, 6), *rest) for i, (a, b, *rest) in enumerate(cuts)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])

    return recordings.select("path", "regions").mapInPandas(run, PLAN)


def windows(rows: DataFrame, keys: list[str], n: int = QUIET_FRAMES) -> DataFrame:
    """Energy of the window of ``n`` frames that ends at each frame, by running sums; full windows only."""
    w = Window.partitionBy(*keys).orderBy("frame")
    total = F.sum("energy").over(w)
    return rows.withColumn("_t", total).withColumn("window", F.col("_t") - F.coalesce(F.lag("_t", n).over(w), F.lit(0))).where(F.col("frame") >= n - 1).drop("_t")


def quietest(rows: DataFrame, keys: list[str], target: str, n: int = QUIET_FRAMES) -> DataFrame:
    """(keys, centre, window): the quietest window; of equal ones the one nearest to the column ``target``."""
    centre = F.col("frame") - n // 2
    best = F.min(F.struct("window", F.abs(centre - F.col(target)).alias("d"), centre.alias("centre")))
    return windows(rows, keys, n).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.centre", "b.window")


def join_chunks(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Segments of chunk results on the recording's timeline: shifted, cut at the chunk's end, without those beyond it."""
    c = chunks.select("doc", "chunk", F.col("s").alias("off"), (F.col("e") - F.col("s")).alias("len"))
    rows = results.join(c, ["doc", "chunk"]).where("s < len")
    return rows.select("doc", "chunk", "n", (F.col("off") + F.greatest(F.col("s"), F.lit(0))).alias("s"), (F.col("off") + F.least("e", "len")).alias("e"), "text").where("e > s")


def work_list(chunks: DataFrame, cached: DataFrame) -> DataFrame:
    """Chunks whose key has no stored result."""
    return chunks.join(cached.select("key").distinct(), "key", "left_anti")
