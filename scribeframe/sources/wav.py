"""WAV recordings as rows of samples: a batch reader that deals a file out by ranges, a reader of files that still grow, and
a writer of chunks. 16-bit mono PCM; headers of any length, with any other chunks in them.

``spark.dataSource.register(wav.Pcm)``, then ``spark.read.format("pcm").load(path)`` or ``spark.readStream.format("pcm")``.
A path is a file or a folder of ``*.wav``, local or in any store that pyarrow opens. Rows: (path, start, rate, pcm), start in
samples; pcm as little-endian bytes.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start long, rate int, pcm binary"
#: samples of a row and of a partition; multiples of a 20 ms frame at all usual rates, so that no frame lies across rows
ROW, PART = 282_240, 34 * 282_240
#: seconds of audio that a growing file gains before they are read, and seconds without growth after which the rest is
WINDOW, IDLE = 5.0, 30.0
#: bytes of a file that are searched for the header's end
HEADER = 1 << 20
#: what writers put as the length of audio that is still being written
OPEN = (0, 0xFFFFFFFF)


@dataclass(frozen=True)
class Layout:
    rate: int
    offset: int
    samples: int


def opened(path: str):
    """(store, path in it) of a path or URI."""
    return stores.FileSystem.from_uri(path) if "://" in path else (stores.LocalFileSystem(), path)


def layout(head: bytes, size: int) -> Layout | None:
    """Rate, place and number of the samples of a file of ``size`` bytes; None while its header isn't complete."""
    if len(head) < 12:
        return None
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, None
    while at + 8 <= len(head):
        name, length = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        at += 8
        if name == b"fmt ":
            if at + 16 > len(head):
                return None
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, at)
            if channels != 1 or bits != 16:
                raise ValueError("not 16-bit mono PCM")
        if name == b"data":
            if rate is None:
                raise ValueError("samples before their format")
            there = max(0, size - at)
            return Layout(rate, at, (there if length in OPEN else min(length, there)) // 2)
        at += length + length % 2
    return None


def look(path: str) -> Layout | None:
    store, own = opened(path)
    size = store.get_file_info(own).size or 0
    with store.open_input_file(own) as f:
        return layout(f.read(min(size, HEADER)), size)


def samples(path: str, own: Layout, start: int, end: int) -> bytes:
    store, inner = opened(path)
    with store.open_input_file(inner) as f:
        f.seek(own.offset + 2 * start)
        return f.read(2 * max(0, min(end, own.samples) - start))


def listed(path: str) -> dict[str, tuple[int, float]]:
    """Each WAV file of a path with its size and the time of its last change."""
    store, own = opened(path)
    info = store.get_file_info(own)
    found = [info] if info.type == stores.FileType.File else store.get_file_info(stores.FileSelector(own)) if info.type == stores.FileType.Directory else []
    prefix = path[: len(path) - len(own)] if path.endswith(own) else path.split("://")[0] + "://" if "://" in path else ""
    return {prefix + x.path: (x.size or 0, (x.mtime_ns or 0) / 1e9) for x in sorted(found, key=lambda x: x.path) if x.type == stores.FileType.File and (x is info or x.path.endswith(".wav"))}


@dataclass
class Range(InputPartition):
    path: str
    layout: Layout
    start: int
    end: int


def ranges(path: str, own: Layout, start: int, end: int, part: int) -> list[Range]:
    return [Range(path, own, a, min(a + part, end)) for a in range(start, end, part)]


def rows(x: Range) -> Iterator[tuple[str, int, int, bytes]]:
    for a in range(x.start, x.end, ROW):
        yield x.path, a, x.layout.rate, samples(x.path, x.layout, a, min(a + ROW, x.end))


class Ranges(DataSourceReader):
    """All samples of all files; option ``part``: samples of a partition."""

    def __init__(self, options: dict[str, str]):
        self.path, self.part = options["path"], int(options.get("part", PART))
        if self.part <= 0 or self.part % ROW:
            raise ValueError(f"part must be a multiple of {ROW}")

    def partitions(self) -> list[Range]:
        found = [(p, look(p)) for p in listed(self.path)]
        return [r for p, own in found if own for r in ranges(p, own, 0, own.samples, self.part)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, int, bytes]]:
        return rows(partition) if partition else iter(())


class Growing(DataSourceStreamReader):
    """What is added to files while they are written. An offset holds each file's samples read so far. A file is admitted
    once it has grown by ``window_seconds``, or has more and hasn't changed for ``idle_seconds``; a file whose header isn't
    complete waits."""

    def __init__(self, options: dict[str, str]):
        self.path, self.window, self.idle = options["path"], float(options.get("window_seconds", WINDOW)), float(options.get("idle_seconds", IDLE))
        self.admitted: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        now = time.time()
        for path, (_, changed) in listed(self.path).items():
            own, before = look(path), self.admitted.get(path, 0)
            if own and own.samples > before and (own.samples - before >= self.window * own.rate or now - changed >= self.idle):
                self.admitted[path] = own.samples
        return {"files": json.dumps(self.admitted, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        first, last = json.loads(start["files"]), json.loads(end["files"])
        for path, n in (*first.items(), *last.items()):  # after a restart, what the checkpoint says has been read
            self.admitted[path] = max(n, self.admitted.get(path, 0))
        return [r for path, n in sorted(last.items()) if n > first.get(path, 0) for r in ranges(path, look(path), first.get(path, 0), n, PART)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, int, bytes]]:
        return rows(partition)


class Pcm(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Ranges(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Growing(dict(self.options))


def header(rate: int, n: int) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 2 * n)


def write_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """(path, chunk, file, samples, fingerprint) of chunks (path, chunk, start_sample, end_sample): each range of samples as
    a WAV file of its own in a shared folder, copied a row's length at a time. A file takes its name when it is whole, so a
    task that runs again does no harm; the name comes from the path and the range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for part in batches:
            out = []
            for path, chunk, start, end in zip(part["path"], part["chunk"], part["start_sample"], part["end_sample"], strict=True):
                own = look(path)
                start, end = max(0, int(start)), max(int(start), min(int(end), own.samples))
                name = f"{root}/{hashlib.sha256(f'{path} {start} {end}'.encode()).hexdigest()[:24]}-{int(chunk):06d}.wav"
                digest, unfinished = hashlib.sha256(), f"{name}.{time.time_ns():x}.part"
                with store.open_output_stream(unfinished) as f:
                    f.write(header(own.rate, end - start))
                    for a in range(start, end, ROW):
                        pcm = samples(path, own, a, min(a + ROW, end))
                        digest.update(pcm)
                        f.write(pcm)
                store.move(unfinished, name)
                out.append((path, int(chunk), name, end - start, f"sha256:{digest.hexdigest()}"))
            yield pd.DataFrame(out, columns=["path", "chunk", "file", "samples", "fingerprint"])

    return chunks.select("path", "chunk", "start_sample", "end_sample").mapInPandas(run, "path string, chunk int, file string, samples long, fingerprint string")
