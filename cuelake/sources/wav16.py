"""16-bit PCM WAV files as a data source: a file is read in ranges of windows, by as many tasks.

Only headers are read where the plan is made. Filters on the episode leave files out, those on the window
leave ranges out. Paths are anything that Arrow's file systems open (local, HDFS, S3 and others).
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


@dataclass(frozen=True)
class Header:
    """Where the samples lie: first byte, channels, frames a second, frames."""

    start: int
    channels: int
    rate: int
    frames: int


def header(file) -> Header:
    """Reads the chunks before the samples; other than 16-bit PCM is refused, a cut file counts what it holds."""
    file.seek(0, 2)
    size = file.tell()
    file.seek(0)
    riff = file.read(12)
    if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    shape = None
    while len(head := file.read(8)) == 8:
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(length)[:16])
            if kind not in (1, 0xFFFE) or bits != 16:
                raise ValueError("only 16-bit PCM is read")
            shape = channels, rate
            file.seek(length & 1, 1)
        elif name == b"data":
            if shape is None:
                raise ValueError("samples before their format")
            start = file.tell()
            return Header(start, *shape, min(length, size - start) // (2 * shape[0]))
        else:
            file.seek(length + (length & 1), 1)
    raise ValueError("no samples")


def listed(path: str) -> tuple[object, list[tuple[str, str]]]:
    """(file system, (episode, file) of a file, a folder's *.wav or a pattern in the last part of the path)."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    folder, pattern = root.rstrip("/"), "*.wav"
    if any(c in posixpath.basename(folder) for c in "*?["):
        folder, pattern = posixpath.split(folder)
    info = system.get_file_info(folder)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info.path] if info.is_file else sorted(x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file and fnmatch.fnmatch(x.base_name.lower(), pattern.lower()))
    return system, [(posixpath.splitext(posixpath.basename(f))[0], f) for f in files]


@dataclass
class Windows(InputPartition):
    ep: str
    file: str
    head: Header
    first: int
    stop: int


class Wav16Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("frames", "1600"))
        self.each = int(options.get("windows", "4096"))
        if self.size < 1 or self.each < 1:
            raise ValueError("frames and windows must be at least 1")
        self.eps: set[str] | None = None
        self.first, self.stop = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kept = self._take(f)
            if not kept:
                yield f

    def _take(self, f: Filter) -> bool:
        if isinstance(f, (EqualTo, In)) and f.attribute == ("ep",):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.eps = wanted if self.eps is None else self.eps & wanted
            return True
        bounds = {EqualTo: (0, 1), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, 0), LessThanOrEqual: (None, 1)}
        if getattr(f, "attribute", None) != ("window",) or type(f) not in bounds or f.value is None:
            return False
        lo, hi = bounds[type(f)]
        if lo is not None:
            self.first = max(self.first, f.value + lo)
        if hi is not None:
            self.stop = f.value + hi if self.stop is None else min(self.stop, f.value + hi)
        return True

    def partitions(self) -> list[Windows]:
        system, files = listed(self.path)
        out = []
        for ep, name in files:
            if self.eps is not None and ep not in self.eps:
                continue
            with system.open_input_file(name) as file:
                head = header(file)
            n = -(-head.frames // self.size)
            stop = n if self.stop is None else min(n, self.stop)
            out += [Windows(ep, name, head, i, min(i + self.each, stop)) for i in range(self.first, stop, self.each)]
        return out

    def read(self, part: Windows) -> Iterator[pa.RecordBatch]:
        system, _ = listed(self.path)
        width = 2 * part.head.channels
        with system.open_input_file(part.file) as file:
            file.seek(part.head.start + part.first * self.size * width)
            for at in range(part.first, part.stop, 256):
                windows = range(at, min(at + 256, part.stop))
                frames = min(len(windows) * self.size, part.head.frames - at * self.size)
                x = np.frombuffer(file.read(frames * width), "<i2")[:: part.head.channels].astype(np.float64)
                edges = np.arange(0, len(x), self.size)
                n = np.diff(np.append(edges, len(x)))
                yield pa.RecordBatch.from_arrays([pa.array([part.ep] * len(n)), pa.array(np.arange(at, at + len(n))), pa.array(n), pa.array(np.add.reduceat(x * x, edges) / n)], names=["ep", "window", "n", "mean_square"])


class Wav16(DataSource):
    """``wav16``: ep, window, n, mean_square of the first channel. Options: path, frames a window, windows a partition."""

    @classmethod
    def name(cls) -> str:
        return "wav16"

    def schema(self) -> str:
        return "ep string, window long, n long, mean_square double"

    def reader(self, schema) -> Wav16Reader:
        return Wav16Reader(self.options)


def wav_energy(spark: SparkSession, path: str, frames: int, windows: int = 4096) -> DataFrame:
    """The energy of every file's windows. Filters are pushed where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Wav16)
    return spark.read.format("wav16").option("frames", str(frames)).option("windows", str(windows)).load(path)
