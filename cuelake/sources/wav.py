"""16-bit WAV files as rows of windowed energy; the first channel counts."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(content: bytes, frames: int) -> list[tuple[int, int, float]]:
    """(window, samples, mean square) of ``frames`` samples each; other sample sizes fail."""
    with wave.open(io.BytesIO(content)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        channels, out, i = f.getnchannels(), [], 0
        while raw := f.readframes(frames):
            x = np.frombuffer(raw, "<i2")[::channels].astype(np.float64)
            out.append((i, len(x), float((x * x).mean())))
            i += 1
        return out


def duration(content: bytes) -> float:
    """Seconds to three places; 0 of what cannot be read."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            return round(f.getnframes() / f.getframerate(), 3)
    except (wave.Error, EOFError, ZeroDivisionError):
        return 0.0


def read_energy(spark: SparkSession, path: str, frames: int) -> DataFrame:
    """Ep, window, n, mean_square of every file; only one window is held at a time."""

    def scan(batches):
        for pdf in batches:
            for ep, content in zip(pdf["ep"], pdf["content"]):
                yield pd.DataFrame([(ep, *w) for w in windows(bytes(content), frames)], columns=["ep", "window", "n", "mean_square"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("ep"), "content")
    return files.mapInPandas(scan, "ep string, window long, n long, mean_square double")


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    """Ep, seconds of every file; 0 for what cannot be read."""

    def scan(batches):
        for pdf in batches:
            yield pd.DataFrame({"ep": pdf["ep"], "seconds": [duration(bytes(c)) for c in pdf["content"]]})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("ep"), "content")
    return files.mapInPandas(scan, "ep string, seconds double")
