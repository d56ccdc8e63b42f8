"""Times: frame grid, SRT timestamps, reading speed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snap_floor(ms: Column, fps: Column | float) -> Column:
    """The last frame start at or before ``ms``, its milliseconds truncated."""
    frame = F.lit(1000.0) / fps
    return F.floor(F.floor(ms / frame + 1e-9) * frame).cast("long")


def snap_ceil(ms: Column, fps: Column | float) -> Column:
    """``snap_floor``, or one frame later where truncation fell below ``ms``."""
    frame = F.lit(1000.0) / fps
    n = F.floor(ms / frame + 1e-9)
    low = F.floor(n * frame).cast("long")
    return F.when(low < ms - 1e-9, F.floor((n + 1) * frame).cast("long")).otherwise(low)


def aligned(ms: Column, fps: Column | float) -> Column:
    """Whether ``ms`` is within a millisecond of a frame."""
    low, high = snap_floor(ms, fps), snap_ceil(ms, fps)
    return F.least(F.abs(ms - low), F.abs(high - ms)) <= 1


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; more digits of hours where needed."""
    whole = lambda a: F.floor(a).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", whole(ms / 3_600_000), whole(ms / 60_000) % 60, whole(ms / 1000) % 60, ms % 1000)


def parse_srt_time(text: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm; null if it is none."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d{2}):(\d{2})[,.](\d{3})$", i).try_cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def cps(width: Column, duration_ms: Column) -> Column:
    """Characters per second to three places; 0 without a duration."""
    return F.when(duration_ms > 0, F.round(width / (duration_ms / 1000.0), 3)).otherwise(F.lit(0.0))
