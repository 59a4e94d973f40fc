"""Times as text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srt_time(sec: Column) -> Column:
    """HH:MM:SS,mmm, half-even."""
    ms = F.bround(F.greatest(sec, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock(sec: Column) -> Column:
    """H:MM:SS, whole seconds downwards."""
    s = F.floor(sec).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def minutes(sec: Column) -> Column:
    """MM:SS, whole seconds downwards; minutes may pass 59."""
    s = F.floor(sec).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def parse_time(text: Column) -> Column:
    """Seconds of [[h:]m:]s."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))


def ass_seconds(text: Column) -> Column:
    """Seconds of H:MM:SS.cc; null if it has another form."""
    p = r"^(\d+):(\d\d):(\d\d)[.:](\d\d)$"
    part = lambda i: F.regexp_extract(F.trim(text), p, i).cast("int")
    return F.when(F.trim(text).rlike(p), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 100.0)
