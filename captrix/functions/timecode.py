"""Timestamps, frames and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from captrix.schema import SCC_FPS, STL_FPS

#: Timestamp patterns.
CLOCK = r"^(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"
LOOSE = r"^(?:(\d{1,4}):)?(\d{1,2}):(\d{1,2})[,.](\d{1,3})\z"
RANGE = r"^((?:\d{1,4}:)?\d{1,2}:\d{1,2}[,.]\d{1,3}) --> ((?:\d{1,4}:)?\d{1,2}:\d{1,2}[,.]\d{1,3})(?: (.*))?\z"


def _n(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("long")


def div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def parse_timestamp(c: Column) -> Column:
    """Milliseconds of ``h:mm:ss,mmm`` (what follows is ignored) or of ``[h:]m:s.f``; null for anything else."""
    fast = (_n(c, CLOCK, 1) * 3600 + _n(c, CLOCK, 2) * 60 + _n(c, CLOCK, 3)) * 1000 + _n(c, CLOCK, 4)
    slow = (F.coalesce(_n(c, LOOSE, 1), F.lit(0)) * 3600 + _n(c, LOOSE, 2) * 60 + _n(c, LOOSE, 3)) * 1000 + _n(c, LOOSE, 4)
    return F.when((F.octet_length(c) >= 11) & c.rlike(CLOCK), fast).when(c.rlike(LOOSE), slow)


def parse_timestamps(c: Column) -> Column:
    """struct(start, end, settings) of ``a --> b settings``."""
    part = lambda k: F.regexp_extract(c, RANGE, k)
    return F.struct(parse_timestamp(part(1)).alias("start"), parse_timestamp(part(2)).alias("end"), F.when(part(3) != "", part(3)).alias("settings"))


def pad_left(c: Column, length: int) -> Column:
    """Decimal number with zeros in front, never cut."""
    return F.format_string(f"%0{max(1, length)}d", c.cast("long"))


def format_timestamp(ms: Column, style: str = "srt") -> Column:
    """``HH:MM:SS,mmm``, with a point for WebVTT."""
    point = "." if style.lower() in ("webvtt", "vtt") else ","
    return F.format_string(f"%02d:%02d:%02d{point}%03d", div(ms, 3600000), div(ms, 60000) % 60, div(ms, 1000) % 60, ms % 1000)


def format_ass_time(ms: Column) -> Column:
    return F.format_string("%d:%02d:%02d.%02d", div(ms, 3600000), div(ms, 60000) % 60, div(ms, 1000) % 60, div(ms % 1000, 10))


def format_subviewer_time(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d.%02d", div(ms, 3600000), div(ms, 60000) % 60, div(ms, 1000) % 60, div(ms % 1000, 10))


def format_sbv_time(ms: Column) -> Column:
    return F.format_string("%d:%02d:%02d.%03d", div(ms, 3600000), div(ms, 60000) % 60, div(ms, 1000) % 60, ms % 1000)


def format_lrc_time(ms: Column) -> Column:
    return F.format_string("[%02d:%02d.%02d]", div(ms, 60000), div(ms, 1000) % 60, div(ms % 1000, 10))


def ms_to_frames(ms: Column, fps: float) -> Column:
    return F.greatest(F.lit(0), F.round(ms * F.lit(float(fps)) / 1000)).cast("long")


def frames_to_ms(frames: Column, fps: float) -> Column:
    return F.greatest(F.lit(0), F.round(frames * F.lit(1000.0) / F.lit(float(fps)))).cast("long")


def mpl2_frame_to_ms(frame: Column, fps: float) -> Column:
    return F.round(frame / F.lit(float(fps)) * 1000).cast("long")


def mpl2_ms_to_frame(ms: Column, fps: float) -> Column:
    return F.round(ms / F.lit(1000.0) * F.lit(float(fps))).cast("long")


def parse_ass_color(c: Column) -> Column:
    """struct(r, g, b, a) of ``&HAABBGGRR``; what is no such number is opaque white (00FFFFFF)."""
    digits = F.regexp_replace(c, "^&[Hh]", "")
    n = F.coalesce(F.when(digits.rlike(r"^[0-9A-Fa-f]{1,8}\z"), F.conv(digits, 16, 10).try_cast("long")), F.lit(0xFFFFFF).cast("long"))
    byte = lambda k: F.shiftright(n, 8 * k).bitwiseAND(255).cast("int")
    return F.struct(byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"), byte(3).alias("a"))


def format_ass_color(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.format_string("&H%02X%02X%02X%02X", a.cast("int"), b.cast("int"), g.cast("int"), r.cast("int"))


def scc_timecode_to_ms(h: Column, m: Column, s: Column, f: Column, drop: Column, fps: float = SCC_FPS) -> Column:
    """Nominal frame count less two a minute (not every tenth) for drop frame, at the true rate."""
    minutes = h * 60 + m
    frames = (h * 3600 + m * 60 + s) * round(fps) + f - F.when(drop, 2 * (minutes - div(minutes, 10))).otherwise(F.lit(0))
    return F.round(frames / F.lit(float(fps)) * 1000).cast("long")


def ms_to_scc_timecode(ms: Column, drop: Column, fps: float = SCC_FPS) -> Column:
    """``HH:MM:SS;FF`` (drop frame) or ``HH:MM:SS:FF``."""
    nominal = round(fps)
    frames = F.round((ms % 3600000) * F.lit(float(fps)) / 1000).cast("long")
    # ten minutes drop 18 frames; within them every minute but the first drops two
    tens = div(frames, 600 * nominal - 18)
    minute = tens * 10 + F.least(F.lit(9), div(frames - tens * (600 * nominal - 18), 60 * nominal - 2))
    left = frames - (minute * (60 * nominal) - 2 * (minute - div(minute, 10)))
    hours = div(ms, 3600000)
    dropped = F.format_string("%02d:%02d:%02d;%02d", hours, minute, div(left, nominal), left % nominal)
    plain = F.format_string("%02d:%02d:%02d:%02d", hours, div(frames, 60 * nominal), div(frames % (60 * nominal), nominal), frames % nominal)
    return F.when(drop, dropped).otherwise(plain)


def smpte_frames(ms: Column) -> Column:
    """struct(h, m, s, f) at 25 frames a second."""
    n = F.round(ms / F.lit(1000.0) * F.lit(STL_FPS)).cast("long")
    return F.struct(div(n, 90000).alias("h"), (div(n, 1500) % 60).alias("m"), (div(n, 25) % 60).alias("s"), (n % 25).alias("f"))


def smpte_to_ms(h: Column, m: Column, s: Column, f: Column) -> Column:
    return F.round(((h * 3600 + m * 60 + s) * 25 + f) / F.lit(STL_FPS) * 1000).cast("long")
