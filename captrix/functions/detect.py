"""Format detection as one column expression over the bytes of a file."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from captrix.functions.text import WS, lines, trim_ws

#: What tells formats apart, in the order in which they are tried.
SRT_HEAD = rf"^\d+{WS}*\n\d{{2}}:\d{{2}}:\d{{2}}[,.]\d{{3}}{WS}*-->"
MICRODVD = r"\{\d+\}\{\d+\}"
SUBVIEWER = r"^\d{1,2}:\d{2}:\d{2}\.\d{2},\d{1,2}:\d{2}:\d{2}\.\d{2}\z"
BRACKETS = r"^\[.*\]"
DFXP = ("http://www.w3.org/2006/04/ttaf1", "http://www.w3.org/2006/10/ttaf1")
TTML = "http://www.w3.org/ns/ttml"
LRC, LRC_MAX_LINES = r"\[\d{1,3}:\d{1,2}\.\d{1,3}\]", 500
MPL2 = r"^\[\d+\]\[\d+\].+"
EXTENSIONS = {"srt": "srt", "vtt": "vtt", "ass": "ass", "ssa": "ssa", "sub": "microdvd", "ttml": "ttml", "xml": "ttml", "sbv": "sbv", "lrc": "lrc", "smi": "sami", "sami": "sami", "mpl": "mpl2", "scc": "scc", "stl": "ebu_stl"}


def detect_text(text: Column) -> Column:
    """Format of decoded text, or null."""
    trimmed, rows = trim_ws(text), lines(text)
    has = lambda *parts: functools.reduce(operator.and_, [text.contains(p) for p in parts])
    some = lambda test: F.exists(rows, test)
    first = F.get(F.filter(F.transform(rows, trim_ws), lambda x: (x != "") & ~x.rlike(BRACKETS)), F.lit(0))
    colon_point = lambda x: x.contains(":") & x.contains(".")
    fields = lambda x: F.split(trim_ws(x), ",", 3)
    sbv = some(lambda x: trim_ws(x).rlike(r"^[0-9]") & (F.size(fields(x)) >= 3) & colon_point(F.get(fields(x), F.lit(0))) & colon_point(F.get(fields(x), F.lit(1))))
    rules = [
        (trimmed.startswith("WEBVTT"), "vtt"),
        (trimmed.rlike(SRT_HEAD), "srt"),
        (has("[Script Info]") & (has("V4+ Styles") | has("V4 Styles")), "ass"),
        (has("[Script Info]"), "ssa"),
        (text.rlike(MICRODVD), "microdvd"),
        (F.coalesce(first.rlike(SUBVIEWER), F.lit(False)), "subviewer"),
        (has(DFXP[0]) | has(DFXP[1]), "dfxp"),
        (has("<tt", TTML), "ttml"),
        (has('"segments"', '"start"', '"end"'), "whisper"),
        (sbv, "sbv"),
        ((F.size(rows) < LRC_MAX_LINES) & some(lambda x: x.rlike(LRC)), "lrc"),
        (has("<SAMI>") | has("<Sync"), "sami"),
        (some(lambda x: trim_ws(x).rlike(MPL2)), "mpl2"),
        (text.startswith("Scenarist_SCC"), "scc"),
    ]
    out = F.lit(None).cast("string")
    for test, name in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def is_stl(content: Column) -> Column:
    """1024 bytes of head and blocks of 128, as many as the head says."""
    size = F.octet_length(content)
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")
    shape = (size >= 1024) & ((size - 1024) % 128 == 0)
    return F.when(shape, (number(1, 1) < 32) & (number(2, 2) > 0) & (number(2, 2) * 128 == size - 1024)).otherwise(F.lit(False))


def detect_format(content: Column) -> Column:
    """Format of a file's bytes, or null. Text rules come first; the byte order mark is not removed before them."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.coalesce(detect_text(text), F.when(is_stl(content), F.lit("ebu_stl")))


def format_of_path(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    out = F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        out = F.when(extension == k, F.lit(v)).otherwise(out)
    return out
