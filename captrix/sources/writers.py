"""Cues to the text (or bytes) of files, one row a file: file_id, content."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrix.functions import timecode as tc
from captrix.schema import DEFAULT_FPS, DEFAULT_STYLE, STYLE, canonical_format

#: What files begin with.
ASS_INFO = "Title: <untitled>\nScriptType: v4.00+\nPlayResX: 384\nPlayResY: 288\nWrapStyle: 0\n"
ASS_STYLE_FORMAT = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
ASS_EVENT_FORMAT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
SUBVIEWER_HEAD = "[INFORMATION]\n[TITLE]Subtitles\n[AUTHOR]{author}\n[SOURCE]\n[FILEPATH]\n[DELAY]0\n[COMMENT]\n[END INFORMATION]\n[SUBTITLE]\n[COLF]&HFFFFFF,[STYLE]bd,[SIZE]18,[FONT]Arial"
SAMI_HEAD = '<Head>\n<Title>Subtitles</Title>\n<Style Type="text/css">\n<!--\n  .ENCC {Name: English; lang: en-US;}\n-->\n</Style>\n</Head>\n'


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def style_line(s: dict) -> str:
    flags = lambda v: "-1" if v else "0"
    shown = []
    for f in STYLE:
        v = s[f.name]
        shown.append(flags(v) if isinstance(f.dataType, T.BooleanType) else _number(v) if isinstance(f.dataType, (T.DoubleType, T.LongType)) else v or ("&H00FFFFFF" if f.name.endswith("color") else ""))
    return "Style: " + ",".join(shown) + "\n"


def style_column(s: Column) -> Column:
    """The same line from a struct column."""
    number = lambda c: F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))
    shown = []
    for f in STYLE:
        v = s[f.name]
        if isinstance(f.dataType, T.BooleanType):
            v = F.when(v, F.lit("-1")).otherwise(F.lit("0"))
        elif isinstance(f.dataType, T.DoubleType):
            v = number(v)
        elif f.name.endswith("color"):
            v = F.when(F.coalesce(v, F.lit("")) == "", F.lit("&H00FFFFFF")).otherwise(v)
        shown.append(F.coalesce(v.cast("string"), F.lit("")))
    return F.concat(F.lit("Style: "), F.concat_ws(",", *shown), F.lit("\n"))


def cue_text(fmt: str, fps: float = DEFAULT_FPS, stored_index: bool = False) -> Column:
    """One cue's part of a line-based file. Needs ``start_ms``, ``end_ms``, ``text``, ``pos`` and the cue's other columns."""
    start, end, text = F.col("start_ms"), F.col("end_ms"), F.coalesce("text", F.lit(""))
    number = F.coalesce(F.col("index"), F.col("pos") + 1) if stored_index else F.col("pos") + 1
    times = lambda style: F.concat(tc.format_timestamp(start, style), F.lit(" --> "), tc.format_timestamp(end, style))
    frames = lambda a, b: (F.format_string("%s%d%s", F.lit(a), tc.ms_to_frames(start, fps), F.lit(b)), F.format_string("%s%d%s", F.lit(a), tc.ms_to_frames(end, fps), F.lit(b)))
    hexed = F.rtrim(F.regexp_replace(F.hex(F.regexp_replace(text, "[^ -~]", "")), "(..)", "00$1 "))
    drop = F.coalesce(F.col("drop_frame"), F.lit(True)) if fmt == "scc" else F.lit(True)
    made = {
        "srt": lambda: F.concat(number.cast("string"), F.lit("\n"), times("srt"), F.lit("\n"), text),
        "vtt": lambda: F.concat(number.cast("string"), F.lit("\n"), times("vtt"), F.when(F.col("settings").isNotNull(), F.concat(F.lit(" "), F.col("settings"))).otherwise(F.lit("")), F.lit("\n"), text),
        "ass": lambda: F.concat(F.when(F.col("is_comment"), F.lit("Comment: 0,")).otherwise(F.lit("Dialogue: 0,")), tc.format_ass_time(start), F.lit(","), tc.format_ass_time(end), F.lit(","),
                                F.coalesce("style", F.lit("Default")), F.lit(","), F.coalesce("actor", F.lit("")), F.lit(",0,0,0,,"), text, F.lit("\n")),
        "microdvd": lambda: F.concat(*frames("{", "}"), F.replace(text, F.lit("\n"), F.lit("|")), F.lit("\n")),
        "subviewer": lambda: F.concat(tc.format_subviewer_time(start), F.lit(","), tc.format_subviewer_time(end), F.lit("\n"), text, F.lit("\n\n")),
        "sbv": lambda: F.concat(tc.format_sbv_time(start), F.lit(","), tc.format_sbv_time(end), F.lit(","), text, F.lit("\n")),
        "lrc": lambda: F.concat(tc.format_lrc_time(start), text, F.lit("\n")),
        "sami": lambda: F.concat(F.lit("<Sync Start="), start.cast("string"), F.lit("><P>"), text, F.lit("</P></Sync>\n")),
        "mpl2": lambda: F.concat(F.lit("["), tc.mpl2_ms_to_frame(start, DEFAULT_FPS).cast("string"), F.lit("]["), tc.mpl2_ms_to_frame(end, DEFAULT_FPS).cast("string"), F.lit("]"), text, F.lit("\n")),
        "scc": lambda: F.concat(tc.ms_to_scc_timecode(start, drop), F.lit("\t9420 94ad "), hexed, F.lit(" 942f\n"), tc.ms_to_scc_timecode(end, drop), F.lit("\t942c\n\n")),
    }
    return made["ass" if fmt == "ssa" else fmt]()


def _joined(cues: DataFrame, part: Column, between: str) -> DataFrame:
    """file_id, body: the parts of a file's cues in order."""
    placed = cues.select("file_id", F.struct("pos", part.alias("part")).alias("x"))
    return placed.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), between).alias("body"))


def render(cues: DataFrame, fmt: str, files: DataFrame | None = None, fps: float | None = None, keep_header: bool = False, render_from_cues: bool = True, author: str = "captrix",
           stored_index: bool = False) -> DataFrame:
    """file_id and content of every file that has cues.

    ``files`` gives headers, script info, styles and drop-frame flags. ``keep_header`` writes WebVTT headers too. With
    ``render_from_cues`` off, LRC is written from the parsed lines with several stamps; with ``stored_index``, SubRip and
    WebVTT cues keep the numbers that they came with, as streams write them.
    """
    fmt = canonical_format(fmt)
    if fmt in ("ttml", "dfxp", "whisper", "ebu_stl"):
        return _render_python(cues, fmt, files)
    if fmt == "lrc" and not render_from_cues and files is not None:
        stamp = lambda x: F.array_join(F.transform(x["times_ms"], tc.format_lrc_time), "")
        return files.select("file_id", F.array_join(F.transform("lrc_lines", lambda x: F.concat(stamp(x), x["text"], F.lit("\n"))), "").alias("content"))
    rate = fps or DEFAULT_FPS
    if fmt == "scc":
        flags = files.select("file_id", "drop_frame") if files is not None else None
        cues = cues.join(flags, "file_id", "left") if flags is not None else cues.withColumn("drop_frame", F.lit(True))
    body = _joined(cues, cue_text(fmt, rate, stored_index), "\n\n" if fmt in ("srt", "vtt") else "")
    meta = files.select("file_id", "header", "info", "styles") if files is not None else None
    body = body.join(meta, "file_id", "left") if meta is not None else body.withColumns({"header": F.lit(None).cast("string"), "info": F.lit(None).cast("map<string,string>"), "styles": F.lit(None).cast(T.ArrayType(STYLE))})
    text = F.col("body")
    if fmt == "srt":
        text = F.concat(text, F.lit("\n"))
    elif fmt == "vtt":
        text = F.concat(F.coalesce("header", F.lit("WEBVTT")) if keep_header else F.lit("WEBVTT"), F.lit("\n\n"), text, F.lit("\n"))
    elif fmt in ("ass", "ssa"):
        pairs = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
        info = F.when(F.col("info").isNull() | (F.size("info") == 0), F.lit(ASS_INFO)).otherwise(pairs)
        styles = F.when(F.col("styles").isNull(), F.lit(style_line(DEFAULT_STYLE))).otherwise(F.array_join(F.transform("styles", style_column), ""))
        text = F.concat(F.lit("[Script Info]\n"), info, F.lit("\n[V4+ Styles]\n" + ASS_STYLE_FORMAT), styles, F.lit("\n[Events]\n" + ASS_EVENT_FORMAT), text)
    elif fmt == "microdvd" and abs(rate - DEFAULT_FPS) > 1e-9:
        text = F.concat(F.lit(f"{{1}}{{1}}{rate:.3f}\n"), text)
    elif fmt == "subviewer":
        text = F.concat(F.coalesce("header", F.lit(SUBVIEWER_HEAD.format(author=author))), F.lit("\n\n"), text)
    elif fmt == "sami":
        text = F.concat(F.lit("<SAMI>\n"), F.coalesce("header", F.lit(SAMI_HEAD)), F.lit("\n<Body>\n"), text, F.lit("</Body>\n</SAMI>\n"))
    elif fmt == "scc":
        text = F.concat(F.lit("Scenarist_SCC V1.0\n\n"), text)
    return body.select("file_id", text.alias("content"))


def ttml_text(rows: list[dict], header: str | None) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="http://www.w3.org/ns/ttml#styling" xml:lang="en">']
    if header:
        out.append(f"  <head>{header}</head>")
    out += ["  <body>", "    <div>"]
    for r in rows:
        if r["text_parts"]:
            styled = lambda p: p["color"] or p["bold"] or p["italic"] or p["underline"]
            inner = "".join(f"<span{f' tts:color={quoteattr(p['color'])}' if p['color'] else ''}>{escape(p['text'])}</span>" if styled(p) else escape(p["text"]) for p in r["text_parts"])
        else:
            inner = escape(r["text"] or "")
        out.append(f'      <p begin="{r["begin"]}" end="{r["finish"]}">{inner}</p>')
    return "\n".join([*out, "    </div>", "  </body>", "</tt>"])


def whisper_text(rows: list[dict]) -> str:
    segments = [{"avg_logprob": -1.0, "compression_ratio": 1.0, "end": r["end_ms"] / 1000.0, "id": r["index"] or 0, "no_speech_prob": 0.0, "seek": 0, "start": r["start_ms"] / 1000.0, "temperature": 0.0, "text": r["text"] or "", "tokens": []}
                for r in rows]
    return json.dumps({"segments": segments, "text": " ".join(r["text"] or "" for r in rows)}, indent=2, ensure_ascii=False)


STL_TEXT = 112


def stl_bytes(rows: list[dict]) -> bytes:
    """Head and text blocks; a text of more than ``STL_TEXT`` bytes goes on in extension blocks, the last of which is marked FF."""
    out = [bytes(1024)]
    for i, r in enumerate(rows, 1):
        text = (r["text"] or "").encode("utf-8")
        parts = [text[k : k + STL_TEXT] for k in range(0, len(text), STL_TEXT)] or [b""]
        for k, part in enumerate(parts):
            block = bytearray(128)
            block[1:3] = (i % 0xFFFF).to_bytes(2, "big")
            for at, ms in ((3, r["start_ms"]), (7, r["end_ms"])):
                n = int(ms / 1000.0 * 25.0 + 0.5)
                block[at : at + 4] = bytes([n // 90000 & 255, n // 1500 % 60, n // 25 % 60, n % 25])
            block[12] = 0 if len(parts) == 1 else 0xFF if k == len(parts) - 1 else min(k, 0xEF)
            block[14] = 20
            block[16 : 16 + len(part)] = part
            out.append(bytes(block))
    return b"".join(out)


def _render_python(cues: DataFrame, fmt: str, files: DataFrame | None) -> DataFrame:
    kind = "binary" if fmt == "ebu_stl" else "string"
    row = F.struct("pos", "index", "start_ms", "end_ms", "text", "text_parts", tc.format_timestamp(F.col("start_ms"), "vtt").alias("begin"), tc.format_timestamp(F.col("end_ms"), "vtt").alias("finish"))
    grouped = cues.select("file_id", row.alias("x")).groupBy("file_id").agg(F.collect_list("x").alias("rows"))
    heads = files.select("file_id", "header") if files is not None else None
    grouped = grouped.join(heads, "file_id", "left") if heads is not None else grouped.withColumn("header", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for rows, header in zip(pdf["rows"], pdf["header"], strict=True):
                rows = sorted(({**r, "text_parts": None if r["text_parts"] is None else list(r["text_parts"])} for r in rows), key=lambda r: r["pos"])
                made.append(ttml_text(rows, header) if fmt in ("ttml", "dfxp") else whisper_text(rows) if fmt == "whisper" else stl_bytes(rows))
            yield pd.DataFrame({"file_id": pdf["file_id"], "content": made})

    return grouped.select("file_id", "rows", "header").mapInPandas(run, f"file_id string, content {kind}")


#: Write policies and Spark's save modes.
POLICIES = {"overwrite": "overwrite", "refuse_if_exists": "errorifexists", "append": "append"}
FILE_ENDING = {"ebu_stl": "stl", "microdvd": "sub", "subviewer": "sub", "sami": "smi", "mpl2": "mpl", "whisper": "json"}


def write(rendered: DataFrame, path: str, policy: str = "overwrite") -> None:
    """Write rendered files as one Parquet table (file_id, content) under a policy; texts and EBU STL bytes alike."""
    rendered.write.mode(POLICIES[policy]).parquet(path)


def write_files(rendered: DataFrame, folder: str, fmt: str, policy: str = "overwrite", name: Column | None = None) -> int:
    """Write every rendered file in its format, from the executors; returns the number of files.

    A file is called ``name``, or its file_id with all but letters, digits and ``_.-~`` percent-encoded, plus the format's ending.
    ``refuse_if_exists`` raises where a path exists, ``append`` adds behind what is there (SubRip: behind an empty line). New contents are written
    beside the path and moved to it, and a mark says that a file is done, so that a repeated task leaves whole files and adds nothing twice.
    ``folder`` must be shared by all machines and known to pyarrow's file systems.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown write policy: {policy}")
    ending = FILE_ENDING.get(canonical_format(fmt), canonical_format(fmt))
    between = b"\n" if ending == "srt" else b""
    uri, call = folder if "://" in folder else f"file://{os.path.abspath(folder)}", uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(uri)
        system.create_dir(f"{base}/.{call}", recursive=True)
        exists = lambda path: system.get_file_info(path).type == fs.FileType.File
        attempt = TaskContext.get().taskAttemptId()
        for pdf in batches:
            for file_id, own, content in zip(pdf["file_id"], pdf["name"], pdf["content"], strict=True):
                called = f"{own if own is not None else quote(str(file_id), safe='~')}.{ending}"
                path, mark = f"{base}/{called}", f"{base}/.{call}/{called}"
                if exists(mark):
                    continue
                there, data = exists(path), bytes(content)
                if there and policy == "refuse_if_exists":
                    raise FileExistsError(path)
                if there and policy == "append":
                    with system.open_input_stream(path) as f:
                        data = f.read() + between + data
                with system.open_output_stream(f"{mark}.{attempt}") as f:
                    f.write(data)
                system.move(f"{mark}.{attempt}", path)
                system.open_output_stream(mark).close()
            yield pd.DataFrame({"n": [len(pdf)]})

    rows = rendered.select("file_id", (name if name is not None else F.lit(None)).cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    try:
        return rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
    finally:
        system, base = fs.FileSystem.from_uri(uri)
        if system.get_file_info(f"{base}/.{call}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/.{call}")


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls left out: of cues, issues or reports."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))
