"""Tables of timed text. Times are whole milliseconds; ``pos`` is the 0-based place in the file and carries its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PART = _struct(text=S, bold=B, italic=B, underline=B, color=S, voice=S)
CUES = _struct(file_id=S, pos=L, index=L, start_ms=L, end_ms=L, text=S, settings=S, text_parts=T.ArrayType(PART), style=S, actor=S, is_comment=B)
STYLE = _struct(name=S, fontname=S, fontsize=L, primary_color=S, secondary_color=S, outline_color=S, back_color=S, bold=B, italic=B, underline=B, strikeout=B, scale_x=D, scale_y=D, spacing=D,
                angle=D, border_style=L, outline=D, shadow=D, alignment=L, margin_l=L, margin_r=L, margin_v=L, encoding=L)
LRC_LINE = _struct(times_ms=T.ArrayType(L), text=S)
TTI = _struct(subtitle_group=I, subtitle_number=I, extension_block=I, cumulative_status=I, timecode_start=L, timecode_end=L, vertical_position=I, justification=I, comment_flag=B, text=S)
GSI = _struct(code_page=I, language_code=S)
PARSE_ERROR = _struct(kind=S, format=S, message=S)
FILES = _struct(file_id=S, path=S, format=S, encoding=S, header=S, fps=D, drop_frame=B, info=T.MapType(S, S), class_styles=T.MapType(S, S), styles=T.ArrayType(STYLE), lrc_lines=T.ArrayType(LRC_LINE),
                tti_blocks=T.ArrayType(TTI), gsi=GSI, n_cues=L, parse_error=PARSE_ERROR)

#: Formats by the spelling that detection returns.
FORMATS = ["srt", "vtt", "ass", "ssa", "microdvd", "subviewer", "ttml", "sbv", "lrc", "sami", "mpl2", "scc", "ebu_stl", "dfxp", "whisper"]
DISPLAY = {"srt": "SRT", "vtt": "WebVTT", "ass": "ASS", "ssa": "SSA", "microdvd": "MicroDVD", "subviewer": "SubViewer", "ttml": "TTML", "sbv": "SBV", "lrc": "LRC", "sami": "SAMI", "mpl2": "MPL2",
           "scc": "SCC", "ebu_stl": "EBU STL", "dfxp": "DFXP", "whisper": "Whisper JSON"}
#: Other spellings that readers, writers and the command line take.
ALIASES = {"stl": "ebu_stl", "webvtt": "vtt", "smi": "sami", "mpl": "mpl2", "sub": "microdvd", "xml": "ttml", "json": "whisper"}
#: Fixed values of the formats.
DEFAULT_FPS, SCC_FPS, STL_FPS = 23.976, 29.97, 25.0
DEFAULT_STYLE = {"name": "Default", "fontname": "Arial", "fontsize": 48, "primary_color": "&H00FFFFFF", "secondary_color": "&H000000FF", "outline_color": "&H00000000", "back_color": "&H00000000",
                 "bold": False, "italic": False, "underline": False, "strikeout": False, "scale_x": 100.0, "scale_y": 100.0, "spacing": 0.0, "angle": 0.0, "border_style": 1, "outline": 2.0,
                 "shadow": 2.0, "alignment": 2, "margin_l": 10, "margin_r": 10, "margin_v": 10, "encoding": 1}


def canonical_format(name: str) -> str:
    name = name.lower()
    name = ALIASES.get(name, name)
    if name not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    return name


def as_cues(df: DataFrame) -> DataFrame:
    """The columns of ``CUES`` in order: missing ones null (``is_comment`` false), other columns dropped."""
    default = {"is_comment": F.lit(False), "text_parts": F.lit(None)}
    return df.select(*[(F.col(f.name) if f.name in df.columns else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in CUES])


def build_file(spark: SparkSession, file_id: str, fmt: str, cues: list[dict], fps: float | None = None, header: str | None = None, styles: list[dict] | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(cues, files) of one file made by hand. A MicroDVD file needs fps, else None; ASS and SSA get the default style."""
    fmt = canonical_format(fmt)
    if fmt == "microdvd" and fps is None:
        return None
    rows = [tuple({"file_id": file_id, "pos": i, "is_comment": False, **c}.get(f.name) for f in CUES) for i, c in enumerate(cues)]
    styles = styles or ([DEFAULT_STYLE] if fmt in ("ass", "ssa") else None)
    meta = {"file_id": file_id, "format": fmt, "header": header, "fps": {"scc": SCC_FPS, "mpl2": fps or DEFAULT_FPS}.get(fmt, fps), "drop_frame": True if fmt == "scc" else None, "styles": styles, "n_cues": len(cues)}
    file = tuple([tuple(s[f.name] for f in STYLE) for s in meta["styles"]] if f.name == "styles" and styles else meta.get(f.name) for f in FILES)
    return spark.createDataFrame(rows, CUES), spark.createDataFrame([file], FILES)
