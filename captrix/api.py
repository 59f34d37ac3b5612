"""One subtitle text at a time: the library's plans over a table of one file, with plain Python values in and out.

For many files use ``sources.reader`` and ``sources.writers``: they do the same for any number of files in one plan.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrix.functions.detect import detect_format
from captrix.functions.text import strip_tags
from captrix.operators import quality, validate
from captrix.schema import DISPLAY, canonical_format
from captrix.sources import reader, writers


def _content(spark: SparkSession, text: str | bytes) -> DataFrame:
    return spark.createDataFrame([("text", bytearray(text.encode() if isinstance(text, str) else text))], "path string, content binary")


def _parsed(spark: SparkSession, text: str | bytes, fmt: str | None, fps: float | None) -> DataFrame:
    return reader.parse_files(reader.with_formats(_content(spark, text), fmt), fps, "FAILFAST")


def parse_subtitles(spark: SparkSession, text: str | bytes, fmt: str | None = None, fps: float | None = None) -> list[dict]:
    """The cues, nulls left out."""
    cues = reader.cues_of(_parsed(spark, text, fmt, fps)).drop("file_id").orderBy("pos")
    return [json.loads(r["value"]) for r in writers.to_json(cues).collect()]


def convert_format(spark: SparkSession, text: str | bytes, to: str, fmt: str | None = None, fps: float | None = None) -> str | bytes:
    """The text in another format; bytes for EBU STL. A text without cues is the empty text."""
    parsed = _parsed(spark, text, fmt, fps)
    row = writers.render(reader.cues_of(parsed), canonical_format(to), reader.files_of(parsed), fps).first()
    return "" if row is None else row["content"] if isinstance(row["content"], str) else bytes(row["content"])


def validate_subtitles(spark: SparkSession, text: str | bytes, fmt: str | None = None) -> list[dict]:
    """Issues with kind, code and sentence."""
    found = validate.validate(reader.cues_of(_parsed(spark, text, fmt, None))).orderBy("seq").select("kind", "code", "index", "index_b", "description")
    return [json.loads(r["value"]) for r in writers.to_json(found).collect()]


def detect(spark: SparkSession, text: str | bytes) -> str | None:
    """The format's display name."""
    name = _content(spark, text).select(detect_format(F.col("content"))).first()[0]
    return DISPLAY.get(name)


def get_info(spark: SparkSession, text: str | bytes, fmt: str | None = None) -> dict:
    """Format, number of cues, first and last times and their difference, which may be negative."""
    parsed = _parsed(spark, text, fmt, None)
    own = parsed.select("format").first()["format"]
    row = quality.timestamps(reader.cues_of(parsed)).drop("file_id").first()
    return {"format": DISPLAY[own], **(row.asDict() if row else {"n_cues": 0, "first_ms": 0, "last_ms": 0, "duration_ms": 0})}


def normalize_text(spark: SparkSession, text: str) -> str:
    """The text without markup."""
    return spark.createDataFrame([(text,)], "t string").select(strip_tags(F.col("t"))).first()[0]
