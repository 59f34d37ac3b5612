"""Files of timed text to the ``cues`` and ``files`` tables."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrix.functions.detect import detect_format, format_of_path
from captrix.functions.encoding import detect_encoding
from captrix.schema import CUES, FILES, canonical_format
from captrix.sources.parsers import Cue, ParseError, parse

_CUE_FIELDS = T.StructType([f for f in CUES if f.name != "file_id"])
_META = [f for f in FILES if f.name not in ("file_id", "path", "format", "encoding")]
PARSED = T.StructType([FILES["file_id"], FILES["path"], FILES["format"], FILES["encoding"], *_META, T.StructField("cues", T.ArrayType(_CUE_FIELDS))])


@dataclass(frozen=True)
class ParseConfig:
    """What parsing does with numbers, failures, encodings and durations; a bound of 0 is none."""

    preserve_indices: bool = False
    lenient_mode: bool = False
    auto_detect_encoding: bool = True
    max_duration_ms: int = 0
    min_duration_ms: int = 0

    def apply(self, cues: DataFrame) -> DataFrame:
        """Number cues from 1 unless their numbers are to stay, and bound their durations; times stay in order of the file."""
        lasts = F.col("end_ms") - F.col("start_ms")
        if self.max_duration_ms:
            cues = cues.withColumn("end_ms", F.when(lasts > self.max_duration_ms, F.col("start_ms") + self.max_duration_ms).otherwise(F.col("end_ms")))
        if self.min_duration_ms:
            cues = cues.withColumn("end_ms", F.when(lasts < self.min_duration_ms, F.col("start_ms") + self.min_duration_ms).otherwise(F.col("end_ms")))
        return cues if self.preserve_indices else cues.withColumn("index", F.col("pos") + 1)


def _row(pos: int, c: Cue) -> dict:
    return {"pos": pos, "index": c.index, "start_ms": c.start, "end_ms": c.end, "text": c.text, "settings": c.settings, "text_parts": c.parts or None, "style": c.style, "actor": c.actor, "is_comment": c.comment}


def parse_files(files: DataFrame, fps: float | None = None, mode: str = "PERMISSIVE", stream: bool = False) -> DataFrame:
    """One row a file, with its cues in an array, from columns file_id, path, format, encoding, content.

    PERMISSIVE keeps a file that fails with its ``parse_error`` and no cues; FAILFAST raises. With ``stream``, files are read as stream readers
    do, and a file keeps its good cues beside the first error. Each row is parsed by itself, so
    the stage has no shuffle and a lost task repeats alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                own = {"file_id": r.file_id, "path": r.path, "format": r.format, "encoding": r.encoding, **{f.name: None for f in _META}, "cues": [], "n_cues": 0}
                try:
                    if r.format is None:
                        raise ParseError("UnknownFormat", "", "unknown subtitle format")
                    done = parse(r.format, bytes(r.content), fps, stream)
                    if done.errors and mode.upper() == "FAILFAST":
                        raise done.errors[0]
                    own["parse_error"] = next(({"kind": e.kind, "format": e.format, "message": str(e)} for e in done.errors), None)
                    own |= done.meta | {"cues": [_row(i, c) for i, c in enumerate(done.cues)], "n_cues": len(done.cues)}
                except ParseError as e:
                    if mode.upper() == "FAILFAST":
                        raise
                    own["parse_error"] = {"kind": e.kind, "format": e.format, "message": str(e)}
                out.append([own.get(f.name) for f in PARSED])
            yield pd.DataFrame(out, columns=PARSED.names)

    return files.select("file_id", "path", "format", "encoding", "content").mapInPandas(run, PARSED)


def cues_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.inline("cues")).select(*CUES.names)


def files_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(*FILES.names)


def with_formats(binary: DataFrame, fmt: str | None = None) -> DataFrame:
    """file_id, path, format, encoding, content of rows (path, content): the given format, else by extension, else by content."""
    found = F.lit(canonical_format(fmt)) if fmt else F.coalesce(format_of_path(F.col("path")), detect_format(F.col("content")))
    return binary.select(F.col("path").alias("file_id"), "path", found.alias("format"), detect_encoding(F.col("content")).alias("encoding"), "content")


def read_binary(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths).select("path", "content")


def read_urls(spark: SparkSession, urls: list[str] | DataFrame, timeout: float = 30.0, partitions: int | None = None) -> DataFrame:
    """path (the url) and content of resources fetched by the executors; ``urls`` is a list or a table with a column ``url``.

    A resource that cannot be fetched fails the job, as a missing file does. Rows are dealt to ``partitions`` tasks, each of which fetches its own.
    """
    table = urls if isinstance(urls, DataFrame) else spark.createDataFrame([(u,) for u in urls], "url string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["url"]:  # one resource held at a time
                with urllib.request.urlopen(url, timeout=timeout) as r:
                    yield pd.DataFrame({"path": [url], "content": [r.read()]})

    return table.select("url").where("url IS NOT NULL").repartition(partitions or spark.sparkContext.defaultParallelism).mapInPandas(run, "path string, content binary")


def read_url_cues(spark: SparkSession, urls: list[str] | DataFrame, fmt: str | None = None, fps: float | None = None, mode: str = "PERMISSIVE", timeout: float = 30.0) -> DataFrame:
    """Cues of subtitle files behind urls; the format is the given one, else that of the path's ending, else of the content."""
    rows = read_urls(spark, urls, timeout)
    plain = F.regexp_extract("path", r"^[^?#]*", 0)
    named = with_formats(rows.withColumn("url", F.col("path")).withColumn("path", plain), fmt)
    return cues_of(parse_files(named, fps, mode))


def read_parsed(spark: SparkSession, paths: str | list[str], fmt: str | None = None, fps: float | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    return parse_files(with_formats(read_binary(spark, paths), fmt), fps, mode)


def read_cues(spark: SparkSession, paths: str | list[str], fmt: str | None = None, fps: float | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Cues of all files under ``paths`` (files, folders or globs)."""
    return cues_of(read_parsed(spark, paths, fmt, fps, mode))


def read_with(spark: SparkSession, paths: str | list[str], config: ParseConfig, fmt: str | None = None, fps: float | None = None) -> DataFrame:
    """Cues of all files under ``paths`` by a configuration. Without detection of the encoding, a file that is no UTF-8 fails as any broken file."""
    rows = with_formats(read_binary(spark, paths), fmt)
    if not config.auto_detect_encoding:
        broken = (F.col("format") != "ebu_stl") & ~F.is_valid_utf8(F.col("content").cast("string"))
        # bytes that nothing decodes: the mark of UTF-16 and half a character
        rows = rows.withColumn("content", F.when(broken, F.unhex(F.lit("FFFE00D8"))).otherwise(F.col("content")))
    return config.apply(cues_of(parse_files(rows, fps, "PERMISSIVE" if config.lenient_mode else "FAILFAST")))


def parse_texts(df: DataFrame, fmt: str, file_id: str = "file_id", text: str = "text", fps: float | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Parsed rows of texts that are a column already (strings, or bytes for EBU STL)."""
    rows = df.select(F.col(file_id).cast("string").alias("file_id"), F.lit(None).cast("string").alias("path"), F.lit(canonical_format(fmt)).alias("format"), F.lit("UTF-8").alias("encoding"), F.col(text).cast("binary").alias("content"))
    return parse_files(rows, fps, mode)
