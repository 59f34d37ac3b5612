"""Command line over the library: parse, convert, validate, edit, pipeline, info, detect, quality, normalize, shift."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrix.functions import text as tx
from captrix.operators import edit, quality, validate
from captrix.plans.pipeline import Pipeline
from captrix.schema import DISPLAY, canonical_format
from captrix.sources import reader, writers


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="captrix", description="Parse, convert, check and edit timed text with Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, output: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("input", help="file, or - for standard input")
        if output:
            c.add_argument("output", help="file, or - for standard output")
            c.add_argument("--to")
        c.add_argument("--from", dest="source")
        c.add_argument("--fps", type=float)
        return c

    command("parse").add_argument("--json", action="store_true")
    command("convert", True)
    for name in ("validate", "quality"):
        c = command(name)
        c.add_argument("--json", action="store_true")
        c.add_argument("--extended", action="store_true")
        c.add_argument("--max-chars", type=int, default=42)
        c.add_argument("--max-gap", type=int, default=5000)
        c.add_argument("--max-cps", type=float, default=25.0)
    c = command("edit", True)
    c.add_argument("--sort", action="store_true")
    c.add_argument("--dedup", action="store_true")
    c.add_argument("--shift", type=int)
    c.add_argument("--merge", type=int)
    c.add_argument("--split", type=int)
    c.add_argument("--fps-in", type=float)
    c.add_argument("--fps-out", type=float)
    command("pipeline", True).add_argument("--config", required=True)
    command("info")
    command("detect")
    c = command("normalize", True)
    for flag in ("fix-ocr", "strip-hi", "quotes", "whitespace"):
        c.add_argument(f"--{flag}", action="store_true")
    command("shift", True).add_argument("--offset", type=int, required=True)
    return p


def _load(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, str]:
    if a.input == "-":
        rows = spark.createDataFrame([("-", bytearray(sys.stdin.buffer.read()))], "path string, content binary")
    else:
        rows = reader.read_binary(spark, a.input)
    parsed = reader.parse_files(reader.with_formats(rows, a.source), a.fps, "FAILFAST").cache()
    first = parsed.select("format").first()
    if first is None or first[0] is None:
        raise SystemExit("Cannot detect subtitle format.")
    return parsed, first[0]


def _save(cues: DataFrame, parsed: DataFrame, fmt: str, a: argparse.Namespace) -> None:
    target = a.to or (a.output.rpartition(".")[2] if "." in a.output else fmt)
    row = writers.render(cues, canonical_format(target), reader.files_of(parsed), a.fps).first()
    content = row["content"] if row else ""
    data = bytes(content) if isinstance(content, (bytes, bytearray)) else content.encode()
    if a.output == "-":
        sys.stdout.buffer.write(data)
    else:
        with open(a.output, "wb") as f:
            f.write(data)


def _rows(df: DataFrame) -> None:
    for r in writers.to_json(df).toLocalIterator():
        print(r["value"])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("captrix").config("spark.ui.enabled", "false").getOrCreate()
    if a.command == "detect":
        fmt = reader.with_formats(reader.read_binary(spark, a.input), a.source).select("format").first()[0]
        print(fmt or "unknown")
        return 0
    parsed, fmt = _load(spark, a)
    cues = reader.cues_of(parsed)
    if a.command == "parse":
        _rows(cues.orderBy("pos") if a.json else cues.orderBy("pos").select("pos", "start_ms", "end_ms", "text"))
    elif a.command == "convert":
        _save(cues, parsed, fmt, a)
    elif a.command == "validate":
        found = (validate.validate_extended(cues, a.max_chars, a.max_gap, a.max_cps) if a.extended else validate.validate(cues)).orderBy("seq").cache()
        _rows(found.drop("file_id") if a.json else found.select("code", "description"))
        return 1 if found.limit(1).count() else 0
    elif a.command == "quality":
        report = quality.quality_report(cues, a.max_chars, a.max_gap, a.max_cps)
        _rows(report if a.json else report.drop("worst_issues"))
    elif a.command == "edit":
        steps = []  # in this order, whatever the order of the flags
        if a.sort:
            steps.append(edit.sort)
        if a.dedup:
            steps.append(edit.remove_duplicates)
        for value, step in ((a.shift, edit.shift), (a.merge, edit.merge_adjacent), (a.split, edit.split_long)):
            if value is not None:
                steps.append(lambda c, v=value, s=step: s(c, v))
        if a.fps_in and a.fps_out:
            steps.append(lambda c: edit.transform_framerate(c, a.fps_in, a.fps_out))
        if not steps:
            raise SystemExit("No edit operations specified.")
        _save(edit.chain(cues, *steps), parsed, fmt, a)
    elif a.command == "pipeline":
        with open(a.config) as f:
            plan = Pipeline.from_json(f.read())
        if not plan.operations:
            raise SystemExit("Pipeline has no operations.")
        _save(plan.apply(cues), parsed, fmt, a)
    elif a.command == "info":
        r = quality.info(cues).first()
        print(json.dumps({"format": DISPLAY[fmt], **(r.asDict() if r else {"n_cues": 0})}, indent=2))
    elif a.command == "normalize":
        text = F.col("text")
        for on, step in ((a.fix_ocr, tx.fix_ocr_errors), (a.strip_hi, tx.strip_hearing_impaired), (a.quotes, tx.normalize_quotes), (a.whitespace, tx.normalize_whitespace)):
            text = step(text) if on else text
        _save(cues.withColumn("text", text), parsed, fmt, a)
    elif a.command == "shift":
        _save(edit.shift(cues, a.offset), parsed, fmt, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
