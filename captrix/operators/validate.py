"""Issues of cues as a long table, one row an issue, in the order file_id, seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from captrix.functions.text import chars_per_second, plaintext
from captrix.operators.edit import in_file, in_time

#: Short names of the kinds.
KINDS = {"Overlap": "OVERLAP", "NegativeDuration": "NEG_DUR", "ZeroDuration": "ZERO_DUR", "DecreasingStartTime": "DECR_START", "TooLongGap": "LONG_GAP", "TextTooLong": "LONG_TEXT", "CpsTooHigh": "HIGH_CPS"}
FIELDS = {"index": "long", "index_b": "long", "start": "long", "end": "long", "time": "long", "end_a": "long", "start_b": "long", "prev_start": "long", "curr_start": "long", "prev_end": "long",
          "gap_ms": "long", "chars": "long", "max_chars": "long", "cps": "double", "max_cps": "double"}


def _issue(phase: int, rank: Column | str, kind: str, **fields: Column) -> Column:
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.struct(F.lit(phase).alias("phase"), rank.cast("long").alias("rank"), F.lit(kind).alias("kind"), *[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def _one(test: Column, issue: Column) -> Column:
    return F.when(test, F.array(issue)).otherwise(F.array().cast(f"array<{_TYPE}>"))


_TYPE = "struct<phase:int,rank:bigint,kind:string," + ",".join(f"{k}:{'bigint' if t == 'long' else t}" for k, t in FIELDS.items()) + ">"


def issues(cues: DataFrame, extended: bool = False, max_chars: int = 42, max_gap_ms: int = 5000, max_cps: float = 25.0) -> DataFrame:
    """file_id, seq, kind, code, the fields of each kind, description.

    Every cue's checks are an array from one pass (two windows, one shuffle) that is exploded, so that nothing is read twice.
    """
    found = with_issues(cues, extended, max_chars, max_gap_ms, max_cps).select("file_id", F.explode("_issues").alias("i")).select("file_id", "i.*")
    found = found.withColumn("seq", (F.row_number().over(Window.partitionBy("file_id").orderBy("phase", "rank")) - 1).cast("long"))
    code = F.lit(None).cast("string")
    for k, v in KINDS.items():
        code = F.when(F.col("kind") == k, F.lit(v)).otherwise(code)
    return found.select("file_id", "seq", "kind", code.alias("code"), *FIELDS, description().alias("description"))


def with_issues(cues: DataFrame, extended: bool = False, max_chars: int = 42, max_gap_ms: int = 5000, max_cps: float = 25.0) -> DataFrame:
    """The cues with an array of their issues, ``_issues``: two windows over one partitioning."""
    start, end, pos = F.col("start_ms"), F.col("end_ms"), F.col("pos")
    d = cues.withColumns({"_prev_start": F.lag("start_ms").over(in_file()), "_prev_end": F.lag("end_ms").over(in_file())})
    d = d.withColumns({"_next_start": F.lead("start_ms").over(in_time()), "_next_pos": F.lead("pos").over(in_time()), "_rank": F.row_number().over(in_time())})
    checks = [
        _one(end < start, _issue(1, pos * 2, "NegativeDuration", index=pos, start=start, end=end)),
        _one(end == start, _issue(1, pos * 2 + 1, "ZeroDuration", index=pos, time=start)),
        _one(end > F.col("_next_start"), _issue(2, "_rank", "Overlap", index=pos, index_b=F.col("_next_pos"), end_a=end, start_b=F.col("_next_start"))),
        _one(start < F.col("_prev_start"), _issue(3, "pos", "DecreasingStartTime", index=pos, prev_start=F.col("_prev_start"), curr_start=start)),
    ]
    if extended:
        chars, cps = F.length("text"), chars_per_second(F.col("text"), start, end)
        gap = F.greatest(start - F.col("_prev_end"), F.lit(0))
        checks += [
            _one(chars > max_chars, _issue(4, pos * 2, "TextTooLong", index=pos, chars=chars, max_chars=F.lit(max_chars))),
            _one(cps > max_cps, _issue(4, pos * 2 + 1, "CpsTooHigh", index=pos, cps=cps, max_cps=F.lit(float(max_cps)))),
            _one(gap > max_gap_ms, _issue(5, "pos", "TooLongGap", index=pos, prev_end=F.col("_prev_end"), curr_start=start, gap_ms=gap)),
        ]
    return d.withColumn("_issues", F.concat(*checks))


def description() -> Column:
    """The sentence of each kind. An infinite speed is ``inf``."""
    c = F.col
    text = lambda x: c(x).cast("string")
    say = lambda *parts: F.concat(*[text(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])
    one = lambda x: F.when(c(x) == float("inf"), F.lit("inf")).otherwise(F.format_string("%.1f", c(x)))
    return (F.when(c("kind") == "Overlap", say("subtitle ", "$index", " (ends at ", "$end_a", "ms) overlaps with subtitle ", "$index_b", " (starts at ", "$start_b", "ms)"))
            .when(c("kind") == "NegativeDuration", say("subtitle ", "$index", " has negative duration: ", "$start", "ms -> ", "$end", "ms"))
            .when(c("kind") == "ZeroDuration", say("subtitle ", "$index", " has zero duration at ", "$time", "ms"))
            .when(c("kind") == "DecreasingStartTime", say("subtitle ", "$index", " starts at ", "$curr_start", "ms before previous subtitle's start time ", "$prev_start", "ms"))
            .when(c("kind") == "TooLongGap", say("subtitle ", "$index", ": ", "$gap_ms", "ms gap between ", "$prev_end", "ms and ", "$curr_start", "ms"))
            .when(c("kind") == "TextTooLong", say("subtitle ", "$index", " has ", "$chars", " characters (max recommended: ", "$max_chars", ")"))
            .when(c("kind") == "CpsTooHigh", F.concat(F.lit("subtitle "), text("index"), F.lit(" has "), one("cps"), F.lit(" chars/second (max recommended: "), one("max_cps"), F.lit(")"))))


def validate(cues: DataFrame) -> DataFrame:
    return issues(cues)


def validate_extended(cues: DataFrame, max_chars: int = 42, max_gap_ms: int = 5000, max_cps: float = 25.0) -> DataFrame:
    return issues(cues, True, max_chars, max_gap_ms, max_cps)


def issue_counts(cues: DataFrame, max_chars: int, max_gap_ms: int, max_cps: float) -> Column:
    """Issues of one cue for quality reports (text length of the plain text; gap to the cue before). Needs ``_prev_end``."""
    start, end, text = F.col("start_ms"), F.col("end_ms"), F.col("text")
    tests = [F.length(plaintext(text)) > max_chars, chars_per_second(text, start, end) > max_cps, F.greatest(start - F.col("_prev_end"), F.lit(0)) > max_gap_ms]
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)).cast("long")
