"""Quality of cues and files: metrics, reports, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrix.functions.text import chars_per_second, duration_ms, plaintext, reading_speed_wpm, words
from captrix.operators.edit import in_file
from captrix.operators.validate import issue_counts, with_issues

#: Fixed value: characters from which one line had better be two.
LONG_LINE = 42


def quality_cues(cues: DataFrame, max_chars: int = 42, max_gap_ms: int = 5000, max_cps: float = 25.0) -> DataFrame:
    """Metrics and number of issues of every cue. Speeds are infinite without duration."""
    start, end, text = F.col("start_ms"), F.col("end_ms"), F.col("text")
    d = cues.withColumn("_prev_end", F.lag("end_ms").over(in_file()))
    return d.select("file_id", F.col("pos").alias("index"), "text", duration_ms(start, end).alias("duration_ms"), chars_per_second(text, start, end).alias("chars_per_second"), reading_speed_wpm(text, start, end).alias("words_per_minute"),
                    F.length(plaintext(text)).cast("long").alias("char_count"), F.size(words(plaintext(text))).cast("long").alias("word_count"), issue_counts(cues, max_chars, max_gap_ms, max_cps).alias("n_issues"),
                    ((F.length("text") > LONG_LINE) & ~text.contains("\n")).alias("has_poor_line_break"))


def quality_report(cues: DataFrame, max_chars: int = 42, max_gap_ms: int = 5000, max_cps: float = 25.0) -> DataFrame:
    """One row a file: counts, averages (duration in whole ms) and the last cue with most issues."""
    q = quality_cues(cues, max_chars, max_gap_ms, max_cps)
    out = q.groupBy("file_id").agg(F.count("*").alias("total_subtitles"), F.sum("n_issues").alias("total_issues"), F.floor(F.sum("duration_ms") / F.count("*")).cast("long").alias("avg_duration_ms"),
                                   F.avg("chars_per_second").alias("avg_cps"), F.avg("words_per_minute").alias("avg_wpm"), F.max(F.struct("n_issues", "index")).alias("_worst"))
    return out.withColumn("worst_index", F.when(F.col("_worst.n_issues") > 0, F.col("_worst.index"))).withColumn("worst_issues", F.col("_worst.n_issues")).drop("_worst")


def info(cues: DataFrame) -> DataFrame:
    """One row a file: times, durations, characters, the highest speed and the number of timing issues."""
    dur = duration_ms(F.col("start_ms"), F.col("end_ms"))
    agg = with_issues(cues).groupBy("file_id").agg(F.sum(F.size("_issues")).cast("long").alias("n_issues"), F.count("*").alias("n_cues"), F.min_by("start_ms", "pos").alias("first_start_ms"), F.max_by("end_ms", "pos").alias("last_end_ms"),
                                      F.floor(F.sum(dur) / F.count("*")).cast("long").alias("avg_duration_ms"), F.min(dur).alias("min_duration_ms"), F.max(dur).alias("max_duration_ms"),
                                      F.sum(F.length("text")).cast("long").alias("total_chars"), F.greatest(F.lit(0.0), F.max(chars_per_second(F.col("text"), F.col("start_ms"), F.col("end_ms")))).alias("max_cps"))
    total = F.greatest(F.col("last_end_ms") - F.col("first_start_ms"), F.lit(0))
    return agg.withColumn("total_duration_ms", total)


def timestamps(cues: DataFrame) -> DataFrame:
    """One row a file: number of cues, first and last times, and their difference, which may be negative."""
    return cues.groupBy("file_id").agg(F.count("*").alias("n_cues"), F.min_by("start_ms", "pos").alias("first_ms"), F.max_by("end_ms", "pos").alias("last_ms")).withColumn("duration_ms", F.col("last_ms") - F.col("first_ms"))
