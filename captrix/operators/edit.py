"""Edits of cues: each takes and gives the ``cues`` table.

Order within a file is ``pos``; edits that sort, drop, join or split cues number it anew. All windows are partitioned by
file_id, so that a chain of edits shuffles once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from captrix.functions.text import duration_ms, is_empty, plaintext, split_text_chunks, trim_ws, words
from captrix.functions.text import strip_tags as strip_tags_of



def in_file() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("pos")


def in_time() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("start_ms", "end_ms", "pos")


def _renumber(cues: DataFrame, *order: str) -> DataFrame:
    return cues.withColumn("pos", (F.row_number().over(Window.partitionBy("file_id").orderBy(*(order or ("pos",)))) - 1).cast("long"))


def sort(cues: DataFrame) -> DataFrame:
    """By start, then end; equal cues keep their order."""
    return _renumber(cues, "start_ms", "end_ms", "pos")


def shift(cues: DataFrame, offset_ms: int) -> DataFrame:
    """Both times moved, not below 0."""
    moved = lambda c: F.greatest(F.col(c) + F.lit(int(offset_ms)).cast("long"), F.lit(0).cast("long"))
    return cues.withColumns({"start_ms": moved("start_ms"), "end_ms": moved("end_ms")})


def map_cues(cues: DataFrame, **columns: Column) -> DataFrame:
    """Any change of columns, cue by cue."""
    return cues.withColumns(columns)


def filter_cues(cues: DataFrame, condition: Column) -> DataFrame:
    return _renumber(cues.where(condition))


def filter_empty(cues: DataFrame) -> DataFrame:
    """Without cues whose text is null or white space."""
    return _renumber(cues.where(~is_empty(F.coalesce("text", F.lit("")))))


def remove_duplicates(cues: DataFrame) -> DataFrame:
    """Without cues whose trimmed text is that of the cue before them in the file."""
    same = trim_ws(F.col("text")).eqNullSafe(F.lag(trim_ws(F.col("text"))).over(in_file())) & F.lag("pos").over(in_file()).isNotNull()
    return _renumber(cues.withColumn("_same", same).where(~F.col("_same")).drop("_same"))


def extract_range(cues: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """What overlaps a range of time, cut to it."""
    kept = cues.where((F.col("start_ms") < to_ms) & (F.col("end_ms") > from_ms))
    return _renumber(kept.withColumns({"start_ms": F.greatest("start_ms", F.lit(from_ms).cast("long")), "end_ms": F.least("end_ms", F.lit(to_ms).cast("long"))}))


def remove_overlaps(cues: DataFrame) -> DataFrame:
    """In time order, no cue starts before the end of the one before it."""
    return _in_time(cues, start_ms=F.greatest("start_ms", F.lag("end_ms").over(in_time())))


def _in_time(cues: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed over the time order, which becomes the order of the file."""
    made = {f"_{k}": v for k, v in columns.items()} | {"_pos": (F.row_number().over(in_time()) - 1).cast("long")}
    return cues.withColumns(made).withColumns({k[1:]: F.col(k) for k in made}).drop(*made)


def _extended(need: Column) -> Column:
    """End that lasts ``need`` ms where the cue is shorter, but not beyond the next start."""
    limit = F.least(F.col("start_ms") + need, F.coalesce(F.lead("start_ms").over(in_time()), F.lit((1 << 63) - 1)))
    return F.when(duration_ms(F.col("start_ms"), F.col("end_ms")) < need, limit).otherwise(F.col("end_ms"))


def enforce_min_duration(cues: DataFrame, min_ms: int) -> DataFrame:
    return _in_time(cues, end_ms=_extended(F.lit(int(min_ms)).cast("long")))


def enforce_max_duration(cues: DataFrame, max_ms: int) -> DataFrame:
    end = F.col("start_ms") + F.lit(int(max_ms)).cast("long")
    return cues.withColumn("end_ms", F.when(duration_ms(F.col("start_ms"), F.col("end_ms")) > max_ms, end).otherwise(F.col("end_ms")))


def auto_extend_for_cps(cues: DataFrame, max_cps: float) -> DataFrame:
    if max_cps <= 0:
        raise ValueError("max_cps must be above 0")
    return _in_time(cues, end_ms=_extended(F.ceil(F.length(plaintext(F.col("text"))) / F.lit(float(max_cps)) * 1000).cast("long")))


def transform_framerate(cues: DataFrame, fps_in: float, fps_out: float) -> DataFrame:
    ratio = fps_out / fps_in
    scaled = lambda c: F.round(F.col(c) * F.lit(ratio)).cast("long")
    return cues.withColumns({"start_ms": scaled("start_ms"), "end_ms": scaled("end_ms")})


def strip_tags(cues: DataFrame) -> DataFrame:
    return cues.withColumns({"text": strip_tags_of(F.col("text")), "text_parts": F.lit(None).cast(cues.schema["text_parts"].dataType)} if "text_parts" in cues.columns else {"text": strip_tags_of(F.col("text"))})


def merge_adjacent(cues: DataFrame, max_gap_ms: int) -> DataFrame:
    """Cues at most a gap apart become one: the first's fields, the last's end, the texts one under another."""
    before = F.lag("end_ms").over(in_time())
    opens = F.when(before.isNull() | (F.greatest(F.col("start_ms") - before, F.lit(0)) > max_gap_ms), 1).otherwise(0)
    marked = cues.withColumns({"_open": opens, "_n": F.row_number().over(in_time())})
    marked = marked.withColumn("_island", F.sum("_open").over(Window.partitionBy("file_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in cues.columns if c not in ("file_id", "pos", "end_ms", "text")]
    merged = marked.groupBy("file_id", "_island").agg(
        F.min_by(F.struct(*rest), "_n").alias("_first"), F.max_by("end_ms", "_n").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    out = merged.withColumns({c: F.col("_first")[c] for c in rest}).withColumn("pos", (F.col("_island") - 1).cast("long"))
    return out.select(*cues.columns)


def split_long(cues: DataFrame, max_chars: int) -> DataFrame:
    """Cues with more characters than that become chunks of whole words (at most so many bytes) that share its time evenly.

    The first chunk keeps number, settings and spans. A text of white space stays as it is.
    """
    long = (F.length("text") > max_chars) & (F.col("end_ms") > F.col("start_ms")) & (F.size(words(F.col("text"))) > 0)
    chunks = F.when(long, split_text_chunks(F.col("text"), max_chars)).otherwise(F.array("text"))
    cut = cues.withColumn("_chunks", chunks).select(*cues.columns, F.size("_chunks").alias("_k"), F.posexplode("_chunks").alias("_i", "_chunk"))
    step = F.greatest(F.floor((F.col("end_ms") - F.col("start_ms")) / F.col("_k")), F.lit(1)).cast("long")
    many = F.col("_k") > 1
    new = {"text": F.col("_chunk"), "start_ms": F.when(many, F.col("start_ms") + F.col("_i") * step).otherwise(F.col("start_ms")), "end_ms": F.when(many, F.col("start_ms") + (F.col("_i") + 1) * step).otherwise(F.col("end_ms"))}
    new |= {c: F.when(F.col("_i") == 0, F.col(c)) for c in ("index", "settings", "text_parts") if c in cues.columns}
    return _renumber(cut.withColumns(new), "pos", "_i").select(*cues.columns)


def concatenate(first: DataFrame, second: DataFrame, gap_ms: int) -> DataFrame:
    """The second table's cues behind the first's last end and a gap, file by file, in time order. Stored numbers stay."""
    ends = first.groupBy("file_id").agg(F.max("end_ms").alias("_end"))
    placed = second.join(ends, "file_id", "left").withColumn("_offset", F.coalesce("_end", F.lit(0)) + F.lit(int(gap_ms)))
    moved = placed.withColumns({"start_ms": F.col("start_ms") + F.col("_offset"), "end_ms": F.col("end_ms") + F.col("_offset")}).select(*first.columns)
    both = first.withColumn("_second", F.lit(0)).unionByName(moved.withColumn("_second", F.lit(1)))
    return _renumber(both, "start_ms", "end_ms", "_second", "pos").select(*first.columns)


def chain(cues: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        cues = step(cues)
    return cues
