"""Timed text as it arrives: files through the batch parsers, and unbounded cues with keyed state.

``read_stream`` is stateless: a file is one row, so a parser runs on each without a shuffle; on well-formed files the result equals the batch's
but for SAMI's ends and LRC's order (see ``sources.parsers``). ``write_stream`` writes
each micro-batch's files in a format. ``dedup_stream`` and ``merge_stream`` keep a row of state for each file: the last text, or the open run of
cues and the number of runs so far. Cues of a file must arrive in the order of ``pos`` from batch to batch; within a batch they
are sorted. The merge emits a run when a later cue opens the next one, when a closing mark ends the file, or when the watermark passes the
event time of the run's last cue by more than the gap. A null text is the empty text, as in batch edits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from captrix.sources.reader import cues_of, parse_files, with_formats
from captrix.sources.writers import render, write_files

#: White space as batch edits trim it.
OUTER_SPACE = r"^[\s\x85]+|[\s\x85]+$"
BINARY = "path string, modificationTime timestamp, length long, content binary"
SIMPLE = "file_id string, pos long, start_ms long, end_ms long, text string"


def read_stream(spark: SparkSession, path: str, fmt: str | None = None, fps: float | None = None, mode: str = "PERMISSIVE", max_files: int = 1000, as_batch: bool = False) -> DataFrame:
    """Cues of files as they appear in a folder, as the formats' stream readers give them, or with ``as_batch`` as ``read_cues`` does."""
    binary = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", max_files).load(path).select("path", "content")
    return cues_of(parse_files(with_formats(binary, fmt), fps, mode, not as_batch))


def write_stream(stream: DataFrame, folder: str, fmt: str, checkpoint: str, policy: str = "overwrite", **options):
    """Cues of whole files (as ``read_stream`` gives them) to one file each in ``fmt``; a repeated micro-batch overwrites what it wrote."""

    def sink(cues: DataFrame, batch: int) -> None:
        write_files(render(cues, fmt, **options), folder, fmt, policy)

    return foreach_stream(stream, sink, checkpoint)


def foreach_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch to a batch writer of one's own."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def dedup_stream(cues: DataFrame) -> DataFrame:
    """Cues whose trimmed text differs from the one before in the file."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("pos")
        trimmed = pdf["text"].fillna("").str.replace(OUTER_SPACE, "", regex=True)
        before = trimmed.shift(1)
        same = trimmed == before
        same.iloc[0] = state.exists and trimmed.iloc[0] == state.get[0]
        state.update((trimmed.iloc[-1],))
        yield pdf[~same]

    simple = cues.select(*[f.split()[0] for f in SIMPLE.split(", ")])
    return simple.groupBy("file_id").applyInPandasWithState(run, SIMPLE, "last string", "append", GroupStateTimeout.NoTimeout)


def merge_stream(cues: DataFrame, max_gap_ms: int, event_time: str | None = None, delay: str = "1 minute", keep: str = "1 day") -> DataFrame:
    """Runs of cues at most a gap apart, as ``merge_adjacent`` gives them once all input is there.

    A cue without a start ends its file (``close_marks``), as a source without a watermark needs it. With ``event_time`` a run also ends
    when the watermark is more than the gap past the event time of its last cue; runs of a file that goes on are numbered on. What is known of a
    file without an open run is forgotten when the watermark is ``keep`` past its last cue.
    """
    names = [f.split()[0] for f in SIMPLE.split(", ")]
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, seen, *open_ = state.get if state.exists else (0, 0, None, None, None)
        done = []

        def close() -> None:
            nonlocal pos, open_
            if open_[0] is not None:
                done.append((key[0], pos, *open_))
                pos, open_ = pos + 1, [None, None, None]

        if state.hasTimedOut:
            idle = open_[0] is None
            close()
            if idle:
                state.remove()
                yield pd.DataFrame(done, columns=names)
                return
        else:
            for r in pd.concat(list(batches)).sort_values(["start_ms", "end_ms", "pos"], na_position="last").to_dict("records"):
                if event_time and not pd.isna(r[event_time]):
                    seen = max(seen, int(pd.Timestamp(r[event_time]).timestamp() * 1000))
                if pd.isna(r["start_ms"]):
                    close()
                    continue
                text = [] if r["text"] is None else [r["text"]]
                if open_[0] is not None and max(r["start_ms"] - open_[1], 0) <= max_gap_ms:
                    open_ = [open_[0], int(r["end_ms"]), "\n".join([*([open_[2]] if open_[2] is not None else []), *text]) if text or open_[2] is not None else None]
                else:
                    close()
                    open_ = [int(r["start_ms"]), int(r["end_ms"]), *(text or [None])]
        state.update((pos, seen, *open_))
        if event_time:
            wait = max_gap_ms if open_[0] is not None else keep_ms
            state.setTimeoutTimestamp(max(seen + wait, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(done, columns=names)

    base = cues.withWatermark(event_time, delay) if event_time else cues
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return base.select(*names, *([event_time] if event_time else [])).groupBy("file_id").applyInPandasWithState(run, SIMPLE, "pos long, seen long, start_ms long, end_ms long, text string", "append", timeout)


def close_marks(files: DataFrame) -> DataFrame:
    """A closing cue for each file_id, for ``merge_stream``."""
    return files.select("file_id", F.lit((1 << 62)).alias("pos"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit(None).cast("string").alias("text"))
