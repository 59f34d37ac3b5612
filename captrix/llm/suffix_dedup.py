"""Removal of long byte strings that occur elsewhere, by suffix sorting of content-defined shards.

Every string of ``LENGTH`` bytes has an anchor, the least hash among its ``GRAM``-byte substrings; equal strings have equal
anchors. Places in a row with one anchor form a run. Runs whose anchor stands once in the corpus hold nothing repeated; of the
others, the bytes of the run's strings (its places and ``LENGTH`` - 1 bytes more), the body, go to the shard of the anchor, equal bodies once.
Each shard's suffixes are sorted by external induced sorting (``induced_sort``), whose common prefixes give the places
that begin a repeated string. A shard of more than ``HOT`` bytes of different bodies is dealt further, by the distance to the anchor in steps
and a hash of the bytes that all strings of a step share; equal strings agree in both, so they still meet. ``STEPS`` end with 1, where a shard
is one string: there is nothing to sort, only its occurrences count, and its bytes are not stored again. So no passage, however frequent
and in whatever contexts, makes a shard of more than ``HOT`` bytes.

Exact copies of a text are found first by hash; one of them is compared with the rest, and each is covered as a whole.

Edge cases: null is the empty text; texts shorter than ``LENGTH`` keep everything; overlapping occurrences count; equal rows
are copies of each other; null ids are ids like others; very long texts are cut into overlapping pieces; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrix.llm import common
from captrix.llm.common import read, shared_folder, small_batches
from captrix.llm.induced_sort import MEMORY, repeated, scratch
from captrix.llm.positional_index import small

LENGTH, GRAM = 400, 64
STEPS = (64, 8, 1)
#: Bytes of different bodies from which on a shard is dealt further.
HOT = 1 << 19
#: Bytes of text from which on a task sorts what it holds (whole shards), and that a task gets at most; places that are hashed at
#: once, bytes of text handled together.
SHARD_BYTES, TASK_BYTES, PIECE, BATCH_BYTES = 1 << 20, 128 << 20, 1 << 19, 7 << 16
SEPARATOR = 0xFF  # in no UTF-8 text
_R = 0x5851F42D4C957F2D
_SPAN = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())]))
_ARROW_SPAN = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """As ``common.stored``, in small Arrow batches: texts and bodies are long rows."""
    with small_batches(df.sparkSession):
        return common.stored(df, folder, name)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_R), np.uint64(pow(_R, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place on."""
    n = len(data)
    up, down = _powers(1 << max(20, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, from running minima of blocks in both directions."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: len(x) - width + 1], ahead[width - 1 : len(x)])


def anchor_runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, anchor, first place, number of places, occurrences of the anchor) of the runs of all texts."""
    out: list[tuple] = []
    pieces, size = [], 0

    def flush() -> None:
        nonlocal size
        if not pieces:
            return
        data = np.frombuffer(b"".join(x[2] for x in pieces), np.uint8)
        sizes = np.array([len(x[2]) for x in pieces])
        begins = np.cumsum(sizes) - sizes
        grams, width = gram_hashes(data), length - GRAM + 1
        least = sliding_least(grams, width)
        places = sizes - length + 1
        at = np.repeat(begins, places) + np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
        who = np.repeat(np.arange(len(pieces)), places)
        value = least[at]
        first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (who[1:] != who[:-1])]))
        counts = np.diff(np.concatenate([first, [len(value)]]))
        w = who[first]
        # How often the anchor stands within the run. The filter finds the few places that may hold some run's anchor.
        known = np.zeros(1 << 20, bool)
        known[(value[first] >> np.uint64(44)).astype(np.int64)] = True
        spots = np.flatnonzero(known[(grams >> np.uint64(44)).astype(np.int64)])
        a, b = np.searchsorted(spots, at[first]), np.searchsorted(spots, at[first] + counts + width - 1)
        near = spots[np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
        hits = np.bincount(np.repeat(np.arange(len(first)), b - a), grams[near] == np.repeat(value[first], b - a), len(first)).astype(np.int64)
        out.append((np.array([x[0] for x in pieces])[w], value[first], at[first] - begins[w] + np.array([x[1] for x in pieces])[w], counts, hits))
        pieces.clear()
        size = 0

    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), PIECE):
            part = t[at : at + PIECE + length - 1]
            pieces.append((i, at, part))
            size += len(part)
            if size >= BATCH_BYTES:
                flush()
    flush()
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parts(body: bytes, n: int, anchor: int, lead: int | None, size: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(shard, first place, places, lead) of the parts of a body of ``n`` places, by steps of ``size`` of the distance to the anchor.

    ``lead`` is the first place's distance; without it, each place's anchor is looked for.
    """
    places = np.arange(n)
    if lead is None:
        hits = np.flatnonzero(gram_hashes(np.frombuffer(body, np.uint8)) == np.uint64(anchor % (1 << 64)))
        away = hits[np.searchsorted(hits, places)] - places
    else:
        away = lead - places
    step = away // size
    new = np.flatnonzero(np.concatenate([[True], (away[1:] != away[:-1] - 1) | (step[1:] != step[:-1])]))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), n], strict=True):
        high = a + int(away[a]) - size * int(step[a])  # the largest place of the whole step; its smallest is size - 1 less
        core = body[high : high - size + 1 + length]
        key = hashlib.blake2b(core, digest_size=8, key=(anchor % (1 << 64)).to_bytes(8, "little") + int(step[a]).to_bytes(4, "little") + size.to_bytes(1, "little")).digest()
        yield int.from_bytes(key, "little", signed=True), a, b - a, int(away[a])


def _cut(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def runs_of(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """d, a, anchor, start, places, hits of every run of texts (columns d, a, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _cut(whole, 500):
                who, anchor, start, n, hits = anchor_runs([t.encode("utf-8") for t in b.column(2).to_pylist()], length)
                owner = pa.array(who)
                yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), pa.array(anchor.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(hits.astype(np.int32))],
                                                 names=["d", "a", "anchor", "start", "places", "hits"])

    kinds = [texts.schema["d"], texts.schema["a"], T.StructField("anchor", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("places", T.IntegerType()), T.StructField("hits", T.IntegerType())]
    return texts.select("d", "a", "text").mapInArrow(run, T.StructType(kinds))


_PARENT = [T.StructField("s0", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType())]
_PART = [T.StructField("off", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("places", T.IntegerType()), T.StructField("lead", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("body", T.BinaryType())]
_SEGMENT = [T.StructField("shard", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("places", T.IntegerType()), T.StructField("body", T.BinaryType())]


def segments_of(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """d, a, shard (the anchor), start, places, body from texts with their live runs (struct of start, places, anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _cut(whole, 100):
                who, rows = [], []
                for i, (text, live) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    data = text.encode("utf-8")
                    who += [i] * len(live)
                    rows += [(r["anchor"], r["start"], r["places"], data[r["start"] : r["start"] + r["places"] + length - 1]) for r in live]
                owner = pa.array(who, pa.int64())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), *columns], names=["d", "a", *[f.name for f in _SEGMENT]])

    return texts.select("d", "a", "text", "live").mapInArrow(run, T.StructType([texts.schema["d"], texts.schema["a"], *_SEGMENT]))


def dealt(parts: DataFrame, size: int, length: int = LENGTH) -> DataFrame:
    """Parts of bodies (s0, k1, k2 name the whole body, ``off`` the part's first place in it) cut into steps of ``size`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for whole in batches:
            for b in _cut(whole, 100):
                who, rows = [], []
                for i, (off, shard, places, lead, n, body) in enumerate(zip(*[b.column(k).to_pylist() for k in range(3, 9)], strict=True)):
                    for part, first, own, away in _parts(body, places, shard, lead, size, length):
                        who.append(i)
                        rows.append((off + first, part, own, away, n, body[first : first + own + length - 1]))
                owner = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(owner) for k in range(3)], *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=[f.name for f in [*_PARENT, *_PART]])

    return parts.select([f.name for f in [*_PARENT, *_PART]]).mapInArrow(run, T.StructType([*_PARENT, *_PART]))


def _hot(bodies: DataFrame, folder: str, name: str, length: int) -> DataFrame | None:
    """The shards of more than ``HOT`` bytes of different bodies, or None."""
    sums = bodies.groupBy("shard", "c1", "c2").agg(F.max("places").alias("places")).groupBy("shard").agg(F.sum(F.col("places") + (length - 1)).alias("bytes"))
    found = stored(sums.where(F.col("bytes") > HOT).select("shard"), folder, name)
    return found if found.limit(1).count() else None


def parts_of(segments: DataFrame, hot: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """The bodies of hot shards in smaller and smaller steps: the names of the whole bodies, off, shard, c1, c2, n, body (null for a single string)."""
    whole = segments.join(small(hot), "shard", "left_semi").groupBy("shard", "c1", "c2").agg(F.count("*").alias("n"), F.max("places").alias("places"), F.first("body").alias("body"))
    rest = stored(whole.select(F.col("shard").alias("s0"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.lit(0).alias("off"), "shard", "places", F.lit(None).cast("int").alias("lead"), "n", "body"), folder, "hot-bodies")
    done = None
    for size in STEPS:
        made = dealt(rest, size, length).withColumns({"c1": F.xxhash64("body"), "c2": F.hash("body")})
        made = stored(made.withColumn("body", F.col("body") if size > 1 else F.lit(None).cast("binary")), folder, f"parts-{size}")
        hot = _hot(made, folder, f"hot-{size}", length) if size > 1 else None
        cold = made if hot is None else made.join(small(hot), "shard", "left_anti").select(made.columns)
        done = cold if done is None else done.unionByName(cold)
        if hot is None:
            return done
        rest = made.join(small(hot), "shard", "left_semi")
    return done


def body_marks(segments: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """shard, c1, c2, spans: the places of each body that begin a repeated string."""
    hot = _hot(segments, folder, "hot", length)
    cold = segments if hot is None else segments.join(small(hot), "shard", "left_anti")
    bodies = cold.groupBy("shard", "c1", "c2").agg(F.count("*").alias("n"), F.first("body").alias("body"))
    total = segments.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    spread = lambda df: dealt_evenly(df, total)
    if hot is None:
        return stored(shard_marks(spread(bodies), length), folder, "marks")
    parts = parts_of(segments, hot, folder, length)
    pieces = parts.where("body IS NOT NULL").groupBy("shard", "c1", "c2").agg(F.sum("n").alias("n"), F.first("body").alias("body"))
    single = parts.where("body IS NULL").groupBy("shard", "c1", "c2").agg(F.sum("n").alias("n")).where("n > 1")
    one = F.array(F.struct(F.lit(0).alias("at"), F.lit(1).alias("n"))).cast(_SPAN)
    found = stored(shard_marks(spread(pieces), length).unionByName(single.select("shard", "c1", "c2", one.alias("spans"))), folder, "part-marks")
    moved = F.transform("spans", lambda s: F.struct((s["at"] + F.col("off")).alias("at"), s["n"].alias("n")))
    back = parts.select("s0", "k1", "k2", "off", "shard", "c1", "c2").join(found, ["shard", "c1", "c2"]).select("s0", "k1", "k2", moved.alias("spans"))
    back = back.groupBy(F.col("s0").alias("shard"), F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).cast(_SPAN).alias("spans"))
    # steps part what belongs together: spans that touch become one
    back = back.withColumn("spans", F.transform(_touching("spans", 0), lambda r: F.struct(r["at"].alias("at"), (r["stop"] - r["at"]).alias("n"))).cast(_SPAN))
    return stored(shard_marks(spread(bodies), length).unionByName(back), folder, "marks")


def _true_runs(marks: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return [{"at": int(a), "n": int(b - a)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def dealt_evenly(bodies: DataFrame, total: int) -> DataFrame:
    """Bodies in tasks of whole shards, in the order of shards: a task for each ``SHARD_BYTES`` while there are few, of ``TASK_BYTES`` at most."""
    usual = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(-(-total // SHARD_BYTES), max(usual, -(-total // TASK_BYTES))))
    return bodies.repartition(tasks, "shard").sortWithinPartitions("shard")


def shard_marks(bodies: DataFrame, length: int = LENGTH) -> DataFrame:
    """shard, c1, c2, spans: the places of each body that begin a repeated string. Shards in a row are sorted as one text of some ``SHARD_BYTES``."""

    def marked(rows: list[tuple], sizes: list[int], held) -> pa.RecordBatch:
        text = scratch(held.tell(), np.uint8)
        held.seek(0)
        held.readinto(memoryview(text))
        marks = repeated(text, length)
        at, found, spans = 0, [], []
        for row, size in zip(rows, sizes, strict=True):
            places = size - length + 1
            own = [{"at": 0, "n": places}] if row[3] > 1 else _true_runs(np.asarray(marks[at : at + places]))
            at += size + 1
            if own:
                found.append(row)
                spans.append(own)
        return pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], pa.array(spans, _ARROW_SPAN)], names=["shard", "c1", "c2", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sizes, held = [], [], tempfile.SpooledTemporaryFile(MEMORY)  # of this task alone
        for b in batches:
            names = [b.schema.get_field_index(c) for c in ("shard", "c1", "c2", "n")]
            for row, body in zip(zip(*[b.column(k).to_pylist() for k in names], strict=True), b.column(b.schema.get_field_index("body")), strict=True):
                if rows and rows[-1][0] != row[0] and held.tell() >= SHARD_BYTES:
                    yield marked(rows, sizes, held)
                    held.close()
                    rows, sizes, held = [], [], tempfile.SpooledTemporaryFile(MEMORY)
                data = body.as_buffer()
                rows.append(row)
                sizes.append(data.size)
                held.write(data)
                held.write(bytes([SEPARATOR]))
        if rows:
            yield marked(rows, sizes, held)

    return bodies.mapInArrow(run, T.StructType([T.StructField("shard", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("c2", T.IntegerType()), T.StructField("spans", _SPAN)]))


def _touching(spans: str, more: int) -> Column:
    """at, stop of the runs of sorted, disjoint spans whose ends, ``more`` bytes behind their last place, reach the next."""
    stop = lambda s: s["at"] + s["n"] + more
    begin = F.filter(spans, lambda s, i: (i == 0) | (stop(F.get(spans, i - 1)) < s["at"]))
    end = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (stop(s) < F.get(spans, i + 1)["at"]))
    return F.zip_with(begin, end, lambda a, b: F.struct(a["at"].alias("at"), stop(b).alias("stop")))


def remove_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """d, n_bytes, n_removed, n_spans, kept (bytes) from texts with ``copies`` and ``places`` (spans of repeated strings' first bytes, or null)."""
    long = lambda c: c.cast("long")
    size = F.octet_length("text")
    rows = texts.withColumn("places", F.array_sort(F.coalesce("places", F.array().cast(_SPAN))))
    rows = rows.withColumn("runs", F.when(F.col("copies").isNotNull() & (size >= length), F.array(F.struct(F.lit(0).alias("at"), size.alias("stop")))).otherwise(_touching("places", length - 1)))
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["stop"]))
    ends = F.concat(F.transform("runs", lambda r: r["at"]), F.array(size))
    # pieces are joined in hexadecimal, in time that follows the text
    pieces = F.zip_with(begins, ends, lambda a, b: F.hex(F.substr(F.col("text").cast("binary"), a + 1, b - a)))
    kept = F.when(F.size("runs") == 0, F.col("text").cast("binary")).otherwise(F.unhex(F.array_join(pieces, "")))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + long(r["stop"] - r["at"]))
    return rows.select("d", long(size).alias("n_bytes"), removed.alias("n_removed"), long(F.size("runs")).alias("n_spans"), kept.alias("kept"))


def dedup(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """d, n_bytes, n_removed, n_spans, kept of every row."""
    rows = docs.select(F.col(doc_id).alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumns({"a": F.xxhash64("text"), "b": F.hash("text")})
    groups = stored(rows.select("d", "a", "b").groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("d").alias("keeper")).where("copies > 1"), folder, "copies")
    marked = rows.join(small(groups), ["a", "b"], "left")
    distinct = marked.where((F.col("copies").isNull() | F.col("d").eqNullSafe(F.col("keeper"))) & (F.octet_length("text") >= length)).select("d", "a", "text")
    runs = stored(runs_of(distinct, length), folder, "runs")
    anchors = runs.groupBy("anchor").agg(F.sum("hits").alias("hits")).where("hits > 1").select("anchor")
    live = runs.join(anchors, "anchor").groupBy("d", "a").agg(F.collect_list(F.struct("start", "places", "anchor")).alias("live"))
    live = live.select(F.col("d").alias("ld"), F.col("a").alias("la"), "live")
    with_runs = distinct.join(live, F.col("d").eqNullSafe(F.col("ld")) & (F.col("a") == F.col("la")))
    cut = segments_of(with_runs, length).withColumns({"c1": F.xxhash64("body"), "c2": F.hash("body")})
    segments = stored(cut, folder, "segments")
    marks = body_marks(segments, folder, length)
    named = segments.select("d", "a", "start", "shard", "c1", "c2").join(marks, ["shard", "c1", "c2"])
    places = named.select("d", "a", F.transform("spans", lambda s: F.struct((s["at"] + F.col("start")).alias("at"), s["n"].alias("n"))).alias("p"))
    places = stored(places.groupBy(F.col("d").alias("pd"), F.col("a").alias("pa")).agg(F.flatten(F.collect_list("p")).alias("places")), folder, "places")
    return remove_spans(marked.join(places, F.col("d").eqNullSafe(F.col("pd")) & (F.col("a") == F.col("pa")), "left"), length)


def op3(spark, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents"), shared_folder(spark))
    return out.select(F.col("d").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(length: int = LENGTH) -> str:
    """SQL over the bytes in hexadecimal, cut into pieces of 1,000 places first."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
c AS (SELECT doc_id, n, o, substr(t, 2 * o + 1, {2 * (1000 + length - 1)}) AS p FROM (SELECT *, len(t) // 2 AS n, unnest(range(0, greatest(len(t) // 2 - {length - 1}, 0), 1000)) AS o FROM d)),
w AS (SELECT doc_id, o + i AS place, hash(substr(p, 2 * i + 1, {2 * length})) AS h FROM (SELECT *, unnest(range(0, least(1000, n - {length - 1} - o))) AS i FROM c)),
r AS (SELECT doc_id, place FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY place) AS k FROM (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + {length} THEN 0 ELSE 1 END AS opens FROM r)),
s AS (SELECT doc_id, min(place) AS a, max(place) + {length} AS b FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, len(t) // 2, NULL FROM d),
f AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST), 0) AS before FROM e),
x AS (SELECT doc_id, sum(b - a) AS gone, count(b) AS spans, string_agg(substr(t, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b NULLS LAST) AS kept FROM f JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(t) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM x JOIN d USING (doc_id)
"""
