"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is a bag of five-word shingles, weighted by 1 + ln(count). Every shingle sends arrivals of a Poisson process whose
rate is its weight, each to a random register, and a register keeps the shingle that came first. A shingle stops as soon
as its next arrival is later than all registers' (early termination), so a signature costs about n + m log m steps. The
share of equal registers estimates the probability Jaccard similarity. Bands of ``ROWS`` registers are hashed into buckets.
Links are by the sets of shingles, whose similarity may be higher than that of the bags. So a text that repeats a shingle also has
the bands of its set, all weights 1; without repeats both are the same, and any two texts meet by their sets at least.

Links: exact copies are one node (the smallest doc_id among them). Two texts are linked if the Jaccard similarity of their
shingle sets, computed from the whole texts, is at least ``SIMILARITY`` = s. Each bucket's members are verified against its
leader L, its smallest node. What this leaves open is settled by counting. Let U be L and all shingles that at least
``LONG`` of L's members have. A pair x, y shares at most min(|x & U|, |y & U|) shingles within U, and needs s / (1 + s) (|x| + |y|) to be
linked. So either it shares a shingle outside U, which then stands among the first of both (``short_lists``), or both hold enough of U,
which is a comparison of counts (``within``). Long lists get leaders of their own before. Both filters only drop pairs that counts
prove unlinked, so every linked pair under one leader is found. What is left to verify are pairs close to the threshold in
different components. Their number follows the members of a group as long as few of its texts are that close without being linked.

Edge cases: texts of one to four words are one shingle; null and empty texts have none, and are classed by equality alone;
rows that share a doc_id are one document and share a class; a row without id takes the class of its exact copies, or
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from captrix.llm.common import read, shared_folder, stored
from captrix.llm.positional_index import small

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 8
#: Members from which on a list of one shingle is long.
LONG = 16
#: Blocks of shingle hashes, in bits.
BLOCK_BITS = 6
BATCH_ROWS = 500
_R = 0x5851F42D4C957F2D
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each: polynomial hashes over the bytes, then mixed."""
    raw = [t.encode("utf-8") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    gaps = _SPACES[data]
    edge = np.diff(np.concatenate([[True], gaps]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    left = np.arange(len(starts))
    k = 0
    while len(left):  # one step for each place in a word; long words are few
        out[left] = out[left] * np.uint64(_R) + data[starts[left] + k].astype(np.uint64) + np.uint64(1)
        k += 1
        left = left[sizes[left] > k]
        if k >= 64 and len(left):
            break
    for i in left:  # words beyond 64 bytes
        x = int(out[i])
        for c in data[starts[i] + k : ends[i]].tolist():
            x = (x * _R + c + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = x
    return _mix(out), counts


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of all distinct shingles, ordered by text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    windows = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), windows)
    first = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    size = np.minimum(counts, SHINGLE)[owner]
    h = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE):
        has = size > k
        if has.all():
            h = h * np.uint64(_R) + words[first + k]
        else:
            h[has] = h[has] * np.uint64(_R) + words[first[has] + k]
    h = _mix(h)
    if not len(h):
        return owner, h, np.zeros(0, np.int64)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]))
    return owner[new], h[new], np.diff(np.concatenate([new, [len(h)]]))


def signatures(texts: list[str], registers: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash signatures (texts x registers) and the numbers of distinct shingles."""
    owner, h, count = shingles(texts)
    return _registers(owner, h, count, len(texts), registers), np.bincount(owner, minlength=len(texts))


def _registers(owner: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    sizes = np.bincount(owner, minlength=n)
    times = np.full(n * registers, np.inf)
    ids = np.zeros(n * registers, np.uint64)
    alone = sizes[owner] == 1
    for d, x in zip(owner[alone], h[alone], strict=True):
        ids[d * registers : (d + 1) * registers] = x
    live = np.flatnonzero(~alone)
    owner, h, rate = owner[live], h[live], 1 + np.log(count[live])
    at, step = np.zeros(len(h)), 0
    latest = np.full(n, np.inf)
    table = times.reshape(n, registers)
    while len(h):
        step += 1
        r = _mix(h + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        place = owner * registers + (_mix(r) % np.uint64(registers)).astype(np.int64)
        good = at < times[place]
        p, t, x = place[good], at[good], h[good]
        np.minimum.at(times, p, t)
        won = times[p] == t
        ids[p[won]] = x[won]
        docs = np.unique(owner)
        latest[docs] = table[docs].max(axis=1)
        stay = at < latest[owner]
        owner, h, rate, at = owner[stay], h[stay], rate[stay], at[stay]
    return ids.reshape(n, registers)


def text_bands(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket hash) of all distinct buckets, ordered by text: of the bag, and of the set where a shingle repeats."""
    owner, h, count = shingles(texts)
    whole = bands_of(_registers(owner, h, count, len(texts)))
    some = np.unique(owner)
    who, made = np.repeat(some, BANDS), whole[some].reshape(-1)
    again = np.unique(owner[count > 1])
    if len(again):
        own = np.isin(owner, again)
        more = bands_of(_registers(np.searchsorted(again, owner[own]), h[own], np.ones(own.sum(), np.int64), len(again)))
        who, made = np.concatenate([who, np.repeat(again, BANDS)]), np.concatenate([made, more.reshape(-1)])
    order = np.lexsort((made, who))
    who, made = who[order], made[order]
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (made[1:] != made[:-1])])[: len(who)]
    return who[new], made[new]


def bands_of(ids: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Bucket hashes (texts x bands)."""
    parts = ids.reshape(len(ids), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = _mix(out * np.uint64(_R) + parts[:, :, k])
    return out.view(np.int64)


def sign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, a, b (hashes of the text), bands."""
    rows = docs.select(F.col(doc_id).alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).select("d", F.xxhash64("text").alias("a"), F.hash("text").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(at, BATCH_ROWS)
                who, made = text_bands(part.column(3).to_pylist())
                offsets = np.searchsorted(who, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], names=["d", "a", "b", "bands"])

    schema = T.StructType([rows.schema["d"], rows.schema["a"], rows.schema["b"], T.StructField("bands", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def bags(docs: DataFrame, ids: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, bag (the sorted shingle hashes of the whole text) of the documents in ``ids`` (column d), stored."""
    chosen = docs.select(F.col(doc_id).alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(small(ids), "d", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(at, BATCH_ROWS)
                owner, h, _ = shingles(part.column(1).to_pylist())
                offsets = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], names=["d", "bag"])

    made = chosen.mapInArrow(run, T.StructType([chosen.schema["d"], T.StructField("bag", T.ArrayType(T.LongType()))]))
    return stored(made, folder, "bags")


def verify(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """x, y, sim, nx, ny, common (numbers of shingles), own (x's shingles that y lacks), blocks (the common ones by block of their
    hash) of pairs (x, y), from the whole texts' shingles in ``known``. Rows that share an id are variants of one document: any may match."""
    bag = lambda k: known.select(F.col("d").alias(k), F.col("bag").alias(f"b{k}"))
    both = pairs.select("x", "y").join(bag("x"), "x").join(bag("y"), "y").select("x", "y", "bx", "by")
    numbers = ["nx", "ny", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(at, BATCH_ROWS)
                rows = []
                for u, v in zip(part.column(2), part.column(3), strict=True):
                    x, y = (np.asarray(k.values).view(np.uint64) for k in (u, v))
                    has = np.isin(x, y, assume_unique=True)
                    common = int(has.sum())
                    blocks = np.bincount((x[has] >> np.uint64(64 - BLOCK_BITS)).astype(np.int64), minlength=1 << BLOCK_BITS)
                    rows.append((common / max(1, len(x) + len(y) - common), len(x), len(y), common, x[~has].view(np.int64), blocks))
                made = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made[0], pa.float64()), *[pa.array(c, pa.int64()) for c in made[1:4]], pa.array(made[4], pa.list_(pa.int64())), pa.array(made[5], pa.list_(pa.int32()))],
                                                 names=["x", "y", "sim", *numbers, "own", "blocks"])

    kinds = [both.schema["x"], both.schema["y"], T.StructField("sim", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in numbers],
             T.StructField("own", T.ArrayType(T.LongType())), T.StructField("blocks", T.ArrayType(T.IntegerType()))]
    return both.mapInArrow(run, T.StructType(kinds))


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """node, class of the nodes of links (x, y): smallest labels spread over links and jump along labels until none changes."""
    sides = stored(links.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(links.select(F.col("y").alias("u"), F.col("x").alias("v"))), folder, f"{name}-sides")
    labels = stored(sides.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("class")), folder, f"{name}-0")
    step = 0
    while True:
        step += 1
        around = sides.join(labels, sides["v"] == labels["node"]).groupBy("u").agg(F.min("class").alias("near"))
        lower = labels.join(around, labels["node"] == around["u"]).select("node", "class", F.least("class", "near").alias("low"))
        heads = labels.select(F.col("node").alias("head"), F.col("class").alias("top"))
        jumped = lower.join(heads, lower["low"] == heads["head"], "left").select("node", F.least("low", F.coalesce("top", "low")).alias("class"), (F.least("low", F.coalesce("top", "low")) < F.col("class")).alias("changed"))
        after = stored(jumped, folder, f"{name}-{step}")
        labels = after.select("node", "class")
        if after.where("changed").limit(1).count() == 0:
            return labels


def classes(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """d, a, b (hashes of the text), node (the smallest id among exact copies) and class of every row."""
    signed = stored(sign(docs, doc_id, text), folder, "signatures")
    copies = stored(signed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("d").alias("keeper")).where("n > 1").select("a", "b", "n", "keeper"), folder, "copies")
    marked = signed.join(small(copies), ["a", "b"], "left").withColumn("node", F.when(F.col("n").isNull(), F.col("d")).otherwise(F.col("keeper"))).drop("n", "keeper")
    members = marked.where(F.col("d") == F.col("node")).select("node", F.explode("bands").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("last > leader").select("bucket", "leader")
    shared = members.join(leaders, "bucket").where("node <> leader")
    stars = stored(shared.select(F.col("node").alias("x"), F.col("leader").alias("y")).distinct(), folder, "pairs")
    known = bags(docs, stored(stars.select(F.explode(F.array("x", "y")).alias("d")).distinct(), folder, "ids"), folder, doc_id, text)
    tested = stored(verify(stars, known), folder, "stars")
    links = tested.where(F.col("sim") >= threshold).select("x", "y")
    labels = components(links, folder, "first")
    # What the leaders leave open: shingles outside the leader first, by leaders of their lists, then what is still open.
    lists = stored(outside(tested, labels), folder, "lists")
    heads = lists.groupBy("leader", "shingle").agg(F.min("x").alias("y"))
    more = verify(lists.join(heads, ["leader", "shingle"]).where("x <> y").select("x", "y").distinct(), known)
    more = stored(more.drop("own", "blocks"), folder, "heads").where(F.col("sim") >= threshold).select("x", "y")
    links = links.unionByName(more)
    labels = components(links, folder, "second")
    open_ = short_lists(tested, lists, labels, threshold).unionByName(within(tested, lists, labels, threshold)).distinct()
    rest = stored(verify(open_, known).drop("own", "blocks"), folder, "rest").where(F.col("sim") >= threshold).select("x", "y")
    if rest.limit(1).count():
        labels = components(links.unionByName(rest), folder, "all")
    rows = marked.select("d", "a", "b", "node")
    return rows.join(labels, "node", "left").select("d", "a", "b", "node", F.coalesce("class", "node").alias("class"))


def _placed(tested: DataFrame, labels: DataFrame) -> DataFrame:
    """The tested pairs (x, leader) with the classes of both, ``class`` and ``leads``."""
    own = tested.withColumnRenamed("y", "leader").join(labels.withColumnRenamed("node", "x"), "x", "left").withColumn("class", F.coalesce("class", "x"))
    of_leader = labels.select(F.col("node").alias("leader"), F.col("class").alias("leads"))
    return own.join(of_leader, "leader", "left").withColumn("leads", F.coalesce("leads", "leader"))


def outside(tested: DataFrame, labels: DataFrame) -> DataFrame:
    """leader, shingle, x, size: lists of the shingles that members have and their leader lacks, where a list spans components."""
    entries = _placed(tested, labels).select("leader", "x", "class", F.explode("own").alias("shingle"))
    mixed = entries.groupBy("leader", "shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("leader", "shingle", "size")
    return entries.join(mixed, ["leader", "shingle"]).select("leader", "shingle", "x", "size")


def _long_counts(lists: DataFrame) -> DataFrame:
    """leader, x, long, short: how many of a member's shingles outside the leader stand in long and in short lists."""
    is_long = (F.col("size") >= LONG).cast("long")
    return lists.groupBy("leader", "x").agg(F.sum(is_long).alias("long"), F.sum(1 - is_long).alias("short"))


def short_lists(tested: DataFrame, lists: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """x, y in different components that may be linked and share a shingle of a short list.

    A member's shingles are ordered: first those that no other component has, then short lists from the shortest on, then U. Of two
    linked texts the first shared shingle stands among the first (1 - s) n + 1 of both (prefix filter), and what they share
    is at most their shares of U and what both have from that shingle on (positional filter).
    """
    counts = _long_counts(lists)
    facts = _placed(tested, labels).join(counts, ["leader", "x"]).select("leader", "x", "nx", "class", "short", (F.col("common") + F.col("long")).alias("held"))
    ranked = lists.where(F.col("size") < LONG).withColumn("nth", F.row_number().over(Window.partitionBy("leader", "x").orderBy("size", "shingle")))
    own = ranked.join(facts, ["leader", "x"]).withColumn("rank", F.col("nx") - F.col("held") - F.col("short") + F.col("nth"))
    own = own.where(F.col("rank") <= F.floor((1 - threshold) * F.col("nx") + 1e-9) + 1).select("leader", "shingle", "x", "nx", "class", "held", (F.col("short") - F.col("nth") + 1).alias("left"))
    other = own.select("leader", "shingle", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("class").alias("cy"), F.col("held").alias("hy"), F.col("left").alias("ly"))
    most = F.least("held", "hy") + F.least("left", "ly")
    fits = most >= threshold / (1 + threshold) * (F.col("nx") + F.col("ny")) - 1e-6
    return own.join(other, ["leader", "shingle"]).where((F.col("x") < F.col("y")) & (F.col("class") != F.col("cy")) & fits).select("x", "y")


def within(tested: DataFrame, lists: DataFrame, labels: DataFrame, threshold: float, width: float = 1.02) -> DataFrame:
    """x, y in different components under one leader, x outside the leader's, that both hold enough of U.

    y is found by its size, in steps of ``width``: at least threshold * |x|, at most what x's share of U allows. Shingles of
    lists within one component count as outside U: only pairs of different components matter, and they share none. Of the leader's
    shingles two members share at most the sum of the smaller counts of each block, which tells changes in different places apart.
    """
    share = threshold / (1 + threshold)
    placed = _placed(tested, labels).where("nx > 0").select("leader", "x", "nx", "common", "blocks", "class", "leads").join(_long_counts(lists), ["leader", "x"], "left")
    placed = placed.withColumn("long", F.coalesce("long", F.lit(0).cast("long"))).withColumn("held", F.col("common") + F.col("long"))
    step = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(width)))
    most = F.col("held") / share - F.col("nx")
    able = placed.where(most >= threshold * F.col("nx") - 1e-6).withColumn("most", most + 1e-6)
    out = able.where("class <> leads").withColumn("bin", F.explode(F.sequence(step(threshold * F.col("nx")), step(F.greatest("most", threshold * F.col("nx"))))))
    every = able.select("leader", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("most").alias("most_y"), F.col("class").alias("class_y"), F.col("long").alias("long_y"), F.col("blocks").alias("blocks_y"), step(F.col("nx")).alias("bin"))
    fits = (F.col("most") >= F.col("ny")) & (F.col("most_y") >= F.col("nx"))
    held = F.aggregate(F.zip_with("blocks", "blocks_y", lambda p, q: F.least(p, q)), F.least("long", "long_y"), lambda a, x: a + x.cast("long"))
    met = out.join(every, ["leader", "bin"]).where((F.col("class") != F.col("class_y")) & fits & (held >= share * (F.col("nx") + F.col("ny")) - 1e-6))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = classes(docs, shared_folder(spark))
    return out.select(F.col("d").alias("doc_id"), F.col("class").alias("class_id"), (F.col("d") == F.col("class")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id stays, once; rows without an id and class stay, once each text.

    Rows travel in a struct, so other columns may have any names. Only ids and hashes are compared; texts are shuffled only of
    rows that stay and stand more than once.
    """
    folder = shared_folder(spark)
    found = stored(classes(docs, folder), folder, "classes")
    gone = found.where("d IS NOT NULL AND class <> d OR d IS NULL AND class IS NOT NULL").select(F.col("d").alias("gd"), F.col("a").alias("ga"), F.col("b").alias("gb")).distinct()
    twice = found.groupBy("d", "a", "b").agg(F.count("*").alias("n")).where("n > 1").select(F.col("d").alias("gd"), F.col("a").alias("ga"), F.col("b").alias("gb"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"), F.xxhash64(text).alias("a"), F.hash(text).alias("b"))
    same = F.col("d").eqNullSafe(F.col("gd")) & (F.col("a") == F.col("ga")) & (F.col("b") == F.col("gb"))
    kept, repeated = rows.join(small(gone), same, "left_anti"), small(twice)
    once = kept.join(repeated, same, "left_anti").select("row.*")
    return once.unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["d", "a", "b"]).select("row.*"))


def oracle() -> str:
    """SQL over all pairs of texts that share a shingle."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + {SHINGLE}], ' ') AS g FROM (SELECT *, unnest(range(0, greatest(len(ws) - {SHINGLE - 1}, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE c::DOUBLE / (u.n + v.n - c) >= {SIMILARITY} UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.t = b.t AND a.doc_id <> b.doc_id),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, e.y FROM r JOIN e ON r.reached = e.x)
SELECT node AS doc_id, min(reached) AS class_id, node = min(reached) AS kept FROM r GROUP BY node
"""
