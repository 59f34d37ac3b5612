"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

``build_index`` writes the postings (term, row, position) of the training texts to the shared folder: every task writes
one segment sorted by term, so that a lookup prunes row groups by their term bounds. Only terms that some query has are
kept. ``phrase_matches`` takes the postings of each query's rarest term, turns them into candidate starts by subtracting
the term's offset, and intersects these with the offset-adjusted postings of the second rarest term, then of all others.
``proximity_matches`` allows every term to be up to ``slop`` words away from its place.

A row is known by an id given while the index is written, so null and repeated doc_ids do no harm. Every text ends with a
posting of the empty term, whose position is the number of words.

Edge cases: null or empty texts have no words; queries without words have no windows; a word is lower-cased in A-Z only;
repeated query texts share their windows and all their item ids are reported; an empty benchmark hits nothing; an empty
corpus gives an empty result; a very long text is a row of its words while it is split, and narrow postings from then on; other columns of
any name are ignored, and kept by the pipeline stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from captrix.llm.common import read, shared_folder, stored

#: What stands between words before A-Z is lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Query-side tables and row ids are broadcast up to so many rows (of at most about 100 bytes), and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class PositionalIndex:
    postings: DataFrame  # term (64-bit hash), row, pos
    documents: DataFrame  # row, doc_id, tie (hash of doc_id and text), n_words


def words_of(text: Column) -> Column:
    """Words as they stand; ``fold`` lower-cases them."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), GAP), "")


def fold(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count says that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def windows_of(items: DataFrame, folder: str, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, win, terms: every window of every item, the terms as words."""
    b = items.select(F.col(item_id).alias("item_id"), F.transform(words_of(F.col(text)), fold).alias("words"))
    n = F.size("words")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    cut = b.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, window))).alias("terms"))
    return stored(cut.select("item_id", F.xxhash64("terms").alias("win"), "terms").distinct(), folder, "windows")


def build_index(docs: DataFrame, vocabulary: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> PositionalIndex:
    """Write the postings of the vocabulary's terms (column ``word``) and read them back."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    ended = rows.select("row", F.xxhash64("doc_id", "text").alias("tie"), "doc_id", F.concat(words_of(F.col("text")), F.array(F.lit(""))).alias("words"))
    tokens = ended.select("row", "tie", "doc_id", F.posexplode("words").alias("pos", "raw")).withColumn("term", F.xxhash64(fold(F.col("raw"))))
    known = vocabulary.select("word").unionByName(docs.sparkSession.createDataFrame([("",)], "word string")).select(F.xxhash64("word").alias("term")).distinct()
    found = tokens.join(small(known), "term")
    end = F.col("raw") == ""
    segments = found.select("term", "row", "pos", F.when(end, F.col("doc_id")).alias("doc_id"), F.when(end, F.col("tie")).alias("tie")).sortWithinPartitions("term")
    index = stored(segments, folder, "postings")
    is_end = F.col("term") == F.xxhash64(F.lit(""))
    return PositionalIndex(index.where(~is_end).select("term", "row", "pos"), index.where(is_end).select("row", "doc_id", "tie", F.col("pos").cast("long").alias("n_words")))


def ranked_terms(index: PositionalIndex, windows: DataFrame, folder: str) -> DataFrame:
    """win, off, term, len, rank: the terms of windows whose terms all occur, the rarest first."""
    lists = windows.select("win", "terms").dropDuplicates(["win"])
    terms = lists.select("win", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "word")).withColumn("term", F.xxhash64("word"))
    counts = small(stored(index.postings.groupBy("term").agg(F.count("*").alias("n")), folder, "counts"))
    by_win = Window.partitionBy("win")
    ranked = terms.join(counts, "term", "left").withColumn("absent", F.max(F.col("n").isNull().cast("int")).over(by_win)).where("absent = 0")
    return stored(ranked.withColumn("rank", F.row_number().over(by_win.orderBy("n", "off"))).select("win", "off", "term", "len", "rank"), folder, "ranked")


def candidates(index: PositionalIndex, ranked: DataFrame) -> DataFrame:
    """row, win, start, len by the rarest term of each window."""
    first = ranked.where("rank = 1").select("term", "win", "off", "len")
    return index.postings.join(small(first), "term").select("row", "win", (F.col("pos") - F.col("off")).alias("start"), "len").where("start >= 0")


def phrase_matches(index: PositionalIndex, ranked: DataFrame, folder: str) -> DataFrame:
    """row, win, start, len of every exact occurrence."""
    found = stored(candidates(index, ranked), folder, "candidates")
    second = ranked.where("rank = 2").select("win", "off", "term")
    lists = index.postings.join(small(second.select("term").distinct()), "term", "left_semi")
    wanted = found.where("len > 1").join(small(second), "win").select("row", "win", "start", "len", "term", (F.col("start") + F.col("off")).alias("pos"))
    both = wanted.join(lists, ["row", "term", "pos"]).select("row", "win", "start", "len")
    left = stored(both.unionByName(found.where("len = 1")), folder, "pairs")
    others = ranked.where("rank > 2").select("win", "off", "term")
    rows = small(left.where("len > 2").select("row").distinct())
    lists = index.postings.join(rows, "row", "left_semi")
    wanted = left.where("len > 2").join(small(others), "win").select("row", "win", "start", "len", "term", (F.col("start") + F.col("off")).alias("pos"))
    whole = wanted.join(lists, ["row", "term", "pos"]).groupBy("row", "win", "start", "len").agg(F.count("*").alias("n")).where("n = len - 2").drop("n")
    return stored(whole.unionByName(left.where("len <= 2")), folder, "matches")


def proximity_matches(index: PositionalIndex, ranked: DataFrame, slop: int) -> DataFrame:
    """row, win, start, len where every term stands within ``slop`` words of its place, the rarest term in its place."""
    found = candidates(index, ranked)
    others = ranked.where("rank > 1").select("win", "off", "term")
    wanted = found.where("len > 1").join(small(others), "win").select("row", "win", "start", "len", "off", "term")
    near = F.abs(F.col("p.pos") - (F.col("w.start") + F.col("w.off"))) <= slop
    joined = wanted.alias("w").join(index.postings.alias("p"), (F.col("w.row") == F.col("p.row")) & (F.col("w.term") == F.col("p.term")) & near)
    whole = joined.select("w.row", "w.win", "w.start", "w.len", "w.off").distinct().groupBy("row", "win", "start", "len").agg(F.count("*").alias("n"))
    return whole.where("n = len - 1").drop("n").unionByName(found.where("len = 1"))


def contamination(docs: DataFrame, items: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """row, doc_id, tie, n_words, n_hit, items (sorted ids as strings), contaminated: one row for each document."""
    windows = windows_of(items, folder, item_id, item_text, window)
    index = build_index(docs, windows.select(F.explode("terms").alias("word")), folder, doc_id, text)
    hits = phrase_matches(index, ranked_terms(index, windows, folder), folder)
    spans = hits.groupBy("row", "start").agg((F.max("len") + F.col("start")).alias("stop"))
    before = F.max("stop").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.select("row", F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))).alias("new"))
    covered = new.groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    owners = small(windows.select("win", F.col("item_id").cast("string").alias("item")))
    named = hits.select("row", "win").distinct().join(owners, "win").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = index.documents.join(covered, "row", "left").join(named, "row", "left")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}).withColumn("contaminated", F.col("n_hit") > 0)


def op5(spark, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), shared_folder(spark))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    found = contamination(docs, read(spark, sf_dir, "benchmark"), shared_folder(spark)).where("contaminated").select(F.col("doc_id").alias("found_id"), F.col("tie").alias("found_tie")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("doc_id", F.col("text").cast("string")).alias("tie"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("tie") == F.col("found_tie")), "left_anti").select("row.*")


def oracle() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
b AS (SELECT item_id, {words} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s + 1:s + 10], ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 9, 1))) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
p AS (SELECT doc_id, n, s, array_to_string(ws[s + 1:s + n], ' ') AS g
      FROM (SELECT doc_id, n, ws, unnest(range(0, len(ws) - n + 1)) AS s FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM p JOIN w USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS k FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.k, 0)::BIGINT AS n_hit, coalesce(i.k, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(c.k, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
