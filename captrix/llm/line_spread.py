"""Line dedup by distinct-site spread.

A line that stands on many distinct sites is boilerplate. Lines found at least ``min_sites`` times (a line cannot be on
more sites than that) get a HyperLogLog sketch of their sites, merged by aggregation; where the estimate is within the
sketch's error of the threshold, the sites are counted exactly. Texts are read three times: to count lines, to store the occurrences of
frequent ones, and to cut. Of a boilerplate line, its first occurrence (by doc_id, then
place) stays and all others are removed.

A line is known by 96 bits of hash of its text without outer spaces; only lines with a word count. Documents are known by
doc_id and a hash of the row.

Edge cases: a null text has no lines and stays null; a null site is the empty site; equal rows (same id, text and site) are
treated alike, so the first occurrence stays in each of them; a null doc_id sorts first; an empty table gives an empty
table; a very long text is one row of its lines while it is split and cut, its lines are rows of hashes between; other columns of any name are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrix.llm.common import read, shared_folder, stored
from captrix.llm.positional_index import small

MIN_SITES, SKETCH_BITS, SIGMAS = 10, 12, 3.0


def _lines(keyed: DataFrame) -> DataFrame:
    """d, tie, site, pos, a, b: every line with a word."""
    cut = keyed.select("d", "tie", "site", F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return cut.select("d", "tie", "site", "pos", F.xxhash64(F.trim("line")).alias("a"), F.hash(F.trim("line")).alias("b"))


def _error(min_sites: int, bits: int) -> int:
    return max(1, math.ceil(SIGMAS * 1.04 / math.sqrt(2**bits) * min_sites))


def boilerplate(lines: DataFrame, folder: str, min_sites: int = MIN_SITES, bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """Occurrences of frequent lines, and a, b, first: the lines on at least ``min_sites`` sites and the place of their first occurrence."""
    frequent = stored(lines.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("a", "b"), folder, "frequent")
    some = stored(lines.join(small(frequent), ["a", "b"], "left_semi"), folder, "occurrences")
    spread = some.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(bits)).alias("sketch"), F.min(F.struct("d", "tie", "pos")).alias("first")).withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch")
    spread = stored(spread, folder, "spread")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= _error(min_sites, bits))
    exact = some.join(small(near.select("a", "b")), ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("exact"))
    decided = spread.join(exact, ["a", "b"], "left")
    return some, stored(decided.where(F.coalesce("exact", "sites") >= min_sites).select("a", "b", "first"), folder, "boilerplate")


def spread_dedup(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of ``docs`` in ``_row``, with n_lines, n_removed and body (the text without the removed lines)."""
    site_of: Column = F.coalesce(F.col(site).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(doc_id).alias("d"), body.alias("body"), site_of.alias("site"))
    keyed = keyed.withColumn("tie", F.xxhash64("d", "body", "site"))
    some, found = boilerplate(_lines(keyed.select("d", "tie", "site", "body")), folder, min_sites)
    gone = some.join(small(found), ["a", "b"]).where(~F.struct("d", "tie", "pos").eqNullSafe(F.col("first")))
    by_doc = gone.groupBy(F.col("d").alias("gd"), F.col("tie").alias("gt")).agg(F.collect_set("pos").alias("gone"))
    joined = keyed.join(by_doc, F.col("d").eqNullSafe(F.col("gd")) & (F.col("tie") == F.col("gt")), "left")
    cut = F.split("body", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.filter(cut, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    return joined.select("_row", F.size(F.filter(cut, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("body"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = spread_dedup(docs, shared_folder(spark))
    return out.select("_row.doc_id", "n_lines", F.when(F.col("n_removed") > 0, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"), F.sha2("body", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without its removed lines."""
    out = spread_dedup(docs, shared_folder(spark))
    text = F.when(F.col("_row.text").isNull(), F.lit(None)).otherwise(F.col("body"))
    return out.select(*[text.cast("string").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def oracle() -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, site, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d),
w AS (SELECT *, trim(line, ' ') AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT k FROM w GROUP BY k HAVING count(DISTINCT site) >= {MIN_SITES}),
r AS (SELECT doc_id, pos FROM w JOIN b USING (k) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1),
n AS (SELECT doc_id, count(*) AS k FROM w GROUP BY doc_id),
x AS (SELECT l.doc_id, count(r.pos) AS gone, coalesce(string_agg(CASE WHEN r.pos IS NULL THEN line END, chr(10) ORDER BY pos), '') AS body
      FROM l LEFT JOIN r USING (doc_id, pos) GROUP BY l.doc_id)
SELECT doc_id, coalesce(n.k, 0)::BIGINT AS n_lines, gone::BIGINT AS n_removed, sha256(body) AS kept_sha256 FROM x LEFT JOIN n USING (doc_id)
"""
