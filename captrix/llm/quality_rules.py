"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gets base counts and two Jensen-Shannon distances: of its character classes and of its common words, each
against the histogram of its language. The references are summed over all documents of a language and joined as a table of one row
a language, broadcast if a count says that it is small; nothing of them passes through the driver.

Edge cases: a null text counts as empty; a document whose language is null is held against the nearest reference; without any
reference (empty table) the divergence rules pass; documents below the minimum lengths pass the divergence rules; all rows
are kept, equal ones included; a very long text is counted as any other (its windows as one array); other columns are kept, but
those named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrix.llm.common import shared_folder, stored
from captrix.llm.positional_index import small

SPACE = r"[\x20\x09-\x0D]+"
#: Closed-class words, the bins of the common-word histogram.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with"],
    "de": ["der", "die", "und", "den", "das", "mit", "sich", "nicht", "ein", "von"],
    "fr": ["le", "la", "les", "et", "des", "du", "que", "un", "une", "pour"],
    "es": ["el", "los", "las", "y", "que", "se", "por", "con", "para", "una"],
}
#: Character classes; what none of them matches is the last bin (letters beyond ASCII and the rest).
LETTERS, BLANKS = r"a-z", r"\x20\x09-\x0D"
CLASSES = [LETTERS, r"A-Z", r"0-9", BLANKS, r".,;:!?'\"()\x2D", r"#*$%&|<>@\x5B\x5C\x5D^_`{}~+=/"]
MIN_CHARS, MIN_WORDS = 200, 80
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.27
#: References that a document without language is compared with at once.
BLOCK_LANGUAGES = 256
#: The columns of a judgement.
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words", "base_failed", "kept"]
#: Positions share a long with the upper bits of a window's hash up to this many words.
_BITS = 20


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ``_words`` and ``_rest`` (the text without a-z) to the rows.

    A 5-word window is known by a 64-bit hash of its words. What is no small letter is counted in ``_rest``, which is a fraction of the text.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.col("n_words")
    d = docs.withColumn("_text", t).withColumns({"_words": F.array_remove(F.split("_text", SPACE), ""), "_rest": F.regexp_replace("_text", f"[{LETTERS}]+", "")})
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.length("_text") - F.length("_rest") + F.length(F.regexp_replace("_rest", SPACE, ""))).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_rest", r"[^#*$%&|<>]+", "")).cast("long"),
        "_lines": lines,
    })
    w = F.col("_words")
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])
    d = d.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.size("_words") - 5), window)).otherwise(F.array().cast("array<long>")),
    })
    d = d.withColumn("_repeats", F.size(F.array_distinct("_h")) < F.size("_h"))
    return d.withColumn("n_repeat_words", F.when(F.col("_repeats"), F.when(n < (1 << _BITS), _covered_small()).otherwise(_covered_any())).otherwise(F.lit(0).cast("long"))).drop("_lines", "_h", "_repeats", "_text")


def _covered_small() -> Column:
    """Words in windows found twice: sort (hash, position) packed into longs, keep positions beside an equal hash.

    Where unequal hashes share their upper bits, equal ones may not be neighbours, so the whole hashes are sorted instead.
    """
    low = (1 << _BITS) - 1
    h = F.col("_h")
    keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    at = lambda v: v.bitwiseAND(F.lit(low)).cast("int")
    alike = lambda v, w: F.coalesce(v.bitwiseAND(F.lit(~low)) == w.bitwiseAND(F.lit(~low)), F.lit(False))
    same = lambda k, v, j: alike(v, F.get(k, j)) & F.coalesce(F.get(h, at(F.get(k, j))) == F.get(h, at(v)), F.lit(False))

    def mixed(k: Column) -> Column:
        return F.exists(F.transform(k, lambda v, j: alike(v, F.get(k, j + 1)) & ~same(k, v, j + 1)), lambda x: x)

    def kept(k: Column) -> Column:
        return F.transform(k, lambda v, j: F.when(same(k, v, j - 1) | same(k, v, j + 1), at(v)).otherwise(F.lit(-1)))

    return _let(keys, lambda k: F.when(mixed(k), _covered_any()).otherwise(_let(F.sort_array(F.filter(kept(k), lambda p: p >= 0)), _union_length)))


def _covered_any() -> Column:
    """The same for texts of any length: sort structs of hash and position."""
    keys = F.array_sort(F.transform(F.col("_h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def kept(k: Column) -> Column:
        same = lambda v, j: F.coalesce(F.get(k, j)["h"] == v["h"], F.lit(False))
        return F.transform(k, lambda v, j: F.when(same(v, j - 1) | same(v, j + 1), v["i"]).otherwise(F.lit(-1)))

    return _let(keys, lambda k: _let(F.sort_array(F.filter(kept(k), lambda p: p >= 0)), _union_length))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _union_length(pos: Column) -> Column:
    step = F.transform(pos, lambda p, j: F.coalesce(F.least(F.lit(5), F.get(pos, j + 1) - p), F.lit(5)).cast("long"))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)


def histograms(counted: DataFrame, text: str = "text", words: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``_chars`` (counts of character classes) and ``_common`` (counts of common words, then of all others)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bins = sorted({w for ws in (words or COMMON_WORDS).values() for w in ws})
    found = F.array_join(F.filter(F.col("_words"), lambda w: w.isin(bins)), "  ")
    counted = counted.withColumns({
        "_found": F.concat(F.lit(" "), found, F.lit(" ")),
        "_all": F.length(t).cast("long"),
    })
    # Small letters are what the rest leaves, white space what words leave.
    only = lambda c: F.length(F.regexp_replace("_rest", f"[^{c}]+", ""))
    counts = {c: F.col("_all") - F.length("_rest") if c == LETTERS else F.col("_all") - F.col("word_chars") if c == BLANKS else only(c) for c in CLASSES}
    counted = counted.withColumn("_c", F.array(*[counts[c].cast("long") for c in CLASSES]))
    each = [((F.length("_found") - F.length(F.replace(F.col("_found"), F.lit(f" {b} "), F.lit("")))) / (len(b) + 2)).cast("long") for b in bins]
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    counted = counted.withColumn("_w", F.array(*each))
    return counted.withColumns({
        "_chars": F.concat(F.col("_c"), F.array(F.col("_all") - total(F.col("_c")))),
        "_common": F.concat(F.col("_w"), F.array(F.col("n_words") - total(F.col("_w")))),
    }).drop("_found", "_c", "_w", "_all", "_rest")


def references(hists: DataFrame, lang: str = "lang", n_bins: tuple[int, int] | None = None) -> DataFrame:
    """lang, rc, rw: of every language the shares of both histograms, summed over all its documents."""
    nc, nw = n_bins or (len(CLASSES) + 1, len({w for ws in COMMON_WORDS.values() for w in ws}) + 1)
    names = {"rc": [f"c{i}" for i in range(nc)], "rw": [f"w{i}" for i in range(nw)]}
    sums = hists.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(
        *[F.sum(F.get("_chars", F.lit(i))).alias(c) for i, c in enumerate(names["rc"])], *[F.sum(F.get("_common", F.lit(i))).alias(c) for i, c in enumerate(names["rw"])]
    )
    total = {k: sum(F.col(c) for c in cs) for k, cs in names.items()}
    return sums.where((total["rc"] > 0) & (total["rw"] > 0)).select("lang", *[F.array(*[F.col(c) / total[k] for c in cs]).alias(k) for k, cs in names.items()])


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, between counts and shares of the same bins."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    half = lambda p, m: F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(F.lit(0.0))

    def term(c: Column, q: Column) -> Column:
        p = c / F.greatest(total, F.lit(1.0))
        return half(p, (p + q) / 2) + half(q, (p + q) / 2)

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda a, x: a + x)))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", base_failed: Column | None = None,
          max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, keep_text: bool = True) -> DataFrame:
    """Add the base counts, js_chars, js_words, base_failed and kept to every row of ``docs``; columns of these names are replaced.

    Counts and histograms are written to the shared folder, so that texts are read once for both references and verdicts.
    """
    own = [c for c in docs.columns if c not in RESULTS and (keep_text or c != text)]
    work = docs.select(F.struct(F.lit(0), *own).alias("_row"), F.col(text).alias("_t"), F.col(lang).alias("_lang"))
    folder = shared_folder(docs.sparkSession)
    hists = stored(histograms(base_counts(work, "_t"), "_t").drop("_words", "_t").withColumn("_id", F.monotonically_increasing_id()), folder, "histograms")
    refs = stored(references(hists, "_lang"), folder, "references")
    judged = ["_row", *RESULTS[:7]]
    long_enough = (F.col("word_chars") >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS)
    own_refs = small(refs.withColumnRenamed("lang", "_lang"))
    known = hists.where(F.col("_lang").isNotNull()).join(own_refs, "_lang", "left")
    known = known.withColumns({"js_chars": F.when(long_enough, js_distance(F.col("_chars"), F.col("rc"))), "js_words": F.when(long_enough, js_distance(F.col("_common"), F.col("rw")))}).select(judged)
    out = known.unionByName(_nearest(hists.where(F.col("_lang").isNull()), refs, long_enough).select(judged))
    failed = base_failed if base_failed is not None else (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = F.coalesce(F.col("js_chars") > max_class_distance, F.lit(False)) | F.coalesce(F.col("js_words") > max_word_distance, F.lit(False))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~(F.col("base_failed") | far))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in own], *RESULTS)


def _nearest(rows: DataFrame, refs: DataFrame, long_enough: Column) -> DataFrame:
    """js_chars and js_words of rows without language: the least distances to any reference, block by block of ``BLOCK_LANGUAGES``."""
    n_blocks = max(1, -(-refs.count() // BLOCK_LANGUAGES))
    blocks = refs.groupBy(F.pmod(F.xxhash64("lang"), F.lit(n_blocks)).alias("block")).agg(F.collect_list("rc").alias("rcs"), F.collect_list("rw").alias("rws"))
    least = lambda counts, all_: F.when(long_enough, F.array_min(F.transform(all_, lambda q: js_distance(F.col(counts), q))))
    if n_blocks == 1:
        met = rows.withColumn("block", F.lit(0).cast("long")).join(small(blocks), "block", "left")
        return met.withColumns({"js_chars": least("_chars", F.col("rcs")), "js_words": least("_common", F.col("rws"))})
    dealt = rows.select("_id", "_chars", "_common", "n_words", "word_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    each = dealt.join(blocks, "block").select("_id", least("_chars", F.col("rcs")).alias("c"), least("_common", F.col("rws")).alias("w"))
    return rows.join(each.groupBy("_id").agg(F.min("c").alias("js_chars"), F.min("w").alias("js_words")), "_id", "left")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    work = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("t"), F.col("lang").alias("l"))
    return judge(work, "t", "l", keep_text=False).where("kept").select("doc.*")


def oracle() -> str:
    """SQL of the whole rule set."""
    bins = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    re_classes = [c.replace(r"\"", '"') for c in CLASSES]
    chars = ", ".join(f"length(regexp_replace(t, {quote('[^' + c + ']+')}, '', 'g'))" for c in re_classes)
    common = ", ".join(f"len(list_filter(ws, lambda x: x = {quote(b)}))" for b in bins)
    half = "CASE WHEN {p} > 0 THEN 0.5 * {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0.0 END"
    one = lambda p, q: half.format(p=p, q=q)
    js = lambda a, b: f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({a}, {b}), lambda z: {one('z[1]', 'z[2]')} + {one('z[2]', 'z[1]')}))))"
    share = lambda h: f"list_transform({h}, lambda x: x / greatest(list_sum({h}), 1.0))"
    nc, nw = len(CLASSES) + 1, len(bins) + 1
    sums = lambda h, n: "[" + ", ".join(f"sum({h}[{i + 1}])::DOUBLE" for i in range(n)) + "]"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT *, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM a),
k AS (SELECT doc_id, n_words, unnest(range(0, n_words - 4)) AS i, ws FROM b WHERE n_words >= 5),
w AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM k),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM r, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
f AS (SELECT b.*, coalesce(c.n, 0)::BIGINT AS n_repeat_words, [{chars}] AS h0, [{common}] AS h1 FROM b LEFT JOIN c USING (doc_id)),
e AS (SELECT * EXCLUDE (h0, h1), list_append(h0, length(t) - list_sum(h0)) AS hc, list_append(h1, n_words - list_sum(h1)) AS hw FROM f),
s AS (SELECT lang AS rl, {sums('hc', nc)} AS rc0, {sums('hw', nw)} AS rw0 FROM e WHERE lang IS NOT NULL GROUP BY lang),
q AS (SELECT rl, {share('rc0')} AS rc, {share('rw0')} AS rw FROM s WHERE list_sum(rc0) > 0 AND list_sum(rw0) > 0),
p AS (SELECT *, {share('hc')} AS pc, {share('hw')} AS pw FROM e),
m AS (SELECT p.doc_id, min({js('pc', 'rc')}) AS jc, min({js('pw', 'rw')}) AS jw FROM p JOIN q
        ON q.rl = p.lang OR p.lang IS NULL OR p.lang NOT IN (SELECT rl FROM q) GROUP BY p.doc_id),
v AS (SELECT e.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        word_chars >= {MIN_CHARS} AND n_words >= {MIN_WORDS} AND (coalesce(jc, 0) > {MAX_CLASS_DISTANCE} OR coalesce(jw, 0) > {MAX_WORD_DISTANCE}) AS far
      FROM e LEFT JOIN m USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR far) AS kept FROM v
"""

