"""Queries over the driver tables and the SQL that defines their results.

The driver tables hold no caption files, so cues are derived from ``conversations`` (file: conversation, place: turn); some have zero
or negative durations, overlaps and tags. Round trips write single-line cues in every format and parse them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrix.functions import detect, encoding
from captrix.functions import text as tx
from captrix.functions import timecode as tc
from captrix.operators import edit, quality, validate
from captrix.plans.pipeline import Builder, Pipeline
from captrix.schema import FORMATS, as_cues
from captrix.sources import reader, writers

QUERIES: dict = {}
ORACLES: dict = {}

START = "turn * 2500 + (length(text) * 37) % 4000"
CUES = f"""SELECT CAST(conv_id AS {{s}}) AS file_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, CAST({START} AS BIGINT) AS start_ms,
 CAST(CASE WHEN length(text) % 17 = 0 THEN {START} WHEN length(text) % 19 = 0 THEN greatest({START} - 100, 0) ELSE {START} + (length(text) * 53) % 4001 END AS BIGINT) AS end_ms,
 CASE turn % 4 WHEN 0 THEN '<i>' || text || '</i>' WHEN 1 THEN '[NOISE] ' || text WHEN 2 THEN 'JOHN: ' || text ELSE '{{{{b1}}}}' || text END AS text FROM conversations"""
#: Cues that every format can hold: whole texts as one line of ASCII, ends after starts; conversations of any length.
PLAIN = """SELECT CAST(conv_id AS {s}) AS file_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, CAST(turn * 1500 + (length(text) % 10) * 40 AS BIGINT) AS start_ms,
 CAST(turn * 1500 + (length(text) % 10) * 40 + 400 + (length(text) % 7) * 100 AS BIGINT) AS end_ms,
 'x' || rtrim({r}) AS text FROM conversations WHERE text IS NOT NULL"""


def _table(spark, sf_dir: str, sql: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    return as_cues(spark.sql(sql))


def cues(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, CUES.format(s="STRING"))


def plain_cues(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, PLAIN.format(s="STRING", r="regexp_replace(text, '[^A-Za-z0-9]+', ' ')"))


def _with(sql: str, base: str = CUES) -> str:
    inner = base.format(s="VARCHAR") if base is CUES else base.format(s="VARCHAR", r="regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')")
    return f"WITH cues AS ({inner})\n{sql}"


def query(name: str, oracle: str | None = None, base: str = CUES):
    """Register a function of a cues table, with the SQL over ``cues`` that gives its rows."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f((cues if base is CUES else plain_cues)(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle if oracle.lstrip().startswith("WITH") else _with(oracle, base)
        return f

    return add


KEY = ("file_id", "pos")
TIMES = (*KEY, "start_ms", "end_ms")
HTML = r"'</?(?:b|i|u|s|font|v|c)(?:\.[^>]*)?(?:\s[^>]*)?>'"
STRIPPED = rf"regexp_replace(regexp_replace(text, {HTML}, '', 'g'), '\{{[^}}]*\}}', '', 'g')"
PLAINTEXT = rf"regexp_replace(regexp_replace({STRIPPED}, '\\[Nn]', chr(10), 'g'), '\\h', ' ', 'g')"
TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
DUR = "greatest(end_ms - start_ms, 0)"
WORDS = lambda x: rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"
CPS = f"(length({PLAINTEXT}) / ({DUR} / 1000.0))"
WPM = f"({WORDS('text')} / ({DUR} / 60000.0))"
BY_TIME = "PARTITION BY file_id ORDER BY start_ms, end_ms, pos"
BY_POS = "PARTITION BY file_id ORDER BY pos"
NEW_POS = f"row_number() OVER ({BY_TIME}) - 1"
CLOCK = lambda x, point: f"printf('%02d:%02d:%02d{point}%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"
HUNDREDTHS = lambda x, h="%d": f"printf('{h}:%02d:%02d.%02d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000 // 10)"
LRC_STAMP = lambda x: f"printf('[%02d:%02d.%02d]', {x} // 60000, {x} // 1000 % 60, {x} % 1000 // 10)"
SBV_TIME = lambda x: f"printf('%d:%02d:%02d.%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"
L = lambda x: f"({x})::BIGINT"

# Projections

query("q_shift", f"SELECT file_id, pos, {L('greatest(start_ms - 1500, 0)')} AS start_ms, {L('greatest(end_ms - 1500, 0)')} AS end_ms FROM cues")(lambda c: edit.shift(c, -1500).select(*TIMES))
query("q_duration", f"SELECT file_id, pos, {L(DUR)} AS duration_ms FROM cues")(lambda c: c.select(*KEY, tx.duration_ms(F.col("start_ms"), F.col("end_ms")).alias("duration_ms")))


@query("q_cps", f"SELECT file_id, pos, CASE WHEN {DUR} > 0 THEN round({CPS}, 6) END AS cps, {DUR} = 0 AS is_inf FROM cues")
def _cps(c):
    v = tx.chars_per_second(F.col("text"), F.col("start_ms"), F.col("end_ms"))
    return c.select(*KEY, F.when(v != float("inf"), F.round(v, 6)).alias("cps"), (v == float("inf")).alias("is_inf"))


@query("q_wpm", f"SELECT file_id, pos, CASE WHEN {DUR} > 0 THEN round({WPM}, 6) END AS wpm, {DUR} = 0 AS is_inf FROM cues")
def _wpm(c):
    v = tx.reading_speed_wpm(F.col("text"), F.col("start_ms"), F.col("end_ms"))
    return c.select(*KEY, F.when(v != float("inf"), F.round(v, 6)).alias("wpm"), (v == float("inf")).alias("is_inf"))


def _text_query(name: str, f, sql: str) -> None:
    query(name, f"SELECT file_id, pos, {sql} AS text FROM cues")(lambda c: c.select(*KEY, f(F.col("text")).alias("text")))


#: Texts with what each normaliser looks for.
MESSY = "replace(replace(text, ' ', '  '), 'e', ' ,e') || '  \n\n\n\n“q” ‘r’ – — .... !!!!! . . . ♪ rn 1rn2 3O4 5l6 a0b (aside) '"


def _messy_query(name: str, f, sql) -> None:
    spark_sql = MESSY.replace("\n", "\\n")
    duck = MESSY.replace("\n", "' || chr(10) || '").replace("' || chr(10) || '' || chr(10) || '", "' || chr(10) || chr(10) || '")
    oracle = f"SELECT file_id, pos, {sql('text')} AS text FROM (SELECT file_id, pos, {duck} AS text FROM cues)"
    query(name, oracle)(lambda c: c.select(*KEY, F.expr(spark_sql).alias("text")).select(*KEY, f(F.col("text")).alias("text")))


_text_query("q_plaintext", tx.plaintext, PLAINTEXT)
_text_query("q_strip_tags", tx.strip_tags, STRIPPED)
_text_query("q_ass_to_plaintext", tx.ass_to_plaintext, r"regexp_replace(regexp_replace(regexp_replace(text, '\{[^}]*\}', '', 'g'), '\\[Nn]', chr(10), 'g'), '\\h', ' ', 'g')")

G = lambda x, pattern, by: f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
SQL_LINES = lambda x: f"string_split(regexp_replace({x}, '\\n$', ''), chr(10))"
SQL_WS = lambda x: TRIM(G(rf"regexp_replace(array_to_string(list_transform({SQL_LINES(x)}, lambda l: {G(TRIM('l'), ' {2,}', ' ')}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')", r"[ \t]+$", ""))
SQL_QUOTES = lambda x: f"replace(translate({x}, '“”‘’–', '\"\"''''-'), '—', '--')"
SQL_PUNCT = lambda x: f"replace({G(G(G(x, ' +([,!.;:?])', chr(92) + '1'), '([.!?,]){4,}', (chr(92) + '1') * 3), r'\.\s*\.\s*\.', '…')}, '....', '…')"


def _sql_ocr(x: str) -> str:
    for pattern, by in ((r"\brn\b", "m"), (r"(\d)rn(\w)", r"\1m\2"), (r"(\d)O(\d)", r"\10\2"), (r"(\d)l(\d)", r"\11\2"), (r"([a-z])0([a-z])", r"\1o\2")):
        x = G(x, pattern, by)
    return x


SQL_HI = lambda x: SQL_WS(TRIM(G(G(G(G(x, r"\s*[\(\[][^)\]]{2,60}[\)\]]", ""), r"\s*\[[^\]]{2,60}\]", ""), r"^(?:>>|>\s|-\s|[A-Z ]{2,20}:)\s*", ""), "[♪♫♬]", "")))
_messy_query("q_norm_ws", tx.normalize_whitespace, SQL_WS)
_messy_query("q_norm_quotes", tx.normalize_quotes, SQL_QUOTES)
_messy_query("q_norm_punct", tx.normalize_punctuation, SQL_PUNCT)
_messy_query("q_norm_ocr", tx.fix_ocr_errors, _sql_ocr)
_messy_query("q_norm_text", tx.normalize_text, lambda x: SQL_WS(SQL_PUNCT(SQL_QUOTES(x))))
_text_query("q_norm_hi", tx.strip_hearing_impaired, SQL_HI("text"))
_messy_query("q_filter_lang", lambda c: tx.filter_language(c, "en"), lambda x: G(x, "[^ -~]", ""))
#: One text with the scripts that languages keep.
SCRIPTS = "text || ' 你好,世界 ひらがな カタカナ 안녕 مرحبا שלום é 42'"
for _lang in ("zh", "ja", "ko", "ar", "he"):
    query(f"q_filter_lang_{_lang}", f"SELECT file_id, pos, regexp_replace({SCRIPTS}, '[^{tx.LANGUAGE_CHARACTERS[_lang]}]', '', 'g') AS text FROM cues".replace("\\n", "\n"))(
        lambda c, k=_lang: c.select(*KEY, tx.filter_language(F.expr(SCRIPTS), k).alias("text")))
_messy_query("q_newlines", tx.remove_all_newlines, lambda x: TRIM(G(f"replace({x}, chr(10), ' ')", " +", " ")))
_messy_query("q_replace_newlines", lambda c: tx.replace_newlines(c, " / "), lambda x: f"array_to_string({SQL_LINES(x)}, ' / ')")
query("q_chunks", r"""WITH RECURSIVE cues AS (""" + CUES.format(s="VARCHAR") + r"""),
g AS (SELECT file_id, pos, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws, 0 AS i, [] :: VARCHAR[] AS done, '' AS held FROM cues
 UNION ALL SELECT file_id, pos, ws, i + 1, CASE WHEN held <> '' AND strlen(held) + 1 + strlen(ws[i + 1]) > 20 THEN list_append(done, held) ELSE done END,
  CASE WHEN held = '' THEN ws[i + 1] WHEN strlen(held) + 1 + strlen(ws[i + 1]) <= 20 THEN held || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM g WHERE i < len(ws))
SELECT file_id, pos, array_to_string(CASE WHEN held <> '' THEN list_append(done, held) ELSE done END, '|') AS text FROM g WHERE i = len(ws)""")(lambda c: c.select(*KEY, F.array_join(tx.split_text_chunks(F.col("text"), 20), "|").alias("text")))
query("q_merge_short_lines", r"""WITH RECURSIVE cues AS (""" + CUES.format(s="VARCHAR") + r"""),
g AS (SELECT file_id, pos, string_split(regexp_replace(replace(text, '. ', '.' || chr(10)), '\n$', ''), chr(10)) AS ls, 0 AS i, [] :: VARCHAR[] AS done, '' AS held FROM cues
 UNION ALL SELECT file_id, pos, ls, i + 1,
  CASE WHEN l <> '' AND strlen(l) <= 40 THEN done ELSE list_append(CASE WHEN held <> '' THEN list_append(done, held) ELSE done END, l) END,
  CASE WHEN l <> '' AND strlen(l) <= 40 THEN CASE WHEN held = '' THEN l ELSE held || ' ' || l END ELSE '' END FROM (SELECT *, ls[i + 1] AS l FROM g WHERE i < len(ls)))
SELECT file_id, pos, array_to_string(CASE WHEN held <> '' THEN list_append(done, held) ELSE done END, chr(10)) AS text FROM g WHERE i = len(ls)""")(lambda c: c.select(*KEY, tx.merge_short_lines(F.replace(F.col("text"), F.lit(". "), F.lit(".\n")), 40).alias("text")))
#: Greedy rows by bytes, cut at the last liked place; a row that no word fits is cut by characters.
BREAKS = r"""WITH RECURSIVE cues AS (""" + CUES.format(s="VARCHAR") + r"""),
l AS (SELECT file_id, pos, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (SELECT file_id, pos, list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM cues)),
g AS (SELECT file_id, pos, i, 0 AS step, '' AS made, line AS rest, true AS more FROM l UNION ALL
 SELECT file_id, pos, i, step + 1, CASE WHEN length(rest) <= 42 THEN rest WHEN cut BETWEEN 1 AND len(ws) - 1 THEN array_to_string(ws[1:cut], ' ') ELSE substr(rest, 1, 42) END,
  CASE WHEN length(rest) <= 42 THEN '' WHEN cut BETWEEN 1 AND len(ws) - 1 THEN array_to_string(ws[cut + 1:], ' ') ELSE substr(rest, 43) END, length(rest) > 42 FROM (
  SELECT *, coalesce(list_max(list_filter(range(1, fit + 1), lambda k: regexp_matches(ws[k], '[,;:]$') OR ws[k + 1] IN ('and', 'or', 'but', 'so', 'yet', 'for'))), fit) AS cut FROM (
  SELECT *, coalesce(list_max(list_filter(range(1, len(ws) + 1), lambda k: strlen(array_to_string(ws[1:k], ' ')) <= 42)), 0) AS fit FROM (
  SELECT *, list_filter(regexp_split_to_array(rest, '\s+'), lambda x: x <> '') AS ws FROM g WHERE more AND (step = 0 OR rest <> '')))))
SELECT file_id, pos, string_agg(made, chr(10) ORDER BY i, step) AS text FROM g WHERE step > 0 GROUP BY file_id, pos"""
query("q_optimize_line_breaks", BREAKS)(lambda c: c.select(*KEY, tx.optimize_line_breaks(F.col("text"), 42).alias("text")))
JSON_SPAN = lambda text, bold: f"""'[{{"text":' || to_json({text}) || ',"bold":{bold},"italic":false,"underline":false}}]'"""
query("q_ass_tags", f"SELECT file_id, pos, CASE WHEN text LIKE '{{b1}}%' THEN {JSON_SPAN('substr(text, 5)', 'true')} ELSE {JSON_SPAN('text', 'false')} END AS parts FROM cues")(lambda c: c.select(*KEY, F.to_json(tx.parse_ass_tags(F.col("text"))).alias("parts")))
@query("q_text_parts", "SELECT file_id, pos, text || '!' AS text, CASE pos % 2 WHEN 1 THEN 5 ELSE 4 END AS first_format, 6 AS second_format, '#00ff00' AS color FROM cues")
def _text_parts(c):
    """Spans made by hand, then restyled: the first bold in odd cues, the second italic, all underlined and green."""
    first = F.when(F.col("pos") % 2 == 1, tx.text_part(F.col("text"), bold=True)).otherwise(tx.text_part(F.col("text"), color="#ff0000"))
    d = c.select(*KEY, tx.restyle(F.array(first, tx.text_part(F.lit("!"), italic=True)), underline=True, color="#00ff00").alias("parts"))
    part = lambda k: F.get("parts", F.lit(k))
    return d.select(*KEY, tx.parts_text(F.col("parts")).alias("text"), tx.part_format(part(0)).cast("int").alias("first_format"), tx.part_format(part(1)).cast("int").alias("second_format"), part(0)["color"].alias("color"))


query("q_fps", f"SELECT file_id, pos, {L('round(start_ms * (25.0 / 23.976))')} AS start_ms, {L('round(end_ms * (25.0 / 23.976))')} AS end_ms FROM cues")(lambda c: edit.transform_framerate(c, 23.976, 25.0).select(*TIMES))


@query("q_frames", f"SELECT file_id, pos, {L('round(start_ms * 23.976 / 1000)')} AS frame, {L('round(round(start_ms * 23.976 / 1000) * 1000.0 / 23.976)')} AS ms, {L('round(start_ms / 1000.0 * 25.0)')} AS mpl2 FROM cues")
def _frames(c):
    frame = tc.ms_to_frames(F.col("start_ms"), 23.976)
    return c.select(*KEY, frame.alias("frame"), tc.frames_to_ms(frame, 23.976).alias("ms"), tc.mpl2_ms_to_frame(F.col("start_ms"), 25.0).alias("mpl2"))


for _name, _f, _sql in (("srt", lambda c: tc.format_timestamp(c), CLOCK("start_ms", ",")), ("vtt", lambda c: tc.format_timestamp(c, "WebVTT"), CLOCK("start_ms", ".")), ("ass", tc.format_ass_time, HUNDREDTHS("start_ms")),
                        ("subviewer", tc.format_subviewer_time, HUNDREDTHS("start_ms", "%02d")), ("sbv", tc.format_sbv_time, SBV_TIME("start_ms")), ("lrc", tc.format_lrc_time, LRC_STAMP("start_ms"))):
    query(f"q_format_{_name}", f"SELECT file_id, pos, {_sql} AS stamp FROM cues")(lambda c, f=_f: c.select(*KEY, f(F.col("start_ms")).alias("stamp")))


@query("q_parse_timestamp", "SELECT file_id, pos, start_ms, end_ms, 'align:start' AS settings FROM cues")
def _parse_timestamp(c):
    line = F.concat(tc.format_timestamp(F.col("start_ms")), F.lit(" --> "), tc.format_timestamp(F.col("end_ms"), "vtt"), F.lit(" align:start"))
    return c.select(*KEY, tc.parse_timestamps(line).alias("t")).select(*KEY, F.col("t.start").alias("start_ms"), F.col("t.end").alias("end_ms"), "t.settings")


#: An hour has 107,892 frames exactly.
#: The loose form, without hours and with fractions as whole ms.
@query("q_parse_timestamp_loose", "SELECT file_id, pos, start_ms, (end_ms % 60000)::BIGINT AS end_ms FROM cues")
def _parse_loose(c):
    part = lambda x, unit, size: F.floor(F.col(x) / unit).cast("long") % size
    a = F.format_string("%d:%d:%d,%d", F.floor(F.col("start_ms") / 3600000).cast("long"), part("start_ms", 60000, 60), part("start_ms", 1000, 60), F.col("start_ms") % 1000)
    b = F.format_string("0:%d.%d", part("end_ms", 1000, 60), F.col("end_ms") % 1000)
    return c.select(*KEY, tc.parse_timestamp(a).alias("start_ms"), tc.parse_timestamp(b).alias("end_ms"))


@query("q_scc_timecode", f"""SELECT file_id, pos, printf('%02d:%02d:%02d;%02d', h, m, left_ // 30, left_ % 30) AS timecode, {L('round((h * 107892 + left_ + m * 1800 - 2 * (m - m // 10)) / 29.97 * 1000)')} AS ms FROM (
SELECT *, frames - (m * 1800 - 2 * (m - m // 10)) AS left_ FROM (SELECT *, list_max(list_filter(range(0, 61), lambda k: k * 1800 - 2 * (k - k // 10) <= frames)) AS m FROM (
SELECT file_id, pos, start_ms // 3600000 AS h, round(start_ms % 3600000 * 29.97 / 1000)::BIGINT AS frames FROM cues)))""")
def _scc_timecodes(c):
    d = c.select(*KEY, tc.ms_to_scc_timecode(F.col("start_ms"), F.lit(True)).alias("timecode"))
    n = lambda k: F.get(F.split("timecode", "[:;]"), F.lit(k)).cast("long")
    return d.withColumn("ms", tc.scc_timecode_to_ms(n(0), n(1), n(2), n(3), F.lit(True)))


@query("q_smpte", f"SELECT file_id, pos, printf('%d:%d:%d:%d', n // 90000, n // 1500 % 60, n // 25 % 60, n % 25) AS timecode, {L('round(n / 25.0 * 1000)')} AS ms FROM (SELECT file_id, pos, round(start_ms / 1000.0 * 25.0)::BIGINT AS n FROM cues)")
def _smpte(c):
    d = c.select(*KEY, tc.smpte_frames(F.col("start_ms")).alias("t"))
    return d.select(*KEY, F.format_string("%d:%d:%d:%d", "t.h", "t.m", "t.s", "t.f").alias("timecode"), tc.smpte_to_ms(F.col("t.h"), F.col("t.m"), F.col("t.s"), F.col("t.f")).alias("ms"))


@query("q_ass_color", "SELECT file_id, pos, (start_ms % 256)::INT AS r, (end_ms % 256)::INT AS g, (pos % 256)::INT AS b, 128 AS a, printf('&H80%02X%02X%02X', pos % 256, end_ms % 256, start_ms % 256) AS color FROM cues")
def _ass_color(c):
    d = c.select(*KEY, tc.format_ass_color(F.col("start_ms") % 256, F.col("end_ms") % 256, F.col("pos") % 256, F.lit(128)).alias("color"))
    return d.withColumn("p", tc.parse_ass_color(F.col("color"))).select(*KEY, "p.r", "p.g", "p.b", "p.a", "color")


query("q_pad_left", "SELECT file_id, pos, printf('%03d', start_ms) AS padded FROM cues")(lambda c: c.select(*KEY, tc.pad_left(F.col("start_ms"), 3).alias("padded")))
query("q_map", "SELECT file_id, pos, text || '!' AS text FROM cues")(lambda c: edit.map_cues(c, text=F.concat("text", F.lit("!"))).select(*KEY, "text"))
query("q_translate", "SELECT file_id, pos, '[x] ' || text AS text FROM cues")(lambda c: c.select(*KEY, tx.translate_with(F.col("text"), lambda t: "[x] " + t).alias("text")))

# Filters and ordered edits


def _repeated(c: DataFrame) -> DataFrame:
    twice = c.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("k") == 0) | (F.col("pos") % 3 != 2))
    return twice.withColumns({"pos": F.col("pos") * 2 + F.col("k"), "text": F.when(F.col("k") == 1, F.concat(F.lit(" "), "text", F.lit("  "))).otherwise(F.col("text"))}).drop("k")


query("q_sort", f"SELECT file_id, {L(NEW_POS)} AS pos, start_ms, end_ms, text FROM cues")(lambda c: edit.sort(c).select(*TIMES, "text"))
query("q_filter", f"SELECT file_id, {L(f'row_number() OVER ({BY_POS}) - 1')} AS pos, text FROM cues WHERE end_ms > start_ms")(lambda c: edit.filter_cues(c, F.col("end_ms") > F.col("start_ms")).select(*KEY, "text"))
query("q_filter_empty", rf"SELECT file_id, {L(f'row_number() OVER ({BY_POS}) - 1')} AS pos, text FROM (SELECT file_id, pos, CASE WHEN pos % 3 = 0 THEN '  ' ELSE text END AS text FROM cues) WHERE {TRIM('text')} <> ''")(
    lambda c: edit.filter_empty(c.withColumn("text", F.when(F.col("pos") % 3 == 0, "  ").otherwise(F.col("text")))).select(*KEY, "text"))
#: Whole texts, each but every third with a copy in other white space behind it.
REPEATED = "SELECT file_id, pos * 2 + k AS pos, CASE k WHEN 1 THEN ' ' || text || '  ' ELSE text END AS text FROM cues, (VALUES (0), (1)) AS t(k) WHERE k = 0 OR pos % 3 <> 2"
query("q_dedup", f"""SELECT file_id, {L(f'row_number() OVER ({BY_POS}) - 1')} AS pos, text FROM (SELECT *, lag(text) OVER ({BY_POS}) AS before, lag(pos) OVER ({BY_POS}) AS place FROM ({REPEATED}))
WHERE place IS NULL OR {TRIM('before')} IS DISTINCT FROM {TRIM('text')}""")(lambda c: edit.remove_duplicates(_repeated(c)).select(*KEY, "text"))
query("q_extract_range", f"SELECT file_id, {L(f'row_number() OVER ({BY_POS}) - 1')} AS pos, {L('greatest(start_ms, 3000)')} AS start_ms, {L('least(end_ms, 9000)')} AS end_ms FROM cues WHERE start_ms < 9000 AND end_ms > 3000")(
    lambda c: edit.extract_range(c, 3000, 9000).select(*TIMES))
query("q_remove_overlaps", f"SELECT file_id, {L(NEW_POS)} AS pos, {L(f'greatest(start_ms, coalesce(lag(end_ms) OVER ({BY_TIME}), 0))')} AS start_ms, end_ms FROM cues")(lambda c: edit.remove_overlaps(c).select(*TIMES))


def _extend_sql(need: str) -> str:
    return f"SELECT file_id, {L(NEW_POS)} AS pos, start_ms, {L(f'CASE WHEN {DUR} < {need} THEN least(start_ms + {need}, coalesce(lead(start_ms) OVER ({BY_TIME}), 9223372036854775807)) ELSE end_ms END')} AS end_ms FROM cues"


query("q_min_duration", _extend_sql("1000"))(lambda c: edit.enforce_min_duration(c, 1000).select(*TIMES))
query("q_auto_extend", _extend_sql(f"ceil(length({PLAINTEXT}) / 20.0 * 1000)::BIGINT"))(lambda c: edit.auto_extend_for_cps(c, 20.0).select(*TIMES))
query("q_max_duration", f"SELECT file_id, pos, start_ms, {L(f'CASE WHEN {DUR} > 2000 THEN start_ms + 2000 ELSE end_ms END')} AS end_ms FROM cues")(lambda c: edit.enforce_max_duration(c, 2000).select(*TIMES))


def _merge_sql(source: str, gap: int) -> str:
    return f"""SELECT file_id, {L('island - 1')} AS pos, arg_min(start_ms, n) AS start_ms, arg_max(end_ms, n) AS end_ms, string_agg(text, chr(10) ORDER BY n) AS text FROM (
SELECT *, sum(opens) OVER (PARTITION BY file_id ORDER BY n) AS island FROM (SELECT *, row_number() OVER ({BY_TIME}) AS n,
 CASE WHEN lag(end_ms) OVER ({BY_TIME}) IS NULL OR greatest(start_ms - lag(end_ms) OVER ({BY_TIME}), 0) > {gap} THEN 1 ELSE 0 END AS opens FROM {source})) GROUP BY file_id, island"""


query("q_merge_adjacent", _merge_sql("cues", 200))(lambda c: edit.merge_adjacent(c, 200).select(*TIMES, "text"))
query("q_split_long", r"""WITH RECURSIVE cues AS (""" + CUES.format(s="VARCHAR") + rf"""),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM cues),
g AS (SELECT file_id, pos, ws, 0 AS i, [] :: VARCHAR[] AS done, '' AS held FROM w WHERE length(text) > 30 AND end_ms > start_ms AND len(ws) > 0
 UNION ALL SELECT file_id, pos, ws, i + 1, CASE WHEN held <> '' AND strlen(held) + 1 + strlen(ws[i + 1]) > 30 THEN list_append(done, held) ELSE done END,
  CASE WHEN held = '' THEN ws[i + 1] WHEN strlen(held) + 1 + strlen(ws[i + 1]) <= 30 THEN held || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM g WHERE i < len(ws)),
k AS (SELECT file_id, pos, list_append(done, held) AS chunks FROM g WHERE i = len(ws)),
a AS (SELECT c.*, coalesce(k.chunks, [c.text]) AS chunks, len(coalesce(k.chunks, [c.text])) AS n FROM cues c LEFT JOIN k USING (file_id, pos)),
e AS (SELECT *, unnest(range(0, n)) AS i FROM a)
SELECT file_id, {L('row_number() OVER (PARTITION BY file_id ORDER BY pos, i) - 1')} AS pos, {L('CASE WHEN n > 1 THEN start_ms + i * greatest((end_ms - start_ms) // n, 1) ELSE start_ms END')} AS start_ms,
 {L('CASE WHEN n > 1 THEN start_ms + (i + 1) * greatest((end_ms - start_ms) // n, 1) ELSE end_ms END')} AS end_ms, chunks[i + 1] AS text FROM e""")(lambda c: edit.split_long(c, 30).select(*TIMES, "text"))
query("q_concatenate", f"""SELECT file_id, {L('row_number() OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, second, pos) - 1')} AS pos, start_ms, end_ms, text FROM (
SELECT *, 0 AS second FROM cues UNION ALL SELECT file_id, pos, (start_ms + o.e + 1000)::BIGINT, (end_ms + o.e + 1000)::BIGINT, text, 1 FROM cues JOIN (SELECT file_id, max(end_ms) AS e FROM cues GROUP BY file_id) o USING (file_id))""")(
    lambda c: edit.concatenate(c, c, 1000).select(*TIMES, "text"))
query("q_pipeline", f"""{_with('').rstrip()}, s AS (SELECT file_id, pos, (start_ms + 500)::BIGINT AS start_ms, (end_ms + 500)::BIGINT AS end_ms, text FROM cues), m AS ({_merge_sql('s', 200)})
SELECT file_id, pos, start_ms, {L(f'CASE WHEN {DUR} > 4000 THEN start_ms + 4000 ELSE end_ms END')} AS end_ms, text FROM m""")(
    lambda c: Pipeline.from_json('{"operations": [{"op": "Sort"}, {"op": "Shift", "offset_ms": 500}, {"op": "MergeAdjacent", "max_gap_ms": 200}, {"op": "EnforceMaxDuration", "max_ms": 4000}]}').apply(c).select(*TIMES, "text"))

#: The other operations, each as a pipeline of its own; the edit's own SQL defines the result.
EMPTY_THIRDS = lambda c: c.withColumn("text", F.when(F.col("pos") % 3 == 0, "  ").otherwise(F.col("text")))
for _name, _same, _columns, _made, _op in (
    ("split_long", "q_split_long", (*TIMES, "text"), lambda c: c, {"op": "SplitLong", "max_chars": 30}), ("transform_fps", "q_fps", TIMES, lambda c: c, {"op": "TransformFps", "in_fps": 23.976, "out_fps": 25.0}),
    ("remove_overlaps", "q_remove_overlaps", TIMES, lambda c: c, {"op": "RemoveOverlaps"}), ("min_duration", "q_min_duration", TIMES, lambda c: c, {"op": "EnforceMinDuration", "min_ms": 1000}),
    ("auto_extend", "q_auto_extend", TIMES, lambda c: c, {"op": "AutoExtendCps", "max_cps": 20.0}), ("filter_empty", "q_filter_empty", (*KEY, "text"), EMPTY_THIRDS, {"op": "FilterEmpty"}),
    ("dedup", "q_dedup", (*KEY, "text"), _repeated, {"op": "RemoveDuplicates"}),
):
    query(f"q_pipeline_{_name}", ORACLES[_same])(lambda c, made=_made, op=_op, columns=_columns: Pipeline([op]).apply(made(c)).select(*columns))
query("q_builder", ORACLES["q_pipeline"])(lambda c: Builder(c).sort().shift(500).merge_adjacent(200).enforce_max_duration(4000).build().select(*TIMES, "text"))

# Validation and quality

ISSUES = f"""SELECT file_id, 'NegativeDuration' AS kind, pos AS a, NULL::BIGINT AS b, 1 AS phase, pos * 2 AS rank FROM cues WHERE end_ms < start_ms
UNION ALL SELECT file_id, 'ZeroDuration', pos, NULL, 1, pos * 2 + 1 FROM cues WHERE end_ms = start_ms
UNION ALL SELECT file_id, 'Overlap', pos, nxt, 2, n FROM (SELECT *, lead(start_ms) OVER ({BY_TIME}) AS ns, lead(pos) OVER ({BY_TIME}) AS nxt, row_number() OVER ({BY_TIME}) AS n FROM cues) WHERE end_ms > ns
UNION ALL SELECT file_id, 'DecreasingStartTime', pos, NULL, 3, pos FROM (SELECT *, lag(start_ms) OVER ({BY_POS}) AS ps FROM cues) WHERE start_ms < ps"""
MORE = f"""UNION ALL SELECT file_id, 'TextTooLong', pos, NULL, 4, pos * 2 FROM cues WHERE length(text) > 42
UNION ALL SELECT file_id, 'CpsTooHigh', pos, NULL, 4, pos * 2 + 1 FROM cues WHERE CASE WHEN {DUR} > 0 THEN {CPS} > 25 ELSE true END
UNION ALL SELECT file_id, 'TooLongGap', pos, NULL, 5, pos FROM (SELECT *, lag(end_ms) OVER ({BY_POS}) AS pe FROM cues) WHERE greatest(start_ms - pe, 0) > 500"""
SEQ = f"SELECT file_id, {L('row_number() OVER (PARTITION BY file_id ORDER BY phase, rank) - 1')} AS seq, kind, a AS index, b AS index_b FROM"
query("q_validate", f"{SEQ} ({ISSUES})")(lambda c: validate.validate(c).select("file_id", "seq", "kind", "index", "index_b"))
query("q_validate_ext", f"{SEQ} ({ISSUES} {MORE})")(lambda c: validate.validate_extended(c, 42, 500, 25.0).select("file_id", "seq", "kind", "index", "index_b"))
query("q_issue_text", f"SELECT file_id, pos, 'subtitle ' || pos || ' has zero duration at ' || start_ms || 'ms' AS description FROM cues WHERE start_ms = end_ms")(
    lambda c: validate.validate(c).where("kind = 'ZeroDuration'").select("file_id", F.col("index").alias("pos"), "description"))
SENTENCES = f"""SELECT file_id, pos AS index, 'Overlap' AS kind, 'OVERLAP' AS code, 'subtitle ' || pos || ' (ends at ' || end_ms || 'ms) overlaps with subtitle ' || nxt || ' (starts at ' || ns || 'ms)' AS description, NULL::DOUBLE AS cps
 FROM (SELECT *, lead(start_ms) OVER ({BY_TIME}) AS ns, lead(pos) OVER ({BY_TIME}) AS nxt FROM cues) WHERE end_ms > ns
UNION ALL SELECT file_id, pos, 'NegativeDuration', 'NEG_DUR', 'subtitle ' || pos || ' has negative duration: ' || start_ms || 'ms -> ' || end_ms || 'ms', NULL FROM cues WHERE end_ms < start_ms
UNION ALL SELECT file_id, pos, 'ZeroDuration', 'ZERO_DUR', 'subtitle ' || pos || ' has zero duration at ' || start_ms || 'ms', NULL FROM cues WHERE end_ms = start_ms
UNION ALL SELECT file_id, pos, 'DecreasingStartTime', 'DECR_START', 'subtitle ' || pos || ' starts at ' || start_ms || 'ms before previous subtitle''s start time ' || ps || 'ms', NULL FROM (SELECT *, lag(start_ms) OVER ({BY_POS}) AS ps FROM cues) WHERE start_ms < ps
UNION ALL SELECT file_id, pos, 'TooLongGap', 'LONG_GAP', 'subtitle ' || pos || ': ' || greatest(start_ms - pe, 0) || 'ms gap between ' || pe || 'ms and ' || start_ms || 'ms', NULL FROM (SELECT *, lag(end_ms) OVER ({BY_POS}) AS pe FROM cues) WHERE greatest(start_ms - pe, 0) > 500
UNION ALL SELECT file_id, pos, 'TextTooLong', 'LONG_TEXT', 'subtitle ' || pos || ' has ' || length(text) || ' characters (max recommended: 42)', NULL FROM cues WHERE length(text) > 42
UNION ALL SELECT file_id, pos, 'CpsTooHigh', 'HIGH_CPS', 'subtitle ' || pos || ' has N chars/second (max recommended: 25.0)', CASE WHEN {DUR} > 0 THEN round({CPS}, 4) END FROM cues WHERE CASE WHEN {DUR} > 0 THEN {CPS} > 25 ELSE true END"""


@query("q_issue_text_all", SENTENCES)
def _sentences(c):
    """Every kind's sentence; the speed in it, to one decimal, is compared as a number."""
    found = validate.validate_extended(c, 42, 500, 25.0)
    return found.select("file_id", "index", "kind", "code", F.regexp_replace("description", r"has [0-9.inf]+ chars/second", "has N chars/second").alias("description"), F.when(F.col("cps") != float("inf"), F.round("cps", 4)).alias("cps"))


query("q_info_speed", f"SELECT file_id, CASE WHEN min({DUR}) > 0 THEN round(greatest(max({CPS}), 0.0), 4) END AS max_cps, min({DUR}) = 0 AS is_inf FROM cues GROUP BY file_id")(
    lambda c: quality.info(c).select("file_id", F.when(F.col("max_cps") != float("inf"), F.round("max_cps", 4)).alias("max_cps"), (F.col("max_cps") == float("inf")).alias("is_inf")))
N_ISSUES = f"((length({PLAINTEXT}) > 42)::INT + (CASE WHEN {DUR} > 0 THEN {CPS} > 25 ELSE true END)::INT + coalesce(greatest(start_ms - pe, 0) > 500, false)::INT)"
WITH_BEFORE = f"(SELECT *, lag(end_ms) OVER ({BY_POS}) AS pe FROM cues)"
query("q_quality_cue", f"""SELECT file_id, pos AS index, {L(DUR)} AS duration_ms, {L(f'length({PLAINTEXT})')} AS char_count, {L(WORDS(PLAINTEXT))} AS word_count, {L(N_ISSUES)} AS n_issues,
 length(text) > 42 AND NOT contains(text, chr(10)) AS has_poor_line_break FROM {WITH_BEFORE}""")(
    lambda c: quality.quality_cues(c, 42, 500, 25.0).select("file_id", "index", "duration_ms", "char_count", "word_count", "n_issues", "has_poor_line_break"))
#: All cues count; averages over a cue without duration are infinite, shown as null beside a flag.
query("q_quality_file", f"""SELECT file_id, count(*) AS total_subtitles, sum(n)::BIGINT AS total_issues, {L(f'floor(sum({DUR}) / count(*))')} AS avg_duration_ms, CASE WHEN min({DUR}) > 0 THEN round(avg({CPS}), 4) END AS avg_cps,
 CASE WHEN min({DUR}) > 0 THEN round(avg({WPM}), 4) END AS avg_wpm, min({DUR}) = 0 AS is_inf, CASE WHEN max(n) > 0 THEN max(struct_pack(n := n, pos := pos)).pos END AS worst_index FROM (SELECT *, {N_ISSUES} AS n FROM {WITH_BEFORE}) GROUP BY file_id""")(
    lambda c: quality.quality_report(c, 42, 500, 25.0).select("file_id", "total_subtitles", "total_issues", "avg_duration_ms", *[F.when(F.col(x) != float("inf"), F.round(x, 4)).alias(x) for x in ("avg_cps", "avg_wpm")],
                                                              (F.col("avg_cps") == float("inf")).alias("is_inf"), "worst_index"))
query("q_info", f"""{_with('').rstrip()}, i AS (SELECT file_id, count(*) AS n FROM ({ISSUES}) GROUP BY file_id)
SELECT c.file_id, count(*) AS n_cues, arg_min(start_ms, pos) AS first_start_ms, arg_max(end_ms, pos) AS last_end_ms, {L(f'floor(sum({DUR}) / count(*))')} AS avg_duration_ms, {L(f'min({DUR})')} AS min_duration_ms, {L(f'max({DUR})')} AS max_duration_ms,
 sum(length(text))::BIGINT AS total_chars, {L('greatest(arg_max(end_ms, pos) - arg_min(start_ms, pos), 0)')} AS total_duration_ms, coalesce(max(i.n), 0)::BIGINT AS n_issues FROM cues c LEFT JOIN i ON i.file_id = c.file_id GROUP BY c.file_id""")(
    lambda c: quality.info(c).drop("max_cps"))
query("q_timestamps", "SELECT file_id, count(*) AS n_cues, arg_min(start_ms, pos) AS first_ms, arg_max(end_ms, pos) AS last_ms, arg_max(end_ms, pos) - arg_min(start_ms, pos) AS duration_ms FROM cues GROUP BY file_id")(quality.timestamps)

# Writers and parsers

#: Drop-frame time code.
SCC_FRAMES = lambda x: f"round({x} % 3600000 * 29.97 / 1000)::BIGINT"
SCC_MINUTE = lambda x: f"list_max(list_filter(range(0, 61), lambda k: k * 1800 - 2 * (k - k // 10) <= {SCC_FRAMES(x)}))"
SCC_LEFT = lambda x: f"({SCC_FRAMES(x)} - ({SCC_MINUTE(x)} * 1800 - 2 * ({SCC_MINUTE(x)} - {SCC_MINUTE(x)} // 10)))"
SCC_CLOCK = lambda x: f"printf('%02d:%02d:%02d;%02d', {x} // 3600000, {SCC_MINUTE(x)}, {SCC_LEFT(x)} // 30, {SCC_LEFT(x)} % 30)"
TTML = ("'" + writers.ttml_text([], None).partition("    </div>")[0] + f"' || string_agg('      <p begin=\"' || {CLOCK('start_ms', '.')} || '\" end=\"' || {CLOCK('end_ms', '.')} || '\">' || text || '</p>', chr(10) ORDER BY pos) || '\n    </div>"
        + writers.ttml_text([], None).partition("    </div>")[2] + "'")
WHISPER = ("'{\n  \"segments\": [\n' || string_agg('    {\n      \"avg_logprob\": -1.0,\n      \"compression_ratio\": 1.0,\n      \"end\": ' || (end_ms / 1000.0) || ',\n      \"id\": 0,\n      \"no_speech_prob\": 0.0,\n      \"seek\": 0,\n      \"start\": '"
           " || (start_ms / 1000.0) || ',\n      \"temperature\": 0.0,\n      \"text\": \"' || text || '\",\n      \"tokens\": []\n    }', ',' || chr(10) ORDER BY pos) || '\n  ],\n  \"text\": \"' || string_agg(text, ' ' ORDER BY pos) || '\"\n}'")
RENDERED = {
    "srt": f"string_agg((pos + 1) || chr(10) || {CLOCK('start_ms', ',')} || ' --> ' || {CLOCK('end_ms', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY pos) || chr(10)",
    "vtt": f"'WEBVTT' || chr(10) || chr(10) || string_agg((pos + 1) || chr(10) || {CLOCK('start_ms', '.')} || ' --> ' || {CLOCK('end_ms', '.')} || chr(10) || text, chr(10) || chr(10) ORDER BY pos) || chr(10)",
    "sbv": f"string_agg({SBV_TIME('start_ms')} || ',' || {SBV_TIME('end_ms')} || ',' || text || chr(10), '' ORDER BY pos)",
    "lrc": f"string_agg({LRC_STAMP('start_ms')} || text || chr(10), '' ORDER BY pos)",
    "microdvd": "string_agg('{' || round(start_ms * 23.976 / 1000)::BIGINT || '}{' || round(end_ms * 23.976 / 1000)::BIGINT || '}' || text || chr(10), '' ORDER BY pos)",
    "mpl2": "string_agg('[' || round(start_ms / 1000.0 * 23.976)::BIGINT || '][' || round(end_ms / 1000.0 * 23.976)::BIGINT || ']' || text || chr(10), '' ORDER BY pos)",
    "sami": "'" + ("<SAMI>\n" + writers.SAMI_HEAD + "\n<Body>\n") + "' || string_agg('<Sync Start=' || start_ms || '><P>' || text || '</P></Sync>' || chr(10), '' ORDER BY pos) || '</Body>' || chr(10) || '</SAMI>' || chr(10)",
    "subviewer": "'" + writers.SUBVIEWER_HEAD.format(author="captrix") + f"\n\n' || string_agg({HUNDREDTHS('start_ms', '%02d')} || ',' || {HUNDREDTHS('end_ms', '%02d')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY pos)",
    "ass": "'[Script Info]\n" + writers.ASS_INFO + "\n[V4+ Styles]\n" + writers.ASS_STYLE_FORMAT + writers.style_line(writers.DEFAULT_STYLE) + "\n[Events]\n" + writers.ASS_EVENT_FORMAT
           + f"' || string_agg('Dialogue: 0,' || {HUNDREDTHS('start_ms')} || ',' || {HUNDREDTHS('end_ms')} || ',Default,,0,0,0,,' || text || chr(10), '' ORDER BY pos)",
    "scc": f"'Scenarist_SCC V1.0' || chr(10) || chr(10) || string_agg({SCC_CLOCK('start_ms')} || chr(9) || '9420 94ad ' || array_to_string(list_transform(string_split(text, ''), lambda c: printf('%04X', ascii(c))), ' ')"
           f" || ' 942f' || chr(10) || {SCC_CLOCK('end_ms')} || chr(9) || '942c' || chr(10) || chr(10), '' ORDER BY pos)",
    "ttml": TTML, "dfxp": TTML, "whisper": WHISPER,
}
DIGEST = lambda sql: f"SELECT file_id, sha256({sql}) AS digest FROM cues GROUP BY file_id"
for _fmt, _sql in RENDERED.items():
    query(f"q_render_{_fmt}", DIGEST(_sql), PLAIN)(lambda c, f=_fmt: writers.render(c, f).select("file_id", F.sha2(F.col("content").cast("binary"), 256).alias("digest")))

#: Blocks of 128 bytes in hexadecimal: number, times, extension, place, 112 bytes of text.
STL_TIME = lambda x: f"printf('%02x%02x%02x%02x', round({x} / 1000.0 * 25.0)::BIGINT // 90000, round({x} / 1000.0 * 25.0)::BIGINT // 1500 % 60, round({x} / 1000.0 * 25.0)::BIGINT // 25 % 60, round({x} / 1000.0 * 25.0)::BIGINT % 25)"
STL = f"""SELECT file_id, sha256(unhex(repeat('00', 1024) || string_agg('00' || printf('%04x', (pos + 1) % 65535) || {STL_TIME('start_ms')} || {STL_TIME('end_ms')} || '00' || CASE WHEN n = 1 THEN '00' WHEN k = n - 1 THEN 'ff' ELSE printf('%02x', k) END
 || '001400' || rpad(hex(encode(substr(text, 112 * k + 1, 112))), 224, '0'), '' ORDER BY pos, k))) AS digest FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, (length(text) + 111) // 112 AS n FROM cues)) GROUP BY file_id"""
query("q_render_ebu_stl", STL, PLAIN)(lambda c: writers.render(c, "ebu_stl").select("file_id", F.sha2("content", 256).alias("digest")))

EXACT = ("start_ms", "end_ms")
TENTHS = ("start_ms // 10 * 10", "end_ms // 10 * 10")
AT = lambda f: (f.format("start_ms"), f.format("end_ms"))
QUANTISED = {"srt": EXACT, "vtt": EXACT, "ttml": EXACT, "dfxp": EXACT, "sbv": EXACT, "whisper": EXACT, "ass": TENTHS, "ssa": TENTHS, "subviewer": TENTHS, "lrc": ("start_ms // 10 * 10", "start_ms // 10 * 10 + 5000"),
             "sami": ("start_ms", f"coalesce(lead(start_ms) OVER ({BY_POS}), start_ms + 3000)"), "microdvd": AT("round(round({} * 23.976 / 1000) * 1000.0 / 23.976)"), "mpl2": AT("round(round({} / 1000.0 * 23.976) / 23.976 * 1000)"),
             "scc": AT("round(round({} * 29.97 / 1000) / 29.97 * 1000)"), "ebu_stl": AT("round(round({} / 1000.0 * 25.0) / 25.0 * 1000)")}


def _round_trip(c: DataFrame, fmt: str) -> DataFrame:
    return reader.cues_of(reader.parse_texts(writers.render(c, fmt), fmt, text="content", mode="FAILFAST")).select(*TIMES, "text")


for _fmt in FORMATS:
    _a, _b = QUANTISED[_fmt]
    query(f"q_roundtrip_{_fmt}", f"SELECT file_id, pos, {L(_a)} AS start_ms, {L(_b)} AS end_ms, text FROM cues", PLAIN)(lambda c, f=_fmt: _round_trip(c, f))



def _parsed(c: DataFrame, fmt: str, **options) -> DataFrame:
    return reader.parse_texts(writers.render(c, fmt, **options), fmt, text="content", mode="FAILFAST")


#: Styled spans: bold words before plain ones, and coloured or spoken ones.
SPAN = lambda bold, more: f"""'[{{"text":"' || text || '","bold":{bold},"italic":false,"underline":false{more}}}]'"""
for _fmt, _open, _close, _more in (("srt", '<font color="#ff8800">', "</font>", ',"color":"#ff8800"'), ("vtt", "<v Ann>", "</v>", ',"voice":"Ann"')):
    query(f"q_rich_text_{_fmt}", f"""SELECT file_id, pos, CASE pos % 3 WHEN 0 THEN text || ' end' ELSE text END AS text, CASE pos % 3 WHEN 0 THEN {SPAN('true', '')} WHEN 1 THEN {SPAN('false', _more)} END AS parts FROM cues""", PLAIN)(
        lambda c, f=_fmt, a=_open, z=_close: reader.cues_of(_parsed(c.withColumn("text", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("<b>"), "text", F.lit("</b> end"))).when(F.col("pos") % 3 == 1, F.concat(F.lit(a), "text", F.lit(z))).otherwise(F.col("text"))), f))
        .select(*KEY, "text", F.to_json("text_parts").alias("parts")))


@query("q_heads", f"""SELECT file_id, w AS format, h AS head, count(*) AS n_cues FROM cues, (VALUES ('vtt', 'WEBVTT'), ('ass', 'Default Arial 48 false 100.0 2 1'), ('sami', 'Name: English; lang: en-US;}}'), ('scc', '29.97 true'),
 ('microdvd', '25.0'), ('mpl2', '23.976'), ('subviewer', '[AUTHOR]captrix'), ('lrc', 'lines')) AS t(w, h) GROUP BY ALL""", PLAIN)
def _heads(c):
    """What files say of themselves beside their cues, as parsed from what the writers made."""
    c = c.repartition("file_id")
    style = F.get("styles", F.lit(0))
    heads = {
        "vtt": F.col("header"), "ass": F.concat_ws(" ", style["name"], style["fontname"], style["fontsize"].cast("string"), style["bold"].cast("string"), style["scale_x"].cast("string"), style["alignment"].cast("string"), style["encoding"].cast("string")),
        "sami": F.col("class_styles")["ENCC"], "scc": F.concat_ws(" ", F.col("fps").cast("string"), F.col("drop_frame").cast("string")), "microdvd": F.col("fps").cast("string"), "mpl2": F.col("fps").cast("string"),
        "subviewer": F.get(F.split("header", "\n"), F.lit(2)), "lrc": F.when(F.size("lrc_lines") == F.col("n_cues"), F.lit("lines")),
    }
    out = None
    for f, head in heads.items():
        one = reader.files_of(_parsed(c, f, **({"fps": 25.0} if f == "microdvd" else {}))).select("file_id", F.lit(f).alias("format"), head.alias("head"), "n_cues")
        out = one if out is None else out.unionByName(one)
    return out


query("q_microdvd_fps", f"SELECT file_id, pos, {L('round(round(start_ms * 25.0 / 1000) * 1000.0 / 25.0)')} AS start_ms, {L('round(round(end_ms * 25.0 / 1000) * 1000.0 / 25.0)')} AS end_ms, text FROM cues", PLAIN)(
    lambda c: reader.cues_of(_parsed(c, "microdvd", fps=25.0)).select(*TIMES, "text"))

#: What detection says of files that the writers made. EBU STL heads are blank, and DFXP files have the TTML name space.
DETECTED = {f: f for f in FORMATS} | {"ssa": "ass", "dfxp": "ttml", "ebu_stl": None}


def _detected(c: DataFrame) -> DataFrame:
    c, out = c.repartition("file_id"), None  # one exchange, which all formats use
    for f in FORMATS:
        one = writers.render(c, f).select("file_id", F.lit(f).alias("written"), F.col("content").cast("binary").alias("content"))
        name = F.lit(None).cast("string") if f == "ebu_stl" else encoding.detect_encoding(F.col("content"))  # its bytes are no text
        one = one.select("file_id", "written", detect.detect_format(F.col("content")).alias("detected"), name.alias("encoding"))
        out = one if out is None else out.unionByName(one)
    return out


DETECTED_ROWS = ", ".join(f"('{k}', {chr(39) + v + chr(39) if v else 'NULL'})" for k, v in DETECTED.items())
query("q_detect", f"""SELECT file_id, w AS written, CASE WHEN w <> 'lrc' OR n < {detect.LRC_MAX_LINES} THEN d END AS detected, CASE WHEN w <> 'ebu_stl' THEN 'UTF-8' END AS encoding
FROM (SELECT file_id, count(*) AS n FROM cues GROUP BY file_id), (VALUES {DETECTED_ROWS}) AS t(w, d)""", PLAIN)(_detected)


#: Files that the writers do not make: with DFXP's name space, a script without styles, EBU STL with a head that counts its blocks.
@query("q_detect_other", "SELECT file_id, w AS written, CASE WHEN w <> 'ebu_stl' OR n < 65536 THEN w END AS detected FROM (SELECT file_id, count(*) AS n FROM cues GROUP BY file_id), (VALUES ('dfxp'), ('ssa'), ('ebu_stl')) AS t(w)", PLAIN)
def _detected_other(c):
    c = c.repartition("file_id")
    made = lambda f, content: writers.render(c, f).select("file_id", F.lit(f).alias("written"), content.cast("binary").alias("content"))
    blocks = F.expr("(octet_length(content) - 1024) div 128")
    head = F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(blocks % 65536), 4, "0")))
    rows = made("dfxp", F.replace(F.col("content"), F.lit(detect.TTML), F.lit(detect.DFXP[1]))).unionByName(made("ssa", F.replace(F.col("content"), F.lit("V4+ Styles"), F.lit("Styles"))))
    rows = rows.unionByName(made("ebu_stl", F.concat(head, F.substring(F.col("content"), 4, 1 << 30))))
    return rows.select("file_id", "written", detect.detect_format(F.col("content")).alias("detected"))


#: Texts that are no UTF-8 in these encodings: codec, name, text.
LEGACY = [
    ("cp1252", "windows-1252", "Über die Brücke"), ("cp1252", "windows-1252", "garçon français"), ("cp1252", "windows-1252", "Déjà vu à l’école"), ("cp1252", "windows-1252", "El niño comió piñas"),
    ("cp1252", "windows-1252", "“Quotes” – it’s fine"), ("cp1250", "windows-1250", "Příliš žluťoučký kůň"), ("cp1250", "windows-1250", "Dziękuję, gdzie jest łazienka?"), ("cp1251", "windows-1251", "Привет, как дела?"),
    ("koi8_u", "KOI8-U", "Я не знаю, что сказать"), ("cp1253", "windows-1253", "Δεν ξέρω τι να πω"), ("cp1254", "windows-1254", "Bugün hava çok güzel, değil mi"), ("cp1255", "windows-1255", "אני לא יודע מה לומר"),
    ("cp1256", "windows-1256", "مرحبا كيف حالك اليوم"), ("shift_jis", "Shift_JIS", "ありがとうございます"), ("euc_jp", "EUC-JP", "こんにちは、元気ですか"), ("gb18030", "GBK", "今天天气很好，我们去公园吧"), ("big5", "Big5", "我不知道該說什麼"),
    ("euc_kr", "EUC-KR", "안녕하세요, 잘 지내세요?"),
]
LEGACY_ROWS = ", ".join(f"({k}, '{name}', '{text}')" for k, (_, name, text) in enumerate(LEGACY))


@query("q_encoding_legacy", f"SELECT file_id, pos, name AS encoding, t.text AS text FROM cues JOIN (VALUES {LEGACY_ROWS}) AS t(k, name, text) ON t.k = (cues.file_id::BIGINT + pos) % {len(LEGACY)}", PLAIN)
def _legacy(c):
    content = F.element_at(F.array(*[F.unhex(F.lit(text.encode(codec).hex())) for codec, _, text in LEGACY]), ((F.col("file_id").cast("long") + F.col("pos")) % len(LEGACY) + 1).cast("int"))
    return c.select(*KEY, encoding.detect_encoding(content).alias("encoding"), encoding.decode_to_string(content).alias("text"))


@query("q_encoding", "SELECT file_id, pos, text || ' é' AS utf8, text || ' é' AS bom, text || ' é' AS utf16le, text || ' é' AS utf16be, 'UTF-8-BOM' AS bom_name, 'UTF-16LE' AS le_name, 'UTF-16BE' AS be_name FROM cues", PLAIN)
def _encodings(c):
    t = F.concat(F.col("text"), F.lit(" é"))
    mark = lambda h, b: F.concat(F.unhex(F.lit(h)), b)
    d = c.select(*KEY, F.encode(t, "UTF-8").alias("a"), mark("EFBBBF", F.encode(t, "UTF-8")).alias("b"), mark("FFFE", F.encode(t, "UTF-16LE")).alias("l"), mark("FEFF", F.encode(t, "UTF-16BE")).alias("e"))
    text, name = encoding.decode_to_string, encoding.detect_encoding
    return d.select(*KEY, text(F.col("a")).alias("utf8"), text(F.col("b")).alias("bom"), text(F.col("l")).alias("utf16le"), text(F.col("e")).alias("utf16be"), name(F.col("b")).alias("bom_name"), name(F.col("l")).alias("le_name"), name(F.col("e")).alias("be_name"))


EXT_ROWS = ", ".join(f"('{e}', '{f}')" for e, f in detect.EXTENSIONS.items())


@query("q_extension", f"SELECT file_id || '/cap.' || e AS path, f AS format FROM (SELECT DISTINCT file_id FROM cues), (VALUES {EXT_ROWS}, ('TXT', NULL), ('SRT', 'srt')) AS t(e, f)", PLAIN)
def _extension(c):
    d = c.select("file_id").distinct().withColumn("e", F.explode(F.array(*[F.lit(e) for e in (*detect.EXTENSIONS, "TXT", "SRT")])))
    return d.select(F.concat("file_id", F.lit("/cap."), "e").alias("path")).withColumn("format", detect.format_of_path(F.col("path")))


@query("q_parse_errors", """SELECT file_id, CASE WHEN file_id::BIGINT % 2 = 0 THEN count(*) ELSE 0 END AS n_cues, CASE WHEN file_id::BIGINT % 2 = 1 THEN 'UnexpectedLine' END AS kind FROM cues GROUP BY file_id""", PLAIN)
def _parse_errors(c):
    texts = writers.render(c, "srt").withColumn("content", F.when(F.col("file_id").cast("long") % 2 == 1, F.concat(F.lit("1\nno time\n\n"), F.col("content"))).otherwise(F.col("content")))
    return reader.files_of(reader.parse_texts(texts, "srt", text="content")).select("file_id", "n_cues", F.col("parse_error.kind").alias("kind"))


query("q_json", "SELECT file_id, pos, start_ms, end_ms FROM cues", PLAIN)(
    lambda c: writers.to_json(c).select(F.from_json("value", "file_id string, pos long, start_ms long, end_ms long").alias("v")).select("v.*"))


def flagship(spark, sf_dir: str) -> DataFrame:
    """Sort, shift and merge every conversation, then count and bound each file."""
    merged = edit.chain(cues(spark, sf_dir), edit.sort, lambda c: edit.shift(c, 500), lambda c: edit.merge_adjacent(c, 200))
    return merged.groupBy("file_id").agg(F.count("*").alias("n_cues"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


QUERIES["q_flagship"] = flagship
ORACLES["q_flagship"] = _with("").rstrip() + f""", s AS (SELECT file_id, pos, (start_ms + 500)::BIGINT AS start_ms, (end_ms + 500)::BIGINT AS end_ms, text FROM cues), m AS ({_merge_sql('s', 200)})
SELECT file_id, count(*) AS n_cues, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM m GROUP BY file_id"""
