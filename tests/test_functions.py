"""Values of column functions, over small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from captrix import registry
from captrix.functions import detect, encoding
from captrix.functions import text as tx
from captrix.functions import timecode as tc


def values(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_timestamps(spark):
    assert values(spark, tc.parse_timestamp, ["00:00:01,000", "1:02:03.456", "00:00:01,000 junk", "01:02.5", "75:00,250", "x", "00:00:01", None]) == [1000, 3723456, 1000, 62005, 4500250, None, None, None]
    assert values(spark, tc.format_timestamp, [0, 3723456, 360000000], "long") == ["00:00:00,000", "01:02:03,456", "100:00:00,000"]
    assert values(spark, lambda c: tc.format_timestamp(c, "WEBVTT"), [1], "long") == ["00:00:00.001"]
    assert values(spark, lambda c: tc.pad_left(c, 3), [7, 12345], "long") == ["007", "12345"]
    got = values(spark, tc.parse_timestamps, ["00:00:01.000 --> 00:00:02.000 align:start", "00:00:01.000 --> 00:00:02.000"])
    assert [tuple(g) for g in got] == [(1000, 2000, "align:start"), (1000, 2000, None)]


def test_frames_and_colours(spark):
    assert values(spark, lambda c: tc.frames_to_ms(tc.ms_to_frames(c, 25.0), 25.0), [0, 40, 1000], "long") == [0, 40, 1000]
    assert [tuple(x) for x in values(spark, tc.parse_ass_color, ["&H80112233", "&hFF", "nonsense"])] == [(0x33, 0x22, 0x11, 0x80), (255, 0, 0, 0), (255, 255, 255, 0)]
    drop = lambda c: tc.ms_to_scc_timecode(c, F.lit(True))
    assert values(spark, drop, [0, 60060, 600000, 3600000], "long") == ["00:00:00;00", "00:01:00;02", "00:10:00;00", "01:00:00;00"]


def test_plain_text_and_speed(spark):
    assert values(spark, tx.plaintext, ["<i>a</i>{\\b1}b\\Nc\\hd", "a < b", "<c.x>q</c>", "\\x"]) == ["ab\nc d", "a < b", "q", "\\x"]
    df = spark.createDataFrame([("ab cd", 0, 1000), ("ab", 5, 5)], "t string, s long, e long")
    cps = [r[0] for r in df.select(tx.chars_per_second(F.col("t"), F.col("s"), F.col("e"))).collect()]
    assert cps == [5.0, math.inf]
    assert [r[0] for r in df.select(tx.reading_speed_wpm(F.col("t"), F.col("s"), F.col("e"))).collect()] == [120.0, math.inf]


@pytest.mark.parametrize(("name", "given", "wanted"), [
    ("normalize_whitespace", "  a   b  \n\n\n\nc \t", "a b\n\nc"),
    ("normalize_quotes", "“a” ‘b’ –—", "\"a\" 'b' ---"),
    ("normalize_punctuation", "a , b!!!!! c. . .", "a, b!!! c…"),
    ("fix_ocr_errors", "rn 1rn2 3O4 5l6 a0b", "m 1m2 304 516 aob"),
    ("strip_hearing_impaired", "JOHN: [noise] hello (sighs) ♪", "hello"),
    ("strip_hearing_impaired", "(door slams)", ""),
    ("remove_all_newlines", "a\n b  c ", "a b c"),
])
def test_normalisers(spark, name, given, wanted):
    assert values(spark, getattr(tx, name), [given]) == [wanted]


def test_line_functions(spark):
    assert values(spark, lambda c: tx.replace_newlines(c, "|"), ["a\r\nb\n", ""]) == ["a|b", ""]
    assert values(spark, lambda c: tx.merge_short_lines(c, 3), ["a\nb\nlonger\nc\n\nd"]) == ["a b\nlonger\nc\n\nd"]
    assert values(spark, lambda c: tx.split_text_chunks(c, 5), ["a bb ccc dddddd e", "  "]) == [["a bb", "ccc", "dddddd", "e"], []]
    assert values(spark, lambda c: tx.optimize_line_breaks(c, 12), ["one two, three four", "abcdefghijklmnop", None]) == ["one two,\nthree four", "abcdefghijkl\nmnop", None]
    assert values(spark, lambda c: tx.filter_language(c, "zh"), ["a中1 b"]) == ["中1 "]
    assert values(spark, lambda c: tx.filter_language(c, "xx"), ["a中"]) == ["a中"]
    spans = values(spark, tx.parse_ass_tags, ["{\\b1}bold{\\r}plain"])[0]
    assert [(s["text"], s["bold"]) for s in spans] == [("bold", True), ("plain", False)]


def test_detection(spark):
    texts = {"WEBVTT\n\n": "vtt", "1\n00:00:01,000 --> 00:00:02,000\nx": "srt", "[Script Info]\n[V4+ Styles]": "ass", "[Script Info]\n": "ssa", "{1}{2}x": "microdvd", "[INFORMATION]\n00:00:01.00,00:00:02.00\nx": "subviewer",
             '<tt xmlns="http://www.w3.org/2006/10/ttaf1">': "dfxp", '<tt xmlns="http://www.w3.org/ns/ttml">': "ttml", '{"segments": [{"start": 1, "end": 2}]}': "whisper", "0:00:01.000,0:00:02.000,hi": "sbv",
             "[00:01.50]la": "lrc", "<SAMI>": "sami", "[10][20]x": "mpl2", "Scenarist_SCC V1.0": "scc", "nothing": None, "﻿WEBVTT": None}
    assert values(spark, detect.detect_text, list(texts)) == list(texts.values())
    stl = bytes([0, 0, 2]) + bytes(1021) + bytes(256)
    assert values(spark, detect.detect_format, [bytearray(stl), bytearray(stl[:-1])], "binary") == ["ebu_stl", None]


def test_encodings(spark):
    cases = {"é".encode(): ("UTF-8", "é"), b"\xef\xbb\xbfa": ("UTF-8-BOM", "a"), b"\xff\xfea\0b": ("UTF-16LE", "a"), b"\xfe\xff\0a": ("UTF-16BE", "a"), b"": ("UTF-8", ""),
             "こんにちは世界".encode("shift_jis"): ("Shift_JIS", "こんにちは世界"), "你好，世界".encode("gbk"): ("GBK", "你好，世界"), "Привет мир".encode("cp1251"): ("windows-1251", "Привет мир")}
    raw = [bytearray(b) for b in cases]
    assert values(spark, encoding.detect_encoding, raw, "binary") == [n for n, _ in cases.values()]
    assert values(spark, encoding.decode_to_string, raw, "binary") == [t for _, t in cases.values()]
    assert encoding.decode(b"\xff") == ""
    with pytest.raises(encoding.InvalidEncoding):
        encoding.decode(b"\xff\xfe\x00\xd8")


def test_legacy_encodings():
    for codec, name, text in registry.LEGACY:
        assert (encoding.guess(text.encode(codec)), encoding.decode(text.encode(codec))) == (name, text)
    more = {"cp1252": ["Où est-il allé ? Là-bas…", "Não há ninguém aqui, irmão", "È già tardi, perché no?", "Jag är på väg hem", "Rødgrød med fløde på", "café"], "cp1251": ["Слава Україні, дуже добре є їжа", "Hello, Иван! Как ты?"],
            "cp1250": ["Köszönöm szépen, őszintén jól vagyok, kérdezzük"], "cp866": ["Я не знаю, что сказать тебе"], "cp874": ["ขอบคุณมากครับ"], "shift_jis": ["今日は日本へ行く"], "euc_kr": ["저는 학생입니다"]}
    for codec, texts in more.items():
        for text in texts:
            assert encoding.decode(text.encode(codec)) == text, text


def test_translate_in_batches(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string").coalesce(1)
    got = [r[0] for r in df.select(tx.translate_with(F.col("t"), batch=lambda xs: [x.upper() for x in xs])).collect()]
    assert got == ["A", None, "B"]
    assert [r[0] for r in df.select(tx.translate_with(F.col("t"), batch=lambda xs: 1 / 0)).collect()] == ["a", None, "b"]
