"""Parsers and writers."""

import time

import pytest
from pyspark.sql import functions as F

from captrix.schema import FORMATS, build_file
from captrix.sources import parsers, reader, writers


def times(parsed):
    return [(c.start, c.end, c.text) for c in parsed.cues]


def test_srt():
    text = "7\n00:01:10,250 --> 00:01:12,000\nGood <u>night</u>, all\n\n8\n00:01:13,000 --> 00:01:15,900\ntwo\nrows\n"
    done = parsers.srt(text)
    assert times(done) == [(70250, 72000, "Good night, all"), (73000, 75900, "two\nrows")] and [c.index for c in done.cues] == [7, 8]
    assert done.cues[0].parts == [{"text": "night", "bold": False, "italic": False, "underline": True, "color": None, "voice": None}]
    assert parsers.srt("\ufeff01:00:00,000 --> 01:00:00,001\ny").cues[0].index is None
    for broken in ("3\nsoon\n", "00:00:09,000 --> later"):
        with pytest.raises(parsers.ParseError):
            parsers.srt(broken)
    assert parsers.srt("5\n0:0:7.5 --> 00:00:08,000 X1:40\n<font size=2 color='blue'>sky</font>").cues[0].parts[0]["color"] == "blue"
    assert parsers.srt("5\n0:0:7.5 --> 00:00:08,000\na < b <i>c</i> <b").cues[0].text == "a < b c <b"


def test_vtt():
    text = "WEBVTT - lesson\nRegion: none\n\nNOTE\nfor nobody\n\nintro\n00:07.250 --> 01:00:08.000 line:0 position:10%\n<v Mara>Well</v> then\n\n00:00:09.000 --> 00:10.500\nplain\n"
    done = parsers.vtt(text)
    assert times(done) == [(7250, 3608000, "Well then"), (9000, 10500, "plain")] and done.meta["header"] == "WEBVTT - lesson\nRegion: none"
    assert done.cues[0].settings == "line:0 position:10%" and done.cues[0].parts[0]["voice"] == "Mara" and done.cues[0].index is None
    assert parsers.vtt("WEBVTT\n\n00:01.0 --> 00:02.0\n<b.loud>x</b> <c.red>y</c>").cues[0].parts[0] == {"text": "x", "bold": True, "italic": False, "underline": False, "color": None, "voice": None}
    with pytest.raises(parsers.ParseError):
        parsers.vtt("WEBVTT\n\nREGION\nid:x\n")


def test_ass():
    style = "Style: Big,Verdana,31,&H0A,&H0B,&H0C,&H0D,0,-1,0,0,90,110,1,0,3,1,0,8,4,5,6,0"
    text = f"[Script Info]\nTitle: a: b\n[V4+ Styles]\nFormat: names\n{style}\nStyle: broken,x\n[Events]\nFormat: names\nDialogue: 2,1:00:02.34,1:00:05.00,Big,Eve,1,-2,3,,Yes, no, {{\\i1}}maybe\nComment: 0,0:00:06.00,0:00:07.00,,,0,0,0,,hidden\nDialogue: 0,0:00:08.00,0:00:09.00,short\nDialogue: soon\n"
    done = parsers.ass(text)
    assert times(done) == [(3602340, 3605000, "Yes, no, {\\i1}maybe"), (6000, 7000, "hidden"), (8000, 9000, "short")]
    assert done.meta["info"] == {"Title": "a: b"} and len(done.meta["styles"]) == 1 and done.cues[0].style == "Big" and done.cues[0].actor == "Eve" and done.cues[1].comment
    assert {k: done.meta["styles"][0][k] for k in ("fontsize", "bold", "italic", "scale_y", "shadow", "margin_v", "encoding")} == {"fontsize": 31, "bold": False, "italic": True, "scale_y": 110.0, "shadow": 0.0, "margin_v": 6, "encoding": 0}
    assert parsers.ass(text.replace("[Events]", "[Other]")).cues == []


def test_line_formats():
    assert times(parsers.microdvd("{1}{1}50\n{100}{150}up|down\nnoise\n {200}{250} x")) == [(2000, 3000, "up\ndown"), (4000, 5000, " x")]
    assert parsers.microdvd("{1}{1}0\n{24}{48}z").meta["fps"] == 23.976
    assert times(parsers.mpl2("[100][250]Once | twice\n[1][2]\n[x][3]no", 25.0)) == [(4000, 10000, "Once | twice")]
    assert times(parsers.sbv("1:00:01.500,1:00:02.000\nbelow\n\n0:07.5,0:08.000,beside, still")) == [(3601500, 3602000, "below"), (7005, 8000, "beside, still")]
    assert times(parsers.subviewer("[TITLE] t\n01:02:03.04,1:02:04.00\nshown\nnot shown\n1:2:3.4,x")) == [(3723040, 3724000, "shown")]
    done = parsers.lrc("[ar:nobody]\n[02:05.50] [00:07.25] chorus\n[00:03.00]verse\n[00:09.00]")
    assert times(done) == [(3000, 8000, "verse"), (7250, 12250, "chorus"), (125500, 130500, "chorus")] and [x["times_ms"] for x in done.meta["lrc_lines"]] == [[125500, 7250], [3000]]


def test_markup_formats():
    ttml = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:s="u"><body><div><p begin="00:00:07.250" dur="750ms">lost</p><p begin="00:00:07.250" dur="0.75s">up<br/>&lt;down&gt;</p><p begin="9s" end="00:00:11.000"><span s:color="#0f0" s:fontStyle="italic">g</span></p></div></body></tt>'
    done = parsers.ttml(ttml)
    assert times(done) == [(7250, 8000, "up\n<down>"), (9000, 11000, "g")] and done.cues[1].parts[0]["color"] == "#0f0" and done.cues[1].parts[0]["italic"]
    with pytest.raises(parsers.ParseError):
        parsers.ttml("<tt><body>")
    sami = "<SAMI>\n<HEAD><STYLE TYPE='text/css'>\n<!--\n.DE {Name: Deutsch;}\np {x}\n-->\n</STYLE></HEAD>\n<BODY><SYNC Start=700><P class=DE></P><P class=DE>eins <i>2</i></P><P>unheard</P></SYNC>\n<Sync id=1 Start = 1900><p>&nbsp;</p></sync>"
    done = parsers.sami(sami)
    assert times(done) == [(700, 1900, "eins 2"), (1900, 4900, "&nbsp;")] and done.meta["class_styles"] == {"DE": "Name: Deutsch;}"} and done.meta["header"].startswith("<HEAD>")
    assert parsers.sami("<SYNC Start=700><P>never closed").cues == []
    assert parsers.sami("<Sync Start=1><P>over\ntwo rows</P></Sync>").cues[0].text == "over\ntwo rows"


def test_scc_and_stl():
    done = parsers.scc("Scenarist_SCC V1.0\n\n00:01:00:02\t9420 94ad 4f6e e520 f4f7 ef80 942f\n00:01:03:00  942c\nnoise\n")
    assert times(done) == [(60127, 63063, "One two")] and done.meta["drop_frame"] is False
    with pytest.raises(parsers.ParseError):
        parsers.ebu_stl(bytes(99))
    long = "word " * 80
    data = writers.stl_bytes([{"start_ms": 4000, "end_ms": 6000, "text": "one"}, {"start_ms": 7000, "end_ms": 8000, "text": long}, {"start_ms": 9000, "end_ms": 9500, "text": None}])
    assert times(parsers.ebu_stl(data)) == [(4000, 6000, "one"), (7000, 8000, long.strip())] and len(data) == 1024 + 128 * 6
    huge = "x" * 40_000
    assert times(parsers.ebu_stl(writers.stl_bytes([{"start_ms": 0, "end_ms": 1000, "text": huge}]))) == [(0, 1000, huge)]
    assert times(parsers.whisper('{"segments": [{"start": 2.25, "end": 3, "text": " so"}]}')) == [(2250, 3000, " so")]


def test_broken_markup_takes_linear_time():
    for parse, piece in ((parsers.srt, "<b "), (parsers.sami, "<Sync "), (parsers.sami, "<P>"), (parsers.lrc, "[0"), (parsers.microdvd, "{1}{"), (parsers.mpl2, "[1][")):
        head = "1\n00:00:01,000 --> 00:00:02,000\n" if parse is parsers.srt else ""
        began = time.time()
        parse(head + piece * 100_000)
        assert time.time() - began < 5


def test_reader_modes(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    (tmp_path / "b.srt").write_text("1\nbroken\n")
    (tmp_path / "c").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nyo\n")
    parsed = reader.read_parsed(spark, str(tmp_path))
    found = {r["path"].rpartition("/")[2]: r for r in reader.files_of(parsed).collect()}
    assert found["a.srt"]["n_cues"] == 1 and found["b.srt"]["parse_error"]["kind"] == "UnexpectedLine" and found["c"]["format"] == "vtt" and found["c"]["header"] == "WEBVTT"
    assert sorted(r["text"] for r in reader.read_cues(spark, str(tmp_path)).collect()) == ["hi", "yo"]
    with pytest.raises(Exception, match="timestamp"):
        reader.read_cues(spark, str(tmp_path), mode="FAILFAST").collect()


@pytest.mark.parametrize("fmt", FORMATS)
def test_written_files_parse_again(spark, fmt):
    cues, files = build_file(spark, "f", fmt, [{"start_ms": 1000, "end_ms": 2000, "text": "x one"}, {"start_ms": 3000, "end_ms": 6000, "text": "x two"}], fps=25.0)
    text = writers.render(cues, fmt, files)
    back = reader.cues_of(reader.parse_texts(text, fmt, text="content", mode="FAILFAST")).orderBy("pos").collect()
    assert [r["text"] for r in back] == ["x one", "x two"]
    assert all(abs(r["start_ms"] - s) <= 40 for r, s in zip(back, (1000, 3000), strict=True))


def test_builder_and_policies(spark, tmp_path):
    assert build_file(spark, "f", "microdvd", []) is None
    cues, files = build_file(spark, "f", "srt", [{"start_ms": 0, "end_ms": 1, "text": "a"}])
    out = writers.render(cues, "srt", files)
    writers.write(out, str(tmp_path / "o"))
    writers.write(out, str(tmp_path / "o"), "append")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    with pytest.raises(Exception, match="exists"):
        writers.write(out, str(tmp_path / "o"), "refuse_if_exists")
    lrc, files = build_file(spark, "f", "lrc", [{"start_ms": 10, "end_ms": 20, "text": "a"}])
    files = files.withColumn("lrc_lines", F.array(F.struct(F.array(F.lit(1500).cast("long"), F.lit(2500).cast("long")).alias("times_ms"), F.lit("la").alias("text"))))
    assert writers.render(lrc, "lrc", files, render_from_cues=False).first()["content"] == "[00:01.50][00:02.50]la\n"


def test_stored_numbers_and_headers(spark):
    cues, files = build_file(spark, "f", "vtt", [{"index": 7, "start_ms": 0, "end_ms": 1000, "text": "a", "settings": "line:1"}], header="WEBVTT - x")
    assert writers.render(cues, "srt", files, stored_index=True).first()["content"].startswith("7\n00:00:00,000")
    assert writers.render(cues, "vtt", files, keep_header=True).first()["content"] == "WEBVTT - x\n\n1\n00:00:00.000 --> 00:00:01.000 line:1\na\n"
    assert writers.render(cues, "vtt", files).first()["content"].startswith("WEBVTT\n\n")


@pytest.mark.parametrize("fmt", FORMATS)
def test_null_texts_are_empty_texts(spark, fmt):
    cues, files = build_file(spark, "f", fmt, [{"start_ms": 1000, "end_ms": 2000, "text": None}, {"start_ms": 3000, "end_ms": 6000, "text": "x two"}], fps=25.0)
    empty, _ = build_file(spark, "f", fmt, [{"start_ms": 1000, "end_ms": 2000, "text": ""}, {"start_ms": 3000, "end_ms": 6000, "text": "x two"}], fps=25.0)
    assert writers.render(cues, fmt, files).collect() == writers.render(empty, fmt, files).collect()


def test_files_in_their_format(spark, tmp_path):
    made = [build_file(spark, f"a/{k}", "srt", [{"start_ms": 0, "end_ms": 1000, "text": f"t{k}"}])[0] for k in range(3)]
    cues = made[0].unionByName(made[1]).unionByName(made[2])
    out = writers.render(cues, "srt")
    folder = str(tmp_path / "o")
    assert writers.write_files(out, folder, "srt", "refuse_if_exists") == 3
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["a%2F0.srt", "a%2F1.srt", "a%2F2.srt"]
    assert sorted(r["text"] for r in reader.read_cues(spark, folder).collect()) == ["t0", "t1", "t2"]
    with pytest.raises(Exception, match="FileExistsError"):
        writers.write_files(out, folder, "srt", "refuse_if_exists")
    writers.write_files(out, folder, "srt", "append")
    assert [(c.start, c.text) for c in parsers.srt((tmp_path / "o" / "a%2F1.srt").read_text()).cues] == [(0, "t1"), (0, "t1")]
    writers.write_files(out, folder, "srt")
    assert len(parsers.srt((tmp_path / "o" / "a%2F1.srt").read_text()).cues) == 1
    assert writers.write_files(writers.render(cues, "ebu_stl"), folder, "stl", name=F.concat(F.lit("n"), F.substring("file_id", 3, 1))) == 3 and (tmp_path / "o" / "n2.stl").stat().st_size == 1152
    with pytest.raises(ValueError):
        writers.write_files(out, folder, "srt", "sometimes")


def test_parse_config(spark, tmp_path):
    (tmp_path / "a.srt").write_text("9\n00:00:01,000 --> 00:00:09,000\nlong\n\n12\n00:00:10,000 --> 00:00:10,010\nshort\n")
    (tmp_path / "b.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\ngarçon\n".encode("cp1252"))
    read = lambda **options: sorted((r["index"], r["end_ms"] - r["start_ms"], r["text"]) for r in reader.read_with(spark, str(tmp_path), reader.ParseConfig(**options)).collect())
    assert read() == [(1, 1000, "garçon"), (1, 8000, "long"), (2, 10, "short")]
    assert read(preserve_indices=True, max_duration_ms=5000, min_duration_ms=500) == [(1, 1000, "garçon"), (9, 5000, "long"), (12, 500, "short")]
    assert read(lenient_mode=True, auto_detect_encoding=False) == [(1, 8000, "long"), (2, 10, "short")]
    with pytest.raises(Exception, match="invalid"):
        read(auto_detect_encoding=False)
