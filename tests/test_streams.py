import datetime

import pytest
from pyspark.sql import functions as F

from captrix.operators import edit
from captrix.schema import CUES
from captrix.sources import parsers, reader
from captrix.streaming import streams


def drain(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_file_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.srt").write_text(f"1\n00:00:0{i},000 --> 00:00:0{i},500\nline {i}\n")
    got = drain(streams.read_stream(spark, str(tmp_path)), "files_seen", spark)
    key = lambda df: sorted((r["file_id"], r["pos"], r["start_ms"], r["text"]) for r in df.collect())
    assert key(got) == key(reader.read_cues(spark, str(tmp_path)))


def test_stateful_streams_equal_batch(spark, tmp_path):
    rows = [("f", i, None, s, e, t, None, None, None, None, False) for i, (s, e, t) in enumerate([(0, 100, "a"), (150, 200, "a"), (1000, 1100, "b"), (1150, 1200, "c"), (5000, 5100, "c")])]
    cues = spark.createDataFrame(rows, CUES)
    simple = cues.select("file_id", "pos", "start_ms", "end_ms", "text")
    for k, (a, b) in enumerate(((0, 2), (2, 5))):
        part = simple.where((F.col("pos") >= a) & (F.col("pos") < b))
        (part if k == 0 else part.unionByName(streams.close_marks(spark.createDataFrame([("f",)], "file_id string")))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(simple.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merged = drain(streams.merge_stream(stream(), 100), "merged_seen", spark)
    key = lambda df: sorted((r["start_ms"], r["end_ms"], r["text"]) for r in df.collect())
    assert key(merged) == key(edit.merge_adjacent(cues, 100))
    deduped = drain(streams.dedup_stream(stream().where("text IS NOT NULL")), "deduped_seen", spark)
    assert key(deduped) == key(edit.remove_duplicates(cues))


#: A file of each format, and what it holds.
FILES = {
    "srt": ("1\n00:00:01,000 --> 00:00:02,000\none\n\n2\n00:00:03,000 --> 00:00:04,000\ntwo\n", [(1000, 2000, "one"), (3000, 4000, "two")]),
    "vtt": ("WEBVTT\n\n00:01.000 --> 00:02.000\none\n\n00:03.000 --> 00:04.000\ntwo\n", [(1000, 2000, "one"), (3000, 4000, "two")]),
    "microdvd": ("{24}{48}one\n{72}{96}two\n", [(1001, 2002, "one"), (3003, 4004, "two")]),
    "subviewer": ("[TITLE]\n00:00:01.00,00:00:02.00\none\n\n00:00:03.00,00:00:04.00\ntwo\n", [(1000, 2000, "one"), (3000, 4000, "two")]),
    "sbv": ("0:00:01.000,0:00:02.000,one\n\n0:00:03.000,0:00:04.000,two\n", [(1000, 2000, "one"), (3000, 4000, "two")]),
    "lrc": ("[00:01.00]one\n[00:03.00]two\n", [(1000, 6000, "one"), (3000, 8000, "two")]),
    "sami": ("<SAMI><Body><Sync Start=1000><P>one</P></Sync><Sync Start=3000><P>two</P></Sync></Body></SAMI>", [(1000, 3000, "one"), (3000, 6000, "two")]),
    "mpl2": ("[24][48]one\n[72][96]two\n", [(1001, 2002, "one"), (3003, 4004, "two")]),
    "scc": ("Scenarist_SCC V1.0\n\n00:00:01:00\t9420 94ad 6f6e 65 942f\n00:00:02:00\t942c\n\n00:00:03:00\t9420 94ad 7477 6f20 942f\n00:00:04:00\t942c\n", [(1001, 2002, "on"), (3003, 4004, "two")]),
}


@pytest.mark.parametrize("fmt", FILES)
def test_formats_stream_in_and_out(spark, tmp_path, fmt):
    text, want = FILES[fmt]
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.{fmt}").write_text(text)
    stream = streams.read_stream(spark, str(tmp_path / "in"), fmt, max_files=1)
    q = streams.write_stream(stream, str(tmp_path / "out"), fmt, str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    made = sorted((tmp_path / "out").iterdir())
    assert len(made) == 2
    for path in made:
        assert [(c.start, c.end, c.text) for c in parsers.parse(fmt, path.read_bytes()).cues] == want


def test_runs_end_by_event_time_and_are_numbered_on(spark, tmp_path):
    folder, late = str(tmp_path / "in"), "file_id string, pos long, start_ms long, end_ms long, text string, at timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)

    def feed(*rows):
        spark.createDataFrame(rows, late).coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()

    spark.createDataFrame([("f", 0, 0, 100, "a", at(0)), ("f", 1, 150, 200, None, at(1))], late).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(late).option("maxFilesPerTrigger", 1).parquet(folder)
    q = streams.merge_stream(stream, 100, "at", "1 second").writeStream.format("memory").queryName("timed_seen").outputMode("append").start()
    q.processAllAvailable()
    feed(("g", 0, 0, 10, "x", at(20)))  # the watermark passes f's run
    feed(("g", 1, 50, 60, "y", at(21)))
    feed(("f", 2, 5000, 5100, "b", at(22)), ("f", 3, None, None, None, at(22)))
    feed(("g", 2, 9000, 9100, "z", at(23)))
    q.stop()
    got = sorted((r["file_id"], r["pos"], r["start_ms"], r["end_ms"], r["text"]) for r in spark.table("timed_seen").collect())
    assert got == [("f", 0, 0, 200, "a"), ("f", 1, 5000, 5100, "b"), ("g", 0, 0, 60, "x\ny")]


def test_null_texts_in_streams_are_as_in_batch(spark, tmp_path):
    rows = [("f", i, None, i * 10, i * 10 + 5, t, None, None, None, None, False) for i, t in enumerate(["a", None, None, " a ", "a\u3000", "b"])]
    cues = spark.createDataFrame(rows, CUES)
    simple = cues.select("file_id", "pos", "start_ms", "end_ms", "text")
    for a, b in ((0, 2), (2, 6)):
        simple.where((F.col("pos") >= a) & (F.col("pos") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(simple.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(streams.dedup_stream(stream), "nulls_seen", spark)
    assert sorted((r["start_ms"], r["text"]) for r in got.collect()) == sorted((r["start_ms"], r["text"]) for r in edit.remove_duplicates(cues).collect())


def times(fmt, text, stream=True):
    done = parsers.parse(fmt, text, stream=stream)
    return [(c.start, c.end, c.text) for c in done.cues], len(done.errors)


@pytest.mark.parametrize(("fmt", "text", "want", "errors"), [
    ("srt", "1\nsoon\n00:00:01,000 --> 00:00:02,000\na\n\n2-->3\n00:00:03,000 --> never\n00:00:04,000 --> 00:00:05,000\nb\n", [(1000, 2000, "a"), (4000, 5000, "b")], 1),
    ("vtt", "\ufeffWEBVTT\n\nid\nmore\n00:01.000 --> 00:02.000\na\n\n0 --> 1\n00:03.000 --> 00:04.000\nb\n", [(1000, 2000, "a"), (3000, 4000, "b")], 1),
    ("microdvd", "{1}{1}25\n{25}{50}a\n{1}{1}50\n{100}{150}b\n{x}{1}c", [(1000, 2000, "a"), (2000, 3000, "b")], 0),
    ("subviewer", "[HEAD]\n00:00:01.00,00:00:02.00\n[SKIP]\na\nb\n00:00:03.00,00:00:04.00\n", [(1000, 2000, "a"), (3000, 4000, "")], 0),
    ("sbv", "0:00:01.000,0:00:02.000,a\n0:00:03.000,0:00:04.000\nb\n0:05.0,x,c\n", [(1000, 2000, "a")], 3),
    ("lrc", "[00:09.00][00:02.00]a\n[00:01.00]b\n[00:05.00]\n", [(9000, 14000, "a"), (2000, 7000, "a"), (1000, 6000, "b")], 0),
    ("sami", "<Sync Start=100><P> </P><P>unheard</P></Sync><Sync Start=900><P>a</P><P>b</P></Sync><Sync Start=1000><P>c</P></Sync>", [(900, 3900, "a"), (1000, 4000, "c")], 0),
    ("mpl2", "[24][48]a\n[x][1]b\n[1][2]\n", [(1001, 2002, "a")], 0),
    ("scc", "Scenarist_SCC V1.0\n00:00:01:00\t9420 942f\n00:00:02:00\t942c\n00:00:03:00\t6162 942f\n00:00:04:00\t942c\n", [(1001, 4004, "ab")], 0),
])
def test_stream_readers_of_broken_files(fmt, text, want, errors):
    assert times(fmt, text) == (want, errors)


def test_stream_readers_differ_from_batch_on_purpose():
    assert times("scc", "00:00:01:00\t9420 942f\n00:00:02:00\t942c\n00:00:03:00\t6162 942f\n00:00:04:00\t942c\n", False)[0] == []
    assert times("lrc", "[00:09.00]a\n[00:01.00]b\n", False)[0] == [(1000, 6000, "b"), (9000, 14000, "a")]
    with pytest.raises(parsers.ParseError):
        parsers.parse("srt", "1\nsoon\n")


def test_streams_keep_good_cues_beside_an_error(spark, tmp_path):
    (tmp_path / "a.sbv").write_text("0:00:01.000,0:00:02.000,a\nnoise\n")
    rows = reader.with_formats(reader.read_binary(spark, str(tmp_path)))
    row = reader.files_of(reader.parse_files(rows, stream=True)).first()
    assert row["n_cues"] == 1 and row["parse_error"]["kind"] == "InvalidLine"
    with pytest.raises(Exception, match="invalid SBV line"):
        reader.parse_files(rows, None, "FAILFAST", True).collect()
