"""One file at a time, the command line, and resources behind urls."""

import functools
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from captrix import api, cli
from captrix.schema import build_file
from captrix.sources import reader, writers

TEXT = "1\n00:00:01,000 --> 00:00:02,000\n<b>one</b>\n\n2\n00:00:01,500 --> 00:00:01,500\n<b>one</b>\n"


def test_one_text(spark):
    cues = api.parse_subtitles(spark, TEXT)
    assert [(c["start_ms"], c["text"], c["index"]) for c in cues] == [(1000, "one", 1), (1500, "one", 2)] and cues[0]["text_parts"][0]["bold"]
    assert api.convert_format(spark, TEXT, "vtt").startswith("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\none")
    assert len(api.convert_format(spark, TEXT, "stl")) == 1024 + 256 and api.convert_format(spark, "WEBVTT\n", "srt") == ""
    assert [x["code"] for x in api.validate_subtitles(spark, TEXT)] == ["ZERO_DUR", "OVERLAP"]
    assert api.detect(spark, TEXT) == "SRT" and api.detect(spark, "nothing") is None
    assert api.get_info(spark, TEXT) == {"format": "SRT", "n_cues": 2, "first_ms": 1000, "last_ms": 1500, "duration_ms": 500}
    assert api.normalize_text(spark, "<i>a</i> {b1}b") == "a b"
    with pytest.raises(Exception, match="unknown subtitle format"):
        api.parse_subtitles(spark, "nothing")


def test_command_line(spark, tmp_path, capsys):
    source, out = tmp_path / "a.srt", tmp_path / "b.vtt"
    source.write_text(TEXT)
    assert cli.main(["convert", str(source), str(out)], spark) == 0 and out.read_text().startswith("WEBVTT")
    assert cli.main(["validate", str(source)], spark) == 1 and "ZERO_DUR" in capsys.readouterr().out
    assert cli.main(["edit", str(source), str(out), "--dedup", "--sort", "--shift", "500"], spark) == 0 and out.read_text().count("-->") == 1 and "00:00:01.500" in out.read_text()
    assert cli.main(["detect", str(source)], spark) == 0 and capsys.readouterr().out.strip() == "srt"
    assert cli.main(["shift", str(source), str(out), "--offset", "-1500"], spark) == 0 and "00:00:00.000 --> 00:00:00.500" in out.read_text()
    assert cli.main(["info", str(source)], spark) == 0 and '"format": "SRT"' in capsys.readouterr().out
    plan = tmp_path / "p.json"
    plan.write_text('{"operations": [{"op": "RemoveDuplicates"}]}')
    assert cli.main(["pipeline", str(source), str(out), "--config", str(plan)], spark) == 0 and out.read_text().count("-->") == 1
    with pytest.raises(SystemExit, match="No edit operations"):
        cli.main(["edit", str(source), str(out)], spark)


def test_urls(spark, tmp_path):
    (tmp_path / "a.srt").write_text(TEXT)
    (tmp_path / "c").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nyo\n")

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        got = reader.read_url_cues(spark, [f"{base}/a.srt?x=1", f"{base}/c"]).collect()
        assert sorted((r["file_id"].rpartition("/")[2], r["text"]) for r in got) == [("a.srt", "one"), ("a.srt", "one"), ("c", "yo")]
        table = spark.createDataFrame([(f"{base}/c",), (None,)], "url string")
        assert reader.read_urls(spark, table).select("path").first()[0] == f"{base}/c"
        with pytest.raises(Exception, match="404"):
            reader.read_urls(spark, [f"{base}/none"]).collect()
    finally:
        server.shutdown()


def test_texts_of_several_languages_in_files(spark, tmp_path):
    """Legacy encodings in files, told apart and decoded on reading."""
    texts = {"cp1251": "Привет, как дела?", "shift_jis": "ありがとうございます", "cp1252": "Où est-il allé ? Là-bas…"}
    for codec, text in texts.items():
        (tmp_path / f"{codec}.srt").write_bytes(f"1\n00:00:01,000 --> 00:00:02,000\n{text}\n".encode(codec))
    assert sorted(r["text"] for r in reader.read_cues(spark, str(tmp_path)).collect()) == sorted(texts.values())
    cues, _ = build_file(spark, "f", "srt", [{"start_ms": 0, "end_ms": 1, "text": "é"}])
    assert writers.write_files(writers.render(cues, "srt"), str(tmp_path / "o"), "srt", name=F.lit("x")) == 1 and "é" in (tmp_path / "o" / "x.srt").read_text()
