"""Edits, checks and reports against values and a sequential reference."""

import random

import pytest
from pyspark.sql import functions as F

from captrix import cli
from captrix.operators import edit, quality, validate
from captrix.plans.pipeline import Builder, Pipeline
from captrix.schema import CUES


def table(spark, rows, file_id="f"):
    return spark.createDataFrame([(file_id, i, i + 1, *r, None, None, None, None, False) for i, r in enumerate(rows)], CUES)


def out(df, *cols):
    return [tuple(r) for r in df.orderBy("file_id", "pos").select(*(cols or ("start_ms", "end_ms", "text"))).collect()]


def test_merge_split_and_durations(spark):
    assert out(edit.merge_adjacent(table(spark, [(1000, 3000, "first"), (3100, 5000, "second"), (7000, 9000, "third")]), 500)) == [(1000, 5000, "first\nsecond"), (7000, 9000, "third")]
    parts = out(edit.split_long(table(spark, [(1000, 1003, "a b c d e f g h")]), 1))
    assert len(parts) == 8 and all(e > s for s, e, _ in parts)
    assert out(edit.split_long(table(spark, [(0, 10, "     ")]), 2)) == [(0, 10, "     ")]
    assert out(edit.enforce_min_duration(table(spark, [(1000, 1200, "a"), (2000, 5000, "b")]), 1000), "end_ms") == [(2000,), (5000,)]
    assert out(edit.enforce_max_duration(table(spark, [(1000, 8000, "a"), (9000, 10000, "b")]), 3000), "end_ms") == [(4000,), (10000,)]
    assert out(edit.auto_extend_for_cps(table(spark, [(0, 500, "x" * 54)]), 20.0), "end_ms") == [(2700,)]
    with pytest.raises(ValueError):
        edit.auto_extend_for_cps(table(spark, []), 0)


def test_ranges_and_order(spark):
    three = table(spark, [(1000, 3000, "a"), (4000, 6000, "b"), (8000, 9000, "c")])
    assert out(edit.extract_range(three, 2000, 7000)) == [(2000, 3000, "a"), (4000, 6000, "b")]
    assert out(edit.concatenate(table(spark, [(1000, 3000, "a"), (4000, 7000, "b")]), table(spark, [(0, 500, "c")]), 1000))[-1] == (8000, 8500, "c")
    assert out(edit.remove_duplicates(table(spark, [(0, 1, "hello"), (1, 2, " hello"), (2, 3, "world"), (3, 4, "hello")])), "text") == [("hello",), ("world",), ("hello",)]
    assert out(edit.shift(table(spark, [(1000, 3000, "a")]), -1500)) == [(0, 1500, "a")]
    assert 1040 <= out(edit.transform_framerate(table(spark, [(1000, 2000, "a")]), 23.976, 25.0))[0][0] <= 1045
    assert out(edit.filter_empty(table(spark, [(0, 1, " \n"), (1, 2, "x")])), "pos", "text") == [(0, "x")]


def test_edits_match_sequential_loops(spark):
    rng = random.Random(5)
    files = {str(k): [(s, s + rng.randint(-50, 400), rng.choice(["a", "b b", "c"])) for s in (rng.randint(0, 2000) for _ in range(rng.randint(0, 12)))] for k in range(60)}
    cues = spark.createDataFrame([(f, i, None, *r, None, None, None, None, False) for f, rows in files.items() for i, r in enumerate(rows)], CUES)

    def check(step, loop):
        want = [(f, i, *r) for f in sorted(files) for i, r in enumerate(loop(sorted(files[f], key=lambda r: r[:2])))]
        assert out(step(cues), "file_id", "pos", "start_ms", "end_ms", "text") == want

    def overlaps(rows):
        ends = [None, *[r[1] for r in rows]]
        return [(s if e0 is None else max(s, e0), e, t) for (s, e, t), e0 in zip(rows, ends, strict=False)]

    def merged(rows):
        done = []
        for s, e, t in rows:
            if done and max(s - done[-1][1], 0) <= 100:
                done[-1] = (done[-1][0], e, f"{done[-1][2]}\n{t}")
            else:
                done.append((s, e, t))
        return done

    def shortest(rows):
        nexts = [*[r[0] for r in rows[1:]], 1 << 62]
        return [(s, min(s + 200, n) if max(e - s, 0) < 200 else e, t) for (s, e, t), n in zip(rows, nexts, strict=False)]

    check(edit.sort, lambda rows: rows)
    check(edit.remove_overlaps, overlaps)
    check(lambda c: edit.merge_adjacent(c, 100), merged)
    check(lambda c: edit.enforce_min_duration(c, 200), shortest)


def test_issues(spark):
    found = validate.validate(table(spark, [(0, 2000, "a"), (5000, 6000, "b"), (1000, 1500, "c"), (7000, 7000, "d"), (9000, 8000, "e")])).orderBy("seq").collect()
    assert [(r["code"], r["index"], r["index_b"]) for r in found] == [("ZERO_DUR", 3, None), ("NEG_DUR", 4, None), ("OVERLAP", 0, 2), ("DECR_START", 2, None)]
    assert found[2]["description"] == "subtitle 0 (ends at 2000ms) overlaps with subtitle 2 (starts at 1000ms)"
    more = validate.validate_extended(table(spark, [(0, 1000, "x" * 50), (9000, 9000, "y")]), 42, 5000, 25.0).orderBy("seq").collect()
    assert [r["code"] for r in more] == ["ZERO_DUR", "LONG_TEXT", "HIGH_CPS", "HIGH_CPS", "LONG_GAP"]
    assert more[3]["description"] == "subtitle 1 has inf chars/second (max recommended: 25.0)"


def test_reports(spark):
    cues = table(spark, [(0, 1000, "x" * 50), (2000, 4000, "ok")])
    r = quality.quality_report(cues).first()
    assert (r["total_subtitles"], r["total_issues"], r["avg_duration_ms"], r["worst_index"]) == (2, 2, 1500, 0)
    i = quality.info(cues).first()
    assert (i["n_cues"], i["first_start_ms"], i["last_end_ms"], i["total_chars"], i["n_issues"]) == (2, 0, 4000, 52, 0)
    assert quality.quality_report(cues.limit(0)).count() == 0


def test_pipeline(spark):
    cues = table(spark, [(5000, 6000, "b"), (1000, 2000, "a")])
    plan = Pipeline.from_json('{"operations": [{"op": "Shift", "offset_ms": 1000}, {"op": "Sort"}, {"op": "Shift", "offset_ms": 500}]}')
    assert out(plan.apply(cues), "start_ms") == [(2500,), (6500,)]
    assert Pipeline.from_json(plan.to_json()).operations == plan.operations
    assert out(Builder(cues).sort().shift(1500).filter(F.col("text") == "b").build(), "start_ms") == [(6500,)]
    for bad in ('{"operations": [{"op": "Nope"}]}', '{"operations": [{"op": "Shift"}]}'):
        with pytest.raises(ValueError):
            Pipeline.from_json(bad)


def test_every_operation_runs(spark):
    from captrix.plans.pipeline import OPERATIONS

    values = {"offset_ms": 100, "max_gap_ms": 200, "max_chars": 3, "in_fps": 24.0, "out_fps": 25.0, "min_ms": 500, "max_ms": 900, "max_cps": 10.0}
    plan = Pipeline()
    for op, (names, _) in OPERATIONS.items():
        plan = plan.add(op, **{n: values[n] for n in names})
    rows = out(plan.apply(table(spark, [(5000, 6000, "b b b b"), (1000, 2000, "a"), (2100, 2500, " ")])), "pos", "start_ms", "end_ms", "text")
    assert [r[0] for r in rows] == list(range(len(rows))) and all(r[3].strip() for r in rows)
    assert plan.apply(table(spark, [])).count() == 0


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "a.srt"
    src.write_text("1\n00:00:01,000 --> 00:00:03,000\nhi there\n\n2\n00:00:02,000 --> 00:00:04,000\nyou\n")
    assert cli.main(["detect", str(src)], spark) == 0 and "srt" in capsys.readouterr().out
    assert cli.main(["convert", str(src), str(tmp_path / "a.vtt")], spark) == 0
    assert (tmp_path / "a.vtt").read_text().startswith("WEBVTT\n\n1\n00:00:01.000 --> 00:00:03.000\nhi there")
    assert cli.main(["validate", str(src)], spark) == 1 and "OVERLAP" in capsys.readouterr().out
    assert cli.main(["edit", str(src), str(tmp_path / "b.srt"), "--shift", "500"], spark) == 0
    assert "00:00:01,500" in (tmp_path / "b.srt").read_text()
    with pytest.raises(SystemExit):
        cli.main(["edit", str(src), str(tmp_path / "b.srt")], spark)
    (tmp_path / "p.json").write_text('{"operations": [{"op": "RemoveOverlaps"}]}')
    assert cli.main(["pipeline", str(src), str(tmp_path / "c.srt"), "--config", str(tmp_path / "p.json")], spark) == 0
    for command in (["info", str(src)], ["quality", str(src)], ["parse", str(src), "--json"], ["normalize", str(src), str(tmp_path / "d.srt"), "--whitespace"], ["shift", str(src), str(tmp_path / "e.srt"), "--offset", "5"]):
        assert cli.main(command, spark) == 0
