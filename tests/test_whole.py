"""Queries over whole texts and conversations of any length, against their SQL over rows that the small tables lack."""

import duckdb
import pytest

from captrix import registry

LONG = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Conversations of 600 turns, past an hour, with long texts, and with cues without duration only."""
    rows = [(1, t, "user", f"{LONG} {t % 13}") for t in range(40)] + [(2, t, "user", f"Turn {t}.") for t in range(600)]
    rows += [(3, t, "user", LONG[: 20 + t % 7]) for t in (0, 39, 41, 719, 1439, 1440, 2399, 2400, 5000)] + [(4, t, "user", "a" * 17) for t in range(3)] + [(5, t, "user", "short") for t in range(140)]
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def tables(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in registry.ORACLES if n.startswith(("q_render_", "q_roundtrip_", "q_detect", "q_enc", "q_ext", "q_parse_err", "q_json", "q_scc", "q_dedup", "q_quality_file"))))
def test_whole_query_equals_sql(spark, folder, tables, name):
    got = registry.QUERIES[name](spark, folder)
    want = tables.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("fmt", ["srt", "scc", "whisper", "ebu_stl"])
def test_round_trips_keep_long_texts_and_late_turns(spark, folder, fmt):
    got = registry.QUERIES[f"q_roundtrip_{fmt}"](spark, folder).collect()
    assert len(got) == 792 and max(len(r["text"]) for r in got) > len(LONG) and max(r["start_ms"] for r in got) > 3_600_000


def test_quality_counts_cues_without_duration(spark, folder):
    got = {r["file_id"]: r for r in registry.QUERIES["q_quality_file"](spark, folder).collect()}
    assert {k: r["total_subtitles"] for k, r in got.items()} == {"1": 40, "2": 600, "3": 9, "4": 3, "5": 140}
    assert got["4"]["is_inf"] and got["4"]["avg_cps"] is None and got["4"]["total_issues"] >= 3


def test_dedup_compares_whole_texts(spark, folder):
    got = registry.QUERIES["q_dedup"](spark, folder).collect()
    assert len(got) == 792 and max(len(r["text"]) for r in got) > len(LONG)


def test_scc_timecodes_of_later_hours(spark, folder):
    got = registry.QUERIES["q_scc_timecode"](spark, folder)
    assert got.count() == 792 and got.where("timecode >= '01'").count() == 4
