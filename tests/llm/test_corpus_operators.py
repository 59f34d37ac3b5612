"""Operators over the whole corpus, against brute force."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from captrix.llm import induced_sort, prob_minhash, suffix_dedup, warc_members
from captrix.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return out


@pytest.mark.parametrize("hot", [1 << 20, 1500, 500, 0])
def test_suffix_dedup(docs, empty, rows, folder, same, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = [(r[0], n, g, s, k) for r, (n, g, s, k) in zip(rows, brute_repeats([r[1] for r in rows], 400), strict=True)]
    got = [tuple(r) for r in suffix_dedup.dedup(docs, folder).select("d", "n_bytes", "n_removed", "n_spans", "kept").collect()]
    clean = lambda xs: sorted((str(a), b, c, d, bytes(e)) for a, b, c, d, e in xs)
    assert clean(got) == clean(want) and sum(w[2] for w in want) > 0
    assert suffix_dedup.dedup(empty, folder + "-e").count() == 0


@pytest.mark.parametrize(("base", "memory"), [(1 << 22, 64 << 20), (4, 200)])
def test_induced_sort(base, memory):
    rng = random.Random(1)
    for _ in range(120):
        n, k = rng.randint(1, 250), rng.choice([1, 2, 3, 26])
        t = [rng.randint(1, k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, b, m = rng.randrange(n), rng.randrange(n), rng.randint(1, 50)
            t[b : b + m] = t[a : a + m]
        text = np.array(t, np.uint8)
        order = np.concatenate([p for p, _ in induced_sort.descending(text, 1000, base, memory)]).tolist()
        assert order == sorted(range(len(t)), key=lambda i: bytes(t[i:]), reverse=True)
        length = rng.choice([1, 3, 12, 30])
        seen = Counter(bytes(t[i : i + length]) for i in range(len(t) - length + 1))
        assert induced_sort.repeated(text, length, base, memory).tolist() == [i + length <= len(t) and seen[bytes(t[i : i + length])] > 1 for i in range(len(t))]


def shingle_set(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    """doc_id to smallest doc_id of its class, by all pairs."""
    known = [(r[0], r[1] or "", shingle_set(r[1])) for r in rows]
    parent = {i: i for i, *_ in known if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, ta, sa in known:
        for b, tb, sb in known:
            if a is not None and b is not None and (ta == tb or a == b or sa and sb and len(sa & sb) / len(sa | sb) >= 0.8):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_near_duplicates(docs, empty, rows, folder):
    own = [r for r in rows if r[1] != "same id other text"]  # an id with two texts stands for both
    got = prob_minhash.classes(docs.where("text IS NULL OR text <> 'same id other text'"), folder)
    found = {r["d"]: r["class"] for r in got.collect() if r["d"] is not None}
    assert found == brute_classes(own) and len(set(found.values())) < len(found)
    by_text = {r["class"] for r in got.collect() if r["d"] is None}
    assert by_text == {None, 1}  # one of the rows without an id is a copy of document 1
    assert prob_minhash.classes(empty, folder + "-e").count() == 0


def test_a_large_group_of_near_copies(spark, folder):
    rows = group_of(150)
    got = prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert {r["d"]: r["class"] for r in got.collect()} == brute_classes(rows)


def group_of(n, seed=9):
    """Near copies of one text with up to 12 changed words each, so that links and near links mix."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((i, " ".join(t)))
    return out


def test_joined_rows_follow_the_members_of_a_group(spark, folder, monkeypatch):
    """Rows that reach verification at two sizes of one group of near copies."""
    sizes = {}

    def counted(df, where, name, **options):
        out = stored(df, where, name, **options)
        sizes[where][name] = out.count()
        return out

    stored = prob_minhash.stored
    monkeypatch.setattr(prob_minhash, "stored", counted)
    for n in (400, 2000):
        sizes[f"{folder}-{n}"] = {}
        found = prob_minhash.classes(spark.createDataFrame(group_of(n), "doc_id long, text string"), f"{folder}-{n}").collect()
        assert 1 < len({r["class"] for r in found}) < n / 2
    print(sizes)
    small, large = sizes[f"{folder}-400"], sizes[f"{folder}-2000"]
    for name in ("pairs", "stars", "lists", "heads", "rest"):
        assert large[name] <= 5 ** 1.25 * max(small[name], 400), (name, small[name], large[name])


def test_near_duplicate_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["class_id"], r["kept"]) for r in prob_minhash.op6(spark, SF).collect()} == {i: (c, c == i) for i, c in brute_classes(rows).items()}


def test_suffix_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op3(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == {i: (n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True)}


def test_suffix_dedup_of_long_texts(spark, folder, monkeypatch):
    """Pieces end within repeats, a hot run of one byte, and a text that repeats itself."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "HOT", 1200)
    rng = random.Random(4)
    block = "".join(rng.choice("abcdé ") for _ in range(1500))
    texts = [block + "x" * 900 + block, "y" + block[200:900] + "x" * 450, "z" * 399, "q".join([block[:401]] * 3)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.dedup(table, folder).select("d", "n_bytes", "n_removed", "n_spans", "kept").collect())
    assert [(*r[:4], bytes(r[4])) for r in got] == [(i, *w) for i, w in enumerate(brute_repeats(texts, 400))]


def test_near_duplicate_stage_keeps_one(spark, docs, rows):
    kept = prob_minhash.stage(spark, docs, "")
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(0) == 1 and 40 not in ids and 41 not in ids and 42 not in ids and ids.count(None) == 1


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    a = [f"w{rng.randrange(5000)}" for _ in range(400)]
    b = list(a)
    for i in range(0, 400, 45):
        b[i] = "changed"
    ids, sizes = prob_minhash.signatures([" ".join(a), " ".join(b), "", "one"], 1024)
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert abs((ids[0] == ids[1]).mean() - len(x & y) / len(x | y)) < 0.06 and sizes.tolist() == [len(x), len(y), 0, 1]


def test_warc_round_trip(spark, folder, same):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 2000]
    rows = [(i, f"http://x/{i} y\n", h, "extra") for i, h in enumerate(html)] + [(9, None, "<p>b</p>", None), (9, None, "<p>b</p>", None), (None, "u", "<p>a</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").select("page_id", "url", "html")
    files = warc_members.write_archives(warc_members.with_revisits(pages), f"{folder}/m").persist()
    done = warc_members.normalise(files, f"{folder}/n", 2).persist()
    assert files.agg({"n_records": "sum"}).first()[0] == done.agg({"n_records": "sum"}).first()[0] == len(rows)
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        b, keeper = (h or "").encode(), last[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == keeper else "revisit", None if i == keeper else keeper))
    same(warc_members.read_archives(done, 2), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], want)
    again = warc_members.read_archives(done, payloads=True).where("page_id = 5").first()
    assert bytes(again["payload"]).decode() == html[5] and again["uri"] == "http://x/5%20y%0A"
    assert warc_members.write_archives(warc_members.with_revisits(pages.limit(0)), f"{folder}/e").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_near_copies_with_unlike_counts_meet(spark, folder):
    """Two texts of one set of shingles, 30 of which one repeats 2 times and the other 50 times."""
    rows = []
    for k in range(40):
        ring, tail = " ".join(f"r{k}x{i}" for i in range(30)) + " ", " ".join(f"t{k}x{i}" for i in range(70))
        rows += [(2 * k, ring * 2 + tail), (2 * k + 1, ring * 50 + tail)]
    found = prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()
    assert {r["d"]: r["class"] for r in found} == {i: i // 2 * 2 for i in range(80)}
