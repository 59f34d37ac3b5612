"""Operators that take one text at a time."""

import hashlib
import html
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from captrix.llm import crf_language, dac_tokens, line_spread, main_text, piece_codec, positional_index, quality_rules


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_piece_codec_is_the_library(docs, empty, rows, same):
    out = piece_codec.encode(docs, outputs=("ids", "n_tokens", "decoded"))
    lib = piece_codec.PieceCodec(piece_codec.default_model()).library
    want = [(r[0], lib.encode(r[1] or ""), len(lib.encode(r[1] or "")), lib.decode(lib.encode(r[1] or ""))) for r in rows]
    same(out, ["doc_id", "ids", "n_tokens", "decoded"], want)
    assert "row" in out.columns and piece_codec.encode(empty).count() == 0
    same(piece_codec.decode(out, "ids", output="again"), ["again"], [(w[3],) for w in want])


@pytest.mark.parametrize("text", [" ", "  a   b  ", "\n\n x", "a▁b c", "don't stop.Now", "🎉🎉 é́", "a" * 3000, " " * 500 + "x", "½²., x².", "\t{\n\t}\r\n", "\x00a", "mid.dle,word!?end", "▁▁"])
def test_piece_codec_on_odd_texts(text):
    codec = piece_codec.PieceCodec(piece_codec.default_model())
    ids = codec.library.encode(text)
    assert codec.batch([text]) == [(",".join(map(str, ids)), codec.library.decode(ids))]
    assert codec.decode(ids) == codec.library.decode(ids)


def test_dac_files_give_every_token(spark, docs, empty, rows, folder, same):
    manifest = dac_tokens.write_files(docs, f"{folder}/t", partitions=4)
    manifest.write.parquet(f"{folder}/m")
    manifest = spark.read.schema(manifest.schema).parquet(f"{folder}/m")
    out = dac_tokens.read_documents(manifest)
    lib = dac_tokens.WordTokenizer(dac_tokens.default_tokenizer()).library
    ids = [lib.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    same(out, ["doc_id", "n_tokens", "ids_crc32"], [(r[0], len(x), crc(x)) for r, x in zip(rows, ids, strict=True)])
    ends = sorted((r["start"], r["start"] + r["n_tokens"], r["doc_id"]) for r in out.collect())
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    order = [d for *_, d in ends if d is not None]
    assert order == sorted(order)
    none = dac_tokens.write_files(empty, f"{folder}/none", partitions=2)
    assert none.count() == 0 and dac_tokens.read_documents(none).count() == 0


def test_dac_random_access():
    rng = np.random.default_rng(3)
    ids = rng.choice([0, 1, 255, 256, 65535, 65536, 70000, 1 << 30], 5000).astype("<u4")
    ends = np.cumsum([1000, 0, 1500, 2500])
    for bits in (4, 8, 16):
        f = dac_tokens.DacFile(dac_tokens.encode_file(ids, ends, bits))
        assert all(f.token(i) == ids[i] for i in range(0, 5000, 37)) and (f.slice(513, 4999) == ids[513:4999]).all()
        assert (f.document(2) == ids[1000:2500]).all() and len(f.document(1)) == 0
    assert dac_tokens.DacFile(dac_tokens.encode_file(ids[:0], ends[:0])).n == 0


def test_word_memory_is_the_library():
    texts = ["It's DON'T we'll 's't", "<|endoftext|> a", "É ß ÿ Ÿ µ ª", "a\x1cb", "Σας", "1½2 34", "\n\n ,,, ''s", ""]
    path = dac_tokens.default_tokenizer()
    assert dac_tokens.WordTokenizer(path).batch(texts) == dac_tokens.WordTokenizer(path, plain_words=False).batch(texts)


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_quality_counts(spark, docs, empty, rows, same):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality_rules.judge(docs)
    same(out, columns, [(r[0], *brute_quality(r[1])) for r in rows])
    assert out.where("kept AND base_failed").count() == 0 and quality_rules.judge(empty).count() == 0


@pytest.mark.parametrize("bits", [3, 20, 60])
def test_quality_long_texts_use_the_same_rule(spark, monkeypatch, docs, rows, same, bits):
    """With 3 bits texts are too long for packed places; with 60, unequal windows share what is left of their hashes."""
    monkeypatch.setattr(quality_rules, "_BITS", bits)
    same(quality_rules.base_counts(docs), ["doc_id", "n_repeat_words"], [(r[0], brute_quality(r[1])[4]) for r in rows])


def test_quality_rejects_odd_distributions(spark):
    import random

    rng = random.Random(2)
    words = "the of and to in is that for with day night house water stone river people garden morning winter letter number street".split()
    clean = [(i, " ".join(rng.choice(words) for _ in range(120)) + ".", "en") for i in range(40)]
    odd = [(100, " ".join(rng.choice(words).upper() + "!!" for _ in range(120)), "en"), (101, " ".join(f"{rng.choice(words)}%%%$$" for _ in range(120)), None), (102, "short", "en")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert not kept[100] and not kept[101] and not kept[102] and sum(kept[i] for i in range(40)) >= 39


def test_line_spread(docs, empty, rows, folder):
    def brute():
        sites, first = {}, {}
        for i, text, _, site, *_ in rows:
            for k, line in enumerate((text or "").split("\n")):
                if line.strip():
                    sites.setdefault(line.strip(" "), set()).add(site or "")
                    first[line.strip(" ")] = min(first.get(line.strip(" "), (9e9, 0)), (-1 if i is None else i, k))
        out = []
        for i, text, _, _, *_ in rows:
            kept = [x for k, x in enumerate((text or "").split("\n")) if not x.strip() or len(sites[x.strip(" ")]) < 10 or first[x.strip(" ")] == (-1 if i is None else i, k)]
            out.append((i, "\n".join(kept)))
        return out

    got = line_spread.spread_dedup(docs, folder).cache()
    assert sorted(map(repr, ((r["_row"]["doc_id"], r["body"]) for r in got.collect()))) == sorted(map(repr, brute()))
    assert got.agg(F.sum("n_removed")).first()[0] == 14
    assert line_spread.spread_dedup(empty, folder + "-e").count() == 0
    staged = line_spread.stage(docs.sparkSession, docs, "")
    assert staged.columns == docs.columns and staged.count() == len(rows) and staged.where("text IS NULL").count() == 1


def test_decontamination(spark, docs, empty, rows, folder, same):
    items = [(1, " ".join((rows[5][1] or "").split()[:14])), (2, "One TWO three"), (3, "nothing like this occurs anywhere at all in these documents here"), (4, None), (5, ""), (6, "one two THREE")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = [(i, w[k : k + 10]) for i, t in items for w in [fold(t)] if w for k in range(max(1, len(w) - 9))]

    def brute(text):
        w, hit, found = fold(text), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
        return len(w), len(hit), sorted(found), bool(hit)

    out = positional_index.contamination(docs, bench, folder)
    same(out, ["doc_id", "n_words", "n_hit", "items", "contaminated"], [(r[0], *brute(r[1])) for r in rows])
    assert positional_index.contamination(empty, bench, folder + "-e").count() == 0
    assert positional_index.contamination(docs, bench.limit(0), folder + "-b").where("contaminated").count() == 0


def test_proximity(spark, folder):
    docs = spark.createDataFrame([(0, "alpha beta gamma delta"), (1, "alpha x beta gamma delta"), (2, "alpha x x x beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    windows = positional_index.windows_of(items, folder)
    index = positional_index.build_index(docs, windows.select(F.explode("terms").alias("word")), folder)
    ranked = positional_index.ranked_terms(index, windows, folder)
    near = positional_index.proximity_matches(index, ranked, 1).join(index.documents, "row")
    assert sorted(r["doc_id"] for r in near.collect()) == [0, 1]
    assert [r["start"] for r in positional_index.phrase_matches(index, ranked, folder).collect()] == [0]


def test_language_of_words(spark, docs, empty, rows):
    en = "the of and to in is that for with house water stone river people garden morning winter letter number street".split()
    de = "der die und das nicht mit sich auf haus wasser stein fluss leute garten morgen winterzeit brief zahl strasse".split()
    import random

    rng = random.Random(4)
    train = [("\n".join(" ".join(rng.choice(ws) for _ in range(8)) for _ in range(6)), lang) for lang, ws in (("en", en), ("de", de)) for _ in range(30)]
    model = crf_language.train(train, rounds=20)
    table = spark.createDataFrame([(0, "the water of the river"), (1, "das wasser und der fluss"), (2, "12 !?"), (3, None), (4, " ".join(en) + " " + " ".join(de[:3]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in crf_language.predict(table, model, words=True).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["en", "de", "und", "und", "en"] and got[3]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [x["lang"] for x in got[4]["labels"]][-3:] == ["de"] * 3
    assert crf_language.predict(empty, None).count() == 0 and {r["lang_pred"] for r in crf_language.predict(docs, None).collect()} == {"und"}
    assert crf_language.sample(empty) == [] and all(lang for _, lang in crf_language.sample(docs))


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    lengths, k = np.array([3, 1, 4]), 3
    e, start, moves = rng.normal(size=(8, k)), rng.normal(size=k), rng.normal(size=(k, k))
    got = crf_language.forward_backward(e, lengths, start, moves)
    at = 0
    for n in lengths:
        want, total = np.zeros((n, k)), 0.0
        for path in np.ndindex(*[k] * n):
            w = np.exp(start[path[0]] + sum(e[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for t, y in enumerate(path):
                want[t, y] += w
        assert np.allclose(got[at : at + n], want / total)
        at += n


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><ul><li><a href="/">Menu</a></ul></nav><header>Site</header><!-- c -->
<div class="ad">Buy the best things you can ever buy in this whole wide world, right now and here</div><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1><p><b>First  part<br><p>A &lt;b&gt; short
one.</p><p>x</p></article><aside>side</aside><form><input value=">">go</form><section id="comments"><p>I think so too, and here is why I think that this is so very good to read</p></section><footer>foot"""


def test_main_text(spark):
    assert main_text.main_text(PAGE) == "Head & line\nFirst part\nA <b> short one.\nx"
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<div>") == ""
    assert main_text.main_text("plain text only, no markup") == "plain text only, no markup"
    words = "many words that make a paragraph which is long enough to count as text of a page. " * 2
    assert main_text.main_text(f"<div>Home</div><br><br><br><br><p>{words}</p><p>tiny</p><p>{words}</p><br><br><br><br><div>About</div>") == f"{words.strip()}\ntiny\n{words.strip()}"
    nested = f'<main><h2>Section</h2><article><div class="article-header"><h1>T</h1></div><p>{words}</p><article class="comment"><p>{words}</p></article></article></main>'
    assert main_text.main_text(nested) == f"T\n{words.strip()}"
    assert main_text.main_text(f"<main><p>{words}</p><p>x</p></main><p>{words}</p>") == f"{words.strip()}\nx"
    pages = spark.createDataFrame([(1, "u", PAGE, "kept"), (1, "u", PAGE, "kept"), (None, None, None, None)], "page_id long, url string, html string, text2 string")
    out = main_text.extract(pages)
    assert out.columns == ["page_id", "url", "text2", "text"] and [len(r["text"]) for r in out.orderBy("page_id").collect()] == [0, 41, 41]


def test_digests_of_queries(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    lib = piece_codec.PieceCodec(piece_codec.default_model()).library
    ids = {r["doc_id"]: lib.encode(r["text"] or "") for r in rows}
    got = {r["doc_id"]: tuple(r)[1:] for r in piece_codec.op2(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for i, x in ids.items()}
    words = dac_tokens.WordTokenizer(dac_tokens.default_tokenizer()).library
    got = {r["doc_id"]: tuple(r)[1:] for r in dac_tokens.op8(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start = 0
    for r in rows:
        x = np.array(words.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[r["doc_id"]] == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert len(got) == len(rows)


def test_dac_files_roll_and_add_up(spark, docs, rows, folder, monkeypatch):
    """Many files a task, a group of one task each, and a text longer than a file."""
    monkeypatch.setattr(dac_tokens, "FILE_IDS", 50)
    monkeypatch.setattr(dac_tokens, "BATCH_ROWS", 3)
    monkeypatch.setattr(dac_tokens, "GROUP", 1)
    dac_tokens.write_files(docs, f"{folder}/t", partitions=5).write.parquet(f"{folder}/m")
    manifest = spark.read.parquet(f"{folder}/m")
    out = sorted((r["start"], r["n_tokens"]) for r in dac_tokens.read_documents(manifest).collect())
    lib = dac_tokens.WordTokenizer(dac_tokens.default_tokenizer()).library
    assert manifest.count() > 10 and len(out) == len(rows)
    assert all(a + n == b for (a, n), (b, _) in zip(out, out[1:], strict=False)) and sum(out[-1]) == sum(len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)


def test_language_query(spark):
    """The query itself on the table: the fold rule, ``und``, and accuracy on the fold that it did not learn from."""
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = crf_language.op1(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    right = total = 0
    for r in got:
        own = truth[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in own["text"] or ""))
        if r["held_out"] and own["lang"] and r["lang_pred"] != "und":
            right, total = right + (own["lang"] == r["lang_pred"]), total + 1
    assert total > 200 and right >= 0.98 * total


def test_language_sample_is_bounded(spark, monkeypatch):
    rows = [(i, f"wort{i} " * 9, f"l{i % 7}") for i in range(400)] + [(i, "x" * 90_000, None if i % 2 else "l0") for i in range(400, 420)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = crf_language.sample(table, docs_in_all=35)
    counts = Counter(lang for _, lang in got)
    assert len(counts) == 7 and set(counts.values()) == {5} and max(len(text) for text, _ in crf_language.sample(table)) == crf_language.SAMPLE_CHARS
    with pytest.warns(UserWarning, match="not learned"):
        assert len(crf_language.sample(table, docs_in_all=3)) == 3
    many = crf_language.train([(f"aa{i}bb cc{i}dd\nee{i}ff", f"l{i:02}") for i in range(70)], rounds=3)
    monkeypatch.setattr(crf_language, "CELLS", 140)
    assert len(many.label([crf_language.words_of("aa b"), [], crf_language.words_of("aa bb cc dd ee")])) == 3


def test_quality_nearest_reference_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(6)
    words = "the of and to der die und das le la les et el los y que house water stein fluss".split()
    rows = [(i, " ".join(rng.choice(words[4 * (i % 4) :]) for _ in range(100)), f"l{i % 9}" if i % 3 else None) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda df: sorted((r["doc_id"], r["js_chars"], r["js_words"], r["kept"]) for r in df.collect())
    one = key(quality_rules.judge(table))
    monkeypatch.setattr(quality_rules, "BLOCK_LANGUAGES", 2)
    assert key(quality_rules.judge(table)) == one and all(r[1] is not None for r in one)


def brute_surges(plain, window, surge):
    high = [sum(plain[i : i + window]) for i in range(len(plain))]
    out, i = [], 0
    while i < len(plain):
        if high[i] >= surge:
            stop = next((j for j in range(i, len(plain)) if not high[j]), len(plain))
            out.append((next(j for j in range(i, stop) if plain[j]), stop))
            i = stop
        else:
            i += 1
    return out


def test_surges_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(500):
        plain = (rng.integers(0, 60, rng.integers(0, 30)) * (rng.random() < rng.random(1)[0])).tolist()
        plain = [x if rng.random() < 0.6 else 0 for x in plain]
        window, surge = int(rng.integers(1, 5)), int(rng.integers(1, 120))
        assert main_text.surges(plain, window, surge) == brute_surges(plain, window, surge)


LONG = ("long words of the page " * 8).strip()


@pytest.mark.parametrize(("page", "want"), [
    (f"<h1>T</h1><p>Short.</p><p>{LONG}</p>", f"T\nShort.\n{LONG}"),
    (f"<div>Home</div><div>{LONG}</div>", LONG),
    (f"<article><h1>A</h1><p>tiny</p></article><article><p>{LONG}</p></article>", f"A\ntiny\n{LONG}"),
    (f"<article><p>{LONG}</p><p class='cookie-notice'>cookies</p><ul><li class=share>share<li>kept</ul><p>x</p></article>", f"{LONG}\nkept\nx"),
    (f"<div class='page has-sidebar'><article><p>{LONG}</p></article><div class=sidebar>side</div></div>", LONG),
    (f"<ul><li><a href=x>Home</a><li><a href=y>News</a><li><a href=z>About us all</a></ul><h2>T</h2><div>By X</div><p>{LONG}</p><p>The end.</p><ul><li><a href=x>Imprint and so on</a></ul>", f"T\nBy X\n{LONG}\nThe end."),
    (f"<p>{LONG}</p><br><br><br><div><a href=a>one</a></div><div><a href=b>two</a></div><div><a href=c>three</a></div><p>{LONG}</p>", f"{LONG}\n{LONG}"),
    (f"<table><tr><td class='ad'>buy<td>{LONG}<tr><td>c, and so on.</table>", f"{LONG}\nc, and so on."),
    (f"<p>a <script>x</script>b <svg><p>no</p></svg>c &lt;b&gt; &amp;amp;</p><p>{LONG}", f"a b c <b> &amp;\n{LONG}"),
    (f"<main><p>{LONG}</p></main><article class='comment'><p>{LONG}</p></article>", LONG),
    ("x < y and <b>z", "x < y and z"), ("<div", "<div"),
])
def test_main_text_without_marked_articles(page, want):
    assert main_text.main_text(page) == want


def test_windows_decide_where_no_article_is_marked(spark):
    """On pages whose article tags are taken away, the windows find the article's text; other windows find other text."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    bare = [re.sub(r"</?article>", lambda m: m[0].replace("article", "div"), p) for p in pages]
    assert all(main_text.main_text(p) == main_text.main_text(q) for p, q in zip(pages, bare, strict=True))
    page = f"<div><p>Some forty characters of a lone line.</p><br><br><br><br><p>{LONG}</p></div>"
    assert main_text.main_text(page) == LONG != main_text.main_text(page, surge=30) and main_text.main_text(page, window=6).startswith("Some")
    got = {r["page_id"]: r for r in main_text.op10(spark, "/root/testdata/sf0.001").collect()}
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in table:  # by hand: the blocks of the one article
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|br|div|ul|li|ol|blockquote)\b[^>]*>", inner)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


@pytest.mark.parametrize("piece", ['<a "', "<a ", '<a =">"', '<a ="> "', "<!--", "<p>", "</b></p>", "<a ='>\" ", '<div class="', "<article>", "<main>", "<script>", "<li><ul><b></li>", "<a<", "&amp"])
def test_broken_pages_take_linear_time(piece):
    began = time.time()
    main_text.main_text(piece * (1_000_000 // len(piece)) + "> '\" >")
    assert time.time() - began < 20


def test_main_text_of_nested_blocks_without_article():
    long = "long words of the page " * 8
    page = f"<div><h1>Title</h1></div><div><div><p>{long}</p></div></div><div><p>The end.</p></div>"
    assert main_text.main_text(page) == f"Title\n{long.strip()}\nThe end."
