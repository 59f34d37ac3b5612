"""The pipeline's stages and its run against brute force."""

import hashlib
import re

import corpus_pipeline
import duckdb
import pytest
from captrix.llm import line_spread, piece_codec, quality_rules
from captrix.llm.common import read, shared_folder, workspace

from .test_corpus_operators import brute_classes

SF = "/root/testdata/sf0.001"


def by_sql(sql, documents):
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(sql).df()


def without_boilerplate(documents):
    """The texts that the line stage leaves, line by line."""
    lines = [(i, k, x) for i, t in zip(documents.doc_id, documents.text, strict=True) for k, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    site = dict(zip(documents.doc_id, documents.source, strict=True))
    sites, first = {}, {}
    for i, k, x in sorted(lines):
        sites.setdefault(x.strip(" "), set()).add(site[i] or "")
        first.setdefault(x.strip(" "), (i, k))
    gone = {(i, k) for i, k, x in lines if len(sites[x.strip(" ")]) >= line_spread.MIN_SITES and first[x.strip(" ")] != (i, k)}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone) for i, t in zip(documents.doc_id, documents.text, strict=True)}


def contaminated(texts, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    folded = [fold(t) for t in items]
    wins = {tuple(w[k : k + 10]) for w in folded if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in wins}
    return {i for i, t in texts.items() for w in [fold(t)] if any(tuple(w[k : k + n]) in wins for n in sizes for k in range(len(w) - n + 1))}


def test_run_is_the_stages_by_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "encoding"]
    docs = read(spark, SF, "documents")
    start = docs.toPandas()
    verdicts = by_sql(quality_rules.oracle(), start)
    good = start[start.doc_id.isin(verdicts[verdicts.kept].doc_id)]
    texts = without_boilerplate(good)
    digests = by_sql(line_spread.oracle(), good).set_index("doc_id").kept_sha256.to_dict()
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()} == digests
    near = {i: texts[i] for i in set(brute_classes(list(texts.items())).values())}
    dirty = contaminated(near, [r["text"] for r in read(spark, SF, "benchmark").collect()])
    lib = piece_codec.PieceCodec(piece_codec.default_model()).library
    want = {i: (lib.encode(t), lib.decode(lib.encode(t))) for i, t in near.items() if i not in dirty}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: (list(r["ids"]), r["text"]) for r in got} == want and len(got) == len(want) < len(near) < len(good) < len(start)
    digest = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.result(spark, SF).collect()}
    assert digest == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, (x, _) in want.items()}


def test_stages_keep_columns_of_any_name(spark, docs):
    """Columns named as what the operators use inside, of rows with nulls, repeats and empty texts; and a table without rows."""
    names = ["d", "a", "b", "_a", "_b", "_d", "_t", "_tie", "_row", "tie", "class", "node", "gd", "body", "site", "lines", "_lines", "_words", "_h", "_id", "_lang", "n_words", "kept", "base_failed", "found_id", "doc", "t", "l", "gone"]
    extra = docs.selectExpr("*", *[f"doc_id as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain = stage(spark, docs, SF)
        got = stage(spark, extra, SF)
        assert got.columns == extra.columns, name
        key = lambda df: sorted(map(repr, df.select("doc_id", "text", "lang", "source").collect()))
        assert key(got) == key(plain), name
        assert got.where(" OR ".join(f"NOT (`{n}` <=> doc_id)" for n in names)).count() == 0, name
        assert stage(spark, extra.limit(0), SF).count() == 0, name


def test_stored_tables_of_a_stage_go_with_its_workspace(spark, tmp_path):
    with workspace(spark) as folder:
        inner = shared_folder(spark)
        spark.range(3).write.parquet(f"{inner}/x")
        assert inner.startswith(folder) and spark.read.parquet(f"{inner}/x").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{inner}/x")
