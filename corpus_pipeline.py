"""A training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads it
back as the next stage's documents, and deletes what the stage had stored for itself. All but the last return the columns of ``docs``; the
last adds ``ids`` and returns the decoded text.

Edge cases: a document with a null or empty text has no words, so the quality rules reject it; of rows with one id and one text the
near dedup keeps one; rows with one id and several texts are one document there; null ids, languages and sources, very long texts, ties and
other columns of any name pass through as each stage's module says; without documents the result is empty with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrix.llm import line_spread, piece_codec, positional_index, prob_minhash, quality_rules
from captrix.llm.common import read, shared_folder, stored, workspace

STAGES = [
    ("quality rules", quality_rules.stage),
    ("line dedup", line_spread.stage),
    ("near dedup", prob_minhash.stage),
    ("decontamination", positional_index.stage),
    ("encoding", piece_codec.stage),
]

#: SQL cannot express ProbMinHash classes or piece ids; ``tests/llm/test_pipeline.py`` holds every stage and run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        with workspace(spark):
            docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs


def result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of ids, and digests of ids and text of what ``run`` keeps."""
    out = run(spark, sf_dir)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("ids_sha256"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"pipeline": result}
ORACLES = {"pipeline": ORACLE_SQL}
