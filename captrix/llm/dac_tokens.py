"""Token ids in directly addressable code files.

Every id is split into chunks of ``bits`` bits, low chunk first. Level k holds the k-th chunk of all ids that have one, and
a bitmap that says whether a further chunk follows; a rank directory counts the set bits before every block of 512, so
position i of level k maps to position rank(i) of level k + 1 and any token is read without decoding its neighbours.

File layout (little endian): magic ``DAC1``, u32 bits, u32 levels, u64 n ids, u64 n documents, then the documents'
ends (u64 each, counted within the file), then per level: u64 n, the chunks (u8 each, or u16 above 8 bits), the bitmap (u64 words),
the directory (u64 per block). Documents are in ascending doc_id order and files cover ascending ranges.

Edge cases: a null or empty text has the end id alone; null doc_ids sort first; equal doc_ids are ordered by their text;
an empty table writes no file and returns no row; a very long text is one document of one file, which may then be longer than ``FILE_IDS``;
other columns are ignored. Texts beyond ASCII and Latin-1 letters, with
control characters or with "<|" go to the library whole; all others are cut into the library's own pre-tokens, whose
ids are remembered, which gives the same ids.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from captrix.llm.common import read, shared_folder

MAGIC, BLOCK = b"DAC1", 512
MEMO_WORDS, BATCH_ROWS = 500_000, 1000
PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Chunk width in bits.
BITS = 8
#: A task begins another file after so many ids, which bounds its memory; its files are numbered within ROLLS.
FILE_IDS, ROLLS = 8_000_000, 1_000_000
#: Tasks whose files are added up together.
GROUP = 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """The tokenizers library with a memory of pre-token ids, as little-endian u32 bytes."""

    def __init__(self, path: str, plain_words: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain_words = plain_words
        self.memo: dict[str, bytes] = {}
        size = self.library.get_vocab_size()
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single pre-tokens: many in one text, cut behind the ids that end a word; one by one where that doesn't tally."""
        out: list[bytes] = []
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.asarray(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else []
            if len(cut) != len(part) or cut[-1] != len(ids):
                out += self._library(part)
                continue
            data, stops = ids.tobytes(), (4 * cut).tolist()
            out += [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        cut: dict[int, list[str]] = {}
        if self.plain_words:
            for i, t in enumerate(texts):
                if PLAIN.fullmatch(t) and "<|" not in t:
                    cut[i] = WORDS.findall(t.lower())
        memo = self.memo
        new = sorted(set().union(*cut.values()).difference(memo))
        full = len(memo) >= MEMO_WORDS
        memo.update(zip(new, self._words(new), strict=True))
        for i, ws in cut.items():
            out[i] = b"".join(map(memo.__getitem__, ws))
        for w in new:  # frequent words are met early, so a full memo stays as it is
            if full or len(w) > 48:
                del memo[w]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, b in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            out[i] = b
        return out


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for a Python worker, which keeps its memory from task to task."""
    return WordTokenizer(path)


def encode_file(ids: np.ndarray, ends: np.ndarray, bits: int = BITS) -> bytes:
    """The bytes of one file from the ids of its documents, end to end."""
    kind = np.dtype("<u1") if bits <= 8 else np.dtype("<u2")
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest >= (1 << bits)
        words = np.zeros(-(-len(rest) // 64) * 8, "u1")
        packed = np.packbits(more, bitorder="little")
        words[: len(packed)] = packed
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype="<u8"))]) if len(more) else np.zeros(1)
        levels.append(struct.pack("<Q", len(rest)) + (rest & ((1 << bits) - 1)).astype(kind).tobytes() + words.tobytes() + ones.astype("<u8").tobytes())
        rest = rest[more] >> bits
        if not len(rest):
            break
    return MAGIC + struct.pack("<IIQQ", bits, len(levels), len(ids), len(ends)) + ends.astype("<u8").tobytes() + b"".join(levels)


class DacFile:
    """Random access into a file's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 file")
        self.bits, n_levels, self.n, n_docs = struct.unpack_from("<IIQQ", data, 4)
        at = 28
        self.ends = np.frombuffer(data, "<u8", n_docs, at)
        at += 8 * n_docs
        kind = np.dtype("<u1") if self.bits <= 8 else np.dtype("<u2")
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, kind, n, at)
            at += n * kind.itemsize
            n_words = -(-n // 64)
            bitmap = np.frombuffer(data, "<u8", n_words, at)
            at += 8 * n_words
            n_blocks = -(-n // BLOCK) + 1
            ranks = np.frombuffer(data, "<u8", n_blocks, at)
            at += 8 * n_blocks
            self.levels.append((chunks, bitmap, ranks))

    def token(self, i: int) -> int:
        """Id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            word, bit = divmod(i, 64)
            if not (int(bitmap[word]) >> bit) & 1:
                break
            first = i // BLOCK * (BLOCK // 64)
            before = sum(int(w).bit_count() for w in bitmap[first:word])
            i = int(ranks[i // BLOCK]) + before + (int(bitmap[word]) & ((1 << bit) - 1)).bit_count()
            shift += self.bits
        return value

    def rank(self, level: int, i: int) -> int:
        """Set bits before position i of a level."""
        _, bitmap, ranks = self.levels[level]
        word, bit = divmod(i, 64)
        before = sum(int(w).bit_count() for w in bitmap[i // BLOCK * (BLOCK // 64) : word])
        return int(ranks[i // BLOCK]) + before + ((int(bitmap[word]) & ((1 << bit) - 1)).bit_count() if bit else 0)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids at positions a to b, b not included: one run of each level."""
        out, at, shift = np.zeros(b - a, "<u4"), np.arange(b - a), 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if a >= b:
                break
            out[at] |= chunks[a:b].astype("<u4") << shift
            bits = np.unpackbits(bitmap[a // 64 : -(-b // 64)].view("u1"), bitorder="little")[a % 64 : a % 64 + b - a].astype(bool)
            at = at[bits]
            if k + 1 < len(self.levels):
                a = self.rank(k, a)
                b = a + len(at)
            shift += self.bits
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, bits: int = BITS, doc_id: str = "doc_id", text: str = "text",
                partitions: int | None = None) -> DataFrame:
    """Tokenise, write the files into ``folder`` and return a manifest: file, part, n_docs, n_tokens, first and last doc_id.

    Rows are dealt by ranges of (doc_id, text hash) and sorted, so a task writes the same files at every attempt.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("part", T.LongType()), T.StructField("n_docs", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type))])
    arrow_id = pa.list_(rows.limit(0).toArrow().schema.field("doc_id").type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words, last = word_tokenizer(tokenizer), struct.pack("<I", end_id)
        keys, data, lengths, roll = [], [], [], 0

        def flush() -> pa.RecordBatch:
            """Write what is held as one file: under a name of this attempt first, then moved to its place."""
            ids = np.frombuffer(b"".join(data), "<u4")
            system, path = _filesystem(folder)
            system.create_dir(path, recursive=True)
            name = f"part-{part:06d}-{roll:04d}.dac"
            attempt = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(attempt) as out:
                out.write(encode_file(ids, np.cumsum(lengths), bits))
            system.move(attempt, f"{path}/{name}")
            values = [pa.array([f"{folder}/{name}"]), pa.array([part * ROLLS + roll], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([keys], arrow_id)]
            return pa.RecordBatch.from_arrays(values, names=["file", "part", "n_docs", "n_tokens", "doc_ids"])

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                keys += b.column(0).to_pylist()
                made = [x + last for x in words.batch(b.column(1).to_pylist())]
                lengths += [len(x) // 4 for x in made]
                data.append(b"".join(made))
                if sum(map(len, data)) >= 4 * FILE_IDS:
                    yield flush()
                    keys, data, lengths, roll = [], [], [], roll + 1
        if keys:
            yield flush()

    return rows.select("doc_id", "text").mapInArrow(run, schema)


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 of every document of a stored manifest.

    What a file's documents start at is the sum of the files before it: sums of ``GROUP`` tasks' files are added up first (one row a
    group), then the files within a group, and both meet by a join.
    """
    spark: SparkSession = manifest.sparkSession
    sizes = manifest.select("part", "n_tokens", F.expr(f"part div {ROLLS * GROUP}").alias("g"))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("g").agg(F.sum("n_tokens").alias("n_tokens")).select("g", before(Window.orderBy("g")).alias("groups_before"))
    placed = sizes.select("g", "part", before(Window.partitionBy("g").orderBy("part")).alias("files_before")).join(groups, "g")
    bases = placed.select("part", (F.col("groups_before") + F.col("files_before")).alias("base"))
    files = manifest.join(bases, "part").select("file", "base", "doc_ids")
    id_type = manifest.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                uri, base, keys = b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].values
                system, path = _filesystem(uri)
                with system.open_input_stream(path) as f:
                    held = DacFile(f.read())
                ends = held.ends.astype("i8")
                begins = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(ends), 10_000):
                    some = range(at, min(at + 10_000, len(ends)))
                    crcs = [zlib.crc32(held.document(i).astype("<u4").tobytes()) for i in some]
                    own = slice(some.start, some.stop)
                    yield pa.RecordBatch.from_arrays([keys[own.start : own.stop], pa.array(begins[own] + base, pa.int64()), pa.array((ends - begins)[own], pa.int64()), pa.array(crcs, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = min(manifest.count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return (files.repartition(tasks, "file") if tasks > 1 else files).mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_folder(spark)
    manifest = write_files(docs, f"{folder}/tokens")
    manifest.write.parquet(f"{folder}/manifest")
    return read_documents(spark.read.schema(manifest.schema).parquet(f"{folder}/manifest"))
