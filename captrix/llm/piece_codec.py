"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A chunk of text is cut into characters; an agenda (heap) holds the adjacent symbol pairs whose concatenation is a piece,
best score first and leftmost among equals; the best pair merges and its new neighbours enter, until none is left.
Symbols outside the vocabulary become byte pieces. Two neighbouring characters that stand side by side in no piece can
never merge, so a text is encoded chunk by chunk at such places and chunks are remembered; what places are used is
checked against the vocabulary when it is loaded. Every chunk that the agenda encodes is checked against the
sentencepiece library within its Arrow batch, and so is one whole text of each batch; a difference raises.

Edge cases: a null or empty text has no ids and decodes to the empty text; very long texts without spaces are one chunk
(n log n); rows are independent, so repeated rows, null ids and any other columns pass through unchanged; an empty table
gives an empty table. Columns of the input named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Longest chunk that is remembered, and how many chunks a Python worker remembers.
MEMO_CHARS, MEMO_CHUNKS = 48, 400_000
#: Rows that go to Python at once.
BATCH_ROWS = 1000

OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder over the vocabulary of a model file; identity normalisation with a leading space."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        plain = [i for i in range(len(pieces)) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.cost = {pieces[i]: -lib.get_score(i) for i in plain}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.surface = dict(enumerate(pieces))
        joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] or "\n" in x for x in joined):
            self.chunks = re.compile(r"(?s:.+)")
        elif any(x[1] in ".,!?" and re.match(f"[{LETTERS}]", x) for x in joined):
            self.chunks = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        else:
            self.chunks = re.compile(f"{SPACE}*[{LETTERS}]+(?![^.,!?{SPACE}\n])|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.memo: dict[str, tuple[str, str]] = {}

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk, by the agenda."""
        symbols: list[str | None] = list(chunk)
        n, cost = len(symbols), self.cost
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in cost:
                agenda.append((cost[pair], i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or len(left) + len(right) != size:
                continue
            symbols[i], symbols[j] = left + right, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                pair = symbols[i] + symbols[k]
                if pair in cost:
                    heapq.heappush(agenda, (cost[pair], i, k, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + symbols[i]
                if pair in cost:
                    heapq.heappush(agenda, (cost[pair], h, i, len(pair)))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                if i is not None:
                    out.append(i)
                else:
                    out.extend(self.byte_ids[b] for b in s.encode("utf-8"))
        return out

    def decode(self, ids) -> str:
        """Text of ids: pieces with spaces for their space mark, runs of byte pieces as UTF-8, one leading space off."""
        return self._pieces(ids).removeprefix(" ") if len(ids) else ""

    def _pieces(self, ids) -> str:
        out, run = [], bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.surface[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def _learn(self, chunks: set[str]) -> dict[str, tuple[str, str]]:
        """(ids joined by commas, surface) of new chunks, each checked against the library."""
        new = sorted(chunks)
        got = [self.merge(c) for c in new]
        marked = [(c, g) for c, g in zip(new, got, strict=True) if c[0] == SPACE != c]
        bare = [(c, g) for c, g in zip(new, got, strict=True) if c[0] != SPACE or c == SPACE]
        want = self.library.encode([c[1:] for c, _ in marked], num_threads=1) if marked else []
        # A chunk within a text has no leading space; behind a line break, which never merges, the library adds none.
        want_bare = self.library.encode(["\n" + c for c, _ in bare], num_threads=1) if bare else []
        lead = len(self.library.encode("\n"))
        for (c, g), w in [*zip(marked, want, strict=True), *((x, w[lead:]) for x, w in zip(bare, want_bare, strict=True))]:
            if g != w:
                raise ValueError(f"the agenda and the library differ on {c[:80]!r}: {g[:20]} and {w[:20]}")
        return {c: (",".join(map(str, g)), self._pieces(g)) for c, g in zip(new, got, strict=True)}

    def batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text, checked against the library."""
        cut = [self.chunks.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        memo = self.memo
        missing = {c for cs in cut for c in cs if c not in memo}
        extra: dict[str, tuple[str, str]] = {}
        if missing:
            extra = self._learn(missing)
            if len(memo) < MEMO_CHUNKS:  # frequent chunks are met early, so a full memo stays as it is
                memo.update((c, v) for c, v in extra.items() if len(c) <= MEMO_CHARS)
        out = []
        for cs in cut:
            if extra:
                found = [memo.get(c) or extra[c] for c in cs]
            else:
                found = [memo[c] for c in cs]
            out.append((",".join([f[0] for f in found]), "".join([f[1] for f in found]).removeprefix(" ")))
        k = next((i for i, t in enumerate(texts) if t), None)
        if k is not None:
            ids = self.library.encode(texts[k], num_threads=1)
            if out[k] != (",".join(map(str, ids)), self.library.decode(ids)):
                raise ValueError("the agenda and the library differ on a whole text")
        return out


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def encode(docs: DataFrame, text: str = "text", model_file: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Add the ``outputs`` (of ``OUTPUTS``) of every whole text."""
    model_file = model_file or default_model()
    kept = [c for c in docs.columns if c not in outputs]
    fields = [docs.schema[c] for c in kept] + [T.StructField(o, OUTPUTS[o][0]) for o in outputs]
    if text not in kept:
        raise ValueError(f"the text column {text!r} has the name of an output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(at, BATCH_ROWS)
                done = codec.batch([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
                made = {
                    "ids": lambda d: [[int(i) for i in s.split(",")] if s else [] for s, _ in d],
                    "n_tokens": lambda d: [s.count(",") + 1 if s else 0 for s, _ in d],
                    "ids_sha256": lambda d: [hashlib.sha256(s.encode()).hexdigest() for s, _ in d],
                    "decoded": lambda d: [x for _, x in d],
                    "decoded_sha256": lambda d: [hashlib.sha256(x.encode("utf-8")).hexdigest() for _, x in d],
                }
                columns = [part.column(i) for i in range(part.num_columns)] + [pa.array(made[o](done), OUTPUTS[o][1]) for o in outputs]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *outputs])

    return docs.select(*kept).mapInArrow(run, T.StructType(fields))


def decode(table: DataFrame, ids: str = "ids", model_file: str | None = None, output: str = "decoded") -> DataFrame:
    """Add the text of an array of ids; a null array decodes to the empty text."""
    model_file = model_file or default_model()
    kept = [c for c in table.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_file)
        for b in batches:
            texts = [codec.decode(x or []) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*kept, output])

    return table.select(*kept).mapInArrow(run, T.StructType([table.schema[c] for c in kept] + [T.StructField(output, T.StringType())]))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its ids, and the text that they decode to."""
    renamed = docs.drop("ids", "decoded")
    return encode(renamed).withColumn("text", F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.col("decoded"))).drop("decoded")
