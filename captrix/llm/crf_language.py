"""Language of words in code-switched text by a linear-chain conditional random field.

A word's features are its affixes (1 to 4 characters), its character n-grams (1 to 3, with word bounds) and its membership
in each language's lexicon; transition weights between the languages of neighbouring words are learned with them. The
field is trained on the driver by gradient ascent (Adam, full batch) on a bounded sample of labelled rows: ``SAMPLE_DOCS`` documents at most,
shared out evenly to all languages and at most ``DOCS_PER_LANGUAGE`` for each, picked by hash among all labelled rows; of each at most ``SAMPLE_CHARS``
characters are learned from. Should there be more languages than ``SAMPLE_DOCS``, the rarest are not learned, which a warning says.
Their lines are shuffled and chained into sequences of several languages, so the transitions see switches. Every word of
every whole text is then labelled by forward-backward; a document's language is the one with the largest mean marginal.

Edge cases: a null text or one without a letter is ``und`` with score 0; without any labelled row everything is ``und``;
rows are independent, so repeated rows, null ids and any other columns do no harm; a null id counts as the empty text
for the fold; very long texts are one sequence; ties go to the language that sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from captrix.llm.common import read

#: Bounds of the training sample.
SAMPLE_DOCS, DOCS_PER_LANGUAGE, SAMPLE_CHARS = 19_200, 300, 20_000
LEXICON_WORDS, LINES_PER_SEQUENCE = 2000, 8
HASH_BITS, ROUNDS, RATE, RIDGE = 18, 25, 0.15, 1e-6
BATCH_ROWS, MEMO_WORDS = 1000, 300_000
#: Marginals (words x languages) held at once, beyond one text's.
CELLS = 1 << 23
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray, tag: int) -> np.ndarray:
    x = (x ^ np.uint64(tag * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of affixes and n-grams, as two arrays."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    who, what = [], []
    gram = np.zeros(len(chars), np.uint64)
    for n in (1, 2, 3):
        gram = (gram[: len(chars) - n + 1] if n == 1 else gram[:-1]) * np.uint64(0x100000001B3) + chars[n - 1 :]
        whole = owner[: len(gram)] == owner[n - 1 :]
        who.append(owner[: len(gram)][whole])
        what.append(_mix(gram[whole], n))
    for n in (1, 2, 3, 4):
        has = np.flatnonzero(sizes - 2 >= n)
        head, tail = np.zeros(len(has), np.uint64), np.zeros(len(has), np.uint64)
        for k in range(n):
            head = head * np.uint64(0x100000001B3) + chars[starts[has] + 1 + k]
            tail = tail * np.uint64(0x100000001B3) + chars[ends[has] - 1 - n + k]
        who += [has, has]
        what += [_mix(head, 10 + n), _mix(tail, 20 + n)]
    return np.concatenate(who), np.concatenate(what)


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that lays sequences (end to end) out step by step, the longest first; and the rows of each step."""
    rank = np.empty(len(lengths), np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
    starts = np.cumsum(lengths) - lengths
    step = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    order = np.argsort(step * len(lengths) + np.repeat(rank, lengths))
    return order, np.bincount(step) if len(step) else np.zeros(0, np.int64)


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Marginals of every step of sequences laid end to end; with ``pairs`` also log-likelihood terms for training.

    ``emissions`` are log scores, ``start`` and ``moves`` are log weights.
    """
    order, counts = time_major(lengths)
    top = emissions.max(axis=1, keepdims=True)
    e = np.exp(emissions - top)[order]
    m, s = np.exp(moves), np.exp(start)
    at = np.concatenate([[0], np.cumsum(counts)])
    ahead, scale = np.empty_like(e), np.empty(len(e), e.dtype)
    for t in range(len(counts)):
        here = slice(at[t], at[t + 1])
        x = e[here] * s if t == 0 else (ahead[at[t - 1] : at[t - 1] + counts[t]] @ m) * e[here]
        scale[here] = z = x.sum(axis=1)
        ahead[here] = x / z[:, None]
    back = np.ones_like(e)
    for t in range(len(counts) - 2, -1, -1):
        n = counts[t + 1]
        nxt = slice(at[t + 1], at[t + 2])
        back[at[t] : at[t] + n] = ((e[nxt] * back[nxt]) @ m.T) / scale[nxt][:, None]
    both = ahead * back
    both /= both.sum(axis=1, keepdims=True)
    out = np.empty_like(both)
    out[order] = both
    if not pairs:
        return out
    expected = np.zeros_like(m)
    for t in range(1, len(counts)):
        n, nxt = counts[t], slice(at[t], at[t + 1])
        expected += m * (ahead[at[t - 1] : at[t - 1] + n].T @ (e[nxt] * back[nxt] / scale[nxt][:, None]))
    return out, expected, both[: counts[0]].sum(axis=0), float(np.log(scale).sum() + top.sum())


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # features x languages
    lexicon: dict[str, tuple[int, ...]]  # word -> its languages
    lexicon_weights: np.ndarray  # languages x languages
    start: np.ndarray
    moves: np.ndarray
    memo: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def scores(self, words: list[str]) -> np.ndarray:
        who, what = features(words)
        k = len(self.languages)
        out = np.stack([np.bincount(who, self.weights[what, j], len(words)) for j in range(k)], axis=1)
        return (out + membership(words, self.lexicon, k) @ self.lexicon_weights).astype(np.float32)

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals (words x languages) of every text, given its words; a bounded number of words at once."""
        out, at, room = [], 0, CELLS // len(self.languages)
        while at < len(texts):
            end, n = at + 1, len(texts[at])
            while end < len(texts) and n + len(texts[end]) <= room:
                n += len(texts[end])
                end += 1
            out += self._label(texts[at:end])
            at = end
        return out

    def _label(self, texts: list[list[str]]) -> list[np.ndarray]:
        if self.table is None:
            self.table = np.zeros((0, len(self.languages)), np.float32)
        memo = self.memo
        new = sorted({w for ws in texts for w in ws if w not in memo})
        extra = {w: len(memo) + i for i, w in enumerate(new)}
        table = np.concatenate([self.table, self.scores(new)]) if new else self.table
        if len(memo) < MEMO_WORDS:  # frequent words are met early, so a full memo stays as it is
            memo.update(extra)
            self.table = table
            extra = {}
        lengths = np.array([len(ws) for ws in texts], np.int64)
        ids = [memo[w] if w in memo else extra[w] for ws in texts for w in ws] if extra else [memo[w] for ws in texts for w in ws]
        full = np.flatnonzero(lengths)
        marginals = forward_backward(table[np.array(ids, np.int64)], lengths[full], self.start, self.moves) if ids else np.zeros((0, len(self.languages)), np.float32)
        return np.split(marginals, np.cumsum(lengths)[:-1]) if len(lengths) else []


def membership(words: list[str], lexicon: dict[str, tuple[int, ...]], k: int) -> np.ndarray:
    """words x languages: whether the word is in the language's lexicon."""
    out = np.zeros((len(words), k))
    for i, w in enumerate(words):
        if (own := lexicon.get(w)) is not None:
            out[i, own] = 1
    return out


def train(rows: list[tuple[str, str]], seed: int = 7, rounds: int = ROUNDS) -> Field | None:
    """Fit the field to (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    code = {x: i for i, x in enumerate(languages)}
    lines = [(ws, code[lang]) for text, lang in rows for line in text.split("\n") if (ws := words_of(line))]
    random.Random(seed).shuffle(lines)
    k = len(languages)
    counts = [Counter() for _ in languages]
    for ws, y in lines:
        counts[y].update(ws)
    lexicon: dict[str, tuple[int, ...]] = {}
    for j, c in enumerate(counts):
        for w, n in c.most_common(LEXICON_WORDS):
            if n > 1:
                lexicon[w] = (*lexicon.get(w, ()), j)
    vocabulary: dict[str, int] = {}
    ids, labels, lengths = [], [], []
    for at in range(0, len(lines), LINES_PER_SEQUENCE):
        part = lines[at : at + LINES_PER_SEQUENCE]
        lengths.append(sum(len(ws) for ws, _ in part))
        for ws, y in part:
            ids += [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
            labels += [y] * len(ws)
    out = Field(languages, np.zeros((1 << HASH_BITS, k)), lexicon, np.zeros((k, k)), np.zeros(k), np.zeros((k, k)))
    if not ids:
        return out
    ids, labels, lengths = np.array(ids), np.array(labels), np.array(lengths)
    words = list(vocabulary)
    who, what = features(words)
    used, what = np.unique(what, return_inverse=True)
    member = membership(words, lexicon, k)
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(ids), bool)
    inner[first] = False
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    seen_start = np.bincount(labels[first], minlength=k).astype(float)
    seen = np.stack([np.bincount(ids, labels == j, len(words)) for j in range(k)], axis=1)
    parts = {"w": np.zeros((len(used), k)), "l": np.zeros((k, k)), "s": np.zeros(k), "m": np.zeros((k, k))}
    mean = {n: np.zeros_like(p) for n, p in parts.items()}
    square = {n: np.zeros_like(p) for n, p in parts.items()}
    for t in range(1, rounds + 1):
        scores = np.stack([np.bincount(who, parts["w"][what, j], len(words)) for j in range(k)], axis=1) + member @ parts["l"]
        marginals, moved, started, _ = forward_backward(scores[ids], lengths, parts["s"], parts["m"], pairs=True)
        expected = np.stack([np.bincount(ids, marginals[:, j], len(words)) for j in range(k)], axis=1)
        gap = (seen - expected) / len(ids)
        slope = {"w": np.stack([np.bincount(what, gap[who, j], len(used)) for j in range(k)], axis=1), "l": member.T @ gap, "s": (seen_start - started) / len(ids), "m": (seen_moves - moved) / len(ids)}
        for n, p in parts.items():
            g = slope[n] - RIDGE * p
            mean[n] = 0.9 * mean[n] + 0.1 * g
            square[n] = 0.99 * square[n] + 0.01 * g * g
            p += RATE * (mean[n] / (1 - 0.9**t)) / (np.sqrt(square[n] / (1 - 0.99**t)) + 1e-9) * (1 - t / (rounds + 1))
    out.weights[used] = parts["w"]
    out.weights = out.weights.astype(np.float32)
    out.lexicon_weights, out.start, out.moves = parts["l"], parts["s"].astype(np.float32), parts["m"].astype(np.float32)
    return out


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_in_all: int = SAMPLE_DOCS, per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """Labelled rows outside the held-out fold, a bounded number of each language, picked by hash over all rows.

    Rows are thinned by their hash to a little more than what is wanted of their language before they are ranked within it,
    so that no language's rows meet in one task.
    """
    rows = docs.where((fold_of(doc_id) != 1) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(docs_in_all + 1).collect()
    if len(counts) > docs_in_all:
        warnings.warn(f"languages after the first {docs_in_all} are not learned", stacklevel=2)
        counts = counts[:docs_in_all]
    if not counts:
        return []
    wanted = max(1, min(per_language, docs_in_all // len(counts)))
    parts = 1 << 40
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(parts, parts * (2 * wanted + 100) // r["count"])) for r in counts], "lang string, share long")
    some = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(parts)) < F.col("share"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picked = some.withColumn("text", F.substring("text", 1, SAMPLE_CHARS)).withColumn("nth", nth).where(F.col("nth") <= wanted).collect()
    return [(r["text"], r["lang"]) for r in sorted(picked, key=lambda r: (r["h"], r["text"]))]


def predict(docs: DataFrame, model: Field | None, text: str = "text", words: bool = False) -> DataFrame:
    """Add lang_pred and score to every row; with ``words`` also labels: array of (word, lang, score)."""
    made = ["lang_pred", "score", *(["labels"] if words else [])]
    kept = [c for c in docs.columns if c not in made]
    label = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.FloatType())]))
    kinds = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("labels", label)][: len(made)]
    arrow_label = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float32())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                cut = [words_of(t) if fitted else [] for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                langs, scores, labels = [], [], []
                for ws, m in zip(cut, fitted.label(cut) if fitted else [None] * len(cut), strict=True):
                    if not ws:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        labels.append([])
                        continue
                    means = m.mean(axis=0, dtype=np.float64)
                    j = int(means.argmax())
                    langs.append(fitted.languages[j])
                    scores.append(float(min(1.0, max(0.0, means[j]))))
                    if words:
                        labels.append([{"word": w, "lang": fitted.languages[i], "score": float(x[i])} for w, x, i in zip(ws, m, m.argmax(axis=1), strict=True)])
                columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *([pa.array(labels, arrow_label)] if words else [])]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*kept, *made])

    return docs.select(*kept).mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + kinds))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(sample(docs))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold_of() == 1).alias("held_out"), "lang_pred", "score")
