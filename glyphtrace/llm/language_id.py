"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is a row of lower-case letters with single boundaries between words; its features are the letter n-grams of
NGRAMS sizes that lie within a word and its boundaries, hashed to BUCKETS. A document's vector is the mean of its
n-grams' embeddings. Training sees whole texts and short pieces of them, so that texts of a few words are not left to
chance. A held-back part of the sample sets a temperature, and the level of confidence below which a text is
rejected: at most REJECTED of the rightly labelled whole texts of that part fall below it.

At prediction the embeddings and the softmax's weights are one table (BUCKETS x languages); scoring is a mean of its
rows. The sample holds at most TRAIN_ROWS texts of each language (fewer, LEAST_ROWS at least, where languages are so many
that there would be more than TRAIN_ALL), a window of TRAIN_WINDOW code points of a longer one. Every language of the table is learned.

Cases: a null text, an empty one or one without a letter is `und` with score 0 and is rejected; nothing to learn from
makes every text `und`; of equally likely languages the first by code point; null ids are folded as the text 'null';
repeated rows get the same answer; a very long text is scored whole, in slices; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, table
from .fitting import label_counts, labelled_sample

BUCKETS, WIDTH, NGRAMS = 1 << 15, 16, (1, 2, 3, 4)
TRAIN_ROWS, LEAST_ROWS, TRAIN_ALL, TRAIN_WINDOW = 400, 10, 80_000, 20_000
EPOCHS, RATE = 6, 0.5
#: Share of rightly labelled texts that calibration lets be rejected, and the level never exceeded.
REJECTED, MOST = 0.001, 0.5
#: Code points of a text that are scored at once.
SLICE = 1_000_000
NONE = "und"


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str, letters: np.ndarray) -> np.ndarray:
    """The buckets of a text's n-grams; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    row = np.where(letters[points], points, 0)
    row = np.concatenate(([0], row, [0])).astype(np.uint64)
    row = row[np.concatenate(([True], (row[1:] != 0) | (row[:-1] != 0)))]
    if len(row) < 2:
        return np.zeros(0, np.int64)
    out = []
    wall = row == 0
    inside = np.cumsum(wall)  # walls up to here
    for n in NGRAMS:
        m = len(row) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h ^ row[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        if n > 1:  # walls only at the ends
            good = inside[n - 2 : n - 2 + m] - inside[:m] == 0 if n > 2 else ~(wall[:m] & wall[1 : m + 1])
            h = h[good]
        else:
            h = h[~wall]
        out.append(h % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int64)


class Model:
    """languages, the table of logits, biases, temperature, and the level of rejection."""

    def __init__(self, texts: list[tuple[str, str]]) -> None:
        self.languages = sorted({y for _, y in texts})
        self.temperature, self.level = 1.0, 0.0
        self.table, self.bias = np.zeros((BUCKETS, len(self.languages)), np.float32), np.zeros(len(self.languages), np.float32)
        if self.languages:
            with np.errstate(over="ignore"):
                self._fit(texts)

    def _fit(self, texts: list[tuple[str, str]]) -> None:
        draw, letters = random.Random(8), letter_table()
        number = {y: k for k, y in enumerate(self.languages)}
        train, check = [], []
        for i, (t, y) in enumerate(texts):
            part = check if i % 5 == 4 else train
            words = t.split()
            short = [" ".join(words[a : a + n]) for n in (1, 3, 8) for a in [draw.randrange(max(1, len(words) - n + 1))]]
            for whole, piece in ((True, t), *((False, p) for p in short)):
                if len(x := ngrams(piece, letters)):
                    buckets, counts = np.unique(x, return_counts=True)
                    part.append((buckets, (counts / counts.sum()).astype(np.float32), number[y], whole))
        check = check or train
        rng = np.random.default_rng(8)
        e = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        w, b = np.zeros((WIDTH, len(self.languages)), np.float32), np.zeros(len(self.languages), np.float32)
        steps, step = EPOCHS * len(train), 0
        for _ in range(EPOCHS):
            draw.shuffle(train)
            for buckets, share, y, _whole in train:
                rate = RATE * (1 - step / steps)
                step += 1
                v = share @ e[buckets]
                z = v @ w + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = w @ p
                w -= rate * np.outer(v, p)
                b -= rate * p
                e[buckets] -= rate * len(buckets) ** 0.5 * share[:, None] * back
        self.table, self.bias = e @ w, b
        logits = np.array([share @ self.table[buckets] + b for buckets, share, _, _ in check])
        truth, whole = np.array([c[2] for c in check]), np.array([c[3] for c in check])
        self.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
        p = _softmax(logits / self.temperature)
        right = (p.argmax(1) == truth) & whole
        self.level = float(min(MOST, np.quantile(p.max(1)[right], REJECTED) * 0.9)) if right.any() else 0.0

    def predict(self, text: str, letters: np.ndarray) -> tuple[str, float]:
        """The language and its calibrated probability."""
        total, n = np.zeros(len(self.languages), np.float64), 0
        for i in range(0, len(text), SLICE):
            x = ngrams(text[i : i + SLICE], letters)
            if len(x):
                total += self.table[x].sum(0, dtype=np.float64)
                n += len(x)
        if not n or not self.languages:
            return NONE, 0.0
        p = _softmax((total / n + self.bias)[None] / self.temperature)[0]
        return self.languages[int(p.argmax())], float(p.max())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame) -> Model:
    """A model of the language column of docs, which has only rows that may be learned from."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").alias("label"))
    counts = label_counts(rows)
    each = max(LEAST_ROWS, min(TRAIN_ROWS, TRAIN_ALL // max(1, len(counts))))
    return Model(labelled_sample(rows, counts, dict.fromkeys(counts, each), TRAIN_WINDOW, 8))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected added (under names of their own where docs has such columns: `_lang_pred`, ...)."""
    names = [n if n not in docs.columns else f"_{n}" for n in ("lang_pred", "score", "rejected")]
    n = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            with np.errstate(over="ignore"):
                found = [model.predict(t.as_py() or "", letters) for t in batch.column(n)]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            rejected = [x == NONE or s < model.level for x, s in found]
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held_out))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
