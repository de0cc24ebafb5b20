"""Toxicity by compression distance to two zstandard dictionaries.

A window (WINDOW_WORDS words, lower case, after a fixed anchor that both dictionaries end with) is compressed with
the toxic and with the ordinary dictionary; the difference of the compressed lengths tells which text it is nearer
to. The anchor keeps zstandard from storing short windows raw, so a difference counts in single bytes. A document's
features are the largest differences, the shares of windows above fixed differences and the length; a logistic
regression on labelled documents that the dictionaries didn't see calibrates them to a probability.

The dictionaries hold the words that set the classes apart, by document frequency, the most telling ones last, where
zstandard reaches them cheapest; a dictionary trained on all text of a class holds what both classes share.

Learning takes at most TRAIN_ROWS labelled texts of each class, a window of TRAIN_WINDOW code points of a longer one. Scoring is a
pass over whole texts; compressed lengths are kept by window within a task.

Cases: null and empty texts have one empty window and get its score; without labels of both classes the score is the
share of toxic labels (0 if there are none); repeated rows and ids are scored alike; a very long text is scored whole,
its windows' differences are held at once; of equal differences any will do; an empty table gives an empty result;
other columns of documents are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .fitting import Logistic, sample_by_id

TRAIN_ROWS = {1: 2_000, 0: 4_000}
TRAIN_WINDOW = 20_000
WINDOW_WORDS = 1
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 1024, 8192, 9
#: Bytes that no text has in a row.
ANCHOR = bytes([*range(1, 8), *range(14, 31)])
WORD = r"[^\s.,!?|;:()$%&*#\"]+"
STEPS = (2, 3, 4, 5, 6, 7)
KEPT_WINDOWS = 400_000
#: Least scales of the features, of which the length is the last.
SCALES = [0.0] * (7 + len(STEPS)) + [0.5]
THRESHOLD = 0.3


def windows(text: str, n: int = WINDOW_WORDS) -> list[str]:
    words = re.findall(WORD, text.lower())
    return words or [""] if n == 1 else [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def contrast(texts: list[tuple[str, int]], n: int = WINDOW_WORDS) -> tuple[bytes, bytes]:
    """The contents of the toxic and the ordinary dictionary."""
    seen, rows = {0: Counter(), 1: Counter()}, Counter()
    for text, label in texts:
        seen[label].update({f" {w} " for w in windows(text, n)})
        rows[label] += 1
    share = lambda w, k: (seen[k][w] + 0.2) / (rows[k] + 0.4)
    toxic = {w: math.log(share(w, 1) / share(w, 0)) * math.sqrt(c) for w, c in seen[1].items() if c >= 3}
    ordinary = {w: c for w, c in seen[0].items() if c >= 5 and share(w, 1) < 1.5 * share(w, 0)}
    return _content(toxic, TOXIC_BYTES), _content(ordinary, ORDINARY_BYTES)


def _content(scores: dict[str, float], most: int) -> bytes:
    out, size = [], 0
    for w, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        b = w.encode()
        if s <= 0 or size + len(b) > most:
            break
        out.append(b)
        size += len(b)
    return b"".join(out[::-1])


class Distance:
    """The compressed length under the ordinary dictionary less that under the toxic one, by window."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.compress = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        self.known: dict[str, int] = {}

    def of(self, window: str) -> int:
        d = self.known.get(window)
        if d is None:
            if len(self.known) > KEPT_WINDOWS:
                self.known.clear()
            b = ANCHOR + b" " + window.encode() + b" "
            ordinary, toxic = self.compress
            d = self.known[window] = len(ordinary(b)) - len(toxic(b))
        return d

    def features(self, text: str) -> list[float]:
        d = np.sort(np.fromiter(map(self.of, windows(text)), np.int32))[::-1]
        n = len(d)
        above = [int(np.searchsorted(-d, -s, "right")) for s in STEPS]
        return [d[0], d[:3].mean(), d[:10].mean(), d.mean(), *(a / n for a in above), *(min(3, a) for a in above[3:]), math.log(n)]


class Model:
    """Dictionaries and calibration; `share` is the answer where there was nothing to fit."""

    def __init__(self, texts: list[tuple[str, int]], counts: dict) -> None:
        self.share = counts.get(1, 0) / max(1, sum(counts.values()))
        self.contents = self.logistic = None
        have = Counter(y for _, y in texts)
        if min(have[0], have[1]) < 2:
            return
        apart = min(have[0], have[1]) >= 60  # else both parts use all rows
        nth, first, second = Counter(), [], []
        for t, y in texts:
            nth[y] += 1
            (second if nth[y] % 3 == 0 else first).append((t, y))
        if not apart:
            first = second = texts
        self.contents = contrast(first)
        distance = Distance(*self.contents)
        y = np.array([y for _, y in second])
        weight = np.array([counts[k] / have[k] for k in y.tolist()])
        self.logistic = Logistic(np.array([distance.features(t) for t, _ in second]), y, weight, squares=False, least=SCALES)

    def scorer(self):  # noqa: ANN201
        if self.logistic is None:
            return lambda texts: [self.share] * len(texts)
        distance = Distance(*self.contents)
        return lambda texts: self.logistic.score(np.array([distance.features(t) for t in texts])).tolist() if texts else []


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, label (0 or 1), only rows that may be learned from."""
    return Model(*sample_by_id(docs, labels.where(F.col("label").isin(0, 1)), TRAIN_ROWS, TRAIN_WINDOW, 2))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1 of every row. The model (tens of kB) travels with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = []
            for t in batch.column(1):
                scores += score([t.as_py() or ""])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(docs, labels.where(~held_out).select("doc_id", F.col("toxic").alias("label")))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
