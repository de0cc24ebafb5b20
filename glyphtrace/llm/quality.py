"""Quality by compression with two trained zstandard dictionaries.

Dictionaries are trained on pieces of good and of bad labelled texts. A text is cut into pieces of PIECE bytes, each
compressed with both; the normalised difference of the compressed sizes (of all, and of the most extreme pieces) is
calibrated to the probability of label 1 by a logistic regression on labelled texts that the dictionaries didn't see.

Learning takes at most TRAIN_ROWS labelled texts of each class, a window of TRAIN_WINDOW code points of a longer one. Scoring is a pass
over whole texts, a text of any length at a time.

Cases: null and empty texts are one empty piece and get its score; without labels of both classes the score is the
share of good labels (1 if there are none, so that nothing is dropped unjudged); repeated rows and ids are scored
alike; an empty table gives an empty result; other columns of documents are not read.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .fitting import Logistic, sample_by_id
from .toxicity import scored

TRAIN_ROWS = {1: 3_000, 0: 3_000}
TRAIN_WINDOW = 20_000
PIECE, DICTIONARY, LEVEL = 512, 32_768, 3
#: Pieces of a text that a dictionary learns from, of good and of bad texts (bad ones are fewer), and of all texts of a class together.
PIECES, ALL_PIECES = {1: 2, 0: 12}, 12_000
THRESHOLD = 0.3
#: Least scales of the features, of which the length is the last but one.
SCALES = [0.0] * 5 + [0.5, 0.0]


def pieces(text: str) -> list[bytes]:
    b = text.encode()
    return [b[i : i + PIECE] for i in range(0, len(b), PIECE)] or [b""]


def trained(texts: list[str], each: int) -> bytes:
    """A dictionary of DICTIONARY bytes at most, trained on pieces of all texts, fewer of each where these are many; raw text where there is too little."""
    draw = random.Random(2)
    each, some = max(1, min(each, ALL_PIECES // max(1, len(texts)))), []
    for ps in map(pieces, texts):
        some += draw.sample(ps, min(each, len(ps)))
    draw.shuffle(some)
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, some)) // 8)), some).as_bytes()
    except zstandard.ZstdError:
        return b"".join(some)[:DICTIONARY]


class Sizes:
    """Compressed sizes of pieces with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.compress = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def features(self, text: str) -> list[float]:
        ps = pieces(text)
        good, bad = (np.fromiter((len(c(p)) for p in ps), np.float64, len(ps)) for c in self.compress)
        size = sum(map(len, ps)) + 8
        d = (good - bad) / np.maximum(good, bad)
        return [(good.sum() - bad.sum()) / max(good.sum(), bad.sum()), d.max(), d.min(), good.sum() / size, bad.sum() / size, math.log(size), (d > 0).mean()]


class Model:
    def __init__(self, texts: list[tuple[str, int]], counts: dict) -> None:
        self.share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
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
        self.contents = [trained([t for t, y in first if y == k], PIECES[k]) for k in (1, 0)]
        sizes = Sizes(*self.contents)
        y = np.array([y for _, y in second])
        weight = np.array([counts[k] / have[k] for k in y.tolist()])
        self.logistic = Logistic(np.array([sizes.features(t) for t, _ in second]), y, weight, squares=True, least=SCALES)

    def scorer(self):  # noqa: ANN201
        if self.logistic is None:
            return lambda texts: [self.share] * len(texts)
        sizes = Sizes(*self.contents)
        return lambda texts: self.logistic.score(np.array([sizes.features(t) for t in texts])).tolist() if texts else []


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, label (0 or 1), only rows that may be learned from."""
    return Model(*sample_by_id(docs, labels.where(F.col("label").isin(0, 1)), TRAIN_ROWS, TRAIN_WINDOW, 3))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
