"""Bounded labelled samples and a small logistic regression, for the classifiers that are fitted on the driver.

Cases: rows with a null label or a null or empty text are not sampled; equal texts of a label are one; a label on few
rows gives as many as there are; of a text that is longer than a window one window is taken, at a place that its hash
decides, so texts of any length are learned from; an empty table gives no sample; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of


def fraction(hashed: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return hashed.cast("double") / float(1 << 64) + 0.5


def window_of(text: Column, most: int, seed: int) -> Column:
    """text, or of a longer one `most` code points from a place that its hash decides."""
    length = F.length(text)
    start = F.floor(fraction(F.xxhash64(F.lit(seed), F.lit("window"), text)) * (length - most + 1)).cast("int")
    return F.when(length <= most, text).otherwise(F.substr(text, start + 1, F.lit(most)))


def label_counts(rows: DataFrame) -> dict:
    """The number of rows of each label. rows: label."""
    return {r["label"]: r["n"] for r in rows.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).collect()}


def labelled_sample(rows: DataFrame, counts: dict, most: dict, window: int, seed: int) -> list[tuple[str, object]]:
    """At most most[label] different texts of each label, as (text, label). rows: text and label in one row.

    The sample is drawn by a hash of the text, so neither ids nor copies matter; of texts over `window` code points a
    window is taken. It is cut to size before it is collected: what comes to the driver is bounded by most and window.
    """
    if not counts:
        return []
    part = fraction(F.xxhash64(F.lit(seed), "text"))
    share = F.coalesce(*(F.when(F.col("label") == k, F.lit(min(1.0, 1.3 * most[k] / n))) for k, n in counts.items()))
    some = rows.select(text_of().alias("text"), "label").where(F.length("text") > 0).withColumn("part", part).where(F.col("part") <= share)
    some = some.withColumn("text", window_of(F.col("text"), window, seed))
    first = Window.partitionBy("label").orderBy("part", "text")
    ranked = some.groupBy("label", "text").agg(F.first("part").alias("part")).withColumn("n", F.row_number().over(first))
    quota = F.coalesce(*(F.when(F.col("label") == k, F.lit(most[k])) for k in counts))
    found = ranked.where(F.col("n") <= quota).select("text", "label", "part").collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["part"], r["text"], str(r["label"])))]


def by_id(docs: DataFrame, labels: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns (text, if none is named) and label of the rows of docs whose doc_id has a label; the least one where an id has several. labels: doc_id, label."""
    one = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    slim = docs.select("doc_id", *(columns or ("text",))).join(one, "doc_id")
    return slim if columns else slim.drop("doc_id")


def sample_by_id(docs: DataFrame, labels: DataFrame, most: dict, window: int, seed: int) -> tuple[list[tuple[str, object]], dict]:
    """The sample of labelled_sample() for labels that stand in a table of their own, and the number of rows of each label.

    Labels meet ids, hashes and lengths, never texts; the texts of what is picked, at most the sum of `most` rows, which
    are broadcast, are then read in a second scan.
    """
    key = F.xxhash64(F.lit(seed), text_of())
    slim = by_id(docs, labels, key.alias("h"), F.length(text_of()).alias("len"))
    counts = label_counts(slim)
    if not counts:
        return [], counts
    part = fraction(F.col("h"))
    by_label = lambda of: F.coalesce(*(F.when(F.col("label") == k, F.lit(of(k, n))) for k, n in counts.items()))
    some = slim.withColumn("part", part).where((F.col("len") > 0) & (F.col("part") <= by_label(lambda k, n: min(1.0, 1.3 * most[k] / n))))
    each = some.groupBy("label", "h", "part").agg(F.min("doc_id").alias("doc_id"))
    first = Window.partitionBy("label").orderBy("part", "h")
    picked = each.withColumn("n", F.row_number().over(first)).where(F.col("n") <= by_label(lambda k, n: most[k])).select("doc_id", "h", "label", "part")
    texts = docs.select("doc_id", key.alias("h"), window_of(text_of(), window, seed).alias("text"))
    found = texts.join(F.broadcast(picked), ["doc_id", "h"]).groupBy("label", "text").agg(F.first("part").alias("part")).collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["part"], r["text"], str(r["label"])))], counts


class Logistic:
    """Standardised features, their squares, and a logistic regression with a weight for each row.

    least: scales that features have at least, so that one that hardly differs in the sample (the length, where all
    texts are long) can't decide what lies far from it.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, squares: bool, least: list[float], penalty: float = 1e-3, steps: int = 4000, rate: float = 0.3) -> None:
        self.squares, self.mean, self.scale = squares, x.mean(0), np.maximum(x.std(0), least) + 1e-9
        a, weight = self.basis(x), weight / weight.sum()
        w = np.zeros(a.shape[1])
        free = np.ones_like(w)
        free[0] = 0
        speed = np.zeros_like(w)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            speed = 0.8 * speed - rate * 0.2 * (a.T @ ((p - y) * weight) + penalty * free * w)
            w += speed
        self.w = w

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, *([z * z / 4] if self.squares else [])], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.basis(x) @ self.w, -30, 30)))
