"""The whole pipeline of a document or an author, from text to verdict."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import sized, written
from . import authors, documents, features, history, lexicon, near_duplicate, rules, scoring

#: What rules, near duplicates and scores need of a document's context.
BASE = ("raw", "folded", "markdown", "channel", "shape", "genre", "language", "domain", "cell", "n_tokens", "chars", "nfc", "lexicon_hits", "segmentation_suspect")
#: Authors' texts are dealt over one partition for so many characters, at most so many partitions.
PART_CHARS, MOST_PARTS = 1_000_000, 10_000


def detect(
    rows: DataFrame,
    key: str,
    weights: DataFrame | None = None,
    weights_from: Callable[[DataFrame], DataFrame] | None = None,
    options: dict[str, str] | None = None,
    phrases: DataFrame | None = None,
    index: DataFrame | None = None,
    markers: DataFrame | None = None,
    aggregate: bool = False,
    provenance: str = "prior",
    expires_at: str | None = None,
    now: datetime.datetime | None = None,
    profiles: DataFrame | None = None,
) -> DataFrame:
    """A row for each row of `rows` (key, text, and author for the index) with context, rules, score, verdict.

    weights: the table that scoring.load_weights() makes; weights_from makes one from the long table of features
    instead. index: key, author, text of a corpus in which near duplicates are looked up. phrases: a compiled lexicon.
    profiles: history.profiles() of the rows' authors.
    """
    given = (options or {}) | ({"shape": "prose"} if aggregate else {})
    ctx = documents.context(rows, given)
    by = ["author"] if "author" in ctx.columns and key != "author" else []
    hits = lexicon.without_hits if phrases is None else lambda views: lexicon.with_hits(views, phrases, key)
    # the texts of authors are long: each step is written with what the next ones need, so that few copies of a row are held at once
    cut = written if aggregate else T.barrier
    if aggregate:
        ctx = documents.parts(written(hits(written(ctx.select(key, *by, *documents.VIEWS)))))
    else:
        ctx = hits(ctx)
    # what the texts are read for is written once; rules, near duplicates and scores take it from there
    base = written(features.with_features(ctx).select(key, *by, *BASE, *features.FEATURES))
    found = None
    if index is not None:
        probe = near_duplicate.shingled(base, key, "author" if by else None)
        # rows that are looked up among themselves have their views already, unless an option gave their language
        if index is rows and not {"lang", "preset"} & given.keys() and bool(by) == ("author" in index.columns):
            build = probe
        else:
            views = written(documents.context(index).select(*(c for c in (key, "author") if c in index.columns), "folded"))
            build = near_duplicate.shingled(views, key, "author" if "author" in index.columns else None)
        found = near_duplicate.nearest(probe, build, key)
    wide = cut(rules.with_rules(base, key, found, markers))
    long = features.long_table(base, [key, *by, "cell", "language", "domain"])
    if aggregate:
        long = long.where(~F.col("feature").isin(*scoring.AGGREGATE_DISABLED))
        long = long.unionByName(author_rows(rows, base, key), allowMissingColumns=True)
    weights = weights if weights is not None else weights_from(long)
    contributed = written(scoring.contributions(long, weights))
    b0 = sized(weights.groupBy("cell").agg(F.first("b0").alias("b0")))
    wide = features.evidence(wide)
    docs = wide.join(b0, "cell", "left").select(key, *by, "evidence_spans", "spanless", "segmentation_suspect", "n_tokens", "chars", "shape", "genre", "language", "rules", "rule_notes", "invisible", "b0", F.lit(aggregate).alias("aggregate"))
    scored = scoring.sums(contributed, docs, [key])
    if profiles is not None and by:
        scored = with_history(scored, contributed, docs, profiles, key)
    judged = scoring.verdicts(rules.with_signal_count(scored), provenance, expires_at, now)
    return judged.withColumn("warnings", F.when(F.col("segmentation_suspect"), F.array_append("warnings", F.lit("segmentation_suspect"))).otherwise(F.col("warnings"))).drop("segmentation_suspect")


def with_history(scored: DataFrame, contributed: DataFrame, docs: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """scored again with the signal of a steady author, and history (features, shifted, declared) of rows that have a profile."""
    scored = written(scored.withColumn("gate", scoring.gate(F.col("shape"), F.col("aggregate"))))
    compared = written(history.compared(contributed.select(key, "author", "feature", "z"), profiles, key))
    extra = history.consistency_signal(scored, compared, key).select("*", F.lit("history").alias("feature_group"), F.lit("MED").alias("confidence"))
    again = scoring.sums(contributed.unionByName(extra, allowMissingColumns=True), docs, [key])
    # the gates are those of the document without its history
    again = again.drop("active", "firm").join(scored.select(key, "active", "firm"), key)
    return again.join(compared.select(key, F.struct("features", "shifted", "declared").alias("history")), key, "left")


def author_rows(rows: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """The authors' features as rows of the long table. rows: key (the author) with messages, as detect_authors() makes it."""
    named = {"msg_length_uniformity": ("llm", "continuous", "MED"), "template_repetition": ("llm", "binary", "HIGH"), "cross_msg_style_variance": ("human", "continuous", "MED"), "idiolect_stability": ("human", "rate", "HIGH"), "bare_token_turn_rate": ("human", "continuous", "MED")}
    each = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), F.lit(d).alias("direction"), F.lit("aggregate").alias("feature_group"), F.lit(k).alias("kind"), F.lit(c).alias("confidence")) for n, (d, k, c) in named.items()))
    got = rows.select(key, F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("f")).select(key, "f.*")
    return got.join(wide.select(key, "cell", "language", "domain"), key)


def detect_authors(messages: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """A row for each author (author, message, text) past the floor: their texts joined, scored with the features over messages.

    Authors under the floor have the verdict insufficient_text and the gate aggregate_floor.
    """
    per = written(authors.author_features(messages))
    chars = messages.agg(F.sum(F.char_length("text"))).first()[0] or 0
    # a task, and a file that it writes, has few long texts
    rows = authors.joined(messages).join(per, "author").where("passes_floor").repartition(min(MOST_PARTS, 1 + chars // PART_CHARS), "author")
    scored = detect(rows, "author", aggregate=True, **options)
    refused = per.where(~F.col("passes_floor")).select("author", F.lit("aggregate_floor").alias("gate"), F.lit("insufficient_text").alias("verdict"))
    return scored.unionByName(refused, allowMissingColumns=True)
