"""An author's own history: a profile of each feature, and how far a document is from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TOKENS, MIN_DOCS, LEAST_SD, SHIFT, DECLARED = 150, 2, 0.25, 2.0, 3
WEIGHT, STANDING = 0.35, 0.25


def normalised(rows: DataFrame, history: str = "history") -> DataFrame:
    """A row for each earlier text of a row (place, prior_text); those that are null or blank go."""
    every = rows.select("*", F.posexplode(F.col(history)).alias("place", "prior"))
    text = F.col("prior.text") if "struct" in rows.schema[history].dataType.simpleString() else F.col("prior")
    return every.withColumn("prior_text", text).where(F.trim("prior_text") != "").drop("prior")


def profiles(rows: DataFrame, key: str, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """author, feature, mean, sd, docs of features that two long enough documents have. rows: author, key, n_tokens, feature, z."""
    p = rows.where((F.col("n_tokens") >= min_tokens) & F.col("z").isNotNull()).groupBy("author", "feature")
    return p.agg(F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"), F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS)


def compared(rows: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """key, features, shifted, declared: features compared, those more than two spreads away, and whether three are."""
    met = rows.join(profile.withColumnRenamed("author", "_a"), [F.col("author").eqNullSafe(F.col("_a")), rows["feature"] == profile["feature"]])
    far = F.abs((F.col("z") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(LEAST_SD))) > SHIFT
    return met.groupBy(key).agg(F.count("*").alias("features"), F.count_if(far).alias("shifted")).withColumn("declared", F.col("shifted") >= DECLARED)


def mismatch(profile: Column, version: int, cell: Column, weights_id: str) -> Column:
    """Why a stored profile doesn't belong to a row, else null."""
    return F.when(profile["version"] != version, "version").when(profile["cell"] != cell, "cell").when(profile["weightsId"] != weights_id, "weightsId")


def consistency_signal(scored: DataFrame, compared_rows: DataFrame, key: str) -> DataFrame:
    """Rows that get a signal for being like their author: compared, not shifted, past the gates and with evidence of their own."""
    met = scored.join(compared_rows.where(~F.col("declared")), key).where(F.col("gate").isNull() & (F.greatest("llm_channel", "human_channel") >= STANDING))
    return met.select(key, F.lit("history_consistency").alias("feature"), F.lit("human").alias("direction"), F.lit(WEIGHT).alias("w"), F.lit(1.0).alias("z"), F.lit(-WEIGHT).alias("raw"))
