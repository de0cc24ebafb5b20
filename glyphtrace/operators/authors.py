"""Features of an author over all of their messages, the floor, and the joined text.

messages: author, message (a number in order within the author), text. A null author is '(unknown)'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import text as T
from ..functions.tables import sized, written
from .features import EMOJI

UNKNOWN = "(unknown)"
MIN_MESSAGES, MIN_LONG, LONG_TOKENS, GRAM = 5, 3, 150, 6
BARE = r"^\s*(?:\p{Nd}[\p{Nd}.,:/-]*|\p{L}{1,12})\s*$"


def prepared(messages: DataFrame) -> DataFrame:
    """messages with tokens and style axes."""
    m = messages.withColumns({"author": F.coalesce(F.col("author").cast("string"), F.lit(UNKNOWN)), "text": F.coalesce("text", F.lit(""))})
    m = T.barrier(m.withColumn("tokens", T.words(T.case_fold(T.nfc(F.col("text"))))))
    lines = F.filter(T.lines(F.col("text")), lambda x: x.rlike(r"\S"))
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return written(m.withColumns({
        "n_chars": F.char_length("text"), "n_tokens": F.size("tokens"),
        "ended": part(F.size(F.filter(lines, lambda x: x.rlike(T.TERMINALS + r"\s*$"))), F.size(lines)),
        "caps": part(F.regexp_count("text", F.lit(r"\p{Lu}")), letters),
        "emoji": F.least(F.lit(1.0), F.regexp_count("text", F.lit(EMOJI)) / 3),
        "elongation": F.least(F.lit(1.0), F.regexp_count("text", F.lit(r"(\p{L})\1{2,}")) / 2),
        "bare": (F.size("tokens") <= 2) | F.trim("text").rlike(BARE),
    }))


def uniformity(m: DataFrame) -> DataFrame:
    """author, messages, msg_length_uniformity, cross_msg_style_variance, bare_token_turn_rate, passes_floor."""
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    length = F.when(F.avg("n_chars") > 0, 1 - F.least(F.lit(1.0), sd("n_chars") / F.avg("n_chars")))
    axes = (sd("ended") + sd("caps") + sd("emoji") + sd("elongation")) / 4
    floor = (F.count("*") >= MIN_MESSAGES) | (F.count_if(F.col("n_tokens") >= LONG_TOKENS) >= MIN_LONG)
    return m.groupBy("author").agg(F.count("*").alias("messages"), length.alias("msg_length_uniformity"), axes.alias("cross_msg_style_variance"), F.avg(F.col("bare").cast("double")).alias("bare_token_turn_rate"), floor.alias("passes_floor"))


def templates(m: DataFrame, gram: int = GRAM, least: int = 3) -> DataFrame:
    """author, template, template_messages: the six-word run in most messages (at least three), ties by the run."""
    grams = m.select("author", "message", F.explode_outer(T.shingles(F.col("tokens"), gram)).alias("gram")).where("gram IS NOT NULL")
    counts = grams.groupBy("author", "gram").agg(F.count_distinct("message").alias("n")).where(F.col("n") >= least)
    best = counts.groupBy("author").agg(F.min(F.struct((-F.col("n")).alias("neg"), "gram")).alias("b"))
    return best.select("author", F.col("b.gram").alias("template"), (-F.col("b.neg")).alias("template_messages"))


def idiolect(m: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """author, idiolect_stability: the longer words that come back in two or more messages, but not in most. phrases: phrase."""
    words = m.select("author", "message", F.explode_outer(F.array_distinct("tokens")).alias("word")).where((F.length("word") >= 5) & ~F.col("word").isin(*L.EN_STOP))
    if phrases is not None:
        words = words.join(sized(phrases.select(F.col("phrase").alias("word")).distinct()), "word", "left_anti")
    counts = words.groupBy("author", "word").agg(F.count_distinct("message").alias("c"))
    most = m.groupBy("author").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * 0.4)).alias("most"))
    return counts.join(most, "author").where((F.col("c") >= 2) & (F.col("c") <= F.col("most"))).groupBy("author").agg(F.count("*").alias("idiolect_stability"))


def author_features(messages: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """A row for each author with the five features; null where one can't be computed."""
    m = prepared(messages)
    found = uniformity(m).join(templates(m), "author", "left").join(idiolect(m, phrases), "author", "left")
    return found.withColumn("template_repetition", F.when(F.col("template").isNotNull(), 1.0))


def joined(messages: DataFrame) -> DataFrame:
    """author, text: the messages in order, with an empty line between."""
    author = F.coalesce(F.col("author").cast("string"), F.lit(UNKNOWN))
    every = messages.groupBy(author.alias("author")).agg(F.array_sort(F.collect_list(F.struct("message", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))
    return every.select("author", F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("text"))


def per_message(scored: DataFrame) -> DataFrame:
    """author, per_message: id, verdict and score of each message, in order. scored: author, message, verdict, score."""
    return scored.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("message", "verdict", "score"))).alias("per_message"))
