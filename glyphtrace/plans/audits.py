"""Queries that look over a corpus before it is used: notes, strata, pages, manifests, pairs, labels, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import text as T
from ..operators import documents as D
from ..operators import evaluation as E
from ..sources import batch as B
from .common import table
from .corpus import SCORES, _fnv, scores
from .text import _language_sql, _some, _sql_words

PAGES, PAGE = 10, 7


def display_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report shows beside a document: typographic quotes, digits of other scripts, words of another language."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw")).withColumn("nfc", T.nfc(F.col("raw")))
    d = T.barrier(d.withColumn("lower", T.lower_words(F.col("nfc"))))
    d = L.identify(d).withColumn("n_tokens", F.size("lower"))
    return D.notes(d).select("doc_id", F.array_join("display_notes", ",").alias("notes"))


DISPLAY_NOTES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, list_transform({_sql_words("nfc_normalize(coalesce(text, ''))")}, lambda x: lower(x)) AS w FROM documents),
v AS ({_language_sql()}),
h AS (SELECT d.*, CASE language WHEN 'en' THEN len(list_filter(w, lambda x: list_contains({_some(L.TR_STOP)}, x))) WHEN 'tr' THEN len(list_filter(w, lambda x: list_contains({_some(L.EN_STOP)}, x))) ELSE 0 END AS other FROM d JOIN v USING (doc_id))
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(raw, '[\x{{201C}}\x{{201D}}\x{{2018}}\x{{2019}}]') THEN 'typographic_quotes' END,
  CASE WHEN regexp_matches(raw, '[\x{{0660}}-\x{{0669}}\x{{06F0}}-\x{{06F9}}]') THEN 'other_digits' END,
  CASE WHEN other >= 3 AND other / greatest(len(w), 1) >= 0.10 THEN 'code_switching' END) AS notes FROM h"""


def strata_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strata of conversations' turns, all taken as chat."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("raw"), F.lit("chat").alias("shape"))
    c = c.withColumns({"n_tokens": F.regexp_count(T.nfc(F.col("raw")), F.lit(T.WORD)), "lines_with_words": T.lines_with_words(F.col("raw"))})
    return D.strata(T.barrier(c)).select("conv_id", "turn", F.array_join("strata", ",").alias("strata"))


STRATA_MARKS = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS raw, len({_sql_words("nfc_normalize(coalesce(text, ''))")}) AS n,
             list_filter(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: regexp_matches(x, '[\p{{L}}\p{{M}}]')) AS l FROM conversations)
SELECT conv_id, turn, concat_ws(',',
  CASE WHEN n >= 30 AND len(l) >= 2 AND len(list_filter(l, lambda x: regexp_matches(x, '{T.TERMINALS.replace("'", "''")}\s*$'))) / len(l) > 0.9 THEN 'formal_register' END,
  CASE WHEN regexp_matches(raw, '[!?]{{2,}}') OR len(list_filter(range(1, length(raw) - 1), lambda i: raw[i] = raw[i + 1] AND raw[i] = raw[i + 2] AND regexp_matches(raw[i], '\p{{L}}'))) > 0 THEN 'mobile_typed' END) AS strata FROM c"""


def strided_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced pages of documents in the order of their ids."""
    return B.strided(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", PAGES, PAGE)


STRIDED_PAGES = f"""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest({PAGE}, count(*) OVER () // {PAGES}) AS step FROM documents)
WHERE i % step < {PAGE} AND i < step * {PAGES}"""


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.manifest(table(spark, sf_dir, "documents"), "text")


CORPUS_MANIFEST = """
SELECT count(*) AS rows, coalesce(sum(length(text)), 0)::BIGINT AS chars, coalesce(sum(('0x' || substr(md5(coalesce(text, '')), 1, 12))::BIGINT), 0)::VARCHAR AS digest FROM documents"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))


def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pair keys over sources: keys that name several languages, or that one source alone has."""
    return B.pair_problems(_keyed(spark, sf_dir), "key", "lang", "source").select("key", "audits", "sides")


PAIR_AUDIT = """
SELECT md5(coalesce(text, '')) AS key, count(DISTINCT lang) AS audits, count(DISTINCT source) AS sides FROM documents GROUP BY key HAVING count(DISTINCT lang) > 1 OR count(DISTINCT source) < 2"""


def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of toxic texts that are labelled as good ones too: a second field that contradicts the first."""
    return B.inconsistent(table(spark, sf_dir, "labels"), (F.col("toxic") == 0) | (F.col("quality") == 0)).select("doc_id", "toxic", "quality")


LABEL_CHECK = "SELECT doc_id, toxic, quality FROM labels WHERE NOT coalesce(toxic = 0 OR quality = 0, false)"


def cross_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand under more than one source."""
    return E.cross_label(_keyed(spark, sf_dir), "key", "source").select("key", "labels", "rows")


CROSS_SOURCES = "SELECT md5(coalesce(text, '')) AS key, count(DISTINCT source) AS labels, count(*) AS rows FROM documents GROUP BY key HAVING count(DISTINCT source) > 1"


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that people look at first."""
    from ..operators.scoring import triage as first

    s = scores(spark, sf_dir).withColumnRenamed("table_verdict", "verdict")
    return first(s, "doc_id").select("doc_id", "score", "verdict")


TRIAGE = rf"""
SELECT doc_id, score, table_verdict AS verdict FROM ({SCORES})
WHERE table_verdict IN ('uncertain', 'leaning_llm', 'leaning_human') OR (starts_with(table_verdict, 'likely') AND {_fnv("'triage|' || doc_id::VARCHAR")} % 1000 < 100)
ORDER BY round(abs(score - 0.5), 9), doc_id LIMIT 40"""


def paired_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much longer a conversation's assistant turns are than its user's, on average."""
    c = table(spark, sf_dir, "conversations").withColumn("chars", F.char_length(F.coalesce("text", F.lit(""))))
    found = E.paired_delta(c, "conv_id", "role", "chars", "user", "assistant")
    return found.select("conv_id", *(F.round(x, 6).alias(x) for x in ("before", "after", "delta")))


PAIRED_LENGTHS = """
SELECT conv_id, round(a, 6) AS before, round(b, 6) AS after, round(b - a, 6) AS delta FROM (
  SELECT conv_id, avg(length(coalesce(text, ''))) FILTER (role = 'user') AS a, avg(length(coalesce(text, ''))) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id)
WHERE a IS NOT NULL AND b IS NOT NULL"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents score 0.8 or more, with a bound on the rate where none does."""
    return E.flag_rate(scores(spark, sf_dir).withColumnRenamed("score", "p"), 0.8).select("rows", "flagged", F.round("bound", 9).alias("bound"))


FLAGGED = rf"""
SELECT count(score) AS rows, count(*) FILTER (score >= 0.8) AS flagged, round(CASE WHEN count(*) FILTER (score >= 0.8) = 0 THEN 3.0 / nullif(count(score), 0) ELSE count(*) FILTER (score >= 0.8) / nullif(count(score), 0) END, 9) AS bound FROM ({SCORES})"""

QUERIES = {f.__name__: f for f in (display_notes, strata_marks, strided_pages, corpus_manifest, pair_audit, label_check, cross_sources, triage, paired_lengths, flagged)}
ORACLE_SQL = {n: globals()[n.upper()] for n in QUERIES}
