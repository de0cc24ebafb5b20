"""Queries over rows of a corpus: near duplicates, authors, history, scores, splits, audits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import written
from ..operators import authors as A
from ..operators import evaluation as E
from ..operators import history as H
from ..operators import near_duplicate as N
from ..operators import scoring as S
from ..operators import splits as P
from ..sources import batch as B
from .common import table
from ..operators import rules as R
from .text import MARKERS, PROSE, PROSE_ROWS, _sql_words, lexicon_by_rule, prose_rows, prose_wide


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other document of each document; the source is the author."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", T.folded(T.nfc(F.coalesce("text", F.lit("")))).alias("folded"))
    s = N.shingled(T.barrier(d), "doc_id", "source")
    return N.nearest(s, s, "doc_id").select("doc_id", "matched_id", F.round("jaccard", 9).alias("jaccard"))


NEAR_DUPLICATES = rf"""
WITH d AS (SELECT doc_id, source, {_sql_words("lower(nfc_normalize(coalesce(text, '')))")} AS w FROM documents),
s AS (SELECT doc_id, source, len(w) AS n, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
e AS (SELECT doc_id, source, n, len(g) AS k, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id, b.doc_id AS matched_id, count(*) / (any_value(a.k) + any_value(b.k) - count(*)) AS jaccard
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND NOT coalesce(a.source = b.source, false) WHERE a.n >= 20 GROUP BY a.doc_id, b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, matched_id::VARCHAR) AS i FROM p WHERE jaccard >= 0.8)
SELECT doc_id, matched_id, round(jaccard, 9) AS jaccard FROM r WHERE i = 1"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as authors' messages: an author is a conversation's role."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("/", F.pmod("conv_id", F.lit(20)).cast("string"), "role").alias("author"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message"), "text")


_MESSAGES = "SELECT concat_ws('/', (conv_id % 20)::VARCHAR, role) AS author, conv_id * 1000 + turn AS message, coalesce(text, '') AS text FROM conversations"


def author_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.author_features(_messages(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("author", "messages", r("msg_length_uniformity"), r("bare_token_turn_rate"), "passes_floor", "template", "template_messages", "idiolect_stability")


AUTHOR_FEATURES = rf"""
WITH m AS (SELECT *, list_transform({_sql_words("nfc_normalize(text)")}, lambda x: lower(x)) AS w FROM ({_MESSAGES})),
u AS (SELECT author, count(*) AS messages, CASE WHEN avg(length(text)) > 0 THEN round(1 - least(1.0, coalesce(stddev_samp(length(text)), 0) / avg(length(text))), 6) END AS msg_length_uniformity,
        round(avg((len(w) <= 2 OR regexp_matches(trim(text), '^\s*(?:\p{{Nd}}[\p{{Nd}}.,:/-]*|\p{{L}}{{1,12}})\s*$'))::INT), 6) AS bare_token_turn_rate,
        count(*) >= 5 OR count(*) FILTER (len(w) >= 150) >= 3 AS passes_floor, greatest(2, ceil(count(*) * 0.4)) AS most FROM m GROUP BY author),
g AS (SELECT author, x AS template, count(DISTINCT message) AS n FROM (SELECT author, message, unnest(list_distinct(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i : i + 5], ' ')))) AS x FROM m WHERE len(w) >= 6) GROUP BY ALL HAVING n >= 3),
t AS (SELECT author, template, n AS template_messages FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, template) AS i FROM g) WHERE i = 1),
k AS (SELECT author, x, count(*) AS c FROM (SELECT author, unnest(list_distinct(w)) AS x FROM m)
      WHERE length(x) >= 5 AND x NOT IN ('about', 'could', 'would', 'very', 'more', 'most') GROUP BY ALL),
i AS (SELECT k.author, count(*) AS idiolect_stability FROM k JOIN u USING (author) WHERE c >= 2 AND c <= most GROUP BY k.author)
SELECT author, messages, msg_length_uniformity, bare_token_turn_rate, passes_floor, template, template_messages, idiolect_stability
FROM u LEFT JOIN t USING (author) LEFT JOIN i USING (author)"""


def author_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.joined(_messages(spark, sf_dir)).select("author", F.char_length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


AUTHOR_TEXTS = rf"SELECT author, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT author, string_agg(text, chr(10) || chr(10) ORDER BY message, text) AS t FROM ({_MESSAGES}) GROUP BY author)"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's features of documents that SQL can give too; their values are written once, a row for each document."""
    return prose_rows(written(prose_wide(spark, sf_dir)))


_SQL_LONG = f"SELECT r.*, c.feature_group, c.direction, c.kind, c.confidence FROM ({PROSE_ROWS}) r JOIN (VALUES {', '.join(str((n, *about)) for n, about in PROSE.items())}) AS c(feature, feature_group, direction, kind, confidence) USING (feature)"
_words_n = f"len({_sql_words('raw')})"


def history_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = H.profiles(_long(spark, sf_dir).withColumnRenamed("source", "author").withColumn("z", F.log1p("value")), "doc_id")
    return p.select("author", "feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "docs")


HISTORY_PROFILES = rf"""
SELECT source AS author, feature, round(avg(ln(1 + value)), 6) AS mean, round(stddev_samp(ln(1 + value)), 6) AS sd, count(*) AS docs
FROM ({_SQL_LONG}) WHERE n_tokens >= 150 GROUP BY source, feature HAVING count(*) >= 2"""


def history_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(spark, sf_dir).withColumnRenamed("source", "author").withColumn("z", F.log1p("value"))
    p = H.profiles(rows, "doc_id")
    return H.compared(rows.select("doc_id", "author", "feature", "z"), p, "doc_id").select("doc_id", "features", "shifted", "declared")


HISTORY_SHIFTS = rf"""
WITH l AS (SELECT *, ln(1 + value) AS z FROM ({_SQL_LONG})),
p AS (SELECT source, feature, avg(z) AS mean, stddev_samp(z) AS sd FROM l WHERE n_tokens >= 150 GROUP BY ALL HAVING count(*) >= 2)
SELECT doc_id, count(*) AS features, count(*) FILTER (abs((z - mean) / greatest(sd, 0.25)) > 2) AS shifted, count(*) FILTER (abs((z - mean) / greatest(sd, 0.25)) > 2) >= 3 AS declared
FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source AND l.feature = p.feature GROUP BY doc_id"""


def _weights(rows: DataFrame) -> DataFrame:
    """Weights by rule: every feature weighs 0.4, standardised by its own mean and spread over the table."""
    v = rows.withColumn("value", F.when(F.col("kind") == "rate", F.log1p("value")).otherwise(F.col("value")))
    kind = v.groupBy("feature").agg(F.first("kind").alias("kind"))
    return E.standardised(v, F.lit(True)).join(kind, "feature").select(F.lit("en:prose").alias("cell"), "feature", F.lit(0.4).alias("w"), "mu", "sigma", "kind", F.lit(-0.4).alias("b0"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit, capped score and channels of documents, from features of the catalogue and weights by rule."""
    wide = written(prose_wide(spark, sf_dir))
    rows = prose_rows(wide).withColumn("cell", F.lit("en:prose"))
    docs = wide.select("doc_id", "n_tokens", F.lit(-0.4).alias("b0"))
    s = S.sums(S.contributions(rows, _weights(rows)).drop("n_tokens"), docs, ["doc_id"])
    s = s.withColumn("table_verdict", S.table_verdict(F.round("llm_channel", 6), F.round("human_channel", 6)))
    return s.select("doc_id", F.round("logit", 6).alias("logit"), F.round("score", 6).alias("score"), F.round("llm_channel", 6).alias("llm_channel"), F.round("human_channel", 6).alias("human_channel"), "band", "table_verdict")


SCORES = rf"""
WITH l AS (SELECT *, CASE WHEN kind = 'rate' THEN ln(1 + value) ELSE value END AS v FROM ({_SQL_LONG})),
w AS (SELECT feature, avg(v) AS mu, CASE WHEN stddev_samp(v) > 1e-9 THEN stddev_samp(v) ELSE 1 END AS sigma FROM l GROUP BY feature),
z AS (SELECT l.*, CASE WHEN kind = 'binary' THEN (value <> 0)::INT ELSE greatest(-3.0, least(3.0, (v - mu) / sigma)) END AS z FROM l JOIN w USING (feature)),
t AS (SELECT doc_id, sum(CASE direction WHEN 'llm' THEN 1 ELSE -1 END * 0.4 * z) AS raw,
        sum(CASE WHEN direction = 'llm' THEN greatest(0, 0.4 * z) ELSE 0 END) AS a, sum(CASE WHEN direction = 'human' THEN greatest(0, 0.4 * z) ELSE 0 END) AS b FROM z GROUP BY doc_id),
s AS (SELECT d.doc_id, len({_sql_words("nfc_normalize(coalesce(text, ''))")}) AS n, -0.4 + coalesce(raw, 0) AS logit, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM documents d LEFT JOIN t USING (doc_id)),
c AS (SELECT *, CASE WHEN n <= 19 THEN '<20_tokens' WHEN n <= 49 THEN '20-49_tokens' WHEN n <= 149 THEN '50-149_tokens' WHEN n <= 499 THEN '150-499_tokens' ELSE '500+_tokens' END AS band,
        CASE WHEN n <= 19 THEN NULL WHEN n <= 49 THEN 0.15 WHEN n <= 149 THEN 0.30 WHEN n <= 499 THEN 0.45 END::DOUBLE AS cap FROM s),
f AS (SELECT *, CASE WHEN cap IS NULL OR abs(logit) <= ln((0.5 + cap) / (0.5 - cap)) THEN 1.0 ELSE ln((0.5 + cap) / (0.5 - cap)) / abs(logit) END AS factor,
        round(1 - exp(-a / 2.0), 6) AS llm, round(1 - exp(-b / 2.0), 6) AS human FROM c)
SELECT doc_id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit * factor)), 6) AS score, llm AS llm_channel, human AS human_channel, band,
  CASE WHEN llm > 0.6 THEN CASE WHEN human < 0.25 THEN 'leaning_llm' ELSE 'uncertain' END
       WHEN llm >= 0.25 THEN CASE WHEN human < 0.25 THEN 'leaning_llm' WHEN human > 0.6 THEN 'leaning_human' ELSE 'uncertain' END
       ELSE CASE WHEN human >= 0.25 THEN 'leaning_human' ELSE 'insufficient_text' END END AS table_verdict
FROM f"""


def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline on conversations' turns: context, features, rules with near duplicates, score, verdict."""
    from ..operators.detect import detect as run

    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("author"), "text")
    out = run(c, "id", weights_from=_rule_weights, index=c, phrases=lexicon_by_rule(spark, sf_dir), markers=R.check_markers(MARKERS, spark))
    return out.select("id", "shape", "language", F.round("score", 6).alias("score"), "verdict", "label", F.array_join("warnings", ",").alias("warnings"), F.size("rules").alias("n_rules"), F.size("evidence_spans").alias("n_spans"))


def _rule_weights(rows: DataFrame) -> DataFrame:
    v = rows.withColumn("value", F.when(F.col("kind") == "rate", F.log1p("value")).otherwise(F.col("value")))
    w = E.standardised(v, F.lit(True))
    return w.join(rows.select("feature", "kind", "cell").distinct(), "feature").select("cell", "feature", F.lit(0.4).alias("w"), "mu", "sigma", "kind", F.lit(-0.4).alias("b0"))


def corpus_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    by_time = E.side_by_time(d, "source", "n_chars", "doc_id").select("doc_id", F.col("side").alias("time_side"))
    d = d.select("doc_id", E.side_of_group(F.col("source")).alias("group_side"), E.side_of_shard(F.col("doc_id")).alias("shard_side"))
    return d.join(by_time, "doc_id")


def _fnv(x: str) -> str:
    return f"list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)"


CORPUS_SPLITS = rf"""
SELECT doc_id, CASE WHEN g < 0.6 THEN 'fit' WHEN g < 0.8 THEN 'val' ELSE 'test' END AS group_side, CASE WHEN s < 12 THEN 'fit' WHEN s < 16 THEN 'val' ELSE 'test' END AS shard_side,
  CASE WHEN i <= floor(n * 0.6) THEN 'fit' WHEN i <= floor(n * 0.6) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS time_side
FROM (SELECT doc_id, {_fnv("'split|' || source")} / 4294967295 AS g, {_fnv("'shard|' || doc_id::VARCHAR")} % 20 AS s,
        count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents)"""


def normal_key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of documents that stand more than once, with their first document and their languages."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(E.norm_key(F.coalesce("text", F.lit(""))).cast("binary")).alias("key_md5"))
    first = E.first_of_key(d.select("doc_id", "key_md5"), "key_md5", "doc_id").where("repeats > 1").withColumnsRenamed({"doc_id": "first_id", "repeats": "rows"})
    return first.join(d.groupBy("key_md5").agg(F.count_distinct("lang").alias("languages")), "key_md5").select("key_md5", "rows", "languages", "first_id")


def _sql_key(x: str) -> str:
    return f"trim(regexp_replace(lower(translate(lower(translate({x}, 'Iİ', 'ıi')), '{E.TURKISH_FROM}', '{E.TURKISH_TO}')), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"


#: Texts in the compatibility form are the same as in the composed one in this table.
NORMAL_KEY_DUPLICATES = f"SELECT md5(key) AS key_md5, count(*) AS rows, count(DISTINCT lang) AS languages, min(doc_id) AS first_id FROM (SELECT *, {_sql_key(chr(110) + 'fc_normalize(coalesce(text, repeat(chr(32), 0)))')} AS key FROM documents) GROUP BY key HAVING count(*) > 1"


def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each benchmark item's words any one document has."""
    tokens = lambda t, i: t.select(F.col(i).alias("id"), F.array_distinct(F.transform(T.words(F.coalesce("text", F.lit(""))), F.lower)).alias("tokens"))
    b, d = tokens(table(spark, sf_dir, "benchmark"), "item_id"), tokens(table(spark, sf_dir, "documents"), "doc_id")
    found = E.contamination(b, d)
    return found.select("id", F.round("overlap", 9).alias("overlap"), F.when(F.col("overlap") >= 0.9, "0.9").when(F.col("overlap") >= 0.7, "0.7").when(F.col("overlap") >= 0.5, "0.5").otherwise("-").alias("overlap_band"))


CONTAMINATED = rf"""
WITH b AS (SELECT item_id AS id, list_distinct(list_transform({_sql_words("coalesce(text, '')")}, lambda x: lower(x))) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_transform({_sql_words("coalesce(text, '')")}, lambda x: lower(x))) AS w FROM documents),
eb AS (SELECT id, len(w) AS n, unnest(w) AS x FROM b), ed AS (SELECT doc_id, len(w) AS m, unnest(w) AS x FROM d),
j AS (SELECT id, doc_id, count(*) / (any_value(n) + any_value(m) - count(*)) AS o FROM eb JOIN ed USING (x) GROUP BY ALL),
k AS (SELECT id, max(o) AS overlap FROM j GROUP BY id)
SELECT b.id, round(coalesce(overlap, 0), 9) AS overlap, CASE WHEN overlap >= 0.9 THEN '0.9' WHEN overlap >= 0.7 THEN '0.7' WHEN overlap >= 0.5 THEN '0.5' ELSE '-' END AS overlap_band FROM b LEFT JOIN k USING (id)"""


def source_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("side", E.side_of_shard(F.col("doc_id")))
    return E.tally(d, "source", "side", ("fit", "val", "test"))


SOURCE_CROSSTAB = rf"""
SELECT source, count(*) FILTER (s < 12) AS fit, count(*) FILTER (s >= 12 AND s < 16) AS val, count(*) FILTER (s >= 16) AS test
FROM (SELECT source, {_fnv("'shard|' || doc_id::VARCHAR")} % 20 AS s FROM documents) GROUP BY source"""


def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.standardised(_long(spark, sf_dir), F.col("n_tokens") >= 50)
    return s.select("feature", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


FEATURE_STATISTICS = rf"SELECT feature, round(avg(value), 6) AS mu, round(CASE WHEN stddev_samp(value) > 1e-9 THEN stddev_samp(value) ELSE 1 END, 6) AS sigma FROM ({_SQL_LONG}) WHERE n_tokens >= 50 GROUP BY feature"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a p from the share of exclamation marks and capital words, gated under 20 words."""
    d = table(spark, sf_dir, "documents").withColumn("raw", F.coalesce("text", F.lit("")))
    n = F.regexp_count("raw", F.lit(T.WORD))
    odd = F.regexp_count("raw", F.lit(r"[!*#$%&|]"))
    p = F.when(n >= 20, F.round(odd / (odd + n), 4))
    rows = d.select("doc_id", "source", "lang", p.alias("p"), T.length_bucket(n).alias("bucket"))
    return rows.join(table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", (1 - F.col("quality")).alias("y")), "doc_id")


_JUDGED = rf"""
SELECT d.*, 1 - quality AS y FROM (
  SELECT doc_id, source, lang, CASE WHEN n >= 20 THEN round(odd / (odd + n), 4) END AS p,
    CASE WHEN n < 20 THEN '<20' WHEN n < 50 THEN '20-49' WHEN n < 150 THEN '50-149' WHEN n < 500 THEN '150-499' ELSE '500+' END AS bucket
  FROM (SELECT *, len({_sql_words("coalesce(text, '')")}) AS n, len(regexp_extract_all(coalesce(text, ''), '[!*#$%&|]')) AS odd FROM documents)) d JOIN labels USING (doc_id) WHERE quality IS NOT NULL"""


def auc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = E.auc(_judged(spark, sf_dir).where("p IS NOT NULL"), ["lang"])
    return a.select("lang", F.round("auc", 6).alias("auc"), "positives", "negatives")


AUC_BY_LANGUAGE = rf"""
WITH j AS (SELECT * FROM ({_JUDGED}) WHERE p IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS k FROM j)
SELECT lang, round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auc,
  count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM r GROUP BY lang"""


def calibration_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_error(_judged(spark, sf_dir).where("p IS NOT NULL"), ["lang"]).select("lang", F.round("ece", 6).alias("ece"))


CALIBRATION_BY_LANGUAGE = rf"""
SELECT lang, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM (
  SELECT lang, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM ({_JUDGED}) WHERE p IS NOT NULL GROUP BY ALL) GROUP BY lang"""


def confusion_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.confusion(_judged(spark, sf_dir), ["bucket"], 0.3)
    r = lambda n: F.round(n, 6).alias(n)
    return c.select("bucket", "tp", "fp", "pos", "neg", r("fpr"), r("tpr"), r("precision"))


CONFUSION_BY_BUCKET = rf"""
SELECT bucket, tp, fp, pos, neg, round(fp / nullif(neg, 0), 6) AS fpr, round(tp / nullif(pos, 0), 6) AS tpr, round(tp / nullif(tp + fp, 0), 6) AS precision
FROM (SELECT bucket, count(*) FILTER (p >= 0.3 AND y = 1) AS tp, count(*) FILTER (p >= 0.3 AND y = 0) AS fp, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM ({_JUDGED}) GROUP BY bucket)"""


def fair_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fair_threshold(_judged(spark, sf_dir).withColumn("stratum", F.col("lang")))


FAIR_THRESHOLD = rf"""
WITH j AS (SELECT * FROM ({_JUDGED}) WHERE p IS NOT NULL),
n AS (SELECT lang, count(*) AS n FROM j WHERE y = 0 GROUP BY lang HAVING count(*) >= 20),
c AS (SELECT DISTINCT p AS tau FROM j),
r AS (SELECT tau, max(k / n) AS worst FROM (SELECT c.tau, n.lang, n.n, count(j.p) AS k FROM c CROSS JOIN n LEFT JOIN j ON j.lang = n.lang AND j.y = 0 AND j.p >= c.tau GROUP BY ALL) GROUP BY tau)
SELECT coalesce(min(tau) FILTER (worst <= 0.02), 'infinity'::DOUBLE) AS tau FROM r"""


def stratum_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumn("strata", F.array("lang", "bucket"))
    return E.stratum_rates(rows, 0.3).select("stratum", "neg", "fp", F.round("fpr", 6).alias("fpr"))


STRATUM_RATES = rf"""
SELECT stratum, count(*) FILTER (y = 0) AS neg, count(*) FILTER (p >= 0.3 AND y = 0) AS fp, round(count(*) FILTER (p >= 0.3 AND y = 0) / nullif(count(*) FILTER (y = 0), 0), 6) AS fpr
FROM (SELECT p, y, unnest(['ALL', lang, bucket]) AS stratum FROM ({_JUDGED})) GROUP BY stratum"""


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.headline(_judged(spark, sf_dir), ["lang", "bucket"])


HEADLINES = rf"""
SELECT *, CASE WHEN least(machine, human) < 100 THEN 'INSUFFICIENT' WHEN scored < 40 THEN 'NO COVERAGE' ELSE 'OK' END AS status
FROM (SELECT lang, bucket, count(*) FILTER (y = 1) AS machine, count(*) FILTER (y = 0) AS human, count(p) AS scored FROM ({_JUDGED}) GROUP BY ALL)"""


def prior_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.confusion(_judged(spark, sf_dir).withColumn("every", F.lit(1)), ["every"], 0.3)
    return E.precision_at_priors(c).select("prior", F.round("precision_at_prior", 6).alias("precision_at_prior"))


PRIOR_PRECISION = rf"""
WITH c AS (SELECT count(*) FILTER (p >= 0.3 AND y = 1) / count(*) FILTER (y = 1) AS tpr, count(*) FILTER (p >= 0.3 AND y = 0) / count(*) FILTER (y = 0) AS f, count(*) FILTER (y = 0) AS neg FROM ({_JUDGED})),
r AS (SELECT tpr, CASE WHEN f = 0 THEN 3.0 / neg ELSE f END AS fpr, unnest([0.01, 0.05, 0.10, 0.20, 0.35, 0.50])::DOUBLE AS prior FROM c)
SELECT prior, round(prior * tpr / (prior * tpr + (1 - prior) * fpr), 6) AS precision_at_prior FROM r"""


def fitted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model of standardised features, fitted on the fit side, with isotonic calibration fitted on the validation side."""
    value = F.when(F.col("kind") == "rate", F.log1p("value")).otherwise(F.col("value"))
    wide = _long(spark, sf_dir).withColumn("value", value).groupBy("doc_id").pivot("feature", list(PROSE)).agg(F.first("value"))
    rows = written(_judged(spark, sf_dir).select("doc_id", "y").join(wide, "doc_id", "left").withColumn("side", E.side_of_shard(F.col("doc_id"))))
    scored = E.fitted(rows, list(PROSE), F.col("side") == "fit")
    return E.calibrated(scored, F.col("side") == "val").select("doc_id", "side", "p", "calibrated")


def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("fit").alias("side"), F.coalesce("text", F.lit("")).alias("text"))
    return E.corpus_hash(d, "doc_id", "side", "text").select("corpus_hash")


CORPUS_DIGEST = r"""
WITH p AS (SELECT substr(md5(doc_id::VARCHAR), 1, 5) AS part, sha256(string_agg(doc_id || '|fit|' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id || '|fit|' || sha256(coalesce(text, '')))) AS h FROM documents GROUP BY part),
q AS (SELECT substr(part, 1, 2) AS part2, sha256(string_agg(part || ':' || h, chr(10) ORDER BY part || ':' || h)) AS h FROM p GROUP BY part2)
SELECT sha256(string_agg(part2 || ':' || h, chr(10) ORDER BY part2 || ':' || h)) AS corpus_hash FROM q"""


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each source and language (a report of examples)."""
    return E.head_by(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], 3)


HEADS = "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i FROM documents) WHERE i <= 3"


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents by hash (the sampling operator)."""
    return E.sampled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "sample", 50)


SAMPLE = rf"SELECT doc_id FROM documents ORDER BY {_fnv("'sample|' || doc_id::VARCHAR")}, doc_id LIMIT 50"


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return B.intake(d, "source", "lang", "doc_id").select("doc_id", F.char_length("text").cast("long").alias("chars"))


INTAKE = rf"""
WITH t AS (SELECT doc_id, source, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS t FROM documents)
SELECT min(doc_id) AS doc_id, arg_min(length(t)::BIGINT, doc_id) AS chars FROM (SELECT *, {_sql_key("nfc_normalize(t)")} AS key FROM t WHERE length(t) >= 20) GROUP BY source, key"""


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", B.pseudonym(F.col("source"), "salt").alias("author"), F.md5(B.without_numbers(F.coalesce("text", F.lit(""))).cast("binary")).alias("text_md5"))


PSEUDONYMS = r"SELECT doc_id, 'p' || substr(sha256('salt ' || source), 1, 12) AS author, md5(regexp_replace(coalesce(text, ''), '\d{10,15}', '[NUM]', 'g')) AS text_md5 FROM documents"


def side_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a split by shards leaves on more than one side."""
    d = table(spark, sf_dir, "documents").withColumn("side", E.side_of_shard(F.col("doc_id")))
    return E.straddling(d, "source")


SIDE_AUDIT = rf"SELECT source, count(DISTINCT CASE WHEN s < 12 THEN 0 WHEN s < 16 THEN 1 ELSE 2 END) AS sides FROM (SELECT source, {_fnv("'shard|' || doc_id::VARCHAR")} % 20 AS s FROM documents) GROUP BY source HAVING sides > 1"

def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations without names and numbers."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return E.scrubbed(c, "id")


_SCRUB_UNITS = r"\[(?:REF|NUM)\]|\p{L}+|[^\p{L}\[]+|\["
SCRUBBED = rf"""
WITH c AS (SELECT conv_id || '-' || turn AS id, regexp_replace(regexp_replace(coalesce(text, ''), '{E.REFERENCE}', '[REF]', 'g'), '{E.LONG_NUMBER}', '[NUM]', 'g') AS t FROM conversations),
w AS (SELECT DISTINCT id, unnest(list_transform(regexp_extract_all(regexp_replace(t, '\[(?:REF|NUM)\]', ' ', 'g'), '\p{{L}}+'), lambda u: {_sql_key("u")})) AS word FROM c),
known AS (SELECT word FROM w GROUP BY word HAVING count(DISTINCT id) >= 15),
hidden AS (SELECT id, list(word) AS words FROM w WHERE word NOT IN ({", ".join(f"'{x}'" for x in ("", *E.ALLOWED, *E.SCRUB_STOP))}) AND word NOT IN (SELECT word FROM known) GROUP BY id),
l AS (SELECT c.id, coalesce(words, []) AS words, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM c LEFT JOIN hidden ON c.id = hidden.id),
h AS (SELECT *, regexp_extract(line, '(?i)^(.*?{E.NAME_CUE})', 1) AS head FROM l),
s AS (SELECT id, i, array_to_string(list_transform(regexp_extract_all(CASE WHEN head = '' THEN line ELSE head END, '{_SCRUB_UNITS}'), lambda u: CASE WHEN regexp_matches(u, '^\p{{L}}') AND list_contains(words, {_sql_key("u")}) THEN '[NAME]' ELSE u END), '') AS a,
        CASE WHEN head = '' THEN '' ELSE array_to_string(list_transform(regexp_extract_all(substr(line, length(head) + 1), '{_SCRUB_UNITS}'), lambda u: CASE WHEN regexp_matches(u, '^\p{{L}}') THEN '[NAME]' ELSE u END), '') END AS b FROM h)
SELECT id, string_agg(a || b, chr(10) ORDER BY i) AS text FROM s GROUP BY id"""


def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns of each role are out of a corpus' scope, and why; assistants stand for the machine side."""
    label = F.when(F.col("role") == "user", "REAL").when(F.col("role") == "assistant", "SYNTH").otherwise("OTHER")
    rows = table(spark, sf_dir, "conversations").select("role", label.alias("label"), "text", F.lit(None).cast("string").alias("lang"))
    return E.in_scope(rows).groupBy("role", "excluded").agg(F.count("*").alias("rows"))


SCOPE_COUNTS = r"""
SELECT role, CASE WHEN role NOT IN ('user', 'assistant') OR role IS NULL THEN 'label' WHEN trim(coalesce(text, '')) = '' THEN 'blank'
  WHEN len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) / greatest(len(regexp_extract_all(text, '\p{L}')), 1) >= 0.2 THEN 'script' END AS excluded, count(*) AS rows FROM conversations GROUP BY ALL"""


def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation as the pair key of its turns, dropped where a role has one turn only in it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("conv_id").alias("pair"))
    return E.paired(c, "pair", "role")


PAIR_KEYS = "SELECT conv_id, turn, role, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) >= 2 THEN conv_id END AS pair FROM conversations"


def combined_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the channels met with that of a judge who goes by the capped score alone."""
    s = scores(spark, sf_dir)
    judge = F.when(F.col("band") == "<20_tokens", "insufficient_text").when(F.col("score") >= 0.8, "likely_llm").when(F.col("score") >= 0.6, "leaning_llm").when(F.col("score") > 0.4, "uncertain").when(F.col("score") > 0.2, "leaning_human").otherwise("likely_human")
    return s.select("doc_id", judge.alias("judge"), S.combined(F.col("table_verdict"), judge).alias("c")).select("doc_id", "judge", "c.verdict", "c.conflict")


COMBINED_VERDICTS = rf"""
WITH s AS (SELECT *, CASE WHEN band = '<20_tokens' THEN 'insufficient_text' WHEN score >= 0.8 THEN 'likely_llm' WHEN score >= 0.6 THEN 'leaning_llm' WHEN score > 0.4 THEN 'uncertain' WHEN score > 0.2 THEN 'leaning_human' ELSE 'likely_human' END AS judge FROM ({SCORES}))
SELECT doc_id, judge, CASE table_verdict
    WHEN 'leaning_llm' THEN CASE WHEN judge IN ('likely_llm', 'leaning_llm') THEN 'leaning_llm' ELSE 'uncertain' END
    WHEN 'uncertain' THEN CASE judge WHEN 'likely_llm' THEN 'leaning_llm' WHEN 'likely_human' THEN 'leaning_human' ELSE 'uncertain' END
    WHEN 'leaning_human' THEN CASE WHEN judge IN ('leaning_human', 'likely_human') THEN 'leaning_human' ELSE 'uncertain' END
    ELSE 'insufficient_text' END AS verdict,
  (table_verdict = 'leaning_llm' AND judge IN ('leaning_human', 'likely_human')) OR (table_verdict = 'leaning_human' AND judge = 'likely_llm') AS conflict FROM s"""


def author_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors judged over all of their messages: joined texts with the features over messages, refused under the floor."""
    from ..operators.detect import detect_authors

    out = detect_authors(_messages(spark, sf_dir), weights_from=_rule_weights, phrases=lexicon_by_rule(spark, sf_dir), markers=R.check_markers(MARKERS, spark))
    return out.select("author", "gate", F.round("score", 6).alias("score"), "verdict", "label")


def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), E.side_of_shard(F.col("doc_id")).alias("side"))
    return E.split_leaks(d, "key", "side", "source")


SPLIT_LEAKS = rf"""
WITH d AS (SELECT source, md5(coalesce(text, '')) AS key, CASE WHEN s < 12 THEN 0 WHEN s < 16 THEN 1 ELSE 2 END AS side FROM (SELECT *, {_fnv("'shard|' || doc_id::VARCHAR")} % 20 AS s FROM documents))
SELECT 'key' AS kind, count(*) AS n FROM (SELECT key FROM d GROUP BY key HAVING count(DISTINCT side) > 1)
UNION ALL SELECT 'group', count(*) FROM (SELECT source FROM d GROUP BY source HAVING count(DISTINCT side) > 1)"""



def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a split: five ids in a row are a group (a writer), the normal key of the text the key; every 97th id stands in an earlier split as test."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_chars"), E.norm_key(F.coalesce("text", F.lit(""))).alias("_key"))
    rows = T.barrier(d).select("doc_id", F.concat(F.lit("w"), F.floor(F.col("doc_id") / 5).cast("string")).alias("group"), F.when(F.col("_key") != "", F.md5(F.col("_key").cast("binary"))).alias("key"), F.when(F.col("doc_id") % 97 == 0, "test").alias("recorded"), T.length_bucket(F.col("n_chars")).alias("bucket"), "n_chars")
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    return rows.join(labels, "doc_id", "left")


_SPLIT_ROWS = f"""SELECT d.doc_id, 'w' || (d.doc_id // 5) AS grp, CASE WHEN k <> '' THEN md5(k) END AS key, d.doc_id % 97 = 0 AS recorded, label
  FROM (SELECT doc_id, {_sql_key("nfc_normalize(coalesce(text, repeat(chr(32), 0)))")} AS k FROM documents) d LEFT JOIN (SELECT doc_id, min(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l USING (doc_id)"""


def component_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side of every group, by components of groups and text keys."""
    return P.leak_free_sides(_split_rows(spark, sf_dir))


def _side_sql(x: str) -> str:
    return f"CASE WHEN {_fnv(x)} / 4294967295 < 0.6 THEN 'fit' WHEN {_fnv(x)} / 4294967295 < 0.8 THEN 'val' ELSE 'test' END"


COMPONENT_SIDES = rf"""
WITH RECURSIVE d AS ({_SPLIT_ROWS}), e AS (SELECT DISTINCT grp, key FROM d WHERE key IS NOT NULL), n AS (SELECT DISTINCT a.grp AS a, b.grp AS b FROM e a JOIN e b USING (key)),
reach(a, b) AS (SELECT DISTINCT grp, grp FROM d UNION SELECT r.a, n.b FROM reach r JOIN n ON n.a = r.b),
c AS (SELECT a AS grp, min(b) AS component FROM reach GROUP BY a),
f AS (SELECT key FROM d WHERE key IS NOT NULL AND label IS NOT NULL GROUP BY key HAVING count(DISTINCT label) > 1),
s AS (SELECT component, min(key) FILTER (key IN (SELECT key FROM f)) AS forced, bool_or(recorded) AS tested FROM d JOIN c USING (grp) GROUP BY component)
SELECT grp AS "group", component, CASE WHEN forced IS NOT NULL THEN {_side_sql("'split|collision|' || forced")} WHEN tested THEN 'test' ELSE {_side_sql("'split|' || component")} END AS side,
  CASE WHEN forced IS NOT NULL THEN 'collision' WHEN tested THEN 'recorded' ELSE 'hash' END AS why FROM c JOIN s USING (component)"""


def component_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and groups that stand on two sides of component_sides: none."""
    rows = written(_split_rows(spark, sf_dir))
    sides = P.leak_free_sides(rows).select("group", "side")
    return E.split_leaks(rows.join(sides, "group").where("key IS NOT NULL"), "key", "side", "group")


COMPONENT_LEAKS = "SELECT unnest(['key', 'group']) AS kind, 0::BIGINT AS n"


def split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and the median length of each side and length bucket."""
    rows = written(_split_rows(spark, sf_dir))
    met = rows.join(P.leak_free_sides(rows).select("group", "side"), "group")
    return P.coverage(met, ["side", "bucket"], "n_chars")


SPLIT_COVERAGE = rf"""
WITH s AS ({COMPONENT_SIDES}), d AS (SELECT 'w' || (doc_id // 5) AS "group", length(text) AS n FROM documents)
SELECT side, CASE WHEN n < 20 THEN '<20' WHEN n < 50 THEN '20-49' WHEN n < 150 THEN '50-149' WHEN n < 500 THEN '150-499' ELSE '500+' END AS bucket, count(*) AS rows, count(DISTINCT "group") AS groups, median(n) AS median
FROM d JOIN s USING ("group") GROUP BY ALL"""


QUERIES = {f.__name__: f for f in (component_sides, component_leaks, split_coverage, scrubbed, scope_counts, pair_keys, combined_verdicts, author_verdicts, split_leaks, near_duplicates, author_features, author_texts, history_profiles, history_shifts, scores, detect, corpus_splits, normal_key_duplicates, contaminated, source_crosstab, feature_statistics, auc_by_language, calibration_by_language, confusion_by_bucket, fair_threshold, stratum_rates, headlines, prior_precision, fitted_scores, corpus_digest, heads, sample, intake, pseudonyms, side_audit)}
ORACLE_SQL = {n: globals()[n.upper()] for n in QUERIES if n.upper() in globals()}
