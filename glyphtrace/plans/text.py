"""Queries over single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import segment as G
from ..functions import text as T
from ..operators import documents as D
from ..operators import features as FE
from ..operators import lexicon as X
from ..operators import rules as R
from .common import table



def _sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}][\\p{{L}}\\p{{M}}''’-]*')"


def _some(words) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("raw", F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.char_length("raw").cast("long").alias("chars"), F.octet_length("raw").cast("long").alias("bytes"), F.sha2(F.col("raw").cast("binary"), 256).alias("sha256"), F.md5(T.folded(T.nfc(F.col("raw"))).cast("binary")).alias("folded_md5"), F.size(T.homoglyph_units(F.col("raw"))).cast("long").alias("homoglyph_units"))


TEXT_VIEWS = r"""
SELECT doc_id, length(coalesce(text, '')) AS chars, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes,
       sha256(coalesce(text, '')) AS sha256, md5(replace(translate(lower(nfc_normalize(coalesce(text, ''))), '’‘ʼ´`', ''''''''''''), 'i̇', 'i')) AS folded_md5,
       0::BIGINT AS homoglyph_units
FROM documents"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("raw", F.coalesce("text", F.lit(""))).withColumn("n_words", F.regexp_count(T.nfc(F.col("raw")), F.lit(T.WORD)).cast("long"))
    size = lambda c: F.size(c).cast("long")
    return d.select("doc_id", "n_words", size(T.numbers(F.col("raw"))).alias("n_numbers"), size(T.lines(F.col("raw"))).alias("n_lines"), size(T.lines_with_words(F.col("raw"))).alias("n_lines_with_words"), size(T.paragraphs(F.col("raw"))).alias("n_paragraphs"), T.length_bucket(F.col("n_words")).alias("bucket"))


TOKEN_COUNTS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, len({_sql_words("nfc_normalize(coalesce(text, ''))")}) AS n_words FROM documents)
SELECT doc_id, n_words, len(regexp_extract_all(raw, '\p{{Nd}}[\p{{Nd}}.,:]*')) AS n_numbers,
       len(string_split_regex(raw, '\r?\n')) AS n_lines,
       len(list_filter(string_split_regex(raw, '\r?\n'), lambda x: regexp_matches(x, '[\p{{L}}\p{{M}}]'))) AS n_lines_with_words,
       len(list_filter(string_split_regex(raw, '\r?\n(?:[\t\f\r ]*\r?\n)+'), lambda x: regexp_matches(x, '\S'))) AS n_paragraphs,
       CASE WHEN n_words < 20 THEN '<20' WHEN n_words < 50 THEN '20-49' WHEN n_words < 150 THEN '50-149' WHEN n_words < 500 THEN '150-499' ELSE '500+' END AS bucket
FROM d"""


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(T.folded(T.nfc(F.coalesce("text", F.lit(""))))).alias("w"))
    d = T.barrier(d).select("doc_id", F.size("w").cast("long").alias("n_words"), T.shingles(F.col("w"), 5).alias("s"))
    return T.barrier(d).select("doc_id", "n_words", F.size("s").cast("long").alias("n_shingles"))


SHINGLE_COUNTS = rf"""
WITH d AS (SELECT doc_id, {_sql_words("lower(nfc_normalize(coalesce(text, '')))")} AS w FROM documents)
SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS n_shingles
FROM d"""


def shape_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").withColumn("raw", F.coalesce("text", F.lit("")))
    d = d.withColumns({"n_lines": F.size(T.lines(F.col("raw"))), "chars": F.char_length("raw"), "markdown": D.markdown_kinds(F.col("raw"))})
    none = F.lit("unknown")
    d = d.withColumn("shape", D.shape_of(F.lit("auto"), none, F.col("chars"), F.col("n_lines"), F.col("markdown")))
    d = d.withColumn("genre", D.genre_of(F.lit("auto"), F.col("shape"), none))
    return d.select("conv_id", "turn", "shape", "genre", D.cell_of(F.lit("en"), F.col("shape")).alias("cell"), F.size("markdown").cast("long").alias("markdown_kinds"))


SHAPE_GENRE = r"""
WITH d AS (
  SELECT conv_id, turn, coalesce(text, '') AS raw FROM conversations),
m AS (SELECT *, regexp_matches(raw, '(?m)^\s{0,3}#{1,6}\s+\S')::INT + regexp_matches(raw, '\*\*[^*\n]{2,80}\*\*')::INT + regexp_matches(raw, '(?m)^\s{0,3}```')::INT
        + regexp_matches(raw, '(?m)^\s{0,3}\|.*\|')::INT + (len(regexp_extract_all(raw, '(?m)^\s{0,3}[-*+]\s+\S')) >= 2 AND regexp_matches(raw, '(?m)^\s{0,3}[-*+]\s*\*\*[^*\n]{2,60}\*\*'))::INT AS markdown_kinds FROM d),
s AS (SELECT *, CASE WHEN length(raw) < 400 AND len(string_split_regex(raw, '\r?\n')) <= 4 AND markdown_kinds = 0 THEN 'chat' ELSE 'prose' END AS shape FROM m)
SELECT conv_id, turn, shape, CASE WHEN shape = 'chat' THEN 'chat' ELSE 'unspecified' END AS genre, 'en:' || shape AS cell, markdown_kinds::BIGINT AS markdown_kinds FROM s"""


def language_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw")).withColumn("nfc", T.nfc(F.col("raw")))
    d = T.barrier(d.withColumn("lower", T.lower_words(F.col("nfc"))))
    return L.identify(d).select("doc_id", "language", F.round("language_confidence", 6).alias("language_confidence"))


def _language_sql() -> str:
    some = lambda ws: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"
    hits = lambda ws: f"len(list_filter(w, lambda t: list_contains({some(ws)}, t)))"
    other = ", ".join(hits(ws) for ws in L.OTHERS.values())
    return rf"""
WITH a AS (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS t FROM documents),
b AS (SELECT *, list_transform({_sql_words("t")}, lambda x: lower(x)) AS w, len(regexp_extract_all(t, '\p{{L}}')) AS letters FROM a),
c AS (SELECT *, len(w) AS n, CASE WHEN letters > 0 THEN len(regexp_extract_all(t, '\p{{Latin}}')) / letters ELSE 0 END AS latin,
        CASE WHEN len(w) > 0 AND {hits(L.EN_STOP)} / len(w) > 0.08 THEN 2 ELSE 0 END AS en, greatest({other}) AS o,
        list_filter(w, lambda x: length(x) >= 4 AND regexp_matches(x, '{L.TR_ASCII_SUFFIX}')) AS suf FROM b),
v AS (SELECT *, CASE WHEN o >= 4 AND o / n > 0.06 THEN 3 WHEN o >= 2 AND o / n > 0.03 THEN 2 ELSE 0 END AS ov,
        CASE WHEN letters > 0 AND len(regexp_extract_all(t, '{L.TR_LETTERS}')) / letters > 0.015 THEN 2 ELSE 0 END
        + CASE WHEN n > 0 AND {hits(L.TR_STOP)} / n > 0.06 THEN 2 ELSE 0 END
        + CASE WHEN n > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '{L.TR_SUFFIX}'))) / n >= 0.08 THEN 1 ELSE 0 END
        + CASE WHEN {hits(L.TR_PROBE)} > 0 THEN 1 ELSE 0 END + CASE WHEN {hits(L.TR_SLANG)} > 0 THEN 1 ELSE 0 END
        + CASE WHEN en = 0 AND len(list_distinct(suf)) >= 2 AND len(suf) / n >= 0.12 THEN 1 ELSE 0 END AS tr FROM c),
l AS (SELECT *, CASE WHEN letters < 8 THEN 'unknown' WHEN latin < 0.6 THEN 'unknown'
        WHEN len(regexp_extract_all(t, 'ə')) >= 2 OR len(regexp_extract_all(t, '[ýžň]')) >= 2 OR (ov > 0 AND ov >= greatest(tr, en)) THEN 'unknown'
        WHEN greatest(tr, en) = 0 THEN 'mixed' WHEN tr > 0 AND en > 0 AND abs(tr - en) <= 1 THEN 'mixed' WHEN tr > en THEN 'tr' ELSE 'en' END AS language FROM v)
SELECT doc_id, language, round(CASE WHEN language = 'unknown' THEN 0.0 WHEN language = 'mixed' THEN CASE WHEN tr = 0 AND en = 0 THEN 0.3 ELSE 0.4 END ELSE least(0.95, 0.5 + 0.1 * abs(tr - en)) END::DOUBLE, 6) AS language_confidence FROM l"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.barrier(table(spark, sf_dir, "documents").select("doc_id", T.nfc(F.coalesce("text", F.lit(""))).alias("nfc"))).select("doc_id", T.lower_words(F.col("nfc")).alias("lower"))
    d = T.barrier(T.barrier(d).withColumn("n_tokens", F.size("lower")))
    return D.diagnostics(d).select("doc_id", "ttr", "hapax", "mattr50")


DIAGNOSTICS = rf"""
WITH d AS (SELECT doc_id, list_transform({_sql_words("nfc_normalize(coalesce(text, ''))")}, lambda x: lower(x)) AS w FROM documents),
k AS (SELECT doc_id, count(*) FILTER (c = 1) AS once FROM (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN len(w) >= 30 THEN round(len(list_distinct(w)) / len(w), 4) END AS ttr, CASE WHEN len(w) >= 30 THEN round(coalesce(once, 0) / len(w), 4) END AS hapax,
       CASE WHEN len(w) >= 50 THEN round(list_avg(list_transform(range(1, len(w) - 48), lambda i: len(list_distinct(w[i : i + 49])) / 50.0)), 4) END AS mattr50
FROM d LEFT JOIN k USING (doc_id)"""


def punctuation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that need no segmenter, as the catalogue has them, over prose."""
    names = ("paragraph_uniformity", "content_word_repeat", "repeated_punct_emoticon", "multi_exclam", "bold_lead_in_list", "colon_led_list", "contraction_apostrophe_drop")
    ctx = X.without_hits(D.context(table(spark, sf_dir, "documents").select("doc_id", "text"), {"shape": "prose", "lang": "en"}))
    wide = FE.with_features(ctx, names)
    return wide.select("doc_id", *(F.round(n, 6).alias(n) for n in names))


PUNCTUATION_FEATURES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, {_sql_words("nfc_normalize(coalesce(text, ''))")} AS w, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM documents),
c AS (SELECT *, len(w) AS n, list_filter(list_transform(w, lambda t: lower(t)), lambda t: length(t) >= 4 AND NOT list_contains({_some(L.EN_STOP)}, t)) AS cw,
        list_transform(list_filter(string_split_regex(raw, '\r?\n(?:[\t\f\r ]*\r?\n)+'), lambda x: regexp_matches(x, '\S')), lambda p: len({_sql_words("p")})) AS ps,
        len(regexp_extract_all(raw, '[!?]{{2,}}')) + len(regexp_extract_all(raw, ':\)|:\(|:D|:''\(|<3|xD|:-\)|:-\(|;\)')) AS rp,
        len(regexp_extract_all(raw, '!{{2,}}')) AS me,
        len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•\p{{Nd}}.)]+\s*\*\*[^*\n]{{2,40}}\*\*\s*[:：-]') OR regexp_matches(x, '^\s*[-*•\p{{Nd}}.)]+\s*\*\*[^*\n]{{2,40}}:\s*\*\*'))) AS bl,
        len(list_filter(range(1, len(ls)), lambda i: regexp_matches(ls[i], ':\s*$') AND regexp_matches(ls[i + 1], '^\s*[-*•\p{{Nd}}]'))) + len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]\s*\p{{Lu}}[^:\n]{{2,40}}:\s+\S'))) AS cl,
        len(list_filter(w, lambda t: list_contains({_some(FE.CONTRACTIONS)}, lower(t)))) AS co
      FROM d)
SELECT doc_id,
  CASE WHEN n >= 250 AND len(ps) >= 4 AND list_avg(ps) > 0 THEN round(1 - least(1.0, list_stddev_samp(ps) / list_avg(ps)), 6) END::DOUBLE AS paragraph_uniformity,
  CASE WHEN n >= 150 AND len(cw) >= 20 THEN round(1 - len(list_distinct(cw)) / len(cw), 6) END::DOUBLE AS content_word_repeat,
  CASE WHEN rp > 0 THEN rp END::DOUBLE AS repeated_punct_emoticon, CASE WHEN me > 0 THEN me END::DOUBLE AS multi_exclam,
  CASE WHEN n >= 20 AND bl > 0 THEN bl END::DOUBLE AS bold_lead_in_list, CASE WHEN n >= 20 AND cl > 0 THEN cl END::DOUBLE AS colon_led_list,
  CASE WHEN n >= 5 AND co > 0 THEN co END::DOUBLE AS contraction_apostrophe_drop
FROM c"""


#: Features whose values SQL can give too, over prose and over chat in English: group, direction, kind, confidence.
PROSE = {n: (FE.FEATURES[n].group, FE.FEATURES[n].direction, FE.FEATURES[n].kind, FE.FEATURES[n].confidence) for n in (
    "paragraph_uniformity", "content_word_repeat", "ellipsis_hand_typed", "repeated_punct_emoticon", "space_hygiene", "multi_exclam", "emoji_bullet_led", "bold_lead_in_list", "colon_led_list",
    "closing_summary_move", "llm_lexicon_strong", "llm_lexicon_weak", "politeness_formula", "hedge_density", "human_lexicon", "contraction_apostrophe_drop",
)}
CHAT = ("all_lowercase", "ellipsis_hand_typed", "repeated_punct_emoticon", "space_hygiene", "multi_exclam", "em_dash_in_chat", "emoji_bullet_led", "bold_lead_in_list", "colon_led_list", "greeting_signoff_frame", "llm_lexicon_strong", "llm_lexicon_weak", "politeness_formula", "human_lexicon", "contraction_apostrophe_drop", "self_correction_marker")


#: What a word of the lexicon by rule is, by its place modulo 4.
KINDS = (("llm", "strong"), ("llm", "weak"), ("human", "strong"), ("human", "weak"))
LEXICON_WORDS = 48


def lexicon_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon from a table: the words of four letters or more that most of the benchmark's items have, dealt to kinds and tags."""
    words = T.barrier(table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(T.folded(T.nfc(F.coalesce("text", F.lit("")))), F.lit(X.HEAD), F.lit(0)).alias("w")))
    each = words.select(F.explode(F.array_distinct("w")).alias("phrase")).where(F.length("phrase") >= 4).groupBy("phrase").agg(F.count("*").alias("n"))
    first = Window.orderBy(F.col("n").desc(), "phrase")
    rows = each.orderBy(F.col("n").desc(), "phrase").limit(LEXICON_WORDS).withColumn("place", (F.row_number().over(first) - 1) % len(KINDS))
    of = lambda i: F.element_at(F.array(*(F.lit(k[i]) for k in KINDS)), F.col("place") + 1)
    return rows.select("phrase", F.lit("en").alias("lang"), of(0).alias("kind"), of(1).alias("tag"), F.lit("general").alias("domain"), F.lit("-").alias("flag"))


_FOLDED = "replace(translate(lower(nfc_normalize(coalesce(text, ''))), '’‘ʼ´`', repeat(chr(39), 5)), 'i̇', 'i')"
LEXICON_SQL = rf"""SELECT word, (row_number() OVER (ORDER BY n DESC, word) - 1) % {len(KINDS)} AS kind FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all({_FOLDED}, '[\p{{L}}\p{{M}}]+'))) AS word FROM benchmark)
  WHERE length(word) >= 4 GROUP BY word ORDER BY n DESC, word LIMIT {LEXICON_WORDS})"""

#: Markers of the queries: a name and a pattern, the first that matches is told.
MARKERS = [{"name": "license line", "pattern": r"(?i)released under the [A-Z]+ license"}, {"name": "rights", "pattern": r"(?i)all rights reserved"}]


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first marker that a document has."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    return R.marker_hits(d, R.check_markers(MARKERS, spark), "doc_id")


MARKED = "SELECT * FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{m['pattern']}') THEN '{m['name']}'" for m in MARKERS) + " END AS marker FROM documents) WHERE marker IS NOT NULL"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of documents as prose, a row for each."""
    d = table(spark, sf_dir, "documents").select("doc_id", G.segmented(T.nfc(F.coalesce("text", F.lit(""))), F.lit("prose")).alias("s"))
    # without the barrier a filter on empty arrays segments every text again
    return T.barrier(d).select("doc_id", F.posexplode("s").alias("number", "s")).select("doc_id", "number", F.md5(F.col("s.text").cast("binary")).alias("text_md5"), "s.words", "s.listed", "s.terminator", "s.run")


def chat_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of conversations' turns as chat, by the table function in SQL."""
    G.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("segmented_turns")
    return spark.sql("SELECT conv_id, turn, number, md5(sentence) AS text_md5, words, listed, terminator, run FROM sentences(TABLE(SELECT conv_id, turn, text, 'chat' AS shape FROM segmented_turns))")


def _features_sql(rows: str, key: str, names) -> str:  # noqa: ANN001
    """key, n_tokens, chars, feature, value of the named features over rows (key, raw), from the lists and patterns that the catalogue has."""
    edge, end = r"(?:^|[^\p{L}\p{M}\p{Nd}_])", r"(?:[^\p{L}\p{M}\p{Nd}_]|$)"
    n_of = lambda pattern, x="raw": f"len(regexp_extract_all({x}, {_quoted(pattern)}))"
    # on a copy with its separators doubled, matches that take one on each side don't get in each other's way
    phrases = lambda some: f"len(regexp_extract_all(pad, {_quoted(f'(?:{some})'.replace(' ', '  ') + end)}))"
    whole = lambda some: f"len(regexp_extract_all(pad, {_quoted(edge + f'(?:{some})'.replace(' ', '  ') + end)}))"
    lines = lambda test: f"len(list_filter(ls, lambda x: {test}))"
    at = lambda pattern, x="x": f"regexp_matches({x}, {_quoted(pattern)})"
    plain = lambda p: p.replace(FE.BEFORE, edge).replace(FE.AFTER, end)
    bold = f"({at(FE.BOLD_LEAD)} OR {at(FE.BOLD_LEAD_INSIDE)})"
    slips = rf"""{n_of(r"\S {2,}\S")} + {n_of(r"\s+[,.;:!?\x{060C}\x{061B}\x{061F}]")} + greatest(0, {n_of(r"[,.;:\x{060C}\x{061B}]\p{L}")} - {n_of(r"\p{Nd}[.,]\p{Nd}")} - 2 * {n_of(r"(?:https?://|www\.)\S+")} - {n_of("(?i)" + edge + r"(?:e\.g|i\.e|vs|etc|vb|bkz)\.")}) + {lines(at(r"[ \t\f\r]$") + " AND " + at(r"\S"))}"""
    led = f"len(list_filter(range(1, len(ls)), lambda i: {at(r':\s*$', 'ls[i]')} AND {at(r'^\s*[-*•\p{Nd}]', 'ls[i + 1]')})) + {lines(at(FE.PLAIN_LEAD) + ' AND NOT ' + bold)}"
    positive = lambda x: f"nullif({x}, 0)"
    listed = lambda kind: f"len(list_filter(heads, lambda x: list_contains(kind{kind}, x)))"
    opener, sign = rf"^(?:{FE.OPENERS['en']})" + end, FE.SIGN_OFFS["en"]
    values = {
        "paragraph_uniformity": (250, "CASE WHEN len(ps) >= 4 AND list_avg(ps) > 0 THEN 1 - least(1.0, list_stddev_samp(ps) / list_avg(ps)) END"),
        "content_word_repeat": (150, "CASE WHEN len(cw) >= 20 THEN 1 - len(list_distinct(cw)) / len(cw) END"),
        "all_lowercase": (20, f"CASE WHEN letters >= 20 THEN ((letters - {n_of(r'[\p{Lu}\p{Lt}]', 'nfc')}) / letters > 0.98)::INT END"),
        "ellipsis_hand_typed": (0, positive(r"coalesce(list_sum(list_transform(regexp_extract_all(raw, '\.{2,}'), lambda x: 1 + (length(x) >= 4)::INT)), 0)")),
        "repeated_punct_emoticon": (0, positive(f"{n_of(r'[!?\x{061F}]{2,}')} + {n_of(FE.EMOTICON)}")),
        "space_hygiene": (20, f"({slips}) * 100.0 / n"), "multi_exclam": (0, positive(n_of("!{2,}"))),
        "em_dash_in_chat": (0, "(contains(raw, '—') AND NOT contains(raw, ' - '))::INT"),
        "emoji_bullet_led": (0, f"CASE WHEN {lines(at(rf'^\s*{FE.EMOJI}{FE.EMOJI_MARKS}*\s+\p{{Lu}}'))} >= 2 THEN 1 END"),
        "bold_lead_in_list": (20, positive(lines(bold))), "colon_led_list": (20, positive(led)),
        "closing_summary_move": (120, f"CASE WHEN {at('^(?:' + FE.CLOSERS['en'] + ')' + end, 'lower(ltrim(pt[len(pt)]))')} THEN 1 END"),
        "greeting_signoff_frame": (30, f"CASE WHEN {at(opener, 'ltrim(folded)')} AND {at(sign, 'folded')} THEN 1 END"),
        "llm_lexicon_strong": (0, positive(listed(0))), "llm_lexicon_weak": (40, f"{listed(1)} * 100.0 / n"), "human_lexicon": (1, positive(f"(3 * {listed(2)} + {listed(3)})")), "politeness_formula": (0, positive(phrases(FE.POLITE["en"]))), "hedge_density": (100, f"{whole(FE.HEDGES['en'])} * 100.0 / n"),
        "contraction_apostrophe_drop": (5, positive(f"len(list_filter(w, lambda t: list_contains({_some(FE.CONTRACTIONS)}, lower(t))))")),
        "self_correction_marker": (2, positive(" + ".join(f"{at(plain(p), 'raw')}::INT" for p in FE.SELF_CORRECTIONS))),
    }
    each = " UNION ALL ".join(f"SELECT {key}, n AS n_tokens, chars, '{f}' AS feature, ({values[f][1]})::DOUBLE AS value FROM feature_rows WHERE n >= {values[f][0]}" for f in names)
    return rf"""
WITH feature_lexicon AS MATERIALIZED (SELECT {", ".join(f"coalesce(list(word) FILTER (kind = {k}), []) AS kind{k}" for k in range(len(KINDS)))} FROM ({LEXICON_SQL})),
feature_base AS MATERIALIZED (SELECT *, nfc_normalize(raw) AS nfc, {_sql_words("nfc_normalize(raw)")} AS w, string_split_regex(raw, '\r?\n') AS ls, length(raw) AS chars,
    list_filter(string_split_regex(raw, '\r?\n(?:[\t\f\r ]*\r?\n)+'), lambda x: regexp_matches(x, '\S')) AS pt,
    replace(translate(lower(nfc_normalize(raw)), '’‘ʼ´`', repeat(chr(39), 5)), 'i̇', 'i') AS folded FROM ({rows})),
feature_rows AS MATERIALIZED (SELECT *, len(w) AS n, {n_of(r"\p{L}", "nfc")} AS letters, regexp_extract_all(folded, '[\p{{L}}\p{{M}}]+[\p{{Nd}}_]?') AS heads, regexp_replace(folded, '([^\p{{L}}\p{{M}}\p{{Nd}}_])', '\1\1', 'g') AS pad,
    list_filter(list_transform(w, lambda t: lower(t)), lambda t: length(t) >= 4 AND NOT list_contains({_some(L.EN_STOP)}, t)) AS cw, list_transform(pt, lambda p: len({_sql_words("p")})) AS ps FROM feature_base, feature_lexicon)
SELECT * FROM ({each}) WHERE value IS NOT NULL"""


PROSE_KEY = ["doc_id", "source", "n_tokens", "chars"]


def prose_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, chars and a column for each feature in PROSE, a row for each document."""
    ctx = X.with_hits(D.context(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), {"shape": "prose", "lang": "en"}), lexicon_by_rule(spark, sf_dir), "doc_id")
    return FE.with_features(ctx, tuple(PROSE)).select(*PROSE_KEY, *PROSE)


def prose_rows(wide: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, chars, feature, value and what the catalogue says of the feature, of prose_wide()."""
    return FE.long_table(wide, PROSE_KEY)


def prose_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of documents, a row for each value."""
    return prose_rows(prose_wide(spark, sf_dir)).select("doc_id", "feature", F.round("value", 6).alias("value"))


PROSE_ROWS = _features_sql("SELECT doc_id, source, coalesce(text, '') AS raw FROM documents", "doc_id, source", PROSE)
PROSE_FEATURES = f"SELECT doc_id, feature, round(value, 6) AS value FROM ({PROSE_ROWS})"


def chat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of turns of conversations, judged as chat in English."""
    ctx = X.with_hits(D.context(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), {"shape": "chat", "lang": "en"}), lexicon_by_rule(spark, sf_dir), "conv_id")
    return FE.long_table(FE.with_features(ctx, CHAT), ["conv_id", "turn"]).select("conv_id", "turn", "feature", F.round("value", 6).alias("value"))


CHAT_FEATURES = f"SELECT conv_id, turn, feature, round(value, 6) AS value FROM ({_features_sql('SELECT conv_id, turn, coalesce(text, repeat(chr(32), 0)) AS raw FROM conversations', 'conv_id, turn', CHAT)})"


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all turns of conversations, a row for each value."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ctx = X.with_hits(D.context(c), lexicon_by_rule(spark, sf_dir), "conv_id")
    return FE.long_table(FE.with_features(ctx), ["conv_id", "turn"]).select("conv_id", "turn", "feature", F.round("value", 6).alias("value"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon from a table: every run of four words of the benchmark's items."""
    w = T.barrier(table(spark, sf_dir, "benchmark").select(T.words(T.folded(T.nfc(F.coalesce("text", F.lit(""))))).alias("w")))
    rows = w.select(F.explode(T.shingles(F.col("w"), 4)).alias("phrase")).distinct()
    return rows.select("phrase", F.lit("en").alias("lang"), F.lit("llm").alias("kind"), F.lit("strong").alias("tag"), F.lit("general").alias("domain"), F.lit("-").alias("flag"))


def lexicon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every phrase in documents, before overlaps are resolved."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.folded(T.nfc(F.coalesce("text", F.lit("")))).alias("folded"))
    return X.candidates(T.barrier(d), _phrases(spark, sf_dir), "doc_id").select("doc_id", "phrase", "start", "end")


LEXICON_CANDIDATES = rf"""
WITH b AS (SELECT {_sql_words(_FOLDED)} AS w FROM benchmark),
p AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) AS phrase FROM b WHERE len(w) >= 4),
d AS (SELECT doc_id, {_FOLDED} AS t FROM documents),
h AS (SELECT doc_id, phrase, t, string_split(t, phrase) AS gaps FROM d JOIN p ON contains(t, phrase)),
s AS (SELECT doc_id, phrase, t, unnest(list_transform(range(1, len(gaps)), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + (i - 1) * length(phrase)))::BIGINT AS start FROM h)
SELECT doc_id, phrase, start, start + length(phrase) AS "end" FROM s
WHERE (start = 0 OR NOT regexp_matches(substr(t, start, 1), '[\p{{L}}\p{{M}}]')) AND NOT regexp_matches(substr(t, start + length(phrase) + 1, 1), '[\p{{L}}\p{{M}}\p{{Nd}}_]')"""


def lexicon_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of documents, of overlapping ones the longest, then leftmost, then least."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.folded(T.nfc(F.coalesce("text", F.lit("")))).alias("folded"))
    hits = X.kept(X.candidates(T.barrier(d), _phrases(spark, sf_dir), "doc_id"), "doc_id")
    return hits.select("doc_id", F.explode("lexicon_hits").alias("h")).select("doc_id", "h.phrase", "h.start", "h.end")


def fold_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map from documents' folded view back to the text: how many places it has and their sum; null where there is none."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.nfc(F.coalesce("text", F.lit(""))).alias("nfc"))
    m = T.barrier(T.barrier(d).select("doc_id", T.fold_map(F.col("nfc")).alias("m")))
    return m.select("doc_id", F.when(F.col("m").isNotNull(), F.size("m")).cast("long").alias("places"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


FOLD_PLACES = f"SELECT doc_id, length({_FOLDED}) AS places, length({_FOLDED}) * (length({_FOLDED}) - 1) // 2 AS total FROM documents"


def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the punctuation signals of documents stand."""
    names = ("repeated_punct_emoticon", "multi_exclam", "em_dash_in_chat")
    ctx = X.without_hits(D.context(table(spark, sf_dir, "documents").select("doc_id", "text"), {"shape": "chat", "lang": "en"}))
    rows = FE.evidence(FE.with_features(ctx, names), most=1_000_000)
    return rows.select("doc_id", F.explode("evidence_spans").alias("s")).select("doc_id", "s.name", "s.start", "s.end", "s.text")


def _spans_sql(name: str, pattern: str) -> str:
    return rf"""
SELECT doc_id, '{name}' AS name, start, start + length(m) AS "end", m AS text FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda g: length(g))), 0)))::BIGINT AS start
  FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(pattern)}) AS ms, string_split_regex(text, {_quoted(pattern)}) AS gs FROM documents WHERE text IS NOT NULL AND regexp_matches(text, {_quoted(pattern)})))"""


EVIDENCE_SPANS = _spans_sql("repeated_punct_emoticon", FE.SPAN_PATTERNS["repeated_punct_emoticon"]) + " UNION ALL " + _spans_sql("multi_exclam", "!{2,}") + " UNION ALL SELECT * FROM (" + _spans_sql("em_dash_in_chat", "—") + ") WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE contains(text, ' - '))"


def rule_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    return d.select("doc_id", R.invisible(F.col("raw")).cast("long").alias("invisible"), F.array_join(D.markdown_kinds(F.col("raw")), ",").alias("markdown"))


RULE_MARKS = r"""
SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '[\x{200B}\x{200C}\x{2060}\x{FEFF}\x{00AD}\x{200E}\x{200F}\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]')) - len(regexp_extract_all(coalesce(text, ''), '^\x{FEFF}')))::BIGINT AS invisible,
  concat_ws(',', CASE WHEN regexp_matches(text, '(?m)^\s{0,3}#{1,6}\s+\S') THEN 'header' END, CASE WHEN regexp_matches(text, '\*\*[^*\n]{2,80}\*\*') THEN 'double_asterisk_bold' END,
    CASE WHEN regexp_matches(text, '(?m)^\s{0,3}```') THEN 'code_fence' END, CASE WHEN regexp_matches(text, '(?m)^\s{0,3}\|.*\|') THEN 'pipe_table' END,
    CASE WHEN len(regexp_extract_all(coalesce(text, ''), '(?m)^\s{0,3}[-*+]\s+\S')) >= 2 AND regexp_matches(text, '(?m)^\s{0,3}[-*+]\s*\*\*[^*\n]{2,60}\*\*') THEN 'bullets_with_bold_lead_in' END) AS markdown
FROM documents"""

QUERIES = {f.__name__: f for f in (marked, sentences, chat_sentences, prose_features, chat_features, lexicon_candidates, fold_places, evidence_spans, text_views, token_counts, shingle_counts, shape_genre, language_votes, diagnostics, punctuation_features, feature_table, lexicon_matches, rule_marks)}
ORACLE_SQL = {"marked": MARKED, "text_views": TEXT_VIEWS, "token_counts": TOKEN_COUNTS, "shingle_counts": SHINGLE_COUNTS, "shape_genre": SHAPE_GENRE, "language_votes": _language_sql(), "diagnostics": DIAGNOSTICS, "punctuation_features": PUNCTUATION_FEATURES, "rule_marks": RULE_MARKS, "prose_features": PROSE_FEATURES, "chat_features": CHAT_FEATURES, "lexicon_candidates": LEXICON_CANDIDATES, "fold_places": FOLD_PLACES, "evidence_spans": EVIDENCE_SPANS}
