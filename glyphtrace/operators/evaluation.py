"""Evaluation: keys, splits, audits, metrics and thresholds, each a DataFrame to a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import sized, written
from ..sources.batch import numbered

SIDES = (("fit", 0.6), ("val", 0.8))
PRIORS = (0.01, 0.05, 0.10, 0.20, 0.35, 0.50)
MOST_FPR, MIN_STRATUM = 0.02, 20


# What a key folds beside case: letters of Arabic script, digits, Turkish letters, and emoji, which go.
ARABIC_FROM, ARABIC_TO = "آأإٱىة٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ااااي" + "ه" + "01234567890123456789"
TURKISH_FROM, TURKISH_TO = "çğıöşüâîû", "cgiosuaiu"
# Words that scrubbing never hides: dates, places, rooms, booking.
ALLOWED = (
    "ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "pazartesi", "sali", "carsamba", "persembe", "cuma", "cumartesi", "pazar", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "istanbul", "ankara", "izmir", "antalya", "kapadokya", "cappadocia", "trabzon", "bursa", "konya", "taksim",
    "sultanahmet", "kadikoy", "urgup", "goreme", "nevsehir", "bodrum", "fethiye", "turkiye", "turkey", "alanya", "side", "kemer", "belek",
    "hotel", "otel", "oda", "odalar", "room", "rooms", "suite", "standart", "standard", "deluxe", "superior", "family",
    "aile", "twin", "double", "single", "triple", "sea", "view", "garden", "cave", "magara", "spa", "resort", "palace",
    "grand", "central", "old", "town", "beach", "boutique", "inn", "plaza", "park", "terrace", "bosphorus", "marina",
    "classic", "economy", "balkon", "balcony", "kahvalti", "breakfast", "transfer", "check", "in", "out",
    "gece", "gun", "gunluk", "gecelik", "giris", "cikis", "kisi", "kisilik", "kisiyiz", "yetiskin", "cocuk", "cocuklar",
    "bebek", "yasinda", "yas", "fiyat", "fiyati", "ucret", "toplam", "rezervasyon", "tur", "turu", "program", "tarih",
    "adult", "adults", "child", "children", "night", "nights", "price", "total", "booking", "reservation", "trip", "tour", "date", "dates",
)
# The words of both languages that every scrubbed row may have.
SCRUB_STOP = (
    "ve", "ile", "bir", "bu", "su", "o", "da", "de", "ki", "mi", "mu", "ama", "icin", "gibi", "daha", "cok", "az", "var", "yok", "evet", "hayir", "tamam", "olsun", "olacak", "lazim", "istiyorum", "merhaba", "selam", "naber", "reis", "abi",
    "sonra", "once", "simdi", "yine", "ayni", "diger", "birinci", "ikinci", "ucuncu", "sadece", "bize", "bana", "sana", "biz", "ben", "sen", "hangi", "kac", "ne", "nasil", "nerede", "lutfen", "tesekkurler", "sagol", "iyi", "gunler", "peki", "yani", "pardon",
    "the", "and", "is", "are", "of", "to", "we", "you", "a", "an", "in", "for", "it", "was", "this", "that", "with", "on", "at", "from", "i", "my", "our", "want", "need", "please", "thanks", "thank", "hello", "hi", "yes", "no", "ok", "okay", "have", "has",
    "be", "will", "would", "can", "could", "do", "does", "lets",
)
NAME_CUE = r"\b(?:isim|isimler|isimleri|adi|adı|adlari|adları|names?)\b\s*:?"
REFERENCE, LONG_NUMBER = r"\b[A-Z]{2,5}-?[0-9]{4,8}\b", r"\+?[0-9\x{0660}-\x{0669}\x{06F0}-\x{06F9}]{7,}"


def plain_key(text: Column) -> Column:
    """norm_key() of a text that is in NFKC already."""
    # each search is for texts that have something for it; of ASCII, folding is the lower case
    t = F.translate(F.regexp_replace(text, T.TASHKEEL, ""), ARABIC_FROM + T.TATWEEL, ARABIC_TO)
    t = F.when(text.rlike(r"[\x{0600}-\x{06FF}]"), t).otherwise(text)
    t = F.when(text.rlike(r"[\x{2600}-\x{10FFFF}]"), F.regexp_replace(t, r"[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{FE0F}]", "")).otherwise(t)
    folded = F.lower(F.translate(T.case_fold(t, F.lit("tr")), TURKISH_FROM, TURKISH_TO))
    t = F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{Nd}]+", " "))


def norm_key(text: Column) -> Column:
    """What two texts have in common when only letters and digits count: no case, marks, emoji or spaces between; Turkish and Arabic letters folded."""
    return plain_key(T.nfkc(text))


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, and repeats, the number of its rows. Rows meet as their least one, never all of a key in a task."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r"), F.count("*").alias("repeats")).select(key, "_r.*", "repeats")


def in_scope(rows: DataFrame) -> DataFrame:
    """rows (label, text, lang) with excluded: label, blank, language or script, why a row is not used; null where it is."""
    arabic = F.regexp_count("text", F.lit(r"[\x{0600}-\x{06FF}]")) / F.greatest(F.regexp_count("text", F.lit(r"\p{L}")), F.lit(1))
    why = (
        F.when(~F.coalesce(F.col("label").isin("REAL", "SYNTH"), F.lit(False)), "label").when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank")
        .when(~F.coalesce(F.col("lang").isin("en", "tr", "ar"), F.lit(True)), "language").when(arabic >= 0.2, "script")
    )
    return rows.withColumn("excluded", why)


def paired(rows: DataFrame, pair: str = "pair", source: str = "source") -> DataFrame:
    """rows whose pair key is null where it names fewer than two rows of its source: such a key says nothing about siblings."""
    n = rows.where(F.col(pair).isNotNull()).groupBy(pair, source).agg(F.count("*").alias("_n")).where("_n >= 2")
    met = rows.join(n.select(F.col(pair).alias("_p"), F.col(source).alias("_s"), "_n"), (F.col(pair) == F.col("_p")) & F.col(source).eqNullSafe(F.col("_s")), "left")
    return met.withColumn(pair, F.when(F.col("_n").isNotNull(), F.col(pair))).drop("_p", "_s", "_n")


def cross_label(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that stand under more than one label."""
    return rows.groupBy(key).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("rows")).where("labels > 1")


def side_of_group(group: Column, seed: str = "split") -> Column:
    """fit, val or test by the hash of a group, so that a group never straddles."""
    u = T.fnv1a_32(F.concat(F.lit(seed + "|"), group.cast("string"))) / 4294967295
    return F.when(u < SIDES[0][1], "fit").when(u < SIDES[1][1], "val").otherwise("test")


def side_of_shard(key: Column) -> Column:
    n = T.fnv1a_32(F.concat(F.lit("shard|"), key.cast("string"))) % 20
    return F.when(n < 12, "fit").when(n < 16, "val").otherwise("test")


def side_by_time(rows: DataFrame, author: str, time: str, key: str) -> DataFrame:
    """Per author, the first 60 % of rows fit, the next 20 % val, the rest test.

    Rows are numbered over the whole table by author, time and key, in ranges; an author's first number is then all
    that a row needs, so an author with a great part of the rows is no single task.
    """
    placed = numbered(rows, author, time, key)
    each = placed.groupBy(F.col(author).alias("_a")).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    met = placed.join(sized(written(each)), F.col(author).eqNullSafe(F.col("_a")))
    i, fit, val = F.col("_i") - F.col("_first") + 1, F.floor(F.col("_n") * 0.6), F.floor(F.col("_n") * 0.2)
    return met.withColumn("side", F.when(i <= fit, "fit").when(i <= fit + val, "val").otherwise("test")).drop("_i", "_a", "_first", "_n")


def straddling(rows: DataFrame, group: str) -> DataFrame:
    """Groups with rows on more than one side."""
    return rows.groupBy(group).agg(F.count_distinct("side").alias("sides")).where("sides > 1")


#: Words of the items that are held in a task at once, and cells of a table of rows and items.
HELD_WORDS, CELLS = 4_000_000, 2_000_000


def contamination(machine: DataFrame, human: DataFrame) -> DataFrame:
    """id, overlap: the greatest Jaccard overlap of each row of machine with any one row of human. Both: id, tokens (distinct).

    The rows of machine (a benchmark) are a query set that goes to all rows of human, in blocks of at most HELD_WORDS
    words: what is broadcast is bounded, human is read once for each block, and its words are never shuffled. A task
    counts common words for a slice of its rows and all items of the block at once, and gives each item's greatest
    overlap. Words are told by 64-bit hashes.
    """
    hashed = lambda x: x.select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    items = written(hashed(machine).withColumn("id", F.col("id").cast("string")))
    words = items.agg(F.sum(F.size("tokens"))).first()[0] or 0
    blocks, found = max(1, -(-words // HELD_WORDS)), None
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else items
        index = machine.sparkSession.sparkContext.broadcast(_inverted([(r["id"], r["tokens"]) for r in some.collect()]))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ids, sizes, keys, offsets, postings = index.value
            best = np.zeros(len(ids))
            rows = max(1, CELLS // max(1, len(ids)))
            for batch in batches:
                column = batch.column(0)
                ends, tokens = column.offsets.to_numpy(), column.values.to_numpy()
                for at in range(0, len(column), rows):
                    here = ends[at : min(at + rows, len(column)) + 1]
                    _overlaps(best, sizes, keys, offsets, postings, np.diff(here), tokens[here[0] : here[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(best, pa.float64())], names=["id", "overlap"])

        part = hashed(human).select(F.coalesce("tokens", F.array().cast("array<long>")).alias("tokens")).mapInArrow(run, "id string, overlap double")
        part = written(part.groupBy("id").agg(F.max("overlap").alias("overlap")))
        found = part if found is None else found.unionByName(part)
    every = machine.select("id").distinct().select("id", F.col("id").cast("string").alias("_t"))
    return every.join(found.withColumnRenamed("id", "_t"), "_t", "left").select("id", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def _inverted(items: list[tuple[str, list[int]]]) -> tuple:
    """ids, their sizes, and for each distinct word (sorted) the places of the items that have it."""
    sizes = np.array([len(t or ()) for _, t in items], np.int64)
    word = np.concatenate([np.array(t, np.int64) for _, t in items if t] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(items)), sizes)
    order = np.argsort(word, kind="stable")
    keys, first = np.unique(word[order], return_index=True)
    return [i for i, _ in items], sizes, keys, np.append(first, len(word)), owner[order]


def _overlaps(best: np.ndarray, sizes: np.ndarray, keys: np.ndarray, offsets: np.ndarray, postings: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> None:
    """best, at least the greatest overlap of each item with any of the rows, whose words are `tokens`, `lengths` of them each."""
    if not len(keys) or not len(tokens):
        return
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    held = keys[at] == tokens
    row, at = np.repeat(np.arange(len(lengths)), lengths)[held], at[held]
    n = offsets[at + 1] - offsets[at]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[at], n)
    common = np.bincount(np.repeat(row, n) * len(sizes) + postings[place], minlength=len(lengths) * len(sizes)).reshape(len(lengths), len(sizes))
    np.maximum(best, (common / np.maximum(1, lengths[:, None] + sizes[None, :] - common)).max(axis=0), out=best)


def standardised(rows: DataFrame, reference: Column) -> DataFrame:
    """feature, mu, sigma over the reference rows of a long table; a spread of nothing counts as one."""
    s = rows.where(reference).groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))
    return s.withColumn("sigma", F.when(F.col("sigma") > 1e-9, F.col("sigma")).otherwise(1.0))


def auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """The share of pairs in the right order, ties half, from summed counts of equal scores. rows: p, y."""
    tied = rows.groupBy(*by, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    w = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tied.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    return ranked.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def calibration_error(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    b = rows.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def confusion(rows: DataFrame, by: list[str], tau: float) -> DataFrame:
    """fpr, tpr and precision of p >= tau; a null p never fires."""
    flag = F.coalesce(F.col("p") >= tau, F.lit(False))
    c = rows.groupBy(*by).agg(F.count_if(flag & (F.col("y") == 1)).alias("tp"), F.count_if(flag & (F.col("y") == 0)).alias("fp"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    part = lambda a, b: F.when(b > 0, a / b)
    return c.select(*by, "tp", "fp", "pos", "neg", part(F.col("fp"), F.col("neg")).alias("fpr"), part(F.col("tp"), F.col("pos")).alias("tpr"), part(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def fair_threshold(rows: DataFrame, most: float = MOST_FPR, least_rows: int = MIN_STRATUM) -> DataFrame:
    """tau: the smallest p at which no stratum of enough negatives has a higher false-positive rate; infinity if none.

    rows: p, y, stratum. For each stratum the rate only falls as p grows, so its own smallest p is enough, and the
    answer is the smallest p of all rows not below the strata's largest one.
    """
    neg = rows.where("y = 0 AND p IS NOT NULL")
    n = neg.groupBy("stratum").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    tied = neg.groupBy("stratum", "p").agg(F.count("*").alias("k")).join(n, "stratum")
    up = Window.partitionBy("stratum").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    bad = tied.withColumn("rate", F.sum("k").over(up) / F.col("n")).where(F.col("rate") > most).agg(F.max("p").alias("too_low"))
    best = rows.where("p IS NOT NULL").select("p").distinct().crossJoin(F.broadcast(bad)).where(F.col("too_low").isNull() | (F.col("p") > F.col("too_low")))
    return best.agg(F.coalesce(F.min("p"), F.lit(float("inf"))).alias("tau"))


def precision_at_priors(rates: DataFrame, priors: tuple[float, ...] = PRIORS) -> DataFrame:
    """rates (fpr, tpr, neg) times the priors, with the precision; a rate of 0 is bounded by 3 / n."""
    p = F.explode(F.array(*map(F.lit, priors)))
    fpr = F.when(F.col("fpr") == 0, 3.0 / F.col("neg")).otherwise(F.col("fpr"))
    r = rates.withColumn("prior", p).withColumn("fpr_used", fpr)
    return r.withColumn("precision_at_prior", F.col("prior") * F.col("tpr") / F.nullif(F.col("prior") * F.col("tpr") + (1 - F.col("prior")) * F.col("fpr_used"), F.lit(0.0)))


def stratum_rates(rows: DataFrame, tau: float) -> DataFrame:
    """The false-positive rate of each of a row's strata, and of ALL. rows: p, y, strata."""
    each = rows.withColumn("stratum", F.explode(F.concat(F.array(F.lit("ALL")), F.coalesce("strata", F.array().cast("array<string>")))))
    return confusion(each, ["stratum"], tau).select("stratum", "neg", "fp", "fpr")


def corpus_hash(rows: DataFrame, key: str, side: str, text_key: str) -> DataFrame:
    """One digest of the rows, whatever their order: rows are dealt to 16^5 parts by the key's hash; digests of sorted parts, of 256 groups of these, then of all."""
    line = F.concat_ws("|", F.col(key).cast("string"), side, F.sha2(F.col(text_key).cast("binary"), 256))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"), 256)
    p = rows.select(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 5).alias("part"), line.alias("line")).groupBy("part").agg(digest("line").alias("h"))
    q = p.groupBy(F.substring("part", 1, 2).alias("part2")).agg(digest(F.concat_ws(":", "part", "h")).alias("h"))
    return q.agg(digest(F.concat_ws(":", "part2", "h")).alias("corpus_hash"))


def head_by(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def sampled(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows whose hashed key is smallest; the same ones every time."""
    return rows.withColumn("_h", T.fnv1a_32(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def tally(rows: DataFrame, by: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """A row for each of `by` with the counts of the values, in their order."""
    return rows.groupBy(by).pivot(column, list(values)).count().fillna(0, list(values))


def headline(rows: DataFrame, by: list[str], least: int = 100, least_scored: int = 40) -> DataFrame:
    """Whether a slice has enough rows on both sides, and enough that were scored, to report on. rows: y, p."""
    c = rows.groupBy(*by).agg(F.count_if(F.col("y") == 1).alias("machine"), F.count_if(F.col("y") == 0).alias("human"), F.count("p").alias("scored"))
    return c.withColumn("status", F.when(F.least("machine", "human") < least, "INSUFFICIENT").when(F.col("scored") < least_scored, "NO COVERAGE").otherwise("OK"))


def paired_delta(rows: DataFrame, pair: str, variant: str, value: str, base: str, changed: str) -> DataFrame:
    """pair, before, after, delta of rows whose pair has both variants."""
    a = rows.where(F.col(variant) == base).groupBy(pair).agg(F.avg(value).alias("before"))
    b = rows.where(F.col(variant) == changed).groupBy(pair).agg(F.avg(value).alias("after"))
    return a.join(b, pair).withColumn("delta", F.col("after") - F.col("before"))


def standard_columns(rows: DataFrame, features: list[str], reference: Column, label: str = "y") -> DataFrame:
    """rows with each feature as (x - mu) / sigma within 3, of the human reference rows that have it; a missing value is 0."""
    ref = reference & (F.col(label) == 0)
    stats = rows.agg(*(F.avg(F.when(ref, F.col(f))).alias(f"mu_{f}") for f in features), *(F.stddev_samp(F.when(ref, F.col(f))).alias(f"sd_{f}") for f in features)).first()
    number = lambda x, otherwise: otherwise if x is None or x != x else float(x)
    each = {f: (number(stats[f"mu_{f}"], 0.0), sd if (sd := number(stats[f"sd_{f}"], 0.0)) > 1e-9 else 1.0) for f in features}
    return rows.withColumns({f: F.coalesce(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col(f) - mu) / sd)), F.lit(0.0)) for f, (mu, sd) in each.items()})


def fitted(rows: DataFrame, features: list[str], fit: Column, label: str = "y", dropped: tuple[str, ...] = ()) -> DataFrame:
    """rows with p by an L2 logistic model on columns standardised by the human rows of the fit side, fitted on that side.

    p is null if it has fewer than 30 rows or 10 human ones. dropped: features that the harder fit does without.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [f for f in features if f not in dropped]
    n = rows.where(fit).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("human"), F.count_if(F.col(label) == 1).alias("machine")).first()
    if n["n"] < 30 or n["human"] < 10 or not n["machine"]:
        return rows.withColumn("p", F.lit(None).cast("double"))
    wide = VectorAssembler(inputCols=names, outputCol="_x").transform(standard_columns(rows, names, fit, label))
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / n["n"], elasticNetParam=0.0, standardization=False, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred", maxIter=100).fit(wide.where(fit))
    return model.transform(wide).withColumn("p", vector_to_array("_p")[1]).drop("_x", "_p", "_raw", "_pred")


def calibrated(rows: DataFrame, fit: Column, label: str = "y", least: int = 20) -> DataFrame:
    """rows (p, label) with calibrated, rising with p, fitted on the rows of `fit` that have a p; p itself if they are too few."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    some = rows.where(fit & F.col("p").isNotNull())
    if some.limit(least).count() < least:
        return rows.withColumn("calibrated", F.col("p"))
    wide = lambda x: VectorAssembler(inputCols=["_q"], outputCol="_x").transform(x.withColumn("_q", F.coalesce("p", F.lit(0.0))))
    model = IsotonicRegression(featuresCol="_x", labelCol=label, predictionCol="_c").fit(wide(some))
    return model.transform(wide(rows)).withColumn("calibrated", F.when(F.col("p").isNotNull(), F.col("_c"))).drop("_x", "_q", "_c")


def sign_flips(coefficients: DataFrame, least: float = 0.05) -> DataFrame:
    """Features whose coefficient points against their direction. coefficients: feature, direction, coef."""
    sign = F.when(F.col("direction") == "llm", 1).otherwise(-1)
    return coefficients.where((F.abs("coef") > least) & (F.signum("coef") != sign))


def scrubbed(rows: DataFrame, key: str, least_rows: int = 15, allowed: tuple[str, ...] = ()) -> DataFrame:
    """key, text: references as [REF], long numbers as [NUM], words that few rows use as [NAME], and every word of a line after a cue.

    A word is known if at least `least_rows` rows use it, or by the fixed lists. Only the words that aren't known
    travel, to the row that has them.
    """
    t = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), REFERENCE, "[REF]"), LONG_NUMBER, "[NUM]")
    rows = T.barrier(rows.select(key, t.alias("text")))
    bare = F.regexp_replace("text", r"\[(?:REF|NUM)\]", " ")
    words = rows.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"\p{L}+"), F.lit(0)), plain_key))).alias("word")).where(~F.col("word").isin("", *ALLOWED, *SCRUB_STOP, *allowed))
    words = written(words)
    known = words.groupBy("word").agg(F.count_distinct(key).alias("n")).where(F.col("n") >= least_rows).select("word")
    unknown = words.join(sized(written(known)), "word", "left_anti").groupBy(key).agg(F.collect_set("word").alias("unknown"))
    met = rows.join(unknown, key, "left").withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))
    units = lambda x: F.regexp_extract_all(x, F.lit(r"\[(?:REF|NUM)\]|\p{L}+|[^\p{L}\[]+|\["), F.lit(0))
    hide = lambda x, always: F.array_join(F.transform(units(x), lambda u: F.when(u.rlike(r"^\p{L}") & (F.array_contains("unknown", plain_key(u)) | F.lit(always)), "[NAME]").otherwise(u)), "")

    def line(x: Column) -> Column:
        head = F.regexp_extract(x, rf"(?i)^(.*?{NAME_CUE})", 1)
        return F.when(head == "", hide(x, False)).otherwise(F.concat(hide(head, False), hide(F.substring(x, F.length(head) + 1, F.length(x)), True)))

    return met.select(key, F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


def left_numbers(rows: DataFrame) -> DataFrame:
    """Rows in which a long number has survived scrubbing; there must be none."""
    return rows.where(F.col("text").rlike(r"\d{10,15}"))


def split_leaks(rows: DataFrame, key: str, side: str, group: str) -> DataFrame:
    """What makes a split unsafe: keys, and groups, on more than one side (kind, n). A split with any is refused."""
    n = lambda by, kind: straddling(rows.withColumnRenamed(side, "side"), by).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(key, "key").unionByName(n(group, "group"))


def without_format(features: DataFrame, dropped: tuple[str, ...]) -> DataFrame:
    """The long table without features of format, for a harder fit."""
    return features.where(~F.col("feature").isin(*dropped))


def leave_one_out(rows: DataFrame, features: list[str], writer: str, tau: float, folds: int = 50) -> DataFrame:
    """writer, rows, flagged of every writer, each judged by a model that never saw them.

    Writers are dealt to `folds` folds by hash, and a model is fitted for each fold on the rows of all others: as many
    jobs as folds, whatever the number of writers. Up to `folds` writers, each has a fold of their own.
    """
    number = F.pmod(F.xxhash64(F.col(writer)), F.lit(folds))
    names = rows.select(writer).distinct().limit(folds + 1).collect()
    if len(names) <= folds:
        ranks = {r[writer]: i for i, r in enumerate(sorted(names, key=lambda r: (r[writer] is None, str(r[writer]))))}
        number = F.coalesce(*(F.when(F.col(writer).eqNullSafe(F.lit(k)), F.lit(i)) for k, i in ranks.items())) if ranks else F.lit(0)
        folds = max(1, len(ranks))
    dealt = written(rows.withColumn("_fold", number.cast("int")))
    out = [fitted(dealt, features, F.col("_fold") != k).where(F.col("_fold") == k).select(writer, "p") for k in range(folds)]
    each = out[0]
    for one in out[1:]:
        each = each.unionByName(one)
    return each.groupBy(writer).agg(F.count("*").alias("rows"), F.count_if(F.col("p") >= tau).alias("flagged"))


def shuffled_sentences(ctx: DataFrame, seed: int = 20260909) -> DataFrame:
    """ctx with the text of each document's sentences in another order, a control that style features shouldn't notice."""
    return ctx.withColumn("text", F.array_join(F.shuffle("sentences", seed), " "))


def flag_rate(rows: DataFrame, tau: float) -> DataFrame:
    """rows, flagged, bound: how many of rows that must not fire do; with none, 3 / n bounds the rate."""
    f = rows.agg(F.count("p").alias("rows"), F.count_if(F.col("p") >= tau).alias("flagged"))
    return f.withColumn("bound", F.when(F.col("flagged") == 0, 3.0 / F.nullif(F.col("rows"), F.lit(0))).otherwise(F.col("flagged") / F.nullif(F.col("rows"), F.lit(0))))


def segmenter_difference(ctx: DataFrame, oracle: str) -> DataFrame:
    """differ, mean_abs: how the number of sentences compares with a column of another segmenter's numbers."""
    d = F.abs(F.size("sentences") - F.col(oracle))
    return ctx.agg(F.avg((d > 0).cast("double")).alias("differ"), F.avg(d.cast("double")).alias("mean_abs"))


def expectations(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, passes, critical: verdicts and rules against what a fixture allows. expected: allowed, critical_failure, expect_rules (arrays)."""
    met = expected.join(found, key, "left")
    names = F.transform(F.coalesce("rules", F.array().cast("array<struct<name:string>>")), lambda r: r["name"])
    ok = F.array_contains("allowed", F.coalesce("verdict", F.lit("insufficient_text"))) & (F.size(F.array_except(F.coalesce("expect_rules", F.array().cast("array<string>")), names)) == 0)
    return met.select(key, ok.alias("passes"), F.coalesce(F.array_contains("critical_failure", F.col("verdict")), F.lit(False)).alias("critical"))


def labels_by_truth(rows: DataFrame) -> DataFrame:
    """bucket, truth and the number of rows under each label; `all` sums the buckets. rows: bucket, truth, label."""
    each = rows.groupBy("bucket", "truth", "label").count()
    whole = each.groupBy("truth", "label").agg(F.sum("count").alias("count")).select(F.lit("all").alias("bucket"), "truth", "label", "count")
    return each.unionByName(whole)


def only_side(rows: DataFrame, side: str = "test") -> DataFrame:
    """rows, if all are of that side; metrics of any other side raise."""
    if not rows.where(~F.col("side").eqNullSafe(F.lit(side))).isEmpty():
        raise ValueError(f"rows of another side than {side}")
    return rows


def genre_slice(rows: DataFrame, genre: str, validation: Column, judged: Column) -> DataFrame:
    """tau, picked again on the validation rows of a genre, and the confusion of the judged rows at it. rows: genre, p, y, stratum."""
    some = written(rows.where(F.col("genre") == genre))
    tau = fair_threshold(some.where(validation)).first()["tau"]
    return confusion(some.where(judged).withColumn("genre", F.lit(genre)), ["genre"], tau).withColumn("tau", F.lit(tau))
