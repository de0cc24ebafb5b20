r"""Personal data and the terms that give it away.

Base spans are matches of fixed patterns (email, ip, card, phone). The patterns here are the plain ones with
anchors and possessive repeats added, which give the same leftmost matches in linear time.

Terms are sanitised by information content. A protected entity is the value of a base span, the group that the value
belongs to (mail domain, first half of an address, issuer digits of a card, area of a phone number), or its kind. Its
information content is IC(e) = -log2 p(e), p by documents. A term t discloses the share PMI(t, e) / IC(e) of it, where
PMI = log2(p(e|t) / p(e)) and p(e|t) = (n(t, e) + SMOOTHING p(e)) / (n(t) + SMOOTHING): 1 would be a term that stands
in texts with the entity only, however many. Counts are over the different texts of the corpus, so copies count once,
and over whole texts: n(e), n(t, e) and n(t) are numbers of texts that hold the entity, both, and the term. The words
of every text are counted with 1/c for each of c equal rows and summed before anything is shuffled. A pair counts if
it stands in MIN_SUPPORT different texts and n(t, e) log2(n(t, e) n / (n(t) n(e))), the bits by which these texts are
less likely by chance, are EVIDENCE at least. A term has its largest share over entities. A term with a share of
REMOVE or more is removed, of GENERALISE or more replaced by a word class, wherever it stands in any text, with the
entity or without. Base spans stay as they are, and so do words inside them, which are no terms either.

Everything is a DataFrame operation. Pairs are made only where the numbers of texts of both sides leave a share of
GENERALISE possible (n(t, e) is at most the smaller one), which loses none. Texts are told by 128 bits of MD5.

Cases: a null or empty text has no spans; a null doc_id is kept; repeated texts count as one; spans are in code
points; a match of two kinds is a span of each; of equal shares any entity will do; a very long text takes time in
proportion to its length, and to the 4/3rd power of its matches; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, places, running
from .common import cut, sized, small, table, text_of

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: The group of a value, by kind: what a pattern finds in it.
GROUPS = {"email": "@.*$", "ip": r"^[0-9]+\.[0-9]+\.", "card": "^(?:[^0-9]*[0-9]){6}", "phone": r"^\+(?:[^0-9]*[0-9]){4}"}
MIN_SUPPORT, GENERALISE, REMOVE, SMOOTHING, EVIDENCE = 3, 0.7, 0.9, 1.0, 15.0
WORD = r"(?<!\p{L})\p{L}{3,40}+(?!\p{L})"

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits' check sum is right: from the right, every second digit doubled."""
    each = F.transform(F.split(F.reverse(_digits(m)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


PASSES = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start, then kind."""
    return F.array_sort(F.concat(*(_spans_of(text, n, kind) for n, kind in enumerate(PATTERNS))))


def _spans_of(text: Column, n: int, kind: str) -> Column:
    good = F.filter(places(text, PATTERNS[kind]), lambda x: PASSES[kind](x["value"]))
    spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))
    return F.when(text.rlike(HINTS[kind]), spans.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def entities(spans: Column) -> Column:
    """The protected entities of base spans: values, their groups, their kinds."""
    kind, low = (lambda x: x["kind"].cast("string")), (lambda x: F.lower(x["value"]))
    group = lambda x: F.call_function("regexp_extract", low(x), F.element_at(F.array(*map(F.lit, GROUPS.values())), x["kind"] + 1), F.lit(0))
    each = F.transform(spans, lambda x: F.array(kind(x), F.concat(kind(x), F.lit(":"), low(x)), F.concat(kind(x), F.lit("/"), group(x))))
    return F.array_distinct(F.flatten(each))


def _words(text: Column) -> Column:
    """The distinct words of a text, as they are written, without those inside addresses (no other base span has letters)."""
    bare = F.when(text.rlike(HINTS["email"]), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0)))


def _terms(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.transform(_words(text), F.lower))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_of().alias("text"), _key(text_of()).alias("text_key"))


def entity_texts(docs: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """text_key, entities (entity, n_e) of each different text with entities that stand in min_support texts or more."""
    hinted = _texts(docs).where(" OR ".join(f"text RLIKE r'{h}'" for h in HINTS.values()))
    e = cut(hinted.select("text_key", F.explode(entities(base_spans(F.col("text")))).alias("entity")).distinct())
    n = e.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_support)
    return cut(e.join(n, "entity").groupBy("text_key").agg(F.collect_list(F.struct("entity", "n_e")).alias("entities")))


def copies_of(docs: DataFrame) -> DataFrame:
    """text_key, copies: a row for each different text."""
    return cut(docs.select(_key(text_of()).alias("text_key")).groupBy("text_key").agg(F.count("*").alias("copies")))


def _parts(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """text, text_key, part: 1/c for each of c equal rows, so that sums are over different texts. copies: copies_of(docs)."""
    rows = _texts(docs).join(sized(cut(copies.where("copies > 1"))), "text_key", "left")
    return rows.select("text", "text_key", (1 / F.coalesce("copies", F.lit(1))).alias("part"))


def _texts_with(name: str) -> Column:
    return F.round(F.sum("part")).cast("long").alias(name)


def word_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_t: in how many different texts each of the terms (term, a cut table) stands. rows: _parts()."""
    words = rows.select(F.explode(_terms(F.col("text"))).alias("term"), "part")
    if small(terms):
        return words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(_texts_with("n_t"))
    return words.groupBy("term").agg(_texts_with("n_t")).join(terms, "term", "left_semi")


def disclosures(docs: DataFrame, min_support: int = MIN_SUPPORT, least: float = GENERALISE, smoothing: float = SMOOTHING, evidence: float = EVIDENCE) -> DataFrame:
    """term, share of the terms that disclose at least the share `least` of an entity: the largest one over entities."""
    told, copies = entity_texts(docs, min_support), copies_of(docs)
    n, rows = copies.count(), _parts(docs, copies)
    held = rows.join(sized(told), "text_key")
    terms = held.select(F.explode(_terms(F.col("text"))).alias("term"), "part").groupBy("term").agg(_texts_with("texts"))
    n_t = sized(cut(word_counts(rows, cut(terms.where(F.col("texts") >= min_support).select("term")))))
    words = held.select("entities", "part", F.explode(_terms(F.col("text"))).alias("term")).join(n_t, "term")
    possible = lambda e: (e["n_e"] < n) & (F.log2(n / F.col("n_t")) >= least * F.log2(n / e["n_e"]) - 1e-9)
    pairs = words.select("term", "n_t", "part", F.explode(F.filter("entities", possible)).alias("e")).groupBy("term", "n_t", "e.entity", "e.n_e").agg(_texts_with("n_te"))
    p, n_te, t = F.col("n_e") / n, F.col("n_te"), F.col("n_t")
    share = F.log2((n_te + smoothing * p) / (t + smoothing) / p) / -F.log2(p)
    sure = (n_te >= min_support) & (n_te * F.log2(n_te / (t * p)) >= evidence)
    found = pairs.where(sure).select("term", share.alias("share")).where(F.col("share") >= least)
    return cut(found.groupBy("term").agg(F.max("share").alias("share")))


def find(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """doc_id, text, base, terms of every row. how: parameters of disclosures().

    base: the base spans; terms: struct(start, end, share) of terms to sanitise, by start.
    """
    told = sized(disclosures(docs, **how))
    words = _texts(docs).select("text_key", F.explode(_words(F.col("text"))).alias("word"))
    hits = words.join(told, F.lower("word") == F.col("term")).groupBy("text_key").agg(F.collect_set(F.struct("word", "share")).alias("words"))
    hits = sized(cut(hits.select("text_key", F.col("words.word").alias("words"), F.map_from_entries("words").alias("shares"))))
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _key(text).alias("text_key"), base_spans(text).alias("base"))
    rows = rows.join(hits, "text_key", "left")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    every = F.transform(places(F.col("text"), pattern), lambda x: F.struct(x["start"], x["end"], F.element_at("shares", x["value"]).alias("share")))
    free = F.filter(every, lambda x: ~F.exists("base", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])))
    none = F.array().cast("array<struct<start:int,end:int,share:double>>")
    return rows.select("doc_id", "text", "base", F.when(F.col("words").isNotNull(), free).otherwise(none).alias("terms"))


def sanitised(base: Column, terms: Column, text: Column, remove: float = REMOVE) -> Column:
    """The text with spans replaced: [KIND], [WORD] or nothing for terms. Of overlapping spans the first one is replaced, and all that they cover goes."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    each = F.concat(
        F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(names, x["kind"] + 1).alias("by"))),
        F.transform(terms, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["share"] >= remove, F.lit("")).otherwise(F.lit("[WORD]")).alias("by"))),
    )

    def replaced(spans: Column) -> Column:
        covered = running(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
        new = lambda x, at: F.concat(F.substring(text, at + 1, x["start"] - at), x["by"])
        pieces = F.zip_with(spans, covered, lambda x, at: F.when(x["start"] >= at, new(x, at)).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.coalesce(F.array_max(F.transform(spans, lambda x: x["end"])), F.lit(0)) + 1, F.length(text)))

    return F.when(F.size(base) + F.size(terms) > 0, let(F.array_sort(each), replaced)).otherwise(text)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long")
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end"), F.lit("").alias("value")))
    every = F.array_sort(F.concat("base", terms.cast(f"array<{SPAN}>")))
    removed = F.size(F.filter("terms", lambda x: x["share"] >= REMOVE)).cast("long")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:4])]
    new = F.sha2(sanitised(F.col("base"), F.col("terms"), F.col("text")).cast("binary"), 256)
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("terms").cast("long").alias("n_term"), removed.alias("n_removed"), (F.size("terms") - removed).alias("n_generalised"), new.alias("sanitised_sha256"))
