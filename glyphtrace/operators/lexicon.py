"""Phrase lexicons: compiling, matching, and which of overlapping matches count.

The places of phrases' first words in a text meet the phrases by that word, and a candidate is then compared with the
text itself. A lexicon that is counted to be small is a map in the plan, so that matching is a column; a large one is
a table, joined with the words of the texts (by broadcast if it is counted to be small enough for that).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from ..functions import text as T
from ..functions.tables import sized, written

# What a row of a lexicon may say.
TAGS = ("strong", "weak")
DOMAINS = ("general", "cs", "travel", "email", "marketing", "essay", "content", "formal", "tech")
FLAGS = ("-", "initial")
GAP, GAP_MOST = "…", 60
HIT = "array<struct<phrase:string,lang:string,kind:string,tag:string,domain:string,start:int,end:int>>"
#: First words that are searched for by one pattern.
MOST_HEADS = 64
#: Phrases of a lexicon that is put into the plan.
MOST_PHRASES = 1_000
#: Words at the beginning of a phrase that a text is asked for, where phrases are many.
MOST_WORDS = 4
#: A first word, in phrases and texts alike; hyphens and apostrophes end it, the whole phrase is compared afterwards.
HEAD = r"[\p{L}\p{M}]+"
#: What no phrase has behind it.
BOUND = r"(?![\p{L}\p{M}\p{Nd}_])"
_STARTS = r"(?:^|[.!?\x{2026}\x{061F}\x{06D4}:\n])[\s\"'\x{201C}\x{2018}\x{00AB}*•-]*$"


def compile_lines(lines: DataFrame, lang: str, kind: str) -> DataFrame:
    """phrase, lang, kind, tag, domain, flag, problem of the rows `phrase | tag | domain | flags | note`; comments and blank lines go."""
    parts = F.transform(F.split("value", r"\|", -1), lambda x: F.trim(x))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select(parts.alias("p"))
    at = lambda i: F.get(F.col("p"), F.lit(i))
    rows = rows.select(T.folded(at(0), F.lit(lang)).alias("phrase"), F.lit(lang).alias("lang"), F.lit(kind).alias("kind"), at(1).alias("tag"), at(2).alias("domain"), F.coalesce(at(3), F.lit("-")).alias("flag"))
    if lang == "tr":  # a bare capital I folds to the dotless letter
        dotless = rows.where(F.col("phrase").startswith("i")).withColumn("phrase", F.concat(F.lit("ı"), F.substring("phrase", 2, 1_000)))
        rows = rows.unionByName(dotless)
    return rows.withColumn("problem", F.when(F.col("phrase") == "", "phrase").when(~F.col("tag").isin(*TAGS), "tag").when(~F.col("domain").isin(*DOMAINS), "domain").when(~F.col("flag").isin(*FLAGS), "flag"))


def repeated(lexicon: DataFrame) -> DataFrame:
    """Phrases that stand more than once for a language and kind; such a lexicon is refused."""
    return lexicon.groupBy("lang", "kind", "phrase").agg(F.count("*").alias("n")).where("n > 1")


def _end_of(cut: Column, c: Column) -> Column:
    tail = T.part(cut, c["start"], F.length(c["phrase"]) + GAP_MOST)
    # the phrase's parts around a gap may be up to GAP_MOST characters apart
    left, right = F.trim(F.substring_index(c["phrase"], GAP, 1)), F.trim(F.substring_index(c["phrase"], GAP, -1))

    def end(t: Column) -> Column:
        gap = F.call_function("locate", right, F.substring(t, F.length(left) + 1, GAP_MOST + F.length(right)))
        split = F.when(t.startswith(left) & (gap > 0) & (gap <= GAP_MOST + 1), c["start"] + F.length(left) + gap - 1 + F.length(right))
        return F.when(c["phrase"].contains(GAP), split).when(t.startswith(c["phrase"]), c["start"] + F.length(c["phrase"]))

    return T.let(tail, end)


def _matched(folded: Column, some: Column) -> Column:
    """HIT of the candidates (start, phrase, lang, kind, tag, domain, flag) that the text has there."""

    def good(cut: Column, c: Column) -> Column:
        before = T.part(cut, F.greatest(c["start"] - 40, F.lit(0)), F.least(c["start"], F.lit(40)))
        bounded = ~T.part(cut, c["end"], F.lit(1)).rlike(r"[\p{L}\p{M}\p{Nd}_]")
        return c["end"].isNotNull() & bounded & ((c["flag"] != "initial") | c["phrase"].contains(GAP) | before.rlike(_STARTS))

    def of(cut: Column) -> Column:
        ended = F.transform(some, lambda c: c.withField("end", _end_of(cut, c)))
        return F.transform(F.filter(ended, lambda c: good(cut, c)), lambda c: F.struct(*(c[n].alias(n) for n in ("phrase", "lang", "kind", "tag", "domain", "start", "end"))))

    return T.let(T.pieces(folded), of).cast(HIT)


def _headed(lexicon: DataFrame) -> DataFrame:
    """lexicon with head, the phrase's first word; phrases without a letter have none and go."""
    return lexicon.withColumn("head", F.regexp_extract("phrase", HEAD, 0)).where("head <> ''")


def _tree(words: list[str]) -> str:
    """A pattern of the words, by their common beginnings, so that a place of the text is left at the first letter that none has."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(words):
        by_first.setdefault(w[:1], []).append(w[1:])
    ends = by_first.pop("", None) is not None
    each = "|".join(re.escape(c) + _tree(rest) for c, rest in by_first.items())
    return "" if not each else f"(?:{each})" + ("?" if ends else "")


def _pattern(heads: list[str]) -> str:
    return rf"(?<![\p{{L}}\p{{M}}]){_tree(heads) or '(?!)'}(?![\p{{L}}\p{{M}}])"


def in_columns(lexicon: DataFrame) -> Callable[[Column], Column] | None:
    """A function from a folded text to its matches (array of HIT), all in columns; null for a lexicon that is counted to be larger than MOST_PHRASES or MOST_HEADS."""
    fields = ("phrase", "lang", "kind", "tag", "domain", "flag")
    alone: dict[str, list] = {}
    longer: dict[str, list] = {}
    rows = _headed(lexicon).select("head", *fields).limit(MOST_PHRASES + 1).collect()
    for r in rows:
        # a phrase that is its first word is matched where that stands, and isn't compared with the text again
        of = alone if r["phrase"] == r["head"] and r["flag"] not in (None, "initial") else longer
        of.setdefault(r["head"], []).append({n: r[n] for n in fields})
    if len(rows) > MOST_PHRASES or len(alone.keys() | longer.keys()) > MOST_HEADS:
        return None

    def found(folded: Column, by_head: dict[str, list], after: str, item: Callable[[Column, Column], Column]) -> Column:
        known = F.from_json(F.lit(json.dumps(by_head)), f"map<string,array<struct<{','.join(f'{n}:string' for n in fields)}>>>")
        each = lambda w: F.transform(F.element_at(known, w["value"]), lambda c: item(w, c))
        return F.flatten(F.transform(T.places(folded, _pattern(list(by_head)) + after), each))

    def hits(folded: Column) -> Column:
        whole = lambda w, c: F.struct(*(c[n].alias(n) for n in fields[:-1]), w["start"].alias("start"), w["end"].alias("end"))
        start = lambda w, c: F.struct(w["start"].alias("start"), *(c[n].alias(n) for n in fields))
        kinds = [found(folded, alone, BOUND, whole).cast(HIT)] if alone else []
        kinds += [_matched(folded, found(folded, longer, "", start))] if longer else []
        return F.concat(*kinds) if kinds else F.array().cast(HIT)

    return hits


def _led(lexicon: DataFrame) -> DataFrame:
    """lexicon with head, the first words of the phrase that stand next to each other, and n, how many; of a phrase with a gap, which may end within a word, at most two."""
    run = lambda most: F.regexp_extract("phrase", rf"^{HEAD}(?:[^\p{{L}}\p{{M}}{GAP}]{HEAD}){{0,{most - 1}}}", 0)
    lead = F.when(F.col("phrase").contains(GAP), run(2)).otherwise(run(MOST_WORDS))
    return lexicon.withColumn("head", F.regexp_replace(lead, r"[^\p{L}\p{M}]", " ")).withColumn("n", F.size(F.split("head", " ")))


def _runs(words: Column, n: int) -> Column:
    """i and value of each run of n words; those that the text has more than one character between are compared with it later."""
    run = lambda w, i: w if n == 1 else F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " "))
    return F.transform(words, lambda w, i: F.struct(i.alias("i"), run(w, i).alias("value")))


def candidates(texts: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """key, phrase, lang, kind, tag, domain, start, end of each match. texts: key, folded."""
    row = _headed(lexicon)
    heads = [r["head"] for r in row.select("head").distinct().limit(MOST_HEADS + 1).collect()]
    fields = ("phrase", "lang", "kind", "tag", "domain", "flag")
    if len(heads) <= MOST_HEADS:
        places = T.places(F.col("folded"), _pattern(heads))
        word = texts.select(key, F.explode_outer(places).alias("w")).select(key, "w.start", "w.value").where("value IS NOT NULL")
        place, start = F.col("start"), lambda c, _: c["start"]
    else:
        # the words that a phrase begins with and those of the text meet by their numbers, not every use of a common word
        row = _led(row)
        lengths = sorted(r["n"] for r in row.select("n").distinct().collect())
        words = T.barrier(texts.select(key, F.regexp_extract_all("folded", F.lit(HEAD), F.lit(0)).alias("w")))
        word = words.select(key, F.explode_outer(F.flatten(F.array(*(_runs(F.col("w"), n) for n in lengths)))).alias("w")).select(key, "w.i", "w.value").where("value IS NOT NULL")
        # where words stand is asked of texts that have candidates only
        place, start = F.col("i"), lambda c, at: F.get(at, c["i"])["start"]
    # words and candidates travel without their texts, which the candidates then meet once
    met = word.join(sized(row), F.col("value") == F.col("head"))
    some = written(met.groupBy(key).agg(F.collect_list(F.struct(place, *fields)).alias("_some")))
    found = T.barrier(texts.select(key, "folded").join(sized(some), key))
    begun = lambda at: F.transform("_some", lambda c: F.struct(start(c, at).alias("start"), *(c[n].alias(n) for n in fields)))
    begun = begun(None) if len(heads) <= MOST_HEADS else T.let(T.places(F.col("folded"), HEAD), begun)
    hits = found.select(key, _matched(F.col("folded"), F.filter(begun, lambda c: c["start"].isNotNull())).alias("_hits"))
    return hits.select(key, F.explode_outer("_hits").alias("h")).where("h IS NOT NULL").select(key, "h.*")


@F.pandas_udf(ArrayType(BooleanType()))
def _free(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Which of the spans, in their order, meet none that was kept before: a byte for each place of the text that is taken."""

    def of(a, b) -> list[bool] | None:  # noqa: ANN001
        if a is None:
            return None
        taken, out = bytearray(max(b, default=0)), []
        for s, e in zip(a.tolist(), b.tolist(), strict=True):
            out.append(taken.find(1, s, e) < 0)
            if out[-1]:
                taken[s:e] = b"\1" * (e - s)
        return out

    return pd.Series([of(a, b) for a, b in zip(starts, ends, strict=True)])


def resolved(df: DataFrame, hits: str) -> DataFrame:
    """df with lexicon_hits: of its column of HIT arrays, longest first, then leftmost, then by phrase; what overlaps a kept one goes.

    Only arrays in which neighbours overlap, in the order of their starts, go through Python.
    """
    item = lambda x: F.struct((x["start"] - x["end"]).alias("neg"), x["start"].alias("start"), x["end"].alias("end"), *(x[n].alias(n) for n in ("phrase", "lang", "kind", "tag", "domain")))
    by_start = F.sort_array(F.transform("_ordered", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    meets = T.let(by_start, lambda xs: F.exists(F.zip_with(xs, F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: a["end"] > b["start"]), lambda x: F.coalesce(x, F.lit(False))))
    df = T.barrier(df.withColumn("_ordered", T.sorted_distinct(F.transform(hits, item))))
    df = T.barrier(df.withColumn("_some", F.when(meets, F.col("_ordered"))))
    df = T.barrier(df.withColumn("_free", _free(F.transform("_some", lambda x: x["start"]), F.transform("_some", lambda x: x["end"]))))
    left = F.when(F.col("_free").isNull(), F.col("_ordered")).otherwise(F.filter("_ordered", lambda x, i: F.get(F.col("_free"), i)))
    bare = F.transform(left, lambda x: F.struct(x["phrase"], x["lang"], x["kind"], x["tag"], x["domain"], x["start"], x["end"])).cast(HIT)
    return T.barrier(df.withColumn("lexicon_hits", bare).drop("_ordered", "_some", "_free"))


def kept(hits: DataFrame, key: str) -> DataFrame:
    """key, lexicon_hits: those of resolved()."""
    item = F.struct("phrase", "lang", "kind", "tag", "domain", "start", "end")
    every = hits.groupBy(key).agg(F.collect_set(item).cast(HIT).alias("_h"))
    return resolved(every, "_h").select(key, "lexicon_hits")


def with_hits(ctx: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """ctx with lexicon_hits of its language, on the folded text and on its copy without look-alikes.

    Overlaps are resolved before other languages' hits go. In customer service, machine phrases of that domain go.
    """
    inline, plain = in_columns(lexicon), T.fold_confusables(F.col("folded"))
    if inline is not None:
        ctx = T.barrier(ctx.withColumn("_plain", F.when(F.col("folded").rlike(r"[\x{0370}-\x{10FFFF}]"), plain)))
        both = F.concat(inline(F.col("folded")), F.coalesce(F.when(F.col("_plain") != F.col("folded"), inline(F.col("_plain"))), F.array().cast(HIT)))
        ctx = T.barrier(ctx.withColumn("_all", both))
        out = resolved(ctx, "_all").drop("_plain", "_all")
    else:
        texts = ctx.select(key, "folded")
        others = texts.withColumn("_plain", plain).where("_plain <> folded").select(key, F.col("_plain").alias("folded"))
        out = ctx.join(kept(candidates(texts, lexicon, key).unionByName(candidates(others, lexicon, key)), key), key, "left")
    hits = F.coalesce("lexicon_hits", F.array().cast(HIT))
    lang = F.when(F.col("language") == "tr", "tr").otherwise("en")
    served = F.col("domain") == "customer_service"
    return out.withColumn("lexicon_hits", F.filter(hits, lambda h: (h["lang"] == lang) & ~(served & (h["kind"] == "llm") & (h["domain"] == "cs"))))


def without_hits(ctx: DataFrame) -> DataFrame:
    """ctx with no hits, for a pipeline without a lexicon."""
    return ctx.withColumn("lexicon_hits", F.array().cast(HIT))
