"""Column functions over text: views, tokens, lines, paragraphs, sentences, hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and marks of the text model.
TATWEEL = "ـ"
TASHKEEL = "[ً-ٰٟ]"
ALEF_FORMS = "أإآٱ"
APOSTROPHES = "’‘ʼ´`"
# ASCII is passed by two ranges
MARKED = rf"[\x60\x{{80}}-\x{{10FFFF}}&&[{ALEF_FORMS}{APOSTROPHES}{TATWEEL}{TASHKEEL}]]"
# runs of ASCII are passed by plain ranges; the classes of Unicode are asked for what is left
WORD = r"(?:[A-Za-z]|[\p{L}\p{M}&&[^\x{0640}]])[A-Za-z'-]*+(?:[\p{L}\p{M}\x{0640}'\x{2019}-]++[A-Za-z'-]*+)*+"
NUMBER = r"\p{Nd}[\p{Nd}.,:\x{066B}\x{066C}]*"
TERMINALS = r"[.!?\x{061F}\x{06D4}]"
# Letters that look like Latin ones, with what they look like.
CONFUSABLES_FROM = "аеорсухіјѕкмнвгАВЕКМНОРСТХІЈЅУαονρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
CONFUSABLES_TO = "aeopcyxijskmhbrABEKMHOPCTXIJSYaovpuxABEZHIKMNOPTYX"
# Abbreviations that a full stop doesn't end a sentence after.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "st", "no", "vs", "etc", "inc", "ltd", "approx", "dept", "fig", "vol", "p", "pp",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "mon", "tue", "wed", "thu", "fri", "sat", "sun",
    "doç", "doc", "sn", "av", "vb", "örn", "orn", "bkz", "yy", "tl", "cad", "sok", "mah", "apt", "bl", "tel", "fax", "faks",
)


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfc(text: Column) -> Column:
    """The NFC form; only texts with code points from U+0300 on go through Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[\x{0300}-\x{10FFFF}]"), text)), text)


#: What NFKC may change; the other characters below U+0180 stay as they are, whatever stands beside them.
NOT_NFKC = r"[\xA0\xA8\xAA\xAF\xB2-\xB5\xB8-\xBA\xBC-\xBE\x{0132}\x{0133}\x{013F}\x{0140}\x{0149}\x{017F}\x{0180}-\x{10FFFF}]"


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(text.rlike(NOT_NFKC), text)), text)


def case_fold(text: Column, lang: Column | None = None) -> Column:
    """Lower case, Turkish where lang is 'tr'; a dotted i is one letter."""
    plain = F.lower(text)
    if lang is not None:
        turkish = F.lower(F.translate(text, "Iİ", "ıi"))
        plain = F.when(lang == "tr", turkish).otherwise(plain)
    return F.replace(plain, F.lit("i̇"), F.lit("i"))


def matching_marks(text: Column) -> Column:
    """For matching only: one alef, no tatweel or vowel marks, one apostrophe. Texts that have none of these are passed."""
    unified = F.translate(text, ALEF_FORMS + APOSTROPHES + TATWEEL, "ا" * len(ALEF_FORMS) + "'" * len(APOSTROPHES))
    return F.when(text.rlike(MARKED), F.regexp_replace(unified, TASHKEEL, "")).otherwise(text)


def folded(text: Column, lang: Column | None = None) -> Column:
    """The view that lexicons and rules match on. text: in NFC."""
    return case_fold(matching_marks(text), lang)


#: Characters that folding drops, makes more than one or folds by what stands beside them; any other is folded to one, wherever it stands.
UNEVEN = r"[\x{0640}\x{064B}-\x{065F}\x{0670}\x{0130}\x{0307}\x{03A3}]"


def fold_map(text: Column, lang: Column | None = None) -> Column:
    """For each code point of folded(text, lang), the place of the one in text that it comes from; null if folding one by one gives another text.

    Runs between UNEVEN characters keep their places; only those characters are folded on their own.
    """
    run = lambda start, end: F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    whole, ended = F.char_length(text), lambda xs, i: F.coalesce(F.get(xs, i - 1)["end"], F.lit(0))

    def pieced(x: Column) -> Column:
        odd, gaps = x["odd"], x["gaps"]
        alone = F.array_join(F.transform(odd, lambda o, i: F.concat(folded(gaps[i], lang), folded(o["value"], lang))), "")
        at = F.flatten(F.transform(odd, lambda o, i: F.concat(run(ended(odd, i), o["start"]), F.array_repeat(o["start"], F.length(folded(o["value"], lang))))))
        same = F.concat(alone, folded(F.element_at(gaps, -1), lang)) == folded(text, lang)
        return F.when(same, F.concat(at, run(ended(odd, F.size(odd)), whole)))

    few = let(F.struct(places(text, UNEVEN).alias("odd"), F.split(text, UNEVEN, -1).alias("gaps")), pieced)
    return F.when(text.rlike(UNEVEN), few).otherwise(run(F.lit(0), whole))


def fold_confusables(text: Column) -> Column:
    """Look-alikes, full-width ASCII and mathematical letters as plain ones."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    source, target = CONFUSABLES_FROM + wide, CONFUSABLES_TO + "".join(chr(ord(c) - 0xFEE0) for c in wide)
    for point in range(0x1D400, 0x1D800):
        plain = unicodedata.normalize("NFKC", chr(point))
        if len(plain) == 1 and plain != chr(point):
            source += chr(point)
            target += target[source.index(plain)] if plain in source else plain
    return F.translate(text, source, target)


def homoglyph_units(text: Column) -> Column:
    """The white-space units that mix scripts, or hold full-width or mathematical letters."""
    scripts = ("IsLatin", "IsCyrillic", "IsGreek", "IsArabic", "IsHan", "IsHebrew")

    def odd(unit: Column) -> Column:
        kinds = sum((unit.rlike(rf"\p{{{s}}}").cast("int") for s in scripts), F.lit(0))
        return (kinds > 1) | unit.rlike(r"[\x{FF00}-\x{FFEF}\x{1D400}-\x{1D7FF}]")

    return F.filter(F.split(text, r"\s+", -1), odd)


def count_of(text: Column, others: str) -> Column:
    """How many code points a text has besides those of a class: what is left without them, as a list of matches would have a string for each."""
    return F.char_length(F.regexp_replace(text, f"{others}+", ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lower_words(text: Column) -> Column:
    """The words in lower case; the text is lowered once, but for a capital sigma, whose small form goes by what its word has after it."""
    return F.when(text.contains("Σ"), F.transform(words(text), F.lower)).otherwise(words(F.lower(text)))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def lines(text: Column) -> Column:
    # a line feed alone is found without a pattern
    return F.when(text.contains("\r"), F.split(text, r"\r?\n", -1)).otherwise(F.split(text, "\n", -1))


def lines_with_words(text: Column) -> Column:
    return F.filter(lines(text), lambda x: x.rlike(WORD))


def paragraphs(text: Column) -> Column:
    """Runs of lines that aren't blank."""
    some = F.when(text.contains("\r"), F.split(text, r"\r?\n(?:[^\S\n]*\r?\n)+", -1)).otherwise(F.split(text, r"\n(?:[^\S\n]*\n)+", -1))
    return F.filter(some, lambda p: p.rlike(r"\S"))


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens; none if there are fewer."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def length_bucket(n: Column) -> Column:
    return F.when(n < 20, "<20").when(n < 50, "20-49").when(n < 150, "50-149").when(n < 500, "150-499").otherwise("500+")


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the characters' code points (the UTF-16 units of texts in the basic plane)."""
    # FNV's fixed values: offset basis and prime
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: ((h.bitwiseXOR(c)) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), the value computed once: Spark folds an expression into each place of a lambda that uses it."""
    return F.transform(F.array(value), body)[0]


def sorted_distinct(xs: Column) -> Column:
    """The elements in order, each once; neighbours are compared, where array_distinct() compares all structs with all."""
    return let(F.sort_array(xs), lambda v: F.filter(v, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(v, i - 1))))


def running(xs: Column, op, zero: Column) -> Column:  # noqa: ANN001
    """For each element, op over the elements before it; zero for the first.

    Two levels of blocks of about the cube root of the size, so that the work is n^(4/3) where a fold that appends to
    an array copies n^2 elements.
    """
    over = lambda ys, first: F.aggregate(ys, first, op)
    size = lambda v: F.greatest(F.lit(8), F.ceil(F.cbrt(F.size(v).cast("double")))).cast("int")

    def blocks(v: Column) -> Column:
        n = size(v)
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / n).cast("int")), lambda i: F.slice(v, i * n + 1, n))

    def joined(bs: Column) -> Column:
        return let(F.transform(bs, lambda b: over(b, zero)), lambda sums: F.flatten(F.zip_with(bs, F.transform(sums, lambda _, i: over(F.slice(sums, F.lit(1), i), zero)), lambda b, first: F.transform(b, lambda _, j: over(F.slice(b, F.lit(1), j), first)))))

    return let(xs, lambda v: let(blocks(v), joined))


#: Stand around a match while a text is split there, and what such a character of the text itself is told as.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"


def places(text: Column, pattern: str | Column) -> Column:
    """start, end and value of each match, in code points: what lies between matches adds up to the starts.

    The pattern, which matches no empty text, runs over the text once: matches are marked, and the text split there.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    item = lambda start, m: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

    def summed(ps: Column) -> Column:
        # pieces are in turn a gap and a match; a match starts after all pieces before it
        steps = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(ps) / 2).cast("int") - 1, F.lit(0))), lambda i: F.length(ps[i * 2]) + F.length(F.get(ps, i * 2 + 1)))
        starts = lambda n: F.transform(running(steps, lambda a, x: a + x, F.lit(0)), lambda at, i: item(at + F.length(ps[i * 2]), ps[i * 2 + 1]))
        return F.when(F.size(ps) > 1, starts(ps)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))

    # marks that the text itself has stand as another character of the same kind
    own = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, OTHER * 2)).otherwise(text)
    marked = F.regexp_replace(own, pattern, F.lit(f"{OPEN}$0{CLOSE}"))
    return F.when(text.isNotNull(), let(F.split(marked, f"[{OPEN}{CLOSE}]", -1), summed))


#: Characters of a piece that a text is cut into where many parts of it are read.
PIECE = 512


def pieces(text: Column) -> Column:
    """The text in pieces, so that part() needn't walk it from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, length: Column) -> Column:
    """The substring of pieces() from a place (from 0) on."""
    some = F.slice(cut, F.floor(start / PIECE).cast("int") + 1, F.floor(length / PIECE).cast("int") + 2)
    return F.substring(F.array_join(some, ""), F.pmod(start, F.lit(PIECE)) + 1, length)


def inside_quotes(prefix: Column) -> Column:
    """Whether the text before its last character leaves a quotation open; an apostrophe between letters is none."""
    bare = F.regexp_replace(prefix, r"(?<=\p{L})['\x{2019}](?=\p{L})", "")
    marks = F.regexp_extract_all(F.substring(bare, F.lit(1), F.greatest(F.length(bare) - 1, F.lit(0))), F.lit("[\"'\u201c\u201d\u00ab\u00bb\u2018\u2019]"), F.lit(0))

    def step(open_: Column, m: Column) -> Column:
        double = F.when(m == '"', ~open_["double"]).when(m.isin("\u201c", "\u00ab"), True).when(m.isin("\u201d", "\u00bb"), False).otherwise(open_["double"])
        single = F.when(m == "'", ~open_["single"]).when(m == "\u2018", True).when(m == "\u2019", False).otherwise(open_["single"])
        return F.struct(double.alias("double"), single.alias("single"))

    state = F.aggregate(marks, F.struct(F.lit(False).alias("double"), F.lit(False).alias("single")), step)
    return state["double"] | state["single"]


def one_space(text: Column, lang: Column | None = None) -> Column:
    """White space runs as one space, then folded."""
    return folded(F.regexp_replace(text, r"(?U)\s+", " "), lang)


def barrier(df):  # noqa: ANN001, ANN201
    """df, its columns computed once: what is built on it isn't folded into them. Partitions stay as they are."""
    return df.coalesce(1_000_000)
