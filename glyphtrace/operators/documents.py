"""The context of a document: views, language, shape, tokens, lines, paragraphs, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import text as T
from ..functions.segment import SUSPECT, segmented

# The closed sets of the options.
OPTIONS = {
    "shape": ("auto", "chat", "prose"),
    "lang": ("auto", "en", "tr"),
    "channel": ("whatsapp", "web", "email", "form", "unknown"),
    "genre": ("auto", "review", "email", "chat", "essay", "formal_letter", "marketing"),
    "domain": ("general", "customer_service"),
}
PRESETS = {"essay": {"shape": "prose", "genre": "essay", "lang": "en"}}
MARKDOWN = {
    "header": r"(?m)^\s{0,3}#{1,6}\s+\S",
    "double_asterisk_bold": r"\*\*[^*\n]{2,80}\*\*",
    "code_fence": r"(?m)^\s{0,3}```",
    "pipe_table": r"(?m)^\s{0,3}\|.*\|",
}
BULLET = r"(?m)^\s{0,3}[-*+]\s+\S"
BULLET_BOLD = r"(?m)^\s{0,3}[-*+]\s*\*\*[^*\n]{2,60}\*\*"


def check_options(options: dict[str, str]) -> dict[str, str]:
    """The options with a preset's values filled in; unknown names or values raise ValueError."""
    options = dict(options)
    for name, value in PRESETS.get(options.pop("preset", None), {}).items():
        if options.get(name, "auto") == "auto":
            options[name] = value
    for name, value in options.items():
        if name not in OPTIONS or value not in OPTIONS[name]:
            raise ValueError(f"{name}={value!r}; {name} is one of {OPTIONS.get(name)}")
    return options


def markdown_kinds(raw: Column) -> Column:
    """The kinds of markdown in a text."""
    kinds = [F.when(raw.rlike(p), F.lit(k)) for k, p in MARKDOWN.items()]
    kinds.append(F.when((F.regexp_count(raw, F.lit(BULLET)) >= 2) & raw.rlike(BULLET_BOLD), F.lit("bullets_with_bold_lead_in")))
    return F.filter(F.array(*kinds), lambda k: k.isNotNull())


def shape_of(given: Column, channel: Column, chars: Column, n_lines: Column, markdown: Column) -> Column:
    chat = ((chars < 400) & (n_lines <= 4) & (F.size(markdown) == 0)) | (channel == "whatsapp")
    return F.when(given.isin("chat", "prose"), given).when(chat, "chat").otherwise("prose")


def genre_of(given: Column, shape: Column, channel: Column) -> Column:
    named = given.isNotNull() & (given != "auto")
    return F.when(named, given).when(shape == "chat", "chat").when(channel == "email", "email").otherwise("unspecified")


def cell_of(language: Column, shape: Column) -> Column:
    return F.concat(F.when(language.isin("en", "tr"), language).otherwise(F.lit("en")), F.lit(":"), shape)


def context(df: DataFrame, options: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """df with the context's columns. A column of df named like an option and not null overrides the option."""
    options = check_options(options or {})

    def option(name: str, otherwise: str) -> Column:
        fixed = F.lit(options.get(name, otherwise))
        return F.coalesce(F.col(name), fixed) if name in df.columns else fixed

    given = {n: option(n, o) for n, o in (("shape", "auto"), ("channel", "unknown"), ("genre", "auto"), ("domain", "general"))}
    # lang is an option of the rows only where the caller names it so: tables have a lang of their own
    lang = F.lit(options.get("lang", "auto"))
    df = df.withColumns({f"_{n}": c for n, c in given.items()})
    df = df.withColumn("raw", F.coalesce(F.col(text), F.lit(""))).withColumn("nfc", T.nfc(F.col("raw")))
    df = T.barrier(df.withColumn("tokens", T.words(F.col("nfc"))))
    df = T.barrier(df.withColumn("lower", T.lower_words(F.col("nfc"))))
    df = L.identify(df).withColumn("language", F.when(lang != "auto", lang).otherwise(F.col("language")))
    df = df.withColumns({
        "chars": F.char_length("raw"), "bytes": F.octet_length("raw"), "n_tokens": F.size("lower"),
        "lines": T.lines(F.col("raw")), "paragraphs": T.paragraphs(F.col("raw")), "markdown": markdown_kinds(F.col("raw")),
        "folded": T.folded(F.col("nfc"), F.col("language")), "channel": F.col("_channel"), "domain": F.col("_domain"),
    })
    df = T.barrier(df).withColumn("shape", shape_of(F.col("_shape"), F.col("_channel"), F.col("chars"), F.size("lines"), F.col("markdown")))
    df = df.withColumn("genre", genre_of(F.col("_genre"), F.col("shape"), F.col("_channel")))
    df = split(T.barrier(df))
    return T.barrier(df.withColumn("cell", cell_of(F.col("language"), F.col("shape"))).drop("_shape", "_channel", "_genre", "_domain"))


def split(df: DataFrame) -> DataFrame:
    """df (nfc, lines, shape) with lines_with_words and what the segmenter finds."""
    df = df.withColumns({"lines_with_words": F.filter("lines", lambda x: x.rlike(T.WORD)), "segmented": segmented(F.col("nfc"), F.col("shape"))})
    df = df.withColumns({"sentences": F.col("segmented.text"), "sentence_words": F.col("segmented.words"), "listed": F.col("segmented.listed")})
    return df.withColumn("segmentation_suspect", F.coalesce(F.array_max("sentence_words") > SUSPECT, F.lit(False)))


#: What context() has besides arrays of the text's parts; parts() makes these again.
VIEWS = ("raw", "nfc", "folded", "language", "language_confidence", "chars", "bytes", "n_tokens", "markdown", "channel", "domain", "shape", "genre", "cell")


def parts(views: DataFrame) -> DataFrame:
    """VIEWS with the arrays of context(), for texts whose views are written before their arrays are made."""
    df = T.barrier(views.withColumns({"tokens": T.words(F.col("nfc")), "lower": T.lower_words(F.col("nfc")), "lines": T.lines(F.col("raw")), "paragraphs": T.paragraphs(F.col("raw"))}))
    return T.barrier(split(df))


def diagnostics(ctx: DataFrame) -> DataFrame:
    """ctx with ttr, hapax and mattr50 (null under 30 or 50 tokens), for display only."""
    n = F.col("n_tokens")
    # tokens with their places, sorted: a token's neighbours are where it stood before and where it stands next
    ctx = T.barrier(ctx.withColumn("_s", F.sort_array(F.transform("lower", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))))
    beside = lambda x, j: F.when(F.get("_s", j)["t"] == x["t"], F.get("_s", j)["i"])
    ctx = T.barrier(ctx.withColumn("_s", F.transform("_s", lambda x, j: F.struct(x["i"].alias("i"), F.coalesce(beside(x, j - 1), F.lit(-1)).alias("p"), F.coalesce(beside(x, j + 1), n).alias("q")))))
    kinds, once = F.filter("_s", lambda x: x["p"] < 0), F.filter("_s", lambda x: (x["p"] < 0) & (x["q"] == n))
    ctx = T.barrier(ctx.withColumns({"_kinds": F.size(kinds), "_once": F.size(once), "_s": F.when(n >= 50, F.sort_array("_s"))}))
    # from one window to the next, the token that enters may be new to it and the one that leaves may be its last
    first = F.size(F.filter(F.slice("_s", 1, 50), lambda x: x["p"] < 0))
    steps = F.transform(F.slice("_s", 51, F.greatest(n - 50, F.lit(0))), lambda x, j: (x["p"] <= j).cast("int") - (F.get("_s", j)["q"] > j + 49).cast("int"))
    ctx = T.barrier(ctx.withColumns({"_first": first, "_steps": steps}))
    onward = lambda a, d: F.struct((a["k"] + d).alias("k"), (a["total"] + (a["k"] + d) / 50.0).alias("total"))
    mean = F.aggregate("_steps", F.struct(F.col("_first").alias("k"), (F.col("_first") / 50.0).alias("total")), onward)["total"] / (n - 49)
    return ctx.withColumns({
        "ttr": F.when(n >= 30, F.round(F.col("_kinds") / n, 4)),
        "hapax": F.when(n >= 30, F.round(F.col("_once") / n, 4)),
        "mattr50": F.when(n >= 50, F.round(mean, 4)),
    }).drop("_s", "_kinds", "_once", "_first", "_steps")


def notes(ctx: DataFrame) -> DataFrame:
    """ctx with display_notes: typographic quotes, digits of other scripts, words of another language."""
    raw, lower = F.col("raw"), F.col("lower")
    other = F.when(F.col("language") == "en", L.hits(lower, L.TR_STOP)).when(F.col("language") == "tr", L.hits(lower, L.EN_STOP)).otherwise(0)
    found = F.array(
        F.when(raw.rlike(r"[\x{201C}\x{201D}\x{2018}\x{2019}]"), F.lit("typographic_quotes")),
        F.when(raw.rlike(r"[\x{0660}-\x{0669}\x{06F0}-\x{06F9}]"), F.lit("other_digits")),
        F.when((other >= 3) & (other / F.greatest(F.col("n_tokens"), F.lit(1)) >= 0.10), F.lit("code_switching")),
    )
    return ctx.withColumn("display_notes", F.filter(found, lambda x: x.isNotNull()))


def strata(ctx: DataFrame) -> DataFrame:
    """ctx with strata: formal_register, mobile_typed."""
    units = F.size("lines_with_words")
    ended = F.size(F.filter("lines_with_words", lambda x: x.rlike(T.TERMINALS + r"\s*$")))
    mobile = F.col("raw").rlike(r"[!?]{2,}|(\p{L})\1{2,}") & (F.col("shape") == "chat")
    found = F.array(F.when((F.col("n_tokens") >= 30) & (units >= 2) & (ended / units > 0.9), F.lit("formal_register")), F.when(mobile, F.lit("mobile_typed")))
    return ctx.withColumn("strata", F.filter(found, lambda x: x.isNotNull()))
