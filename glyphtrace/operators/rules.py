"""Artifact rules: marks that a text was machine-written, pasted or copied."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_B, _E = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"
# First-person frames of assistants, on folded text (a space stands for any white space), and whether
# each is a drafting frame.
EN_FRAMES = (
    (rf"{_B}(?:as|i'?m|i am|being|since i am) (?:just |merely |only )?an? (?:ai |large |artificial intelligence )?(?:language model|llm){_E}", False),
    (rf"{_B}as an ai{_E}", False),
    (rf"{_B}i'?m (?:just |merely |only )?an ai{_E}", False),
    (rf"{_B}i am (?:just |merely |only )?an ai{_E}", False),
    (rf"{_B}my (?:training data|knowledge cut-?off|training cut-?off){_E}", False),
    (rf"{_B}(?:i )?(?:do not|don'?t|dont|cannot|can'?t|cant|am unable to) have (?:access to )?real[ -]?time{_E}", False),
    (rf"{_B}(?:do not|don'?t|cannot|can'?t|am unable to) (?:have )?(?:access to|browse) (?:the )?(?:internet|web){_E}", False),
    (rf"{_B}i cannot browse{_E}", False),
    (rf"{_B}here(?:'s)? (?:your|a|an|the) (?:revised|rewritten|polished|updated) (?:version|draft|text){_E}", True),
    (rf"{_B}here is (?:your|a|an|the) (?:revised|rewritten|polished|updated) (?:version|draft|text){_E}", True),
    (rf"{_B}i have (?:rewritten|revised|drafted|polished|reworked) (?:it|this|the|your){_E}", True),
    (rf"{_B}i (?:was|am|have been) trained on data{_E}", False),
    (rf"{_B}as of my (?:last|latest) (?:update|training){_E}", False),
    (rf"{_B}being an? (?:ai|artificial intelligence|machine learning|language) model{_E}", False),
    (rf"{_B}as an? artificial intelligence{_E}", False),
    (rf"{_B}as a machine learning model{_E}", False),
    (rf"{_B}my (?:responses|answers|replies) are (?:generated|produced){_E}", False),
    (rf"{_B}i (?:don'?t|do not) have personal (?:experiences|opinions|feelings|preferences){_E}", False),
    (rf"{_B}i (?:don'?t|do not) have feelings{_E}", False),
    (rf"{_B}i have no (?:ability|way) to (?:access|browse){_E}", False),
    (rf"{_B}i'?m not able to (?:browse|access) the (?:internet|web){_E}", False),
    (rf"{_B}i was (?:created|developed|built|trained) by (?:an? )?(?:ai company|openai|anthropic|google|meta){_E}", False),
    (rf"{_B}i am an automated (?:assistant|system|response){_E}", False),
)
TR_FRAMES = (
    rf"{_B}bir (?:yapay zek[aâ] )?dil modeli(?:yim| olarak){_E}",
    rf"{_B}bir yapay zek[aâ] (?:modeli|asistan[iı])(?:y[iı]m|yim){_E}",
    rf"{_B}yapay zek[aâ] (?:modeli|asistan[iı]) olarak{_E}",
    rf"{_B}eğitim verilerim{_E}",
    rf"{_B}bilgi kesim tarih",
    rf"{_B}gerçek zamanl[iı] (?:erişim|veri)[\p{{L}}\p{{M}}]* (?:yok|bulunm[\p{{L}}\p{{M}}]*|olmad[\p{{L}}\p{{M}}]*|olmuyor)",
    rf"{_B}bir yapay zek[aâ] olarak{_E}",
    rf"{_B}ben bir yapay zek[aâ]y[ıi]m{_E}",
    rf"{_B}kişisel deneyimim (?:yok|bulunm)",
    rf"{_B}yanıtlarım otomatik olarak üretil",
    rf"{_B}gerçek zamanlı (?:verilere |bilgilere )?erişimim (?:yok|bulunm)",
    rf"{_B}duygularım (?:veya|ya da) tercihlerim yok{_E}",
)
#: The letters that a frame may begin with; every frame begins with _B and one of them.
BEGIN = "abcdeghiksmy"
# Words that show a text is about assistants, and what tells that its subject is another one.
CUES = rf"{_B}(?:chatgpt|claude|gemini|copilot|gpt(?:-\p{{Nd}})?|llm|chat ?bot|bot|assistant|asistan[\p{{L}}\p{{M}}]*|ai|yapay zek[aâ][\p{{L}}\p{{M}}]*|dil modeli[\p{{L}}\p{{M}}]*){_E}"
NAMES = ("claude", "gemini", "copilot")
ABOUT = rf"{_B}(?:ai|model|models|assistant[\p{{L}}\p{{M}}]*|chatbot|chat ?bot|bot|llm|yapay zek[aâ][\p{{L}}\p{{M}}]*|asistan[\p{{L}}\p{{M}}]*|dil modeli[\p{{L}}\p{{M}}]*){_E}"
THIRD_PERSON = ("he", "she", "it", "its", "they", "their", "them", "him", "her", "his", "the", "this", "that")
FIRST_PERSON = ("i", "i'm", "im", "my", "me", "mine", "we", "our", "us", "ben", "benim", "bana", "biz", "bizim", "bize", "kendim")
REPORTED = rf"{_B}the (?:reply|message|answer|response|email|text|bot|chat) (?:began|said|read|was|went){_E}|{_B}(?:said|told|explained|argued|insisted|claimed|wrote|replied|answered|responded|began|read|went){_E}"
REPORTED_TR = rf"{_B}(?:dedi|demiş|yazdı|yazmış|cevap verdi|yanıtladı|şöyle|şu şekilde){_E}"
TOKEN, SENTENCE = r"[\p{L}\p{M}\p{N}]+", r"[^.!?\x{2026}\x{061F}\x{06D4}]*"
LOOK_AHEAD, LOOK_BEHIND, CUE_TOKENS, CUE_CHARS = 4, 12, 3, 16
FRAME = "struct<start:int,end:int,suppressed:boolean,value:string,cue:string>"
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{2060}\x{FEFF}\x{00AD}]"
BIDI_MARKS = r"[\x{200E}\x{200F}]"
ODD_SPACES = r"[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
ARABIC = r"[\x{0621}-\x{064A}\x{0671}-\x{06D3}]"
RULE = "struct<name:string,direction:string,precision:string,matched:string,note:string,warning:string,count:int>"


def rule(name: str, precision: str, matched: Column, warning: Column | None = None, count: Column | None = None, note: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(name).alias("name"), F.lit("llm").alias("direction"), F.lit(precision).alias("precision"), matched.cast("string").alias("matched"), (null if note is None else note).alias("note"), (null if warning is None else warning).alias("warning"), (F.lit(None) if count is None else count).cast("int").alias("count"))


def _spaced(pattern: str) -> str:
    return re.sub(r"(?<!\[) ", r"\\s+", pattern)


def _any(patterns: tuple[str, ...]) -> str:
    """A pattern of places where one of the patterns matches: the letter that one begins with is asked for first, and what stands before it once, not once for each."""
    bare = [p.removeprefix(_B) for p in patterns]
    return _spaced(rf"(?=[{BEGIN}]){_B}(?:{'|'.join(bare)})")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _last(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n, F.lit(0)) + 1, n)


def free_cue(view: Column, frames: Column) -> Column:
    """The first word about assistants that is no part of a frame and doesn't stand next to one; null without any.

    A name that is also a person's counts only near a word about models. frames: array of struct(start, end).
    """
    between = lambda a, b: F.substring(view, a + 1, b - a)

    def near(x: Column) -> Column:
        sides = F.array_join(_last(_tokens(F.substring(view, F.greatest(x["start"] - 120, F.lit(0)) + 1, F.least(x["start"], F.lit(120)))), CUE_TOKENS), " "), F.array_join(F.slice(_tokens(F.substring(view, x["end"] + 1, F.lit(120))), 1, CUE_TOKENS), " ")
        return sides[0].rlike(ABOUT) | sides[1].rlike(ABOUT)

    def attached(x: Column, f: Column) -> Column:
        gap = F.when(x["end"] <= f["start"], between(x["end"], f["start"])).otherwise(between(f["end"], x["start"]))
        overlap = (x["start"] < f["end"]) & (f["start"] < x["end"])
        return overlap | (~gap.rlike(TOKEN) & (F.length(gap) <= CUE_CHARS))

    free = F.filter(T.places(view, _spaced(CUES)), lambda x: ~F.exists(frames, lambda f: attached(x, f)) & (~x["value"].isin(*NAMES) | near(x)))
    return F.get(free, F.lit(0))["value"]


def _judged(view: Column, quoted: Column, x: Column, cue: Column, english: bool, drafting: Column) -> Column:
    """FRAME: a frame with what suppresses it. quoted: the text that has the quotation marks, at the same places."""
    before, after = F.substring(view, F.lit(1), x["start"]), F.substring(view, x["end"] + 1, F.length(view))
    ahead = F.filter(F.slice(_tokens(F.substring(after, F.lit(1), F.lit(160))), 1, LOOK_AHEAD), lambda t: t.isin(*THIRD_PERSON, *FIRST_PERSON))
    own = F.exists(_tokens(x["value"]), lambda t: t.isin(*FIRST_PERSON))
    third = F.lit(english) & ~drafting & ~own & F.coalesce(F.get(ahead, F.lit(0)).isin(*THIRD_PERSON), F.lit(False))
    said = F.array_join(_last(_tokens(F.regexp_extract(before, SENTENCE + "$", 0)), LOOK_BEHIND), " ")
    says = F.array_join(F.slice(_tokens(F.regexp_extract(after, "^" + SENTENCE, 0)), 1, LOOK_BEHIND), " ")
    reported = said.rlike(f"{REPORTED}|{REPORTED_TR}") | says.rlike(REPORTED_TR)
    why = F.when(T.inside_quotes(F.substring(quoted, F.lit(1), x["start"] + 1)), "quotation").when(third, "third_person").when(reported, "reporting_clause").otherwise(cue)
    matched = F.trim(F.when(F.length(quoted) == F.length(view), F.substring(quoted, x["start"] + 1, x["end"] - x["start"])).otherwise(x["value"]))
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), why.isNotNull().alias("suppressed"), matched.alias("value"), why.alias("cue"))


def frame_leak(text: Column) -> Column:
    """FRAME: the first assistant's frame of a text that nothing suppresses, else the first suppressed one; null without a frame.

    A frame is suppressed inside a quotation, before a subject of the third person (English self-descriptions without
    a first person of their own), after a reporting clause of its sentence, and where the text is about assistants.
    """

    def found(view: Column, patterns: tuple, drafting: tuple, english: bool) -> Column:
        each = F.array(*(F.struct(F.lit(_spaced(p)).alias("p"), F.lit(d).alias("d")) for p, d in zip(patterns, drafting, strict=True)))

        def of(v: Column) -> Column:
            frames = F.flatten(F.transform(each, lambda e: F.transform(T.places(v, e["p"]), lambda x: F.struct(x["start"], x["end"], x["value"], e["d"].alias("d")))))
            return T.let(frames, lambda fs: T.let(free_cue(v, fs), lambda cue: F.transform(fs, lambda x: _judged(v, text, x, cue, english, x["d"]))))

        return F.when(view.rlike(_any(patterns)), T.let(view, of)).otherwise(F.array()).cast(f"array<{FRAME}>")

    en, tr = (found(T.folded(text, F.lit(lang)), p, d, lang == "en") for lang, p, d in (("en", tuple(p for p, _ in EN_FRAMES), tuple(d for _, d in EN_FRAMES)), ("tr", TR_FRAMES, (False,) * len(TR_FRAMES))))
    return T.let(F.concat(en, tr), lambda fs: F.coalesce(F.array_min(F.filter(fs, lambda f: ~f["suppressed"])), F.array_min(fs)))


def invisible(raw: Column) -> Column:
    """How many invisible characters and odd spaces a text has."""
    arabic = raw.rlike(ARABIC)
    zero = F.regexp_count(raw, F.lit(ZERO_WIDTH)) - F.regexp_count(raw, F.lit(r"^\x{FEFF}")) - F.regexp_count(raw, F.lit(rf"(?<={ARABIC})\x{{200C}}|\x{{200C}}(?={ARABIC})"))
    return zero + F.when(arabic, 0).otherwise(F.regexp_count(raw, F.lit(BIDI_MARKS))) + F.regexp_count(raw, F.lit(ODD_SPACES))


def check_markers(markers: list[dict], spark) -> DataFrame:  # noqa: ANN001
    """A table of markers (place, name, pattern); a pattern that isn't one raises before anything runs."""
    for m in markers:
        if not isinstance(m.get("pattern"), str):
            raise ValueError(f"marker {m.get('name')!r} has no pattern")
        re.compile(m["pattern"])
    rows = [(i, m.get("name") or f"marker {i}", m["pattern"]) for i, m in enumerate(markers)]
    return spark.createDataFrame(rows, "place int, name string, pattern string")


def marker_hits(texts: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """key, marker: the first marker, in their order, that a text or its copy without look-alikes matches.

    markers: a configured list of a few rows, one broadcast dimension.
    """
    plain = texts.select(key, "raw", T.fold_confusables(F.col("raw")).alias("_plain"))
    met = plain.join(F.broadcast(markers), F.expr("raw RLIKE pattern OR _plain RLIKE pattern"))
    return met.groupBy(key).agg(F.min_by("name", "place").alias("marker"))


def with_rules(ctx: DataFrame, key: str, duplicates: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """ctx with rules (in the order frame, markdown, marker, duplicate, invisible) and rule_notes.

    duplicates: key, matched_id, jaccard of near_duplicate.nearest(). Invisible characters count only beside another rule.
    """
    if duplicates is not None:
        ctx = ctx.join(duplicates.select(key, "matched_id", "jaccard"), key, "left")
    if markers is not None:
        ctx = ctx.join(marker_hits(ctx.select(key, "raw"), markers, key), key, "left")
    null = F.lit(None).cast("string")
    # a copy without look-alikes is tried where it is another text; the expression is built once for both
    ctx = T.barrier(ctx.withColumns({"_plain": F.when(F.col("raw").rlike(r"[^\x00-\x7F]"), T.fold_confusables(F.col("raw"))), "invisible": invisible(F.col("raw"))}))
    views = F.array("raw", F.when(F.col("_plain") != F.col("raw"), F.col("_plain")))
    ctx = T.barrier(ctx.withColumn("_frames", F.transform(views, lambda v: F.when(v.isNotNull(), frame_leak(v)))))
    ctx = ctx.withColumns({"_first": F.col("_frames")[0], "_second": F.col("_frames")[1]})
    ctx = ctx.withColumn("_frame", F.coalesce("_first", "_second"))
    frame = F.when(~F.col("_frame.suppressed"), F.col("_frame"))
    swapped = F.when(F.col("_first").isNull(), F.lit("homoglyph_suspect"))
    told = (F.col("shape") == "chat") | (F.col("channel") == "whatsapp")
    matched = F.col("matched_id").cast("string") if duplicates is not None else null
    marker = F.col("marker") if markers is not None else null
    strong = F.filter(F.array(
        F.when(frame.isNotNull(), rule("assistant_frame_leak", "high", frame["value"], warning=swapped)),
        F.when(told & (F.size("markdown") > 0), rule("markdown_in_chat", "medium", F.array_join("markdown", ","))),
        F.when(marker.isNotNull(), rule("known_machine_marker", "high", marker, warning=F.lit("pasted_machine_text"))),
        F.when(matched.isNotNull(), rule("near_duplicate", "high", matched)),
    ).cast(f"array<{RULE}>"), lambda r: r.isNotNull())
    ctx = ctx.withColumn("_strong", strong)
    ctx = ctx.withColumn("rules", F.when(F.size("_strong") > 0, F.concat("_strong", weak_rules())).otherwise(F.col("_strong")))
    held_back = F.array(
        F.when(F.col("_frame.suppressed"), F.concat(F.lit("assistant_frame_suppressed:"), F.col("_frame.cue"))),
        F.when((F.size("_strong") == 0) & (F.col("invisible") > 0), F.lit("invisible_chars_alone")),
    )
    ctx = ctx.withColumn("rule_notes", F.filter(held_back, lambda x: x.isNotNull()))
    return T.barrier(ctx.drop("_frame", "_frames", "_first", "_second", "_plain", "_strong"))


def weak_rules() -> Column:
    """The rule of invisible characters, as an array; it counts beside another rule or two machine signals only."""
    found = F.array(F.when(F.col("invisible") > 0, rule("invisible_chars", "low", F.col("invisible"), count=F.col("invisible"))))
    return F.filter(found.cast(f"array<{RULE}>"), lambda r: r.isNotNull())


def with_signal_count(scored: DataFrame) -> DataFrame:
    """with_rules() rows that have n_llm (signals on the machine side), with invisible characters as a rule where two such signals stand alone."""
    alone = (F.size("rules") == 0) & (F.col("n_llm") >= 2)
    notes = F.when(alone, F.array_remove("rule_notes", "invisible_chars_alone")).otherwise(F.col("rule_notes"))
    return scored.withColumns({"rules": F.when(alone, weak_rules()).otherwise(F.col("rules")), "rule_notes": notes})
