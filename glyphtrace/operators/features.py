"""The features of a document, each a value or null (never a made-up 0), as columns and as a long table.

A feature is computed only for its shape, its languages and from its least number of tokens on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import text as T
from ..functions.segment import SUSPECT
from .documents import MARKDOWN

# Word lists and patterns of the features.
EMOJI = r"[\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{27BF}\x{2934}-\x{2B55}\x{3030}-\x{3299}\x{1F000}-\x{1FAFF}]"
EMOJI_MARKS = r"[\x{FE0F}\x{200D}\x{1F3FB}-\x{1F3FF}]"
EMOTICON = r":\)|:\(|:D|:'\(|<3|xD|:-\)|:-\(|;\)"
# the same, by the first character
EMOTICON_BY_FIRST = r"[:;<x](?:(?<=:)(?:[()D]|'\(|-[()])|(?<=<)3|(?<=x)D|(?<=;)\))"
# what a character of EMOJI is at least
BEYOND = r"[\x{A9}\x{AE}\x{203C}-\x{10FFFF}]"
# what a slip of space hygiene has: a mark after white space, a space or an end after one, a letter after a mark
SLIPS = r"\s[,.;:!?\x{060C}\x{061B}\x{061F}]|[^\S\n](?:[ \n\r\x{85}\x{2028}\x{2029}]|\z)|[,.;:\x{060C}\x{061B}]\p{L}"
BOLD_LEAD = r"^\s*[-*•\p{Nd}.)]+\s*\*\*[^*\n]{2,40}\*\*\s*[:：-]"
BOLD_LEAD_INSIDE = r"^\s*[-*•\p{Nd}.)]+\s*\*\*[^*\n]{2,40}:\s*\*\*"
PLAIN_LEAD = r"^\s*[-*•]\s*\p{Lu}[^:\n]{2,40}:\s+\S"
INVISIBLE = r"[\x{200B}\x{200C}\x{2060}\x{FEFF}\x{00AD}\x{200E}\x{200F}\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
AFTER, BEFORE = r"(?![\p{L}\p{M}\p{Nd}_])", r"(?<![\p{L}\p{M}\p{Nd}_])"
ENUMERATED = {"en": rf"^(?:first,|second(?:ly)?,|third(?:ly)?,|finally,|lastly,)", "tr": rf"^(?:öncelikle|[iı]lk olarak|[iı]kinci olarak|ardından|son olarak){AFTER}"}
FUNCTION_OPENERS = {
    "en": ("the", "a", "an", "i", "it", "this", "that", "he", "she", "they", "we", "you", "there", "my", "his", "her", "our", "in", "on", "at", "when", "but", "and", "so", "if", "as", "then"),
    "tr": ("bu", "o", "ben", "biz", "bir", "ve", "ama", "sonra", "çünkü", "hem", "de", "da"),
}
CONNECTORS = {"en": ("furthermore", "moreover", "additionally"), "tr": ("ayrıca", r"bunun\s+yanı\s+sıra", r"ek\s+olarak")}
CLOSERS = {"en": "in conclusion|overall|in summary|all in all|to sum up", "tr": "sonuç olarak|özetle|k[iı]sacas[iı]|genel olarak"}
BALANCED = {
    "en": (rf"{BEFORE}not only{AFTER}[\s\S]{{0,80}}?{BEFORE}but also{AFTER}", rf"{BEFORE}whether you(?:'re| are){AFTER}[\s\S]{{0,80}}?{BEFORE}or{AFTER}", rf"{BEFORE}on the one hand{AFTER}"),
    "tr": (rf"{BEFORE}hem{AFTER}[\s\S]{{0,60}}?{BEFORE}hem de{AFTER}", rf"{BEFORE}sadece{AFTER}[\s\S]{{0,60}}?{BEFORE}değil,?\s*aynı zamanda{AFTER}", rf"{BEFORE}[iı]ster{AFTER}[\s\S]{{0,60}}?{BEFORE}[iı]ster{AFTER}"),
}
OPENERS = {"en": "dear|hello|greetings|good morning|good afternoon|good evening", "tr": "sayın|merhaba|[iı]yi günler|[iı]yi akşamlar"}
SIGN_OFFS = {"en": "best regards|kind regards|sincerely|yours faithfully|warm regards", "tr": "saygılarımla|[iı]yi çalışmalar|saygılarımızla|[iı]yi günler dilerim"}
POLITE = {
    "en": "thank you (?:so much )?for|please let me know|please do not hesitate|we appreciate your|i am sorry to hear|we are sorry for|it is my pleasure|happy to assist",
    "tr": "teşekkür eder(?:im|iz)|rica ederim|memnuniyetle|kolay gelsin|nazik ilginiz için|[iı]yi günler dilerim",
}
HEDGES = {
    "en": "may|might|could|tends to|generally|typically|it is worth noting|that said",
    "tr": "olabilir|genellikle|çoğunlukla|nispeten|unutulmamalıdır|görünmektedir",
}
CONTRACTIONS = (
    "dont", "cant", "wont", "im", "ive", "id", "youre", "theyre", "doesnt", "didnt", "wasnt", "isnt", "thats", "theres", "whats", "hes", "shes", "wouldnt",
    "couldnt", "shouldnt", "lets", "aint", "yall", "gonna", "wanna", "gotta", "kinda", "dunno",
)
SELF_CORRECTIONS = (
    r"(?m)^\*\s*\S", rf"(?i){BEFORE}i meant{AFTER}", rf"(?i){BEFORE}sorry,? typo{AFTER}", rf"(?i){BEFORE}edit:", rf"(?i){BEFORE}nvm{AFTER}",
    rf"(?i){BEFORE}pardon{AFTER}", rf"(?i){BEFORE}yok yani{AFTER}", rf"(?i){BEFORE}düzelt(?:me|iyorum){AFTER}", rf"(?i){BEFORE}yok\s+pardon{AFTER}",
)
FORMAL_COPULA = r"(?:(?:makta|mekte)(?:dır|dir)|(?:malı|meli)dır)$"
# Turkish words typed without their marks, and with them.
TR_PLAIN = (
    ("icin", "için"), ("cok", "çok"), ("degil", "değil"), ("gecen", "geçen"), ("yasinda", "yaşında"), ("cocuk", "çocuk"), ("buyuk", "büyük"), ("kucuk", "küçük"), ("sey", "şey"), ("oyle", "öyle"),
    ("boyle", "böyle"), ("tesekkurler", "teşekkürler"), ("gunaydin", "günaydın"), ("gorusuruz", "görüşürüz"), ("ogrenci", "öğrenci"), ("dogru", "doğru"), ("yarin", "yarın"), ("bugun", "bugün"),
    ("aksam", "akşam"), ("ucret", "ücret"), ("ucus", "uçuş"), ("gelecegim", "geleceğim"), ("gidecegim", "gideceğim"), ("yapacagim", "yapacağım"), ("olacagim", "olacağım"), ("kalacagiz", "kalacağız"),
    ("calisiyorum", "çalışıyorum"), ("guzel", "güzel"), ("kotu", "kötü"), ("insallah", "inşallah"), ("nasilsin", "nasılsın"), ("tamamdir", "tamamdır"), ("sagol", "sağol"), ("oncelikle", "öncelikle"),
    ("ozellikle", "özellikle"), ("sonrasinda", "sonrasında"), ("kisiyiz", "kişiyiz"), ("giris", "giriş"),
)
# Cities in both spellings, endings of cases, reduced futures, chat words.
TR_CITIES = ("istanbul", "ıstanbul", "ankara", "izmir", "ızmir", "antalya", "turkiye", "türkiye", "trabzon", "bursa", "konya", "kapadokya", "taksim")
TR_CASES = r"(da|de|ta|te|dan|den|tan|ten|a|e|ya|ye|ı|i|u|ü|yı|yi|yu|yü|ın|in|un|ün|nın|nin|nun|nün)$"
TR_FUTURES = r"(?i)\p{L}+(?:cam|cem|cak|cek|caz|cez|ceksin|caksin|icem|icam|icez|icaz)$"
TR_CHAT = rf"(?iu){BEFORE}(?:bi|bii|napıyon|napiyon|valla|aynen|hadi|abi|abicim|reis|hocam|kanka|eyvallah|tmm|slm|mrb|nbr|sagol|sağol){AFTER}"


@dataclass(frozen=True)
class Feature:
    group: str
    direction: str
    kind: str
    confidence: str
    shape: str  # any, chat or prose
    langs: tuple[str, ...]  # () is any
    least: int


_BOTH = ("en", "tr")
#: All features by name; their values are columns over documents.context() and lexicon.with_hits(), see value_of().
FEATURES = {n: Feature(*about) for n, about in {
    "sentence_len_cv": ("rhythm", "human", "continuous", "MED", "prose", (), 120),
    "sentence_len_mode_mass": ("rhythm", "llm", "continuous", "LOW", "prose", (), 120),
    "paragraph_uniformity": ("rhythm", "llm", "continuous", "LOW", "prose", (), 250),
    "content_word_repeat": ("rhythm", "human", "continuous", "LOW", "prose", (), 150),
    "terminal_punct_ratio": ("punctuation", "llm", "continuous", "MED", "any", (), 20),
    "sentence_initial_caps": ("punctuation", "llm", "continuous", "LOW", "chat", _BOTH, 20),
    "all_lowercase": ("punctuation", "human", "binary", "MED", "chat", _BOTH, 20),
    "ellipsis_hand_typed": ("punctuation", "human", "rate", "MED", "any", (), 0),
    "repeated_punct_emoticon": ("punctuation", "human", "rate", "HIGH", "any", (), 0),
    "letter_elongation": ("punctuation", "human", "rate", "HIGH", "any", (), 3),
    "space_hygiene": ("punctuation", "human", "rate", "LOW", "any", (), 20),
    "multi_exclam": ("punctuation", "human", "rate", "MED", "any", (), 0),
    "exclam_single_regular": ("punctuation", "llm", "binary", "LOW", "prose", (), 0),
    "em_dash_in_chat": ("punctuation", "llm", "binary", "LOW", "chat", _BOTH, 0),
    "wa_single_asterisk": ("punctuation", "human", "binary", "MED", "chat", (), 0),
    "emoji_repeat_run": ("punctuation", "human", "binary", "MED", "any", (), 0),
    "emoji_bullet_led": ("structure", "llm", "binary", "MED", "any", (), 0),
    "tr_asciified_probe": ("orthography", "human", "continuous", "HIGH", "any", ("tr",), 8),
    "tr_mixed_orthography": ("orthography", "human", "binary", "MED", "any", ("tr",), 8),
    "tr_bare_capital_I": ("orthography", "human", "rate", "MED", "any", ("tr",), 8),
    "tr_apostrophe_absent": ("orthography", "human", "rate", "LOW", "any", ("tr",), 12),
    "tr_chat_morphology": ("orthography", "human", "rate", "HIGH", "chat", ("tr",), 3),
    "tr_formal_copula": ("register", "llm", "rate", "LOW", "prose", ("tr",), 100),
    "bold_lead_in_list": ("structure", "llm", "rate", "HIGH", "any", (), 20),
    "colon_led_list": ("structure", "llm", "rate", "LOW", "any", (), 20),
    "enumerated_openers": ("structure", "llm", "binary", "MED", "prose", _BOTH, 0),
    "parallel_openers": ("structure", "llm", "continuous", "LOW", "prose", _BOTH, 120),
    "closing_summary_move": ("structure", "llm", "binary", "MED", "prose", _BOTH, 120),
    "balanced_contrast_frame": ("structure", "llm", "rate", "MED", "any", _BOTH, 100),
    "out_of_channel_register": ("structure", "llm", "binary", "MED", "any", (), 0),
    "greeting_signoff_frame": ("structure", "llm", "binary", "LOW", "any", _BOTH, 30),
    "llm_lexicon_strong": ("register", "llm", "rate", "HIGH", "any", _BOTH, 0),
    "llm_lexicon_weak": ("register", "llm", "rate", "LOW", "any", _BOTH, 40),
    "politeness_formula": ("register", "llm", "rate", "MED", "any", _BOTH, 0),
    "hedge_density": ("register", "llm", "rate", "LOW", "prose", _BOTH, 100),
    "human_lexicon": ("human_marker", "human", "rate", "HIGH", "any", _BOTH, 1),
    "contraction_apostrophe_drop": ("human_marker", "human", "rate", "MED", "any", ("en",), 5),
    "self_correction_marker": ("human_marker", "human", "rate", "HIGH", "chat", (), 2),
}.items()}


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _variation(xs: Column) -> Column:
    """Sample standard deviation over mean; null for a mean of 0. Numbers and mean are computed once."""
    of = lambda v, m: F.when(m > 0, F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (F.size(v) - 1)) / m)
    return T.let(xs, lambda v: T.let(_mean(v), lambda m: of(v, m)))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _held(some: Column, n: Column) -> Column:
    """n where a text has what each match holds, else 0: asking for a few letters costs far less than the search."""
    return F.when(some, n).otherwise(0)


def literals(pattern: str) -> list[str]:
    """For each alternative of a pattern, the longest run of characters that all of its matches hold."""
    bare = re.sub(r"\(\?<?[:=!](?:[^()\[\]]|\[[^\]]*\])*\)\??|\[[^\]]*\](?:\{[^}]*\}|[?*+])*|\\s[*+]?|[^|)][?*]|\^", "\n", pattern)
    return [max(alternative.split("\n"), key=len) for alternative in bare.split("|")]


def _said(text: Column, *patterns: str) -> Column:
    """Whether a text may match one of the patterns."""
    return reduce(or_, (text.contains(x) for x in dict.fromkeys(x for p in patterns for x in literals(p))))


def _positive(n: Column) -> Column:
    return F.when(n > 0, n.cast("double"))


def _by_lang(patterns: dict[str, str], make) -> Column:  # noqa: ANN001
    """make(pattern) for the document's language, else null."""
    lang = F.col("language")
    return F.when(lang == "en", make(patterns["en"])).when(lang == "tr", make(patterns["tr"]))


def _bold(line: Column) -> Column:
    return line.rlike(BOLD_LEAD) | line.rlike(BOLD_LEAD_INSIDE)


def _share(some: Column, every: Column) -> Column:
    return F.size(some) / F.size(every)


def _per_100(n: Column) -> Column:
    return n * 100.0 / F.col("n_tokens")


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0))


def _hits(kind: str, tag: str) -> Column:
    return F.size(F.filter("lexicon_hits", lambda h: (h["kind"] == kind) & (h["tag"] == tag)))


def _counts(patterns: tuple[str, ...]) -> Column:
    return sum((_held(_said(F.col("folded"), p), _count(F.col("folded"), p)) for p in patterns), F.lit(0))


class _Values:
    """The features' values, and what several of them use; each is built when it is first asked for."""

    def __init__(self) -> None:
        self.raw, self.nfc, self.folded, self.lower, self.lines, self.sents = (F.col(c) for c in ("raw", "nfc", "folded", "lower", "lines", "sentences"))

    n_sents = cached_property(lambda v: F.size(v.sents))
    turkish = cached_property(lambda v: F.transform("tokens", lambda t: T.case_fold(t, F.lit("tr"))))
    ascii_form = cached_property(lambda v: L.hits(v.turkish, tuple(a for a, _ in TR_PLAIN)))
    proper = cached_property(lambda v: L.hits(v.turkish, tuple(b for _, b in TR_PLAIN)))
    low_sents = cached_property(lambda v: F.transform(v.sents, lambda s: T.case_fold(F.ltrim(s), F.col("language"))))

    @cached_property
    def sentence_len_cv(self) -> Column:
        steady = (self.n_sents >= 8) & (F.coalesce(F.array_max("sentence_words"), F.lit(0)) <= SUSPECT)
        listed = F.size(F.filter("listed", lambda x: x)) / self.n_sents
        return F.when(steady & (listed <= 0.6), _variation(F.transform("sentence_words", lambda x: x.cast("double"))))

    sentence_len_mode_mass = cached_property(lambda v: F.when(v.n_sents >= 8, _share(F.filter("sentence_words", lambda x: x.between(12, 22)), v.sents)))
    paragraph_uniformity = cached_property(lambda v: F.when(F.size("paragraphs") >= 4, 1 - F.least(F.lit(1.0), _variation(F.transform("paragraphs", lambda p: F.regexp_count(p, F.lit(T.WORD)).cast("double"))))))

    @cached_property
    def content_word_repeat(self) -> Column:
        turkish = F.col("language") == "tr"
        content = F.filter(self.lower, lambda t: (F.length(t) >= 4) & ~F.when(turkish, t.isin(*L.TR_STOP)).otherwise(t.isin(*L.EN_STOP)))
        stem = lambda t: F.when(turkish, F.substring(t, F.lit(1), F.least(F.lit(6), F.greatest(F.lit(1), F.length(t) - 2)))).otherwise(t)
        return T.let(content, lambda c: F.when(F.size(c) >= 20, 1 - F.size(F.array_distinct(F.transform(c, stem))) / F.size(c)))

    @cached_property
    def terminal_punct_ratio(self) -> Column:
        trailing = rf"[\s\x{{200B}}-\x{{200D}}\x{{FEFF}}]*(?:{EMOJI}{EMOJI_MARKS}*[\s\x{{200B}}-\x{{200D}}\x{{FEFF}}]*)*$"
        units = F.when(F.size("lines_with_words") >= 2, F.col("lines_with_words")).otherwise(self.sents)
        return F.when(F.size(units) >= 2, _share(F.filter(units, lambda u: u.rlike(T.TERMINALS + trailing)), units))

    @cached_property
    def sentence_initial_caps(self) -> Column:
        firsts = F.filter(F.transform(self.sents, lambda s: F.regexp_extract(s, T.WORD, 0)), lambda w: w.rlike(r"^\p{L}"))
        return F.when((self.n_sents >= 3) & (F.size(firsts) >= 3), _share(F.filter(firsts, lambda w: w.rlike(r"^\p{Lu}")), firsts))

    @cached_property
    def all_lowercase(self) -> Column:
        letters = _count(self.nfc, r"\p{L}")
        return F.when(letters >= 20, F.when((letters - _count(self.nfc, r"[\p{Lu}\p{Lt}]")) / letters > 0.98, 1.0).otherwise(0.0))

    ellipsis_hand_typed = cached_property(lambda v: _positive(_held(v.raw.contains(".."), _count(v.raw, r"\.{2}(?!\.)") + _count(v.raw, r"\.{4,}"))))
    repeated_punct_emoticon = cached_property(lambda v: _positive(_count(v.raw, rf"[!?\x{{061F}}]{{2,}}|{EMOTICON_BY_FIRST}")))
    letter_elongation = cached_property(lambda v: _positive(_count(v.nfc, r"(\p{L})\1{2,}") + _held(v.raw.contains(T.TATWEEL * 2), _count(v.raw, r"\x{0640}{2,}"))))

    @cached_property
    def space_hygiene(self) -> Column:
        raw = self.raw
        fewer = _count(raw, r"\p{Nd}[.,]\p{Nd}") + 2 * _count(raw, r"(?:https?://|www\.)\S+") + _count(raw, rf"(?i){BEFORE}(?:e\.g|i\.e|vs|etc|vb|bkz)\.")
        # most texts have no such mark, and are searched for nothing else then
        after = T.let(_count(raw, r"[,.;:\x{060C}\x{061B}](?=\p{L})"), lambda n: F.when(n > 0, n - fewer).otherwise(0))
        ends = F.size(F.filter(self.lines, lambda x: x.rlike(r"[^\S\n]$") & x.rlike(r"\S")))
        slips = _count(raw, r"\S {2,}\S") + _count(raw, r"\s+[,.;:!?\x{060C}\x{061B}\x{061F}]") + F.greatest(F.lit(0), after) + ends
        return _per_100(_held(raw.rlike(SLIPS), slips))

    multi_exclam = cached_property(lambda v: _positive(_held(v.raw.contains("!!"), _count(v.raw, r"!{2,}"))))

    @cached_property
    def exclam_single_regular(self) -> Column:
        singles = _held(self.raw.contains("!"), _count(self.raw, r"(?<!!)!(?!!)")) / self.n_sents
        return F.when(self.n_sents >= 4, F.when(self.raw.contains("!!"), 0.0).when(singles.between(0.25, 0.75), 1.0).otherwise(0.0))

    em_dash_in_chat = cached_property(lambda v: F.when(v.raw.contains("—") & ~v.raw.contains(" - "), 1.0).otherwise(0.0))
    wa_single_asterisk = cached_property(lambda v: _flag(v.raw.rlike(r"(?<!\*)\*[^*\n]{2,60}\*(?!\*)")))
    emoji_repeat_run = cached_property(lambda v: _flag(v.raw.rlike(rf"({EMOJI})\1|[\x{{1F3FB}}-\x{{1F3FF}}]")))
    emoji_bullet_led = cached_property(lambda v: _flag(_held(v.raw.rlike(BEYOND), F.size(F.filter(v.lines, lambda x: x.rlike(rf"^\s*{EMOJI}{EMOJI_MARKS}*\s+\p{{Lu}}")))) >= 2))
    tr_asciified_probe = cached_property(lambda v: T.let(F.struct(v.ascii_form.alias("a"), v.proper.alias("p")), lambda x: F.when((x["a"] >= 2) & (x["a"] / (x["a"] + x["p"] + 1) > 0.5), x["a"] / (x["a"] + x["p"] + 1))))
    tr_mixed_orthography = cached_property(lambda v: _flag((v.ascii_form > 0) & (v.proper > 0)))
    tr_bare_capital_I = cached_property(lambda v: _positive(F.size(F.filter("tokens", lambda t: t.rlike("^I(?=[a-zçğıöşü])")))))

    @cached_property
    def tr_apostrophe_absent(self) -> Column:
        stem = lambda t: F.regexp_replace(T.case_fold(t, F.lit("tr")), TR_CASES, "")
        cased = lambda t: t.rlike(r"^\p{Lu}") & (F.length(t) >= 6) & ~t.rlike("['\u2019]") & T.case_fold(t, F.lit("tr")).rlike(TR_CASES) & (F.length(stem(t)) >= 4)
        names = T.let(self.turkish, lambda bag: F.size(F.filter("tokens", lambda t: cased(t) & (stem(t).isin(*TR_CITIES) | F.array_contains(bag, stem(t))))))
        return T.let(names, lambda n: F.when(n >= 2, n.cast("double")))

    tr_chat_morphology = cached_property(lambda v: _positive(F.size(F.filter("tokens", lambda t: t.rlike(TR_FUTURES))) + _count(v.nfc, TR_CHAT)))
    tr_formal_copula = cached_property(lambda v: F.when(F.col("genre") != "formal_letter", _per_100(F.size(F.filter(v.turkish, lambda t: t.rlike(FORMAL_COPULA))))))
    bold_lead_in_list = cached_property(lambda v: _positive(_held(v.raw.contains("**"), F.size(F.filter(v.lines, _bold)))))

    @cached_property
    def colon_led_list(self) -> Column:
        pairs = F.arrays_zip(self.lines.alias("a"), F.slice(self.lines, 2, F.size(self.lines)).alias("b"))
        led = F.size(F.filter(pairs, lambda p: p["a"].rlike(r":\s*$") & F.coalesce(p["b"].rlike(r"^\s*[-*•\p{Nd}]"), F.lit(False))))
        return _positive(_held(self.raw.contains(":"), led + F.size(F.filter(self.lines, lambda x: x.rlike(PLAIN_LEAD) & ~_bold(x)))))

    enumerated_openers = cached_property(lambda v: _flag((v.n_sents >= 6) & (_by_lang(ENUMERATED, lambda p: F.size(F.filter(v.low_sents, lambda s: s.rlike(p)))) >= 3)))

    @cached_property
    def parallel_openers(self) -> Column:
        starts = lambda lang: F.filter(F.transform(self.low_sents, lambda s: F.regexp_extract(s, T.WORD, 0)), lambda t: (t != "") & ~t.isin(*FUNCTION_OPENERS[lang]))
        opens = F.when(F.col("language") == "tr", starts("tr")).otherwise(starts("en"))
        links = _by_lang({k: "|".join(v) for k, v in CONNECTORS.items()}, lambda p: _held(_said(self.folded, p), _count(self.folded, rf"{BEFORE}(?:{p}){AFTER}")))

        def value(x: Column) -> Column:
            repeats = F.when(F.size(x["opens"]) >= 2, 1 - F.size(F.array_distinct(x["opens"])) / F.size(x["opens"])).otherwise(0.0)
            return F.when((self.n_sents >= 6) & ((F.size(x["opens"]) >= 2) | (x["links"] >= 3)), F.least(F.lit(1.0), repeats + F.when(x["links"] >= 3, 0.15).otherwise(0.0)))

        return T.let(F.struct(opens.alias("opens"), links.alias("links")), value)

    closing_summary_move = cached_property(lambda v: _flag(_by_lang(CLOSERS, lambda p: T.case_fold(F.substring(F.ltrim(F.element_at("paragraphs", -1)), 1, 100), F.col("language")).rlike(rf"^(?:{p}){AFTER}"))))
    balanced_contrast_frame = cached_property(lambda v: _positive(F.when(F.col("language") == "en", _counts(BALANCED["en"])).when(F.col("language") == "tr", _counts(BALANCED["tr"]))))
    out_of_channel_register = cached_property(lambda v: _flag((F.col("channel") == "whatsapp") & (F.col("chars") > 400) & (F.size("paragraphs") >= 2)))

    @cached_property
    def greeting_signoff_frame(self) -> Column:
        framed = _by_lang(OPENERS, lambda p: F.ltrim(self.folded).rlike(rf"^(?:{p}){AFTER}")) & _by_lang(SIGN_OFFS, lambda p: self.folded.rlike(p))
        return _flag(((F.col("genre") == "review") | (F.col("shape") == "chat")) & framed)

    llm_lexicon_strong = cached_property(lambda v: _positive(_hits("llm", "strong")))
    llm_lexicon_weak = cached_property(lambda v: _per_100(_hits("llm", "weak")))

    @cached_property
    def politeness_formula(self) -> Column:
        found = _by_lang(POLITE, lambda p: F.when(_said(self.folded, p), T.places(self.folded, f"(?:{p}){AFTER}")))
        return _positive(F.size(F.filter(found, lambda x: ~F.exists("lexicon_hits", lambda h: (h["start"] < x["end"]) & (h["end"] > x["start"])))))

    hedge_density = cached_property(lambda v: _by_lang(HEDGES, lambda p: _per_100(_held(_said(v.folded, p), _count(v.folded, f"{BEFORE}(?:{p}){AFTER}")))))
    human_lexicon = cached_property(lambda v: _positive(3 * _hits("human", "strong") + _hits("human", "weak")))
    contraction_apostrophe_drop = cached_property(lambda v: _positive(L.hits(v.lower, CONTRACTIONS)))
    self_correction_marker = cached_property(lambda v: _positive(sum((v.raw.rlike(p).cast("int") for p in SELF_CORRECTIONS), F.lit(0))))


@cache
def _values(application: str) -> _Values:
    return _Values()


def value_of(name: str) -> Column:
    """The value of a feature, without regard to where it applies; built once in an application."""
    return getattr(_values(SparkSession.active().sparkContext.applicationId), name)


def applies(f: Feature) -> Column:
    right = F.col("n_tokens") >= f.least
    if f.shape != "any":
        right &= F.col("shape") == f.shape
    if f.langs:
        right &= F.col("language").isin(*f.langs)
    return right


def with_features(ctx: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """ctx with a column for each feature, null where it doesn't apply or can't be computed."""
    return T.barrier(ctx.withColumns({n: F.when(applies(f), value_of(n).cast("double")) for n, f in FEATURES.items() if only is None or n in only}))


def long_table(wide: DataFrame, key: list[str]) -> DataFrame:
    """key, feature, value, direction, feature_group, kind, confidence: a row for each value that isn't null."""
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value"), F.lit(f.direction).alias("direction"), F.lit(f.group).alias("feature_group"), F.lit(f.kind).alias("kind"), F.lit(f.confidence).alias("confidence")) for n, f in FEATURES.items() if n in wide.columns))
    return wide.select(*key, F.explode_outer(F.filter(rows, lambda r: r["value"].isNotNull())).alias("_f")).select(*key, "_f.*").where("feature IS NOT NULL")


#: Features that are matches of a pattern in the text itself.
SPAN_PATTERNS = {
    "ellipsis_hand_typed": r"\.{2}(?!\.)|\.{4,}", "repeated_punct_emoticon": rf"[!?\x{{061F}}]{{2,}}|{EMOTICON}", "letter_elongation": r"(?:(\p{L})\1{2,})|\x{0640}{2,}",
    "multi_exclam": "!{2,}", "em_dash_in_chat": "—", "wa_single_asterisk": r"(?<!\*)\*[^*\n]{2,60}\*(?!\*)", "bold_lead_in_list": "(?m)" + BOLD_LEAD + "|(?m)" + BOLD_LEAD_INSIDE,
    "emoji_repeat_run": rf"(?:{EMOJI}{EMOJI_MARKS}*){{2,}}", "emoji_bullet_led": rf"(?m)^\s*{EMOJI}{EMOJI_MARKS}*\s+\p{{Lu}}.*$", "self_correction_marker": "|".join(SELF_CORRECTIONS), "colon_led_list": "(?m)" + PLAIN_LEAD,
    "tr_bare_capital_I": rf"{BEFORE}I(?=[a-zçğıöşü])", "tr_chat_morphology": TR_CHAT, "contraction_apostrophe_drop": rf"(?i){BEFORE}(?:{'|'.join(CONTRACTIONS)}){AFTER}",
}
#: Features that are matches in the folded view, by language.
FOLDED_PATTERNS = {
    "hedge_density": {k: f"{BEFORE}(?:{p}){AFTER}" for k, p in HEDGES.items()}, "politeness_formula": {k: f"(?:{p}){AFTER}" for k, p in POLITE.items()},
    "balanced_contrast_frame": {k: "|".join(ps) for k, ps in BALANCED.items()}, "parallel_openers": {k: rf"{BEFORE}(?:{'|'.join(ps)}){AFTER}" for k, ps in CONNECTORS.items()},
}
BLANK = r"^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*$"
SPAN = "struct<start:int,end:int,name:string,source:string,direction:string,text:string>"


def evidence(wide: DataFrame, most: int = 200, longest: int = 80) -> DataFrame:
    """wide (raw, nfc, folded, language, lexicon_hits, features, and rules if there) with evidence_spans, in order, each once, and spanless.

    Spans (start, end, name, source, direction, text) have places in UTF-16 units of the raw text, so that a slice of
    it there is what matched. Places on the folded view are taken back by fold_map(); where that has none, or the NFC
    form is another text, the match is told as spanless, like features and rules without a place. Blank spans go; at
    most `most` spans, and `longest` characters of text each.
    """
    kind, raw, none = f"array<{SPAN}>", F.col("raw"), F.array().cast(f"array<{SPAN}>")
    exact = F.col("nfc") == raw
    # the map is made for texts that have something to take back
    needed = F.size("lexicon_hits") > 0
    for n in (n for n in FOLDED_PATTERNS if n in wide.columns):
        needed |= F.coalesce(F.col(n) > 0, F.lit(False))
    wide = T.barrier(wide.withColumns({"_map": F.when(exact & needed, T.fold_map(F.col("nfc"), F.col("language"))), "_cut": T.pieces(raw)}))
    cut, place = F.col("_cut"), F.col("_map")
    span = lambda start, end, name, source, direction: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), name.alias("name"), F.lit(source).alias("source"), direction.alias("direction"), T.part(cut, start, F.least(end - start, F.lit(longest))).alias("text"))
    back = lambda x: (F.get(place, x["start"]), F.get(place, x["end"] - 1) + 1)
    told, every = [], []
    for n in (n for n in FEATURES if n in wide.columns):
        direction, here = F.lit(FEATURES[n].direction), F.col(n) > 0
        if n in SPAN_PATTERNS:
            at = F.transform(T.places(raw, SPAN_PATTERNS[n]), lambda x: span(x["start"], x["end"], F.lit(n), "signal", direction))
        elif n in FOLDED_PATTERNS:
            at = F.when(place.isNotNull(), F.transform(_by_lang(FOLDED_PATTERNS[n], lambda p: T.places(F.col("folded"), p)), lambda x: span(*back(x), F.lit(n), "signal", direction)))
        else:
            continue
        every.append(F.coalesce(F.when(here, at.cast(kind)), none))
        told.append(n)
    way = lambda h: F.when(h["kind"] == "llm", "llm").otherwise("human")
    hits = F.when(place.isNotNull(), F.transform("lexicon_hits", lambda h: span(*back(h), h["phrase"], "lexicon", way(h))))
    every.append(F.coalesce(hits.cast(kind), none))
    if "rules" in wide.columns:
        # a frame's words are in the text; markdown and odd characters are found again
        at = lambda r: F.when(r["name"] == "assistant_frame_leak", F.call_function("locate", r["matched"], raw) - 1)
        framed = F.filter("rules", lambda r: at(r) >= 0)
        every.append(F.transform(framed, lambda r: span(at(r), at(r) + F.length(r["matched"]), r["name"], "rule", r["direction"])).cast(kind))
        for name, pattern, few in (("markdown_in_chat", "|".join(f"(?:{p})" for p in MARKDOWN.values()), 4), ("invisible_chars", INVISIBLE, 5)):
            held = F.exists("rules", lambda r: r["name"] == name)
            found = F.transform(F.slice(T.places(raw, pattern), 1, few), lambda x: span(x["start"], x["end"], F.lit(name), "rule", F.lit("llm")))
            every.append(F.coalesce(F.when(held, found.cast(kind)), none))
    wide = T.barrier(wide.withColumn("_spans", F.filter(F.concat(*every), lambda x: x["start"].isNotNull() & ~x["text"].rlike(BLANK))))
    wide = T.barrier(wide.withColumn("_spans", F.slice(T.sorted_distinct(F.col("_spans")), 1, most)))
    silent = [F.when(F.col(n).isNotNull() & ~F.exists("_spans", lambda x: x["name"] == n), F.lit(n)) for n in FEATURES if n in wide.columns]
    lost = F.transform("lexicon_hits", lambda h: F.when(~F.exists("_spans", lambda x: x["name"] == h["phrase"]), h["phrase"]))
    bare = F.transform("rules", lambda r: F.when(~F.exists("_spans", lambda x: x["name"] == r["name"]), r["name"])) if "rules" in wide.columns else F.array().cast("array<string>")
    # characters past the basic plane are two units
    astral = raw.rlike(r"[\x{10000}-\x{10FFFF}]")
    unit = lambda at: at + F.regexp_count(F.substring(raw, F.lit(1), at), F.lit(r"[\x{10000}-\x{10FFFF}]"))
    units = F.transform("_spans", lambda x: x.withField("start", unit(x["start"])).withField("end", unit(x["end"])))
    wide = wide.withColumns({"evidence_spans": F.when(astral, units).otherwise(F.col("_spans")), "spanless": F.array_sort(F.array_distinct(F.filter(F.concat(F.array(*silent), lost, bare), lambda x: x.isNotNull())))})
    return wide.drop("_map", "_cut", "_spans")
