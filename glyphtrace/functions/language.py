"""Language identification for a text of English or Turkish: script shares, then votes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Function words and other cues of the votes.
TR_STOP = (
    "ve", "bir", "bu", "için", "icin", "ile", "ama", "çok", "cok", "daha", "gibi", "kadar", "sonra", "önce", "once", "de", "da", "ki",
    "mi", "mı", "mu", "mü", "ne", "var", "yok", "olarak", "olan", "ben", "sen", "biz", "siz", "şey", "sey", "değil", "degil", "göre",
    "gore", "her", "hem", "işte", "iste", "şimdi", "simdi", "zaten", "tamam", "evet", "hayır", "hayir", "iyi", "güzel", "guzel",
    "büyük", "buyuk", "küçük", "kucuk", "çocuk", "cocuk", "yaşında", "yasinda", "geçen", "gecen", "teşekkür", "tesekkur",
    "günaydın", "gunaydin", "merhaba", "lütfen", "lutfen", "nasıl", "nasil", "kişi", "kisi",
)
EN_STOP = (
    "the", "and", "is", "are", "was", "were", "to", "of", "in", "for", "with", "that", "this", "it", "on", "at", "as", "but", "not",
    "have", "has", "had", "be", "been", "will", "would", "can", "could", "from", "they", "we", "you", "your", "our", "my", "me", "i",
    "a", "an", "or", "if", "so", "all", "about", "just", "very", "more", "most",
)
TR_SUFFIX = r"(?:lar|ler|dır|dir|dur|dür|dan|den|tan|ten|ında|inde|unda|ünde|mak|mek|ıyor|iyor|uyor|üyor|acak|ecek|miş|mış|muş|müş)$"
TR_PROBE = (
    "icin", "cok", "degil", "gecen", "yasinda", "cocuk", "buyuk", "kucuk", "sey", "oyle", "boyle", "tesekkurler", "gunaydin",
    "gorusuruz", "ogrenci", "dogru", "yarin", "bugun", "sabah", "aksam", "ucret", "ucus", "gelecegim", "gidecegim", "yapacagim",
    "olacagim", "kalacagiz", "calisiyorum", "guzel", "kotu", "insallah", "nasilsin", "naber", "tamamdir", "sagol", "oncelikle",
    "ozellikle", "sonrasinda", "kisiyiz", "giris", "gece",
)
TR_SLANG = ("naber", "reis", "abi", "abicim", "hocam", "kanka", "eyvallah", "valla", "aynen", "hadi", "tmm", "slm", "mrb", "nbr", "sagol")
TR_ASCII_SUFFIX = r"(?:yiz|siniz|sınız|iz|lar|ler|dan|den|ca|ce|mis|mus|cak|cek|yor|dik|dık)$"
OTHERS = {
    "fr": ("je", "nous", "vous", "votre", "notre", "êtes", "être", "avec", "pour", "dans", "sur", "mais", "donc", "aussi", "cette"),
    "es": ("yo", "nosotros", "ustedes", "nuestra", "nuestro", "pero", "porque", "cuando", "desde", "hasta", "muy", "también", "estamos", "tienen", "sobre"),
    "it": ("io", "noi", "voi", "nostra", "nostro", "vostra", "perché", "quando", "anche", "però", "sono", "abbiamo", "della", "dello", "sulla"),
    "de": ("ich", "wir", "sie", "ihre", "unsere", "nicht", "auch", "aber", "oder", "weil", "wenn", "werden", "haben", "sind", "wurde"),
    "pt": ("eu", "nós", "você", "nossa", "nosso", "porque", "quando", "também", "muito", "estamos", "temos", "sobre", "para", "pelo", "pela"),
}
TR_LETTERS = r"[çğıöşüÇĞİÖŞÜ]"


def hits(tokens: Column, some: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*some)))


def beyond_ascii(nfc: Column) -> Column:
    """What a text has besides ASCII, in which the rarer characters are counted."""
    return F.regexp_replace(nfc, r"[\x00-\x7F]++", "")


def scripts(nfc: Column, rest: Column) -> dict[str, Column]:
    """Letters, and how many are Latin, Arabic and Perso-Arabic ones. rest: beyond_ascii() of the text."""
    plain = T.count_of(nfc, "[^A-Za-z]")
    return {"letters": plain + T.count_of(rest, r"\P{L}"), "latin": plain + T.count_of(rest, r"\P{IsLatin}"), "arabic": T.count_of(rest, r"[^\x{0621}-\x{064A}\x{0671}-\x{06D3}]"), "perso": T.count_of(rest, r"[^\x{067E}\x{0686}\x{0698}\x{06AF}\x{06A9}\x{06CC}]")}


def ends_in(token: Column, pattern: str) -> Column:
    """Whether a token ends in one of a pattern's endings, by a set of endings for each length."""
    by_length: dict[int, list[str]] = {}
    for x in pattern[3:-2].split("|"):
        by_length.setdefault(len(x), []).append(x)
    return reduce(or_, (F.right(token, F.lit(n)).isin(*some) for n, some in by_length.items()))


def cues(lower: Column) -> Column:
    """The tokens that a list of the votes has."""
    return F.filter(lower, lambda t: t.isin(*sorted({*TR_STOP, *EN_STOP, *TR_PROBE, *TR_SLANG, *(w for some in OTHERS.values() for w in some)})))


def votes(rest: Column, lower: Column, known: Column, letters: Column) -> dict[str, Column]:
    """Points for Turkish, English and the strongest other Latin language. rest: beyond_ascii() of the text; lower: lower-case tokens; known: cues() of them."""
    n = F.size(lower)
    point = lambda c, k: F.when(c, k).otherwise(0)
    suffixed = lambda p, least: F.filter(lower, lambda t: (F.length(t) >= least) & ends_in(t, p))
    share_of = lambda some: F.when(n > 0, hits(known, some) / n).otherwise(0.0)
    en = point(share_of(EN_STOP) > 0.08, 2)
    ascii_form = suffixed(TR_ASCII_SUFFIX, 4)
    tr = (
        point((letters > 0) & (T.count_of(rest, TR_LETTERS.replace("[", "[^")) / letters > 0.015), 2)
        + point(share_of(TR_STOP) > 0.06, 2)
        + point((n > 0) & (F.size(suffixed(TR_SUFFIX, 1)) / n >= 0.08), 1)
        + point(hits(known, TR_PROBE) > 0, 1)
        + point(hits(known, TR_SLANG) > 0, 1)
        + point((en == 0) & (F.size(F.array_distinct(ascii_form)) >= 2) & (F.size(ascii_form) / n >= 0.12), 1)
    )
    most = F.greatest(*(hits(known, some) for some in OTHERS.values()))
    rate = F.when(n > 0, most / n).otherwise(0.0)
    other = F.when((most >= 4) & (rate > 0.06), 3).when((most >= 2) & (rate > 0.03), 2).otherwise(0)
    return {"tr": tr, "en": en, "other": other}


def primary(s: dict[str, Column], v: dict[str, Column], rest: Column) -> Column:
    """unknown, unsupported, mixed, en or tr. s: shares of the scripts, and letters; v: votes(); rest: beyond_ascii() of the text."""
    best, gap = F.greatest(v["tr"], v["en"]), F.abs(v["tr"] - v["en"])
    turkic = (T.count_of(rest, "[^ə]") >= 2) | (T.count_of(rest, "[^ýžň]") >= 2)
    return (
        F.when(s["letters"] < 8, "unknown")
        .when((s["arabic"] > 0.3) & (s["perso"] > 0.02), "unknown")
        .when(s["arabic"] >= 0.2, "unsupported")
        .when(s["latin"] < 0.6, "unknown")
        .when(turkic | ((v["other"] > 0) & (v["other"] >= best)), "unknown")
        .when(best == 0, "mixed")
        .when((v["tr"] > 0) & (v["en"] > 0) & (gap <= 1), "mixed")
        .when(v["tr"] > v["en"], "tr")
        .otherwise("en")
    )


def confidence(lang: Column, v: dict[str, Column]) -> Column:
    gap = F.abs(v["tr"] - v["en"])
    none = (v["tr"] == 0) & (v["en"] == 0)
    return F.when(lang.isin("unknown", "unsupported"), 0.0).when(lang == "mixed", F.when(none, 0.3).otherwise(0.4)).otherwise(F.least(F.lit(0.95), 0.5 + 0.1 * gap))


def identify(df, nfc: str = "nfc", tokens: str = "lower"):  # noqa: ANN001, ANN201
    """df with language and language_confidence; tokens: a column of lower-case tokens."""
    df = T.barrier(df.withColumns({"_cues": cues(F.col(tokens)), "_rest": beyond_ascii(F.col(nfc))}))
    s = scripts(F.col(nfc), F.col("_rest"))
    df = T.barrier(df.withColumns({f"_s_{k}": c for k, c in s.items()}))
    letters, v = F.col("_s_letters"), votes(F.col("_rest"), F.col(tokens), F.col("_cues"), F.col("_s_letters"))
    wide = T.barrier(df.withColumns({f"_v_{k}": c for k, c in v.items()}))
    share = {k: F.col(f"_s_{k}") if k == "letters" else F.when(letters > 0, F.col(f"_s_{k}") / letters).otherwise(0.0) for k in s}
    v = {k: F.col(f"_v_{k}") for k in v}
    wide = T.barrier(wide.withColumn("language", primary(share, v, F.col("_rest"))))
    wide = wide.withColumn("language_confidence", confidence(F.col("language"), v))
    return wide.drop(*(f"_s_{k}" for k in s), *(f"_v_{k}" for k in v), "_cues", "_rest")
