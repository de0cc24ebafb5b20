"""Cheap tests before searches: texts that they pass, and that searches give what they gave."""

import random
import re

from pyspark.sql import functions as F

from glyphtrace.functions import text as T
from glyphtrace.operators import features as FE
from glyphtrace.operators import lexicon as X
from glyphtrace.plans import corpus
from tests.conftest import DATA
from tests.test_growth import plan


def test_literals_are_in_each_match():
    some = {p: m for p, m in [
        *((p, x) for p in FE.POLITE.values() for x in ("thank you for", "thank you so much for", "happy to assist", "teşekkür ederiz", "iyi günler dilerim", "ıyi günler dilerim")),
        *((p, x) for p in FE.HEDGES.values() for x in ("may", "tends to", "görünmektedir")),
        *((p, x) for ps in FE.BALANCED.values() for p in ps for x in ("not only a but also", "whether you're a or", "whether you are a or", "on the one hand", "hem a hem de", "sadece a değil aynı zamanda", "ister a ıster")),
        *(("|".join(ps), x) for ps in FE.CONNECTORS.values() for x in ("moreover", "bunun  yanı sıra", "ek olarak")),
    ]}
    for pattern, text in some.items():
        assert all(FE.literals(pattern))
        python = re.sub(r"\\p\{\w+\}", "", pattern)
        if re.search(python, text):
            assert any(x in text for x in FE.literals(pattern)), (pattern, text)


def test_searches_give_the_same(spark):
    draw = random.Random(3)
    bits = [":)", ":-(", ":'(", "<3", "xD", ";)", ":", "x", "<", "!", "?", "؟", " ", "  ", "\n", "\r\n", "\r", "\t", ",", ".", "a", "é", "’", "`", "ـ", "ً", "أ", "\u2028", "1", "-", "may ", "\n \n"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(14))) for _ in range(2_000)]
    t, n = F.col("t"), lambda c, p: F.regexp_count(c, F.lit(p))
    unified = F.regexp_replace(F.translate(t, T.ALEF_FORMS + T.APOSTROPHES + T.TATWEEL, "ا" * len(T.ALEF_FORMS) + "'" * len(T.APOSTROPHES)), T.TASHKEEL, "")
    lines = F.split(t, r"\r?\n", -1)
    slips = n(t, r"\S {2,}\S") + n(t, r"\s+[,.;:!?\x{060C}\x{061B}\x{061F}]") + n(t, r"[,.;:\x{060C}\x{061B}](?=\p{L})") + F.size(F.filter(lines, lambda x: x.rlike(r"[^\S\n]$") & x.rlike(r"\S")))
    pairs = {
        "marks": (T.matching_marks(t), unified), "lines": (T.lines(t), lines), "paragraphs": (T.paragraphs(t), F.filter(F.split(t, r"\r?\n(?:[^\S\n]*\r?\n)+", -1), lambda p: p.rlike(r"\S"))),
        "emoticons": (n(t, rf"[!?\x{{061F}}]{{2,}}|{FE.EMOTICON_BY_FIRST}"), n(t, r"[!?\x{061F}]{2,}") + n(t, FE.EMOTICON)), "slips": (F.when(t.rlike(FE.SLIPS), slips).otherwise(0), slips),
    }
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    for name, (a, b) in pairs.items():
        assert rows.where(~a.eqNullSafe(b)).count() == 0, name


def test_single_words_are_not_compared_again(spark):
    fields = "phrase string, lang string, kind string, tag string, domain string, flag string"
    rows = [("may", "en", "llm", "strong", "general", "-"), ("may be", "en", "llm", "weak", "general", "-"), ("so", "en", "human", "weak", "general", "initial"), ("top", "en", "llm", "weak", "general", "-"), ("well-known", "en", "llm", "weak", "general", "-")]
    texts = ["may be. so may_ may1 may-be mayor maý may", "not so. so top", "a well-known top2 top top-2 top", ""]
    df = T.barrier(spark.createDataFrame(enumerate(texts), "id long, folded string"))
    by_table = X.candidates(df, spark.createDataFrame(rows, fields), "id").select("id", "phrase", "start", "end").collect()
    hits = X.in_columns(spark.createDataFrame(rows, fields))
    inline = df.select("id", F.explode(hits(F.col("folded"))).alias("h")).select("id", "h.phrase", "h.start", "h.end").collect()
    assert sorted(map(tuple, inline)) == sorted(map(tuple, by_table)) and len(inline) > 9
    one = X.in_columns(spark.createDataFrame(rows[:1], fields))
    assert "substring" not in plan(df.select(one(F.col("folded")))).lower()


def test_scores_read_texts_once(spark):
    assert "documents.parquet" not in plan(corpus.scores(spark, f"{DATA}/sf0.001"))


def test_long_lexicons_meet_texts_by_their_first_words(spark):
    from glyphtrace.functions import tables

    fields = "phrase string, lang string, kind string, tag string, domain string, flag string"
    phrases = [*(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)), "one two three four", "one two", "one-two's three", "one  two", "one … ree", "one tw… four", "four"]
    rows = spark.createDataFrame([(p, "en", "llm", "strong", "general", "initial" if p == "four" else "-") for p in phrases], fields)
    texts = ["one two three four. one two three fourth", "one-two's three one  two three", "one twos, four. four four", "one a three", "x wab wabc", "", "one two one two"]
    df = T.barrier(spark.createDataFrame(enumerate(texts), "id long, folded string"))
    seen, old = [], tables.written
    X.written = lambda d: (seen.append(d.select(F.explode("_some")).count()), old(d))[1]
    try:
        got = sorted(tuple(r) for r in X.candidates(df, rows, "id").select("id", "phrase", "start", "end").collect())
    finally:
        X.written = old
    assert got == [
        (0, "one two", 0, 7), (0, "one two", 20, 27), (0, "one two three four", 0, 18), (0, "one … ree", 0, 13), (0, "one … ree", 20, 33), (1, "one  two", 16, 24), (1, "one … ree", 0, 15), (1, "one … ree", 16, 30), (1, "one-two's three", 0, 15),
        (2, "four", 16, 20), (3, "one … ree", 0, 11), (4, "wab", 2, 5), (6, "one two", 1, 8), (6, "one two", 10, 17),
    ]
    # 36 candidates met by two words
    assert seen[0] <= 29, seen


def test_normal_keys_pass_what_they_do_not_change(spark):
    import unicodedata

    from glyphtrace.operators import evaluation as E

    for c in map(chr, range(0x180)):
        kept = unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)
        assert kept or re.match(T.NOT_NFKC.replace("x{0", "u0").replace("-\\x{10FFFF}", "-\U0010ffff").replace("}", ""), c), hex(ord(c))
    draw = random.Random(9)
    some = ["I", "İ", "ı", "i", "i̇", "ç", "â", "É", "ß", "Σ", "ς", "ﬁ", "½", "أ", "ـ", "ً", "ى", "☀", "😀", "️", "-", " ", "A", "9", "٣", "́"]
    texts = [chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0x20000)]] + ["".join(draw.choice(some) for _ in range(draw.randrange(9))) for _ in range(2_000)]
    t = F.translate(F.regexp_replace("t", T.TASHKEEL, ""), E.ARABIC_FROM + T.TATWEEL, E.ARABIC_TO)
    t = F.regexp_replace(t, r"[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}\x{FE0F}]", "")
    old = F.trim(F.regexp_replace(F.lower(F.translate(T.case_fold(t, F.lit("tr")), E.TURKISH_FROM, E.TURKISH_TO)), r"[^\p{L}\p{Nd}]+", " "))
    rows = spark.createDataFrame([(unicodedata.normalize("NFKC", x),) for x in texts], "t string")
    assert rows.where(E.plain_key(F.col("t")) != old).count() == 0
    raw = spark.createDataFrame([(x, unicodedata.normalize("NFKC", x)) for x in texts], "t string, n string")
    assert raw.where(T.nfkc(F.col("t")) != F.col("n")).count() == 0
    # a text of Latin letters with marks went through Python before
    assert spark.createDataFrame([("Çok güzel é",)], "t string").where(F.col("t").rlike(T.NOT_NFKC)).count() == 0
