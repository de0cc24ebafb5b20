"""The segmenter: each rule by worked cases; as a column, a table function and a query."""

import pytest

from glyphtrace.functions import segment as S


def told(text, shape="prose"):
    return [(s[0], s[3], s[4]) for s in S.segment(text, shape)]


@pytest.mark.parametrize(("text", "shape", "want"), [
    # units
    ("one line\ntwo Lines\n\nthree", "chat", ["one line", "two Lines", "three"]),
    ("one line\ngoes on\nThen new", "prose", ["one line goes on", "Then new"]),
    ("one line\n\ngoes not on", "prose", ["one line", "goes not on"]),
    ("I went home\nBut it rained. Then\nAnd we left 😀 Then more", "prose", ["I went home But it rained.", "Then And we left 😀", "Then more"]),
    ("Evde kaldım\nÇünkü yağdı\nYa da kar\nKim", "prose", ["Evde kaldım Çünkü yağdı Ya da kar", "Kim"]),
    ("Android is\nAndroids are", "prose", ["Android is", "Androids are"]),
    ("أهلا\nمرحبا بك", "prose", ["أهلا مرحبا بك"]),
    ("first\n  \t\nsecond\n- item", "prose", ["first", "second", "- item"]),
    # full stops that end nothing
    ("It costs 3.5 dollars. Fine", "prose", ["It costs 3.5 dollars.", "Fine"]),
    ("Saat 1. gece geldi. 15. ayın", "prose", ["Saat 1. gece geldi.", "15. ayın"]),
    ("In 123. we came", "prose", ["In 123.", "we came"]),
    ("1. Otel rezervasyonu. 2. Uçuş", "prose", ["Otel rezervasyonu.", "Uçuş"]),
    ("Ask Dr. Who and Prof. X. Then", "prose", ["Ask Dr. Who and Prof. X. Then"]),
    ("Bkz. sayfa. Tel. 0212", "prose", ["Bkz. sayfa.", "Tel. 0212"]),
    ("Acme Inc. is big", "prose", ["Acme Inc.", "is big"]),  # a capital I is the dotless letter's
    ("See example.com. Next. Mail a@b.c. Now", "prose", ["See example.com. Next.", "Mail a@b.c. Now"]),
    ("at https://x.y/z. Next", "prose", ["at https://x.y/z. Next"]),
    ("by J. Smith and A. B. Clark. Good", "prose", ["by J. Smith and A. B. Clark.", "Good"]),
    ("etc... and more", "prose", ["etc...", "and more"]),
    # runs, closing marks
    ("Really?!... \"Yes.\") No", "prose", ["Really?!...", "\"Yes.\")", "No"]),
    ("wait… what‼ ok！ 好。 end", "prose", ["wait…", "what‼", "ok！", "好。", "end"]),
    ("ما هذا؟ نعم۔ لا، شكرا", "prose", ["ما هذا؟", "نعم۔", "لا، شكرا"]),
    # soft marks
    ("one; two؛ three", "prose", ["one;", "two؛", "three"]),
    ("one; two؛ three", "chat", ["one; two؛ three"]),
    # emoji
    ("nice 😀 day 😀😀 Then", "chat", ["nice 😀 day 😀😀", "Then"]),
    ("nice 👍🏽 Then", "chat", ["nice 👍🏽", "Then"]),
    ("done.😀 Then 😀", "chat", ["done.", "😀 Then 😀"]),
    ("hi 😀 there", "chat", ["hi 😀 there"]),
    # words
    ("... 123 !!! ok", "chat", ["ok"]),
    ("", "prose", []),
    (None, "prose", []),
])
def test_rules(text, shape, want):
    assert [s[0] for s in S.segment(text, shape)] == want


def test_terminators_and_runs():
    assert told("Really?!. So… Well; fine") == [("Really?!.", "?", "?!."), ("So…", "…", "…"), ("Well;", ";", ";"), ("fine", None, "")]
    assert told("Yes 😀", "chat") == [("Yes 😀", "emoji", "")]


@pytest.mark.parametrize(("text", "want"), [
    ("- one item. Two", [True, False]), ("1. First. Second", [True, False]), ("12) First", [True]), ("123) First", [False]), ("• a\n‣ b\n· c\n+ d\n* e", [True] * 5),
    ("1.First thing", [False]), ("word. - not at the start", [False, True]), ("٣. بند", [True]),
])
def test_lists(text, want):
    assert [s[2] for s in S.segment(text, "chat")] == want


def test_words_and_suspects():
    assert [s[1] for s in S.segment("don't stop well-known 12 things. Go", "prose")] == [4, 1]
    assert S.segment("word " * 130, "prose")[0][1] > S.SUSPECT


def test_long_texts_take_one_pass():
    import time

    began = time.time()
    assert len(S.segment("a.b@c." * 200_000, "prose")) == 1 and len(S.segment("Yes. " * 200_000, "chat")) == 200_000
    assert len(S.segment("line\n" * 200_000, "prose")) == 1 and time.time() - began < 30


def test_table_function_equals_the_column(spark):
    from pyspark.sql import functions as F

    S.register(spark)
    rows = [(1, "One. Two 😀 Three", "prose", 7), (2, None, "chat", 8), (3, "a; b\nC", "chat", 9), (4, "a; b\nC", "prose", 9)]
    spark.createDataFrame(rows, "id int, text string, shape string, words int").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT * FROM sentences(TABLE(SELECT * FROM some_texts))")
    assert got.columns == ["id", "text", "shape", "_words", "number", "sentence", "words", "listed", "terminator", "run"]
    each = spark.table("some_texts").select("id", F.posexplode(S.segmented(F.col("text"), F.col("shape"))).alias("number", "s"))
    assert sorted(got.select("id", "number", "sentence", "words", "listed", "terminator", "run").collect()) == sorted(each.select("id", "number", "s.*").collect())
    assert [tuple(r) for r in spark.sql("SELECT n_words('İt''s a test'), length_bucket(n_words('a b')), folded('İ’x')").collect()] == [(3, "<20", "i'x")]
    assert spark.sql("SELECT id, nfc(text) AS n, segmented(text, shape) AS s FROM some_texts").count() == 4
