import datetime

import pytest
from pyspark.sql import functions as F

from glyphtrace.functions import text as T
from glyphtrace.operators import authors, documents, features, history, lexicon, near_duplicate, rules, scoring
from glyphtrace.sources import batch


def one(spark, text, **options):
    ctx = lexicon.without_hits(documents.context(spark.createDataFrame([(1, text)], "id long, text string"), options))
    return features.with_features(ctx).first()


def test_views(spark):
    row = spark.createDataFrame([("İI Ａ а 𝐀é",)], "t string").select(T.case_fold(F.col("t"), F.lit("tr")).alias("tr"), T.fold_confusables(F.col("t")).alias("plain"), T.nfc(F.lit("é")).alias("nfc"), T.homoglyph_units(F.lit("ab аb Ａ ok")).alias("odd"), T.fnv1a_32(F.lit("a")).alias("h")).first()
    assert row["tr"].startswith("iı") and row["plain"] == "İI A a Aé" and row["nfc"] == "é" and row["odd"] == ["аb", "Ａ"] and row["h"] == 0xE40C292C


def test_sentences(spark):
    from glyphtrace.functions.segment import segmented

    text = "Dr. Who paid 3.50 to a.b@c.com on p. 4. He left!! Was it so? Yes."
    got = spark.createDataFrame([(text,)], "t string").select(segmented(F.col("t"), F.lit("prose"))["text"].alias("s")).first()["s"]
    assert got == ["Dr. Who paid 3.50 to a.b@c.com on p. 4.", "He left!!", "Was it so?", "Yes."]


def test_worked_features(spark):
    tens, twenties = " ".join(["word"] * 9 + ["end."]), " ".join(["word"] * 19 + ["end."])
    r = one(spark, " ".join(s[0].upper() + s[1:] for s in [tens] * 4 + [twenties] * 4), shape="prose", lang="en")
    assert r["sentence_len_cv"] == pytest.approx((200 / 7) ** 0.5 / 15) and r["sentence_len_mode_mass"] == 0.5
    r = one(spark, "\n\n".join(" ".join(["word"] * n) for n in (60, 60, 80, 80)), shape="prose", lang="en")
    assert r["paragraph_uniformity"] == pytest.approx(1 - (400 / 3) ** 0.5 / 70)
    r = one(spark, " ".join(["Tiger"] * 160), shape="prose", lang="en")
    assert r["content_word_repeat"] == pytest.approx(1 - 1 / 160)
    r = one(spark, "soooo cool!! wait... dont go :) i meant stay", shape="chat", lang="en")
    assert (r["letter_elongation"], r["multi_exclam"], r["repeated_punct_emoticon"], r["ellipsis_hand_typed"], r["contraction_apostrophe_drop"], r["self_correction_marker"]) == (1, 1, 2, 1, 1, 1)
    assert one(spark, None)["multi_exclam"] is None


def test_lexicon(spark):
    lines = spark.createDataFrame([("# note",), ("i hope this helps | strong | general | - | x",), ("certainly | weak | cs | initial |",), ("on one … other hand | strong | general | -",), ("hope this | weak | general | -",), ("bad | none | general | -",)], "value string")
    lex = lexicon.compile_lines(lines, "en", "llm")
    assert [r["phrase"] for r in lex.where("problem IS NOT NULL").collect()] == ["bad"]
    texts = [(1, "Certainly. I hope this helps, certainly!"), (2, "On one side, on the other hand."), (3, "xi hope this helpsy"), (4, None)]
    ctx = documents.context(spark.createDataFrame(texts, "id long, text string"), {"lang": "en"})
    got = {r["id"]: [(h["phrase"], h["start"]) for h in r["lexicon_hits"]] for r in lexicon.with_hits(ctx, lex.where("problem IS NULL").drop("problem"), "id").collect()}
    assert sorted(got[1]) == [("certainly", 0), ("i hope this helps", 11)] and got[2] == [("on one … other hand", 0)] and got[4] == []
    assert got[3] == [("hope this", 3)]
    served = documents.context(spark.createDataFrame(texts, "id long, text string"), {"lang": "en", "domain": "customer_service"})
    assert [h["phrase"] for h in lexicon.with_hits(served, lex.where("problem IS NULL").drop("problem"), "id").where("id = 1").first()["lexicon_hits"]] == ["i hope this helps"]


def test_lexicon_size_changes_no_hit(spark, monkeypatch):
    lines = spark.createDataFrame([("art | strong | general | -",), ("delve | weak | general | -",), ("state-of-the-art thing | weak | general | -",), ("don't … now | weak | general | -",)], "value string")
    lex = lexicon.compile_lines(lines, "en", "llm").drop("problem")
    texts = spark.createDataFrame([(1, "a state-of-the-art work"), (2, "'delve' or delve- or delved"), (3, "state-of-the-art things, state-of-the-art thing"), (4, "don't go now, party")], "id long, folded string")
    hits = lambda: sorted((r["id"], r["phrase"], r["start"], r["end"]) for r in lexicon.candidates(texts, lex, "id").collect())
    few = hits()
    monkeypatch.setattr(lexicon, "MOST_HEADS", 0)
    assert hits() == few == [(1, "art", 15, 18), (2, "delve", 1, 6), (2, "delve", 11, 16), (3, "art", 13, 16), (3, "art", 38, 41), (3, "state-of-the-art thing", 25, 47), (4, "don't … now", 0, 12)]


def test_rules(spark):
    rows = [(1, "As an AI language model, I cannot."), (2, 'He said "as an ai language model, i cannot" to me'), (3, "# Head\ntext"), (4, "a​b"), (5, "Built by BOT-7"), (6, "# A\na​b")]
    ctx = documents.context(spark.createDataFrame(rows, "id long, text string"), {"shape": "chat", "lang": "en"})
    marks = rules.check_markers([{"name": "bot", "pattern": "BOT-[0-9]"}], spark)
    got = {r["id"]: ([x["name"] for x in r["rules"]], r["rule_notes"]) for r in rules.with_rules(ctx, "id", markers=marks).collect()}
    assert got[1][0] == ["assistant_frame_leak"] and got[2] == ([], ["assistant_frame_suppressed:quotation"]) and got[3][0] == ["markdown_in_chat"]
    assert got[4] == ([], ["invisible_chars_alone"]) and got[5][0] == ["known_machine_marker"] and got[6][0] == ["markdown_in_chat", "invisible_chars"]
    with pytest.raises(ValueError):
        rules.check_markers([{"name": "x"}], spark)


def test_nearest_takes_other_authors(spark):
    words = " ".join("abcdefghij"[i // 10] + "klmnopqrst"[i % 10] for i in range(60))
    rows = [(1, "a", words), (2, "a", words), (3, "b", words + " more"), (4, None, words), (5, "c", "short text")]
    s = near_duplicate.shingled(spark.createDataFrame(rows, "id long, author string, folded string"), "id", "author")
    got = {r["id"]: r["matched_id"] for r in near_duplicate.nearest(s, s, "id").collect()}
    assert got == {1: 4, 2: 4, 3: 1, 4: 1}


def scored(spark, **over):
    base = dict(id=1, n_tokens=600, chars=4000, shape="prose", genre="essay", language="en", rules=[], aggregate=False, active=9, firm=3, score=0.6, llm_channel=0.5, human_channel=0.1, band="500+_tokens", n_llm=3, g_llm=2, n_human=0, g_human=0, n_solid=2, g_solid=2, n_strong_human=0, n_expensive=0, n_human_own=0)
    return spark.createDataFrame([{**base, **over}], f"id long, n_tokens int, chars int, shape string, genre string, language string, rules array<{rules.RULE}>, aggregate boolean, active long, firm long, score double, llm_channel double, human_channel double, band string, n_llm long, g_llm long, n_human long, g_human long, n_solid long, g_solid long, n_strong_human long, n_expensive long, n_human_own long")


FRAME = dict(name="assistant_frame_leak", direction="llm", precision="high", matched="x", note=None, warning=None, count=None)
COPY = {**FRAME, "name": "near_duplicate"}


@pytest.mark.parametrize(
    ("over", "verdict"),
    [
        ({}, "leaning_llm"), ({"n_solid": 1}, "uncertain"), ({"n_llm": 1}, "uncertain"), ({"chars": 10}, "insufficient_text"), ({"language": "unsupported"}, "insufficient_text"),
        ({"llm_channel": 0.1}, "insufficient_text"), ({"llm_channel": 0.7, "n_strong_human": 2}, "uncertain"), ({"rules": [FRAME]}, "likely_llm"), ({"rules": [FRAME], "chars": 10}, "likely_llm"),
        ({"rules": [FRAME], "language": "unsupported"}, "insufficient_text"), ({"rules": [COPY], "llm_channel": 0.1}, "leaning_llm"), ({"genre": "marketing"}, "uncertain"),
        ({"llm_channel": 0.1, "human_channel": 0.5, "n_human": 3, "g_human": 2}, "leaning_human"), ({"llm_channel": 0.1, "human_channel": 0.5, "n_human": 3, "g_human": 2, "aggregate": True, "n_human_own": 3, "n_expensive": 1}, "likely_human"),
    ],
)
def test_verdicts(spark, over, verdict):
    assert scoring.verdicts(scored(spark, **over), now=datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)).first()["verdict"] == verdict


def test_expiry(spark):
    r = scoring.verdicts(scored(spark), expires_at="2025-01-01T00:00:00Z", now=datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)).first()
    assert r["verdict"] == "uncertain" and "weights_expired" in r["warnings"]


def test_weights_contract():
    good = dict(provenance="prior", weightsId="w", generatedAt="x", expiresAt="y", K=2, cells={"en:chat": {"b0": 0, "w": {"f": 1}, "kind": {"f": "rate"}}})
    assert scoring.weight_problems(good) == [] and scoring.weight_problems({**good, "cells": {}}) == ["no usable cell"]


def test_authors(spark):
    rows = [("a", i, f"one two three four five six {'ok' if i % 2 else 'fine'}") for i in range(5)] + [("b", 0, "hm"), (None, 0, None)]
    got = {r["author"]: r for r in authors.author_features(spark.createDataFrame(rows, "author string, message long, text string")).collect()}
    assert got["a"]["template"] == "one two three four five six" and got["a"]["template_messages"] == 5 and got["a"]["passes_floor"] and not got["b"]["passes_floor"] and got["(unknown)"]["bare_token_turn_rate"] == 1


def test_history(spark):
    rows = spark.createDataFrame([(d, "a", 200, f, z) for d, zs in enumerate([(0.0, 1.0, 2.0), (0.2, 1.2, 2.2), (9.0, 9.0, 9.0)]) for f, z in zip("xyz", zs, strict=True)], "doc long, author string, n_tokens int, feature string, z double")
    p = history.profiles(rows.where("doc < 2"), "doc")
    got = {r["doc"]: r["declared"] for r in history.compared(rows, p, "doc").collect()}
    assert got == {0: False, 1: False, 2: True}


def test_batch_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "1", "text": "hello", "sender": "s"}\n\nnot json\n{"id": "3"}\n')
    rows = batch.read_lines(spark, str(tmp_path / "in.jsonl"))
    assert [(r["id"], r["author"], r["_error"]) for r in rows.orderBy("_line").collect()] == [("1", "s", None), (None, None, "not JSON"), ("3", None, "no text")]
    batch.write_reports(rows.where("_error IS NULL"), rows.where("_error IS NOT NULL"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_sources(spark):
    rows = spark.createDataFrame([(1, "x", 0, "a long enough text, this one"), (2, "x", 1, "short"), (3, "x", 0, "A long enough TEXT this one"), (4, "x", 7, "another text that is long enough")], "id long, src string, y long, body string")
    m = batch.mapped(rows, F.col("body"), {0: "llm", 1: "human"}, "y")
    assert {r["id"] for r in m.collect()} == {1, 2, 3} and [r["id"] for r in batch.intake(m, "src", "label", "id", 10).collect()] == [1]
    wide = spark.createDataFrame([(1, ["a", "b"], "c")], "id long, human array<string>, bot string")
    assert {(r["text"], r["label"]) for r in batch.expanded(wide, {"human": "human", "bot": "llm"}).collect()} == {("a", "human"), ("b", "human"), ("c", "llm")}


def test_options():
    assert documents.check_options({"preset": "essay"}) == {"shape": "prose", "genre": "essay", "lang": "en"}
    with pytest.raises(ValueError):
        documents.check_options({"shape": "round"})


def test_stream(spark, tmp_path):
    from glyphtrace.streaming import documents as stream

    spark.createDataFrame([(1, "wow!! so good")], "id long, text string").write.json(str(tmp_path / "in"))
    q = stream.write(stream.feature_rows(stream.read(spark, str(tmp_path / "in"), "id long, text string"), "id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("feature = 'multi_exclam'").count() == 1


def test_evaluation(spark):
    from glyphtrace.operators import evaluation as E

    rows = spark.createDataFrame([(i, f"common words here and number {i} 5551234567 mr {'smith' if i else 'zorro'}") for i in range(16)], "id long, text string")
    got = {r["id"]: r["text"] for r in E.scrubbed(rows, "id").collect()}
    assert got[0] == "common words here and number 0 [NUM] mr [NAME]" and E.left_numbers(E.scrubbed(rows, "id")).isEmpty()
    p = spark.createDataFrame([(0.9, 1, "a"), (0.4, 0, "a"), (0.6, 1, "a"), (None, 0, "a"), (0.6, 0, "a")], "p double, y int, w string")
    assert E.auc(p.where("p IS NOT NULL"), ["w"]).first()["auc"] == pytest.approx(3.5 / 4)
    c = E.confusion(p, ["w"], 0.5).first()
    assert (c["tp"], c["fp"], c["neg"]) == (2, 1, 3) and E.flag_rate(p.where("y = 0"), 0.95).first()["bound"] == 1.5
    fair = spark.createDataFrame([(i / 100, 0, "s") for i in range(100)], "p double, y int, stratum string")
    assert E.fair_threshold(fair).first()["tau"] == pytest.approx(0.98)
    with pytest.raises(ValueError):
        E.only_side(spark.createDataFrame([("fit",)], "side string"))
    e = spark.createDataFrame([("x", ["uncertain"], ["likely_llm"], ["r"])], "id string, allowed array<string>, critical_failure array<string>, expect_rules array<string>")
    f = spark.createDataFrame([("x", "uncertain", [("r",)])], "id string, verdict string, rules array<struct<name:string>>")
    assert E.expectations(f, e, "id").first()[1:] == (True, False)
    assert {(r["bucket"], r["count"]) for r in E.labels_by_truth(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "bucket string, truth int, label string")).collect()} == {("a", 1), ("b", 1), ("all", 2)}
    many = spark.createDataFrame([(i % 3, float(i % 7), i % 2) for i in range(90)], "w long, x double, y int")
    assert E.leave_one_out(many, ["x"], "w", 0.5).count() == 3
