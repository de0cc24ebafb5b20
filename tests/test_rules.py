import pytest
from pyspark.sql import functions as F

from glyphtrace.operators import documents, features, lexicon, rules

LEAKS = [
    "As a large language model I must decline.", "As an AI, I can't say.", "I'm just an AI here.", "I am an AI.", "My training data ends early.", "I do not have real-time data.", "I cannot browse the web.", "Sadly I cannot browse today.",
    "Here's your revised version of it.", "Here is the polished draft.", "I have rewritten it for you.", "I was trained on data from books.", "As of my last update, yes.", "Being an AI model, I pass.", "As an artificial intelligence, I pass.",
    "As a machine learning model, I pass.", "My responses are generated for you.", "I don't have personal opinions.", "I do not have feelings about it.", "I have no ability to access files.", "I'm not able to browse the internet.", "I was created by OpenAI.",
    "I am an automated assistant.", "It doesn’t matter. As an AI, I pass.", "As an AI assistant, I cannot do that.", "as\nan   ai i pass", "Аs an AI, I pass.",
    "Bir dil modeli olarak bunu yapamam.", "Ben bir yapay zeka asistanıyım.", "Yapay zeka modeli olarak yardımcı olurum.", "Eğitim verilerim eski.", "Bilgi kesim tarihim belli.", "Gerçek zamanlı veriler bulunmuyor.", "Gerçek zamanlı erişim yok.",
    "Bir yapay zeka olarak bilemem.", "Ben bir yapay zekâyım.", "Kişisel deneyimim yok.", "Yanıtlarım otomatik olarak üretilir.", "Gerçek zamanlı bilgilere erişimim yok.", "Duygularım ya da tercihlerim yok.",
]
HELD = [
    ('He wrote "As an AI, I pass" and left.', "quotation"), ("“As an AI, I pass” it goes", "quotation"), ("As an AI system he had no way to know.", "third_person"), ("As an AI product the software could not help.", "third_person"),
    ("The reply began As an AI I cannot help.", "reporting_clause"), ("The manager explained that as an AI I would know.", "reporting_clause"), ("Bir dil modeli olarak bunu yapamam dedi.", "reporting_clause"),
    ("I asked ChatGPT about it yesterday and then some more. As an AI, I pass.", "chatgpt"), ("The model Claude wrote a lot of things for us. As an AI, I pass.", "claude"),
]
CLEAN = [
    "Here is the revised itinerary my colleague sent over.", "The language model is a tool.", "sitenin yapay zeka asistanı felaket", "I have feelings about it.", "Claude went to the shop.", "We do not have a garden.", "I was trained by my father.", "", "My answers are short.", "As an aid to memory.",
]


def leak_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ctx = rules.with_rules(features.with_features(lexicon.without_hits(documents.context(rows)), ("multi_exclam",)), "id")
    return {r["id"]: r for r in ctx.select("id", F.filter("rules", lambda x: x["name"] == "assistant_frame_leak").alias("leak"), "rule_notes").collect()}


def test_frames(spark):
    got = leak_of(spark, LEAKS)
    assert [t for i, t in enumerate(LEAKS) if not got[i]["leak"]] == []
    assert got[LEAKS.index("As an AI, I can't say.")]["leak"][0]["matched"] == "As an AI" and got[LEAKS.index("Аs an AI, I pass.")]["leak"][0]["warning"] == "homoglyph_suspect"


def test_suppressed_frames(spark):
    got = leak_of(spark, [t for t, _ in HELD])
    assert [(t, got[i]["rule_notes"]) for i, (t, _) in enumerate(HELD) if got[i]["leak"]] == []
    assert [got[i]["rule_notes"] for i in range(len(HELD))] == [[f"assistant_frame_suppressed:{why}"] for _, why in HELD]


def test_texts_without_frames(spark):
    got = leak_of(spark, CLEAN)
    assert [t for i, t in enumerate(CLEAN) if got[i]["leak"] or got[i]["rule_notes"]] == []


def test_a_name_is_no_cue_by_itself(spark):
    assert leak_of(spark, ["Claude and Gemini went to the shop for some bread. As an AI, I pass."])[0]["leak"]


def test_invisible_characters_beside_two_signals(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, n_llm int").withColumns({"invisible": F.lit(4), "rules": F.array().cast(f"array<{rules.RULE}>"), "rule_notes": F.array(F.lit("invisible_chars_alone"))})
    got = {r["id"]: ([x["name"] for x in r["rules"]], r["rule_notes"]) for r in rules.with_signal_count(rows).collect()}
    assert got == {1: ([], ["invisible_chars_alone"]), 2: ([], ["invisible_chars_alone"]), 3: (["invisible_chars"], [])}


@pytest.mark.parametrize(
    ("text", "name", "value"),
    [
        ("icin cok sey icin güzel ve bir de bu", "tr_asciified_probe", 4 / 6), ("icin güzel ve bir de bu o ben", "tr_mixed_orthography", 1), ("gece sabah bugün ve bir de bu o", "tr_mixed_orthography", None),
        ("Istanbulda Ankaradan gelen bir kisi var ve o da bu ben sen biz", "tr_apostrophe_absent", 2), ("Masadan kalkan adam Kapıdan geçen ve o da bu ben sen biz", "tr_apostrophe_absent", None),
        ("gelicem valla yapcaz hadi abi", "tr_chat_morphology", 5), ("Istanbul ve Izmir bir de bu o ben sen", "tr_bare_capital_I", 2),
    ],
)
def test_turkish_features(spark, text, name, value):
    ctx = lexicon.without_hits(documents.context(spark.createDataFrame([(1, text)], "id long, text string"), {"lang": "tr", "shape": "chat"}))
    got = features.with_features(ctx, (name,)).first()[name]
    assert got is None if value is None else got == pytest.approx(value)


def test_word_lists_are_whole(spark):
    assert (len(features.CONTRACTIONS), len(features.FUNCTION_OPENERS["en"]), len(features.TR_PLAIN), len(rules.EN_FRAMES), len(rules.TR_FRAMES)) == (28, 27, 38, 23, 12)
    ctx = lexicon.without_hits(documents.context(spark.createDataFrame([(1, "it doesnt and didnt matter, thats what shes saying")], "id long, text string"), {"lang": "en", "shape": "chat"}))
    assert features.with_features(ctx, ("contraction_apostrophe_drop",)).first()["contraction_apostrophe_drop"] == 4
