"""Worked examples of features: each value by hand."""

import pytest
from glyphtrace.operators import documents, features, lexicon

WORDS = "we walked along the quiet river and talked about nothing at all for most of the long warm evening"


def values(spark, cases):
    """The features named of each (name, text, options); one job for cases of equal options."""
    out = {}
    for number, (name, text, options) in enumerate(cases):
        out.setdefault(tuple(sorted(options.items())), []).append((number, name, text))
    got = {}
    for options, some in out.items():
        rows = spark.createDataFrame([(n, t) for n, _, t in some], "id int, text string")
        wide = features.with_features(lexicon.without_hits(documents.context(rows, dict(options))), tuple({n for _, n, _ in some}))
        found = {r["id"]: r for r in wide.collect()}
        got |= {n: found[n][name] for n, name, _ in some}
    return [got[n] for n in range(len(cases))]


PROSE, CHAT = {"shape": "prose", "lang": "en"}, {"shape": "chat", "lang": "en"}
TR = {"shape": "prose", "lang": "tr"}


def test_worked_examples(spark):
    twenty = "one two three four five six seven eight nine ten one two three four five six seven eight nine ten"
    opening = "First, we met the old keeper. Second, he showed us the light. Finally, we left the tower. Then we slept. Rain fell. Wind blew."
    parallel = ". ".join(f"{w} {WORDS}" for w in ("Birds", "Birds", "Fish", "Birds", "Stones", "Fish", "Trees")) + "."
    cases = [
        ("terminal_punct_ratio", f"{twenty}.\n{twenty}\nend here! 😀\nno end", CHAT, 0.5),
        ("terminal_punct_ratio", twenty, CHAT, None),  # one unit
        ("sentence_initial_caps", f"Yes we {twenty}. no we do not. Well then\n123 ok fine", CHAT, 0.5),  # Yes, no, Well, ok
        ("exclam_single_regular", "One! Two. Three! Four.", PROSE, 1.0),
        ("exclam_single_regular", "One!! Two. Three! Four.", PROSE, 0.0),
        ("exclam_single_regular", "One. Two. Three.", PROSE, None),
        ("wa_single_asterisk", "this is *really* good", CHAT, 1.0),
        ("wa_single_asterisk", "this is **really** good", CHAT, None),
        ("emoji_repeat_run", "nice 😀😀", CHAT, 1.0),
        ("emoji_repeat_run", "nice 👍🏽", CHAT, 1.0),
        ("emoji_repeat_run", "nice 😀 👍", CHAT, None),
        ("enumerated_openers", opening, PROSE, 1.0),
        ("enumerated_openers", opening.replace("Finally", "Later"), PROSE, None),
        ("parallel_openers", parallel, PROSE, 1 - 4 / 7),
        ("balanced_contrast_frame", f"It is not only cheap but also fast. On the one hand so. {WORDS} " * 5, PROSE, 10.0),
        ("out_of_channel_register", f"{'word ' * 60}\n\n{'word ' * 60}", {"channel": "whatsapp", "lang": "en"}, 1.0),
        ("out_of_channel_register", f"{'word ' * 60}\n\n{'word ' * 60}", {"channel": "email", "lang": "en"}, None),
        ("tr_formal_copula", "kelime " * 99 + "gelmektedir", TR, 1.0),
        ("tr_formal_copula", "kelime " * 98 + "yapmalıdır gelmektedir", TR | {"genre": "formal_letter"}, None),
        ("sentence_len_cv", "\n\n".join(f"- {WORDS}" for _ in range(9)), PROSE, None),  # a list
        ("sentence_len_mode_mass", ". ".join([WORDS] * 6 + ["Short one here"] * 4) + ".", PROSE, 0.6),
    ]
    got = values(spark, [c[:3] for c in cases])
    for case, value in zip(cases, got, strict=True):
        assert value == (None if case[3] is None else pytest.approx(case[3])), case[:2]


def test_phrases_of_people(spark):
    lines = [("lol", "human", "strong"), ("idk", "human", "weak"), ("delve", "llm", "weak"), ("tapestry of", "llm", "strong")]
    lex = spark.createDataFrame([(p, "en", k, t, "general", "-") for p, k, t in lines], "phrase string, lang string, kind string, tag string, domain string, flag string")
    rows = spark.createDataFrame([(1, "lol idk LOL idk, a tapestry of lols"), (2, "we delve " * 20), (3, "nothing")], "id int, text string")
    names = ("human_lexicon", "llm_lexicon_strong", "llm_lexicon_weak")
    got = {r["id"]: tuple(r[n] for n in names) for r in features.with_features(lexicon.with_hits(documents.context(rows, CHAT), lex, "id"), names).collect()}
    assert got == {1: (8.0, 1.0, None), 2: (None, None, 50.0), 3: (None, None, None)}


def test_evidence_in_units_of_the_raw_text(spark):
    """Spans of rules, features and the folded view; characters past the basic plane, decomposed texts, marks without a place."""
    from glyphtrace.operators import rules

    texts = ["😀😀 As an AI language model, I cannot. I’m not sure, it may be so!!", "caf\u0065\u0301 it may be so!!", "# Head\na\u200bb **bold words**", "İt may well be"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ctx = lexicon.without_hits(documents.context(rows, CHAT))
    names = ("multi_exclam", "emoji_repeat_run", "repeated_punct_emoticon", "all_lowercase")
    wide = features.with_features(ctx, names).selectExpr("*", "cast(1 as double) AS hedge_density")
    got = {r["id"]: r for r in features.evidence(rules.with_rules(wide, "id")).collect()}

    def slices(n):
        units = texts[n].encode("utf-16-le")
        spans = got[n]["evidence_spans"]
        assert all(units[2 * s["start"] : 2 * s["end"]].decode("utf-16-le")[:80] == s["text"] for s in spans)
        return [(s["name"], s["text"], s["source"], s["direction"]) for s in spans]

    assert slices(0) == [
        ("emoji_repeat_run", "😀😀", "signal", "human"), ("assistant_frame_leak", got[0]["rules"][0]["matched"], "rule", "llm"), ("hedge_density", "may", "signal", "llm"),
        ("multi_exclam", "!!", "signal", "human"), ("repeated_punct_emoticon", "!!", "signal", "human"),
    ]
    assert [s[0] for s in slices(1)] == ["multi_exclam", "repeated_punct_emoticon"] and "hedge_density" in got[1]["spanless"]
    assert [s[:2] for s in slices(2)] == [("markdown_in_chat", "# H"), ("invisible_chars", "\u200b"), ("markdown_in_chat", "**bold words**")] and slices(3) == [("hedge_density", "may", "signal", "llm")]


def test_report_has_spans_and_suspects(spark):
    """detect() tells where its signals stand, and of sentences that are too long to be one."""
    from glyphtrace.operators.detect import detect
    from glyphtrace.plans.corpus import _rule_weights

    rows = spark.createDataFrame([(1, f"{WORDS} " * 8), (2, f"so good!! {WORDS}. {WORDS}! As an AI language model, I cannot say.")], "id int, text string")
    got = {r["id"]: r for r in detect(rows, "id", weights_from=_rule_weights).collect()}
    assert "segmentation_suspect" in got[1]["warnings"] and "segmentation_suspect" not in got[2]["warnings"]
    assert {"multi_exclam", "assistant_frame_leak"} <= {s["name"] for s in got[2]["evidence_spans"]} and got[1]["evidence_spans"] == []
