"""Operators that no query with SQL exercises, against loops or worked examples."""

import io
import json

import pytest
from pyspark.sql import functions as F

from glyphtrace.functions import text as T
from glyphtrace.operators import documents, features, history, lexicon, scoring
from glyphtrace.operators import evaluation as E
from glyphtrace.operators.detect import detect, detect_authors
from glyphtrace.plans import text as plans
from glyphtrace.sources import batch
from tests.conftest import DATA, duck


def test_kept_phrases_against_loops(spark):
    """Longest first, then leftmost, then least; what overlaps a kept one goes."""
    hits = {}
    for r in duck(plans.LEXICON_CANDIDATES, "sf0.01").itertuples(index=False):
        hits.setdefault(r[0], []).append((r[2] - r[3], r[2], r[3], r[1]))
    want = set()
    for doc, some in hits.items():
        kept = []
        for _, a, b, phrase in sorted(some):
            if not any(x < b and y > a for x, y, _ in kept):
                kept.append((a, b, phrase))
        want |= {(doc, p, a, b) for a, b, p in kept}
    assert {tuple(r) for r in plans.lexicon_matches(spark, f"{DATA}/sf0.01").collect()} == want and len(want) > 50


def test_places_of_many_matches(spark):
    text = " ".join(f"w{i % 97}é" for i in range(20_000))
    got = spark.createDataFrame([(text,), ("",), (None,), ("no",)], "t string").select(T.places(F.col("t"), "w[0-9]+").alias("p")).collect()
    assert [(x["start"], x["value"]) for x in got[0]["p"]] == [(m.start(), m[0]) for m in __import__("re").finditer("w[0-9]+", text)]
    assert got[1]["p"] == [] and got[2]["p"] is None and got[3]["p"] == []
    odd = spark.createDataFrame([("w1\ue000w2 \ue001😀w3",)], "t string").select(T.places(F.col("t"), "w[0-9]+").alias("p"), T.places(F.col("t"), "\\S+").alias("q")).first()
    assert [(x["start"], x["end"]) for x in odd["p"]] == [(0, 2), (3, 5), (8, 10)] and [(x["start"], x["end"]) for x in odd["q"]] == [(0, 5), (6, 10)]


def test_a_hundred_thousand_hits_in_one_text(spark):
    """Overlaps of very many hits are resolved in seconds, as the loops do."""
    import time

    from glyphtrace.operators import lexicon as X

    draw = __import__("random").Random(4)
    some = sorted({(s := draw.randrange(400_000), s + draw.randint(1, 12), f"p{draw.randint(0, 3)}") for _ in range(100_000)})
    rows = spark.createDataFrame([(1, [(p, "en", "llm", "weak", "general", s, e) for s, e, p in some]), (2, [("a", "en", "llm", "weak", "general", 3, 5)]), (3, []), (4, None)], f"id int, h {X.HIT}")
    began = time.time()
    got = {r["id"]: r["k"] for r in X.resolved(rows, "h").select("id", F.col("lexicon_hits").alias("k")).collect()}
    assert time.time() - began < 30 and len(got[2]) == 1 and got[3] == []
    taken, want = bytearray(400_020), []
    for s, e, p in sorted(some, key=lambda x: (x[0] - x[1], *x)):
        if not any(taken[s:e]):
            taken[s:e] = b"x" * (e - s)
            want.append((p, s, e))
    assert [(x["phrase"], x["start"], x["end"]) for x in got[1]] == want


def test_fold_map(spark):
    r = spark.createDataFrame([("aİ’b",), ("",)], "t string").select(T.folded(F.col("t"), F.lit("en")).alias("f"), T.fold_map(F.col("t"), F.lit("en")).alias("m")).collect()
    assert r[0]["m"] == [0, 1, 2, 3] and r[0]["f"] == "ai'b" and r[1]["m"] == []


def test_evidence_of_phrases(spark):
    lines = spark.createDataFrame([("delve into | strong | general | -",)], "value string")
    rows = spark.createDataFrame([(1, "We Delve into it!! Soooo good?!"), (2, None)], "id long, text string")
    ctx = lexicon.with_hits(documents.context(rows, {"lang": "en"}), lexicon.compile_lines(lines, "en", "llm").drop("problem"), "id")
    got = {r["id"]: r for r in features.evidence(features.with_features(ctx)).collect()}
    assert [(s["start"], s["name"], s["text"]) for s in got[1]["evidence_spans"]] == [(3, "delve into", "Delve into"), (16, "multi_exclam", "!!"), (16, "repeated_punct_emoticon", "!!"), (20, "letter_elongation", "oooo"), (29, "repeated_punct_emoticon", "?!")]
    assert "llm_lexicon_strong" in got[1]["spanless"] and got[2]["evidence_spans"] == []


def test_matrix(spark):
    order = ("likely_llm", "leaning_llm", "uncertain", "leaning_human", "likely_human", "insufficient_text")
    rows = spark.createDataFrame([(a, b) for a in order for b in order], "a string, b string").select("a", "b", scoring.combined(F.col("a"), F.col("b")).alias("c")).collect()
    short = dict(zip(order, ("LL", "EL", "UN", "EH", "LH", "IT"), strict=True))
    table = {"LL": "LL EL EL UN UN UN", "EL": "EL EL UN UN UN UN", "UN": "EL UN UN UN EH UN", "EH": "UN UN UN EH EH UN", "LH": "UN UN EH EH LH EH", "IT": "IT IT IT IT IT IT"}
    assert all(short[r["c"]["verdict"]] == table[short[r["a"]]].split()[order.index(r["b"])] for r in rows)
    assert {(short[r["a"]], short[r["b"]]) for r in rows if r["c"]["conflict"]} == {("LL", "EH"), ("LL", "LH"), ("EL", "EH"), ("EL", "LH"), ("EH", "LL"), ("LH", "LL")}


def test_weights_round_trip(spark, tmp_path):
    rows = [("en:prose", "multi_exclam", 0.4, 0.1, 0.5, "rate", -0.3), ("en:prose", "hedge_density", 0.2, 0.0, 1.0, "rate", -0.3)]
    w = spark.createDataFrame(rows, "cell string, feature string, w double, mu double, sigma double, kind string, b0 double")
    doc = scoring.weights_document(w, "fitted", "w1", "2024-01-01T00:00:00Z", "2025-01-01T00:00:00Z")
    (tmp_path / "w.json").write_text(json.dumps(doc))
    back, about = scoring.load_weights(spark, f"file://{tmp_path}/w.json")
    assert sorted(tuple(r) for r in back.select(*w.columns).collect()) == sorted(rows) and about["weightsId"] == "w1"
    with pytest.raises(ValueError, match="provenance"):
        scoring.weights_document(w, "guess", "w1", "a", "b")


def test_numbered_and_strided(spark):
    rows = spark.range(1000).withColumn("x", F.lit("a")).repartition(7)
    got = batch.numbered(rows, "id").collect()
    assert all(r["id"] == r["_i"] for r in got) and len(got) == 1000
    assert sorted(r["id"] for r in batch.strided(rows, "id", 4, 3).collect()) == [p * 250 + i for p in range(4) for i in range(3)]


def test_keys_scope_and_pairs(spark):
    keys = spark.createDataFrame([("ÇAĞRI, Işık ٣!",), ("cagri isik 3",), ("Été 😀 x",)], "t string").select(E.norm_key(F.col("t")).alias("k")).collect()
    assert keys[0]["k"] == keys[1]["k"] == "cagri isik 3" and keys[2]["k"] == "été x"
    rows = spark.createDataFrame([("REAL", "ok", "en"), ("OTHER", "ok", "en"), ("SYNTH", " ", "en"), ("REAL", "ok", "fr"), ("REAL", "سلام", None), (None, "x", None)], "label string, text string, lang string")
    assert [r["excluded"] for r in E.in_scope(rows).collect()] == [None, "label", "blank", "language", "script", "label"]
    p = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "a", "t"), (4, None, "s"), (5, "b", None), (6, "b", None)], "id int, pair string, source string")
    assert {r["id"]: r["pair"] for r in E.paired(p).collect()} == {1: "a", 2: "a", 3: None, 4: None, 5: "b", 6: "b"}
    first = {r["k"]: (r["id"], r["repeats"]) for r in E.first_of_key(spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), (None, 2, "b")], "k string, id int, x string"), "k", "id").collect()}
    assert first == {"k": (1, 2), None: (2, 1)}


def test_fits(spark):
    rows = spark.createDataFrame([(i, i % 2, float(i % 2) + (i % 7) / 10, None if i % 3 else 1.0, ("fit", "val", "test")[i % 3], f"w{i % 90}") for i in range(360)], "id int, y int, a double, b double, side string, w string")
    scored = E.fitted(rows, ["a", "b"], F.col("side") == "fit")
    c = E.calibrated(scored, F.col("side") == "val")
    assert c.where("(p > 0.5) <> (y = 1)").isEmpty() and c.where("calibrated IS NULL").isEmpty()
    assert E.fitted(rows.limit(20), ["a"], F.lit(True)).where("p IS NOT NULL").isEmpty()
    assert E.fitted(rows, ["a", "b"], F.col("side") == "fit", dropped=("a",)).where("p > 0.9").isEmpty()
    std = E.standard_columns(rows, ["a", "b"], F.col("side") == "fit").where("side = 'fit' AND y = 0").agg(F.avg("a"), F.stddev_samp("a")).first()
    assert std[0] == pytest.approx(0, abs=1e-9) and std[1] == pytest.approx(1)
    held = E.leave_one_out(rows, ["a", "b"], "w", 0.5, folds=3).collect()
    assert len(held) == 90 and all(r["rows"] == 4 for r in held)  # more writers than folds: all are judged


def test_genre_slice(spark):
    rows = spark.createDataFrame([("essay", i / 100, int(i >= 60), "s", "val" if i % 2 else "test") for i in range(100)] + [("chat", 0.9, 0, "s", "val")], "genre string, p double, y int, stratum string, side string")
    r = E.genre_slice(rows, "essay", F.col("side") == "val", F.col("side") == "test").first()
    assert (r["tau"], r["tp"], r["fp"]) == (0.61, 19, 0)


def weights_of(spark):
    return spark.createDataFrame([(f"{la}:{s}", f, 0.8, 0.0, 1.0, "rate", -0.2) for la in ("en", "tr") for s in ("chat", "prose") for f in ("multi_exclam", "repeated_punct_emoticon", "letter_elongation", "ellipsis_hand_typed")], "cell string, feature string, w double, mu double, sigma double, kind string, b0 double")


MESSAGE = "well that was sooooo good!! we went to the market and it was the best day... is this not what you have been after all this time?? "


def test_detect_sums_and_history(spark):
    rows = spark.createDataFrame([(1, "ann", MESSAGE * 2), (2, "bob", MESSAGE * 2), (3, "ann", "ok")], "id long, author string, text string")
    plain = {r["id"]: r for r in detect(rows, "id", weights=weights_of(spark)).collect()}
    assert plain[3]["logit"] == -0.2 and plain[3]["gate"] is not None and plain[1]["human_channel"] > 0.25 and "base_rate" in plain[1]["caveats"]
    profile = spark.createDataFrame([("ann", f, 1.0, 1.0, 3) for f in ("multi_exclam", "repeated_punct_emoticon")], "author string, feature string, mean double, sd double, docs long")
    told = {r["id"]: r for r in detect(rows, "id", weights=weights_of(spark), profiles=profile).collect()}
    assert told[1]["history"]["features"] == 2 and not told[1]["history"]["declared"] and told[1]["logit"] == pytest.approx(plain[1]["logit"] - history.WEIGHT)
    assert told[2]["logit"] == plain[2]["logit"] and told[2]["history"] is None and told[1]["active"] == plain[1]["active"]


def test_authors_end_to_end(spark):
    messages = spark.createDataFrame([("ann", i, f"{MESSAGE} {i}") for i in range(6)] + [("bob", 1, "hi")] + [(None, i, "yes") for i in range(2)], "author string, message long, text string")
    got = {r["author"]: r for r in detect_authors(messages, weights=weights_of(spark)).collect()}
    assert got["bob"]["gate"] == got["(unknown)"]["gate"] == "aggregate_floor" and got["ann"]["verdict"] in scoring.VERDICTS and got["ann"]["n_tokens"] > 100


def test_reports_for_people(spark):
    r = spark.createDataFrame([(1, "uncertain", 0.5, 0.2, None, [("near_duplicate", None)], ["w"])], "id int, verdict string, score double, llm_channel double, human_channel double, rules array<struct<name:string,matched:string>>, warnings array<string>")
    assert batch.pretty(r, "id").first()["report"].splitlines() == ["verdict: uncertain", "score: 0.500", "channels: machine 0.200, human -", "rules: near_duplicate ()", "warnings: w"]
    assert batch.read_stdin(spark, io.StringIO("a text")).first()["text"] == "a text"
    with pytest.raises(ValueError, match="no text"):
        batch.read_stdin(spark, io.StringIO(""))
