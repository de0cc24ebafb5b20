"""Operators that stand beside the queries, against worked examples."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from glyphtrace.functions import text as T
from glyphtrace.operators import authors, documents, history, scoring
from glyphtrace.operators import evaluation as E
from glyphtrace.sources import batch


def test_files_and_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\nthere", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.txt").write_bytes(b"")
    got = {r["path"][-5:]: (r["text"], r["problem"]) for r in batch.read_texts(spark, f"file://{tmp_path}/*.txt").collect()}
    assert got == {"a.txt": ("héllo\nthere", None), "b.txt": (None, "not UTF-8")}  # an empty file has no row
    (tmp_path / "w.json").write_text('{"weightsId":\n "x"}')
    (tmp_path / "v.json").write_text("{")
    assert batch.load_json(spark, f"file://{tmp_path}/w.json") == {"weightsId": "x"}
    with pytest.raises(ValueError, match="v.json"):
        batch.load_json(spark, f"file://{tmp_path}/v.json")


def test_manifest_counts_repeats(spark):
    rows = lambda *ts: spark.createDataFrame([(t,) for t in ts], "text string")
    one, two = batch.manifest(rows("a", "b"), "text").first(), batch.manifest(rows("b", "a"), "text").first()
    assert one == two and one["rows"] == 2 and one["chars"] == 2
    assert batch.manifest(rows("a", "b", "c", "c"), "text").first()["digest"] != one["digest"]
    assert batch.manifest(rows(None), "text").first()["chars"] == 0 and batch.manifest(rows(), "text").first()["digest"] == "0"


def test_splits_by_time_with_ties_and_nulls(spark):
    rows = [("a", k // 3, k) for k in range(11)] + [(None, 0, 100), (None, None, 101), ("b", 5, 200)]
    got = E.side_by_time(spark.createDataFrame(rows, "who string, at long, id long").repartition(5), "who", "at", "id")
    assert got.columns == ["who", "at", "id", "side"]
    sides = {r["id"]: r["side"] for r in got.collect()}
    assert [sides[k] for k in range(11)] == ["fit"] * 6 + ["val"] * 2 + ["test"] * 3
    assert sides[101] == "fit" and sides[100] == "test" and sides[200] == "test"  # the row without a time comes first
    assert E.side_by_time(spark.createDataFrame([], "who string, at long, id long"), "who", "at", "id").count() == 0


def test_pair_and_label_audits(spark):
    pairs = spark.createDataFrame([("p", "x", "REAL"), ("p", "x", "SYNTH"), ("q", "x", "REAL"), ("r", "x", "REAL"), ("r", "y", "SYNTH")], "pair string, audit string, label string")
    assert {r["pair"] for r in batch.pair_problems(pairs, "pair", "audit", "label").collect()} == {"q", "r"}
    rows = spark.createDataFrame([("REAL", "human"), ("SYNTH", "human"), ("REAL", None)], "label string, origin string")
    assert {tuple(r) for r in batch.inconsistent(rows, (F.col("label") == "REAL") == (F.col("origin") == "human")).collect()} == {("SYNTH", "human"), ("REAL", None)}
    keyed = spark.createDataFrame([("k", "a"), ("k", "b"), ("m", "a"), ("m", "a")], "key string, label string")
    assert [tuple(r) for r in E.cross_label(keyed, "key", "label").collect()] == [("k", 2, 2)]


def test_weights_of_cells_that_are_missing(spark):
    own = spark.createDataFrame([("en:prose", "f", 0.1)], "cell string, feature string, w double")
    prior = spark.createDataFrame([("en:prose", "f", 0.2), ("tr:chat", "f", 0.3)], "cell string, feature string, w double")
    got = {(r["cell"], r["w"], r["fallback"]) for r in scoring.with_fallback(own, prior).collect()}
    assert got == {("en:prose", 0.1, False), ("tr:chat", 0.3, True)}


def test_sums_that_add_up(spark):
    rows = spark.createDataFrame([(1, 0.5, -0.4), (1, 0.25, -0.4), (2, 1.0, 0.0)], "id long, raw double, b0 double")
    scored = spark.createDataFrame([(1, 0.35), (2, 1.5)], "id long, logit double")
    assert [r["id"] for r in scoring.broken_sums(rows, scored, ["id"]).collect()] == [2]


def test_triage(spark):
    rows = [(k, 0.5 + k / 1000, "uncertain") for k in range(100)] + [(1000 + k, 0.99, "likely_llm") for k in range(500)] + [(2000, None, "insufficient_text")]
    got = [r["id"] for r in scoring.triage(spark.createDataFrame(rows, "id long, score double, verdict string"), "id").collect()]
    assert got == list(range(40))
    few = spark.createDataFrame(rows[100:], "id long, score double, verdict string")
    assert 10 < scoring.triage(few, "id", most=1000).count() < 100  # about a tenth of the confident ones
    assert scoring.triage(few, "id", most=1000).where("verdict = 'insufficient_text'").count() == 0


def test_histories(spark):
    rows = spark.createDataFrame([(1, ["old one", " ", None, "older"]), (2, []), (3, None)], "id long, history array<string>")
    assert [(r["id"], r["place"], r["prior_text"]) for r in history.normalised(rows).orderBy("place").collect()] == [(1, 0, "old one"), (1, 3, "older")]
    named = spark.createDataFrame([Row(id=1, history=[Row(id="a", text="old one")])])
    assert history.normalised(named).first()["prior_text"] == "old one"
    stored = spark.createDataFrame([((2, "en:prose", "w"),), ((1, "tr:chat", "w"),), ((1, "en:prose", "v"),), ((1, "en:prose", "w"),)], "p struct<version:int,cell:string,weightsId:string>")
    assert [r[0] for r in stored.select(history.mismatch(F.col("p"), 1, F.lit("en:prose"), "w")).collect()] == ["version", "cell", "weightsId", None]


def test_history_speaks_for_steady_authors_only(spark):
    scored = spark.createDataFrame([(1, None, 0.5, 0.0), (2, "short", 0.5, 0.0), (3, None, 0.1, 0.1), (4, None, 0.9, 0.9)], "id long, gate string, llm_channel double, human_channel double")
    compared = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "id long, declared boolean")
    got = history.consistency_signal(scored, compared, "id").collect()
    assert [r["id"] for r in got] == [1] and got[0]["raw"] == -history.WEIGHT


def test_views_and_messages(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.one_space(F.lit("A \t\n b c"), F.lit("en"))) == "a b c"
    said = spark.createDataFrame([("x", 2, "uncertain", 0.5), ("x", 1, "likely_human", 0.1), ("y", 3, "uncertain", None)], "author string, message long, verdict string, score double")
    got = {r["author"]: [(m["message"], m["verdict"], m["score"]) for m in r["per_message"]] for r in authors.per_message(said).collect()}
    assert got == {"x": [(1, "likely_human", 0.1), (2, "uncertain", 0.5)], "y": [(3, "uncertain", None)]}


def test_notes_and_strata(spark):
    formal = "\n".join(["One two three four five six seven eight nine ten eleven."] * 3)
    rows = spark.createDataFrame([(1, "He said “hi” and ٣ left"), (2, formal), (3, "soooo good"), (4, None)], "id long, text string")
    ctx = documents.context(rows, {"lang": "en"})
    notes = {r["id"]: r["display_notes"] for r in documents.notes(ctx).collect()}
    assert notes == {1: ["typographic_quotes", "other_digits"], 2: [], 3: [], 4: []}
    strata = {r["id"]: r["strata"] for r in documents.strata(ctx).collect()}
    assert strata[2] == ["formal_register"] and strata[3] == ["mobile_typed"] and strata[1] == [] == strata[4]


def test_controls(spark):
    ctx = documents.context(spark.createDataFrame([(1, "One is here. Two is there. Three is far.")], "id long, text string"), {"lang": "en", "shape": "prose"})
    text = E.shuffled_sentences(ctx).first()["text"]
    assert sorted(text.replace(".", "").split()) == sorted("One is here Two is there Three is far".split()) and text.count(".") == 3
    pairs = spark.createDataFrame([("p", "a", 1.0), ("p", "a", 2.0), ("p", "b", 4.0), ("q", "a", 1.0)], "pair string, variant string, value double")
    assert [tuple(r) for r in E.paired_delta(pairs, "pair", "variant", "value", "a", "b").collect()] == [("p", 1.5, 4.0, 2.5)]
    long = spark.createDataFrame([("f",), ("g",)], "feature string")
    assert [r[0] for r in E.without_format(long, ("g",)).collect()] == ["f"]
    signs = spark.createDataFrame([("f", "llm", -0.2), ("g", "llm", 0.2), ("h", "human", -0.01), ("i", "human", 0.3)], "feature string, direction string, coef double")
    assert [r["feature"] for r in E.sign_flips(signs).collect()] == ["f", "i"]
    told = E.segmenter_difference(ctx.withColumn("other", F.lit(5)), "other").first()
    assert (told["differ"], told["mean_abs"]) == (1.0, 2.0)
