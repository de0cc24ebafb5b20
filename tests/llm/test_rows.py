"""Operators that return the caller's rows or learn from them: clashing column names, very long texts only, very many equal rows, and odd rows for the operators of sharding and divergence."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import EDGES, frame

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _id string, _digest string, _points string, _md5 string, key string, digest string, keep_id string, same string, label string, stays string"


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(i, t, la, s, len(t or ""), *[f"{c}{n}" for c in "abcdefghij"]) for n, (i, t, la, s) in enumerate(EDGES)], CLASH)


def rows_as_they_were(got, docs):
    assert got.columns == docs.columns
    return not set(map(str, got.collect())) - set(map(str, docs.collect()))


def test_copies_leave_clashing_columns(clashing):
    from glyphtrace.llm import exact_dedup as E

    kept = E.drop_exact_copies(clashing)
    assert rows_as_they_were(kept, clashing) and kept.count() == 7
    index, shards = E.build_index(E.keyed(clashing.where("doc_id = 6")))
    met = E.repeats_of_history(clashing, index, shards)
    assert met.columns == [*clashing.columns, "_keep_id", "group_size"] and met.count() == len(EDGES)
    assert {(r["_keep_id"], r["group_size"]) for r in met.where("doc_id IN (6, 7)").collect()} == {(6, 3)}


def test_near_copies_leave_clashing_columns(clashing):
    from glyphtrace.llm.minhash import drop_near_copies

    kept = drop_near_copies(clashing)
    assert rows_as_they_were(kept, clashing) and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 8, 8, None, 9])


def test_a_million_equal_rows(spark):
    """One key on all rows: no step makes an array or a task of them."""
    from glyphtrace.llm.exact_dedup import drop_exact_copies, exact_groups

    docs = spark.range(1_000_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    got = exact_groups(docs).groupBy("kept", "keep_id", "group_size").count().collect()
    assert sorted((r["kept"], r["count"]) for r in got) == [(False, 999_999), (True, 1)] and {r["group_size"] for r in got} == {1_000_000}
    assert drop_exact_copies(docs).count() == 1


def test_equal_rows_share_a_mix(spark):
    import corpus_pipeline as P
    from glyphtrace.llm import mixing

    docs = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("five words are in here").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(22).cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.limit(1000).withColumns({"source": F.lit("b"), "text": F.lit("two words")}))
    want = {r["source"]: r["t"] for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    got = P.mixed(spark, docs, "").groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("t"), F.count("*").alias("n")).collect()
    assert {r["source"]: r["t"] for r in got} == want and sum(want.values()) == pytest.approx(1.5 * 17_000, abs=5)


def test_fits_learn_from_long_texts_only(spark):
    """Languages and classes whose texts are all of 50,000 words are learned."""
    from glyphtrace.llm import language_id, quality, toxicity

    draw = random.Random(1)
    words = {"xx": "yesterday evening whatever housing watered greenish".split(), "yy": "gestern niemals irgendwo gebäude gewässer unterwegs".split()}
    texts = [(k, " ".join(draw.choice(words[la]) + ("!!$$" if la == "xx" else "") for _ in range(50_000)), la, "a") for k, la in enumerate(["xx", "yy"] * 8)]
    docs = frame(spark, texts)
    model = language_id.fit(docs)
    assert model.languages == ["xx", "yy"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(docs.select("doc_id", "text"), model).collect()}
    assert got == {k: la for k, _, la, _ in texts}
    labels = docs.select("doc_id", (F.col("lang") == "xx").cast("int").alias("label"))
    for operator in (quality, toxicity):
        model = operator.fit(docs, labels)
        assert model.logistic is not None
        scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
        assert all((scores[k] > 0.5) == (la == "xx") for k, _, la, _ in texts)


def test_windows_of_long_texts(spark):
    from glyphtrace.llm.fitting import window_of

    texts = ["", "short", "x" * 40] + ["".join(random.Random(k).choices("abcdefgh", k=1000)) for k in range(50)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", window_of(F.col("text"), 40, 1).alias("w")).collect()
    assert all(r["w"] == r["text"] if len(r["text"]) <= 40 else len(r["w"]) == 40 and r["w"] in r["text"] for r in got)
    assert len({r["text"].index(r["w"]) for r in got if len(r["text"]) > 40}) > 20


def test_shards(spark):
    from glyphtrace.llm import sharding as S

    docs = frame(spark, [*EDGES, *[(i, f"text {i}", "en", "a") for i in range(100, 3000)], *[(None, "same", "en", "a")] * 500])
    got = S.shards(docs, [1.0, 2.0, 1.0, 4.0], 2.0)
    rows = got.collect()
    assert len(rows) == docs.count() and got.columns == ["doc_id", "size", "text_crc32", "shard", "grown_shard", "slot"]
    own, slots = {}, {}
    for r in rows:
        assert own.setdefault(r["doc_id"], r["shard"]) == r["shard"] and r["grown_shard"] in (r["shard"], 4)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = Counter(own.values())
    assert all(abs(share[k] / len(own) - w / 8) < 0.04 for k, w in enumerate([1, 2, 1, 4]))
    assert abs(sum(r["grown_shard"] == 4 for r in rows if r["doc_id"] is not None) / 2900 - 0.2) < 0.04
    assert S.shards(docs.limit(0), [1.0, 1.0]).count() == 0
    with pytest.raises(ValueError):
        S.shards(docs, [1.0, 0.0])


def test_written_shards(spark, tmp_path):
    from glyphtrace.llm import sharding as S

    docs = frame(spark, EDGES)
    S.write_shards(docs, str(tmp_path / "out"), [1.0, 3.0], files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r["doc_id"], r["shard"]) for r in S.shards(docs, [1.0, 3.0]).collect()}
    assert back.count() == len(EDGES) and {(r["doc_id"], r["shard"]) for r in back.collect()} == want
    with pytest.raises(ValueError):
        S.write_shards(docs.withColumn("shard", F.lit(1)), str(tmp_path / "no"), [1.0])


def test_transducers():
    import numpy as np

    from glyphtrace.llm.source_divergence import BLOCK, Transducer, Vocabulary, counted  # noqa: F401

    draw = random.Random(3)
    terms = sorted({"".join(draw.choice("abcé") for _ in range(draw.randint(1, 12))).encode() for _ in range(5000)} | {b"a" * 3000, b"a" * 2999})
    whole = Transducer.unpack(Transducer.build(terms).pack())
    some = [*terms, b"zz", b"a" * 2998, b"ab" * 9]
    data, ends = np.frombuffer(b" ".join(some) + b" ", np.uint8), np.cumsum([len(t) + 1 for t in some]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    want = [terms.index(t) if t in set(terms) else -1 for t in some]
    assert whole.ordinals(data, starts, ends).tolist() == want
    blocks = Vocabulary([(i, terms[i], Transducer.build(terms[i : i + 700])) for i in range(0, len(terms), 700)])
    assert blocks.ordinals(data, starts, ends).tolist() == want
    # states are as few as the distinct right languages
    right = {}
    for t in terms[:400]:
        for i in range(len(t) + 1):
            right.setdefault(t[:i], set()).add(t[i:])
    assert len(Transducer.build(terms[:400]).final) == len({frozenset(r) for r in right.values()})
    assert Transducer.build([]).ordinals(data, starts, ends).tolist() == [-1] * len(some)
    for most in (7, 100, 10**6):
        found = Counter()
        for group, ordinal, n in counted(blocks, [(5, data), (2, data[:50]), (5, np.zeros(0, np.uint8))], most):
            for g, o, k in zip(group.tolist(), ordinal.tolist(), n.tolist()):
                found[g, o] += k
        assert {o for g, o in found if g == 5} == {w for w in want if w >= 0} and sum(k for (g, _), k in found.items() if g == 5) == len(terms)


def test_divergence_on_odd_rows(spark, monkeypatch, tmp_path):
    """Blocks, rounds and tiles of a few terms and sources give the rows of the SQL; clashing columns, nulls, long terms."""
    import duckdb

    from glyphtrace.llm import source_divergence as D

    draw = random.Random(5)
    words = ["Été", "the", "The", "of", "straße", "x1y", "a-b", "don't", "日本語", "LONG" * 500, *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [*EDGES, *[(i % 90, " ".join(draw.choices(words, k=draw.randint(0, 40))), draw.choice(["en", "en", "de", None]), draw.choice([None, "", *"abcdefg"])) for i in range(300)], (7, "no", "fr", "a"), (8, "no", "fr", "b")]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/d")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(map(str, c.sql(D.SQL).fetchall()))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(str(tuple(r)) for r in D.audited(docs).select(columns).collect()) == want
    vocabulary = D.cut(D.kept_terms(D.plain(docs)))
    whole = D.recounted(D.plain(docs), D.cut(D.transducers(vocabulary)))
    parts = D.recounted(D.plain(docs), D.cut(D.transducers(vocabulary, 4)), 500)
    assert sorted(whole.collect()) == sorted(parts.collect()) and vocabulary.where("length(term) = 2000").count() > 0
    monkeypatch.setattr(D.pair_sums, "__defaults__", (2, 3))
    assert sorted(str(tuple(r)) for r in D.audited(docs).select(columns).collect()) == want
    assert D.audited(docs.limit(0)).count() == 0
