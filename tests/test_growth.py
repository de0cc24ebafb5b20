"""Steps whose cost grew too fast: what they hold and read, and that their results stay."""

import contextlib
import io
import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from glyphtrace.functions import segment as S
from glyphtrace.functions import text as T
from glyphtrace.operators import documents as D


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_segmenter_holds_few_objects():
    texts = ["One two three. Four five six! Seven eight nine? " * 30] * 400
    tracemalloc.start()
    got = S._segmented.func(pa.array(texts), pa.array(["prose"] * len(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6_000_000  # 36,000 sentences; a dict of each took 9 MB
    assert got.to_pylist() == [[dict(zip(S.SENTENCE.names, s, strict=True)) for s in S.segment(t, "prose")] for t in texts]


def test_fold_map_by_runs(spark):
    letters = spark.createDataFrame([(chr(i),) for i in [*range(1, 0xD800), *range(0xE000, 0x20000)]], "c string")
    assert letters.where(~F.col("c").rlike(T.UNEVEN) & (F.length(T.folded(F.col("c"))) != 1)).count() == 0
    draw = random.Random(5)
    texts = ["".join(draw.choice("abIİ ʼ’éΑσΣـًإi̇😀.") for _ in range(draw.randrange(9))) for _ in range(300)]
    chars = F.filter(F.split("t", ""), lambda c: c != "")
    for lang in (None, F.lit("tr")):
        each = F.transform(chars, lambda c: T.folded(c, lang))
        one = F.flatten(F.transform(each, lambda f, i: F.array_repeat(i, F.length(f))))
        rows = T.barrier(spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold_map(F.col("t"), lang).alias("a"), F.when(F.array_join(each, "") == T.folded(F.col("t"), lang), one).alias("b"))).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows] and any(r["a"] is None for r in rows) and any(r["a"] for r in rows)
    assert spark.range(1).select(F.size(T.fold_map(F.repeat(F.lit("plain text "), 200_000))).alias("n")).first()["n"] == 2_200_000


def test_windows_are_not_cut_again(spark):
    draw = random.Random(7)
    rows = [[draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.randrange(1, 4) for _ in range(n)] for n in (0, 1, 29, 30, 49, 50, 51, 120, 333)]
    df = D.diagnostics(T.barrier(spark.createDataFrame([(w,) for w in rows], "lower array<string>").withColumn("n_tokens", F.size("lower"))))
    assert "array_distinct" not in plan(df)
    for w, r in zip(rows, df.collect(), strict=True):
        means = [len(set(w[i : i + 50])) / 50 for i in range(len(w) - 49)]
        assert r["mattr50"] is None if not means else abs(r["mattr50"] - sum(means) / len(means)) < 6e-5
        assert r["ttr"] is None if len(w) < 30 else abs(r["ttr"] - len(set(w)) / len(w)) < 6e-5
        assert r["hapax"] is None if len(w) < 30 else abs(r["hapax"] - sum(w.count(x) == 1 for x in w) / len(w)) < 6e-5


def test_words_in_lower_case(spark):
    texts = ["ΟΔΟΣ.Α ΟΔΟΣ Σ'Α", "İstanbul I'M don’t-go ـx ـ́ é́a ~a-'b’-c", "Ⅷ Ⓐ ǅ ß ẞ"]
    old = r"[\p{L}\p{M}&&[^\x{0640}]][\p{L}\p{M}\x{0640}'\x{2019}-]*"
    words = F.regexp_extract_all("t", F.lit(old), F.lit(0))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.words(F.col("t")).alias("w"), words.alias("v"), T.lower_words(F.col("t")).alias("a"), F.transform(words, F.lower).alias("b")).collect():
        assert r["w"] == r["v"] and r["a"] == r["b"]


def test_sets_meet_in_one_exchange(spark):
    """The arrays of shingles aren't shuffled to make sets one, and a set that only asks or only answers meets no other of its kind."""
    from glyphtrace.operators import near_duplicate as N

    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    rows = [(1, "x", " ".join(words)), (2, "y", " ".join(words)), (3, "z", " ".join([*words[:-1], "end"])), (4, "x", " ".join(words[:12])), (5, "y", " ".join(words[:12])), (6, None, " ".join(words))]
    s = N.shingled(spark.createDataFrame(rows, "id int, author string, folded string"), "id", "author")
    got = sorted(tuple(r) for r in N.nearest(s, s, "id").select("id", "matched_id").collect())
    assert got == [(1, 2), (2, 1), (3, 1), (6, 1)]
    other = s.where("id IN (2, 3, 5)")
    assert sorted(tuple(r) for r in N.nearest(s.where("id IN (1, 4, 6)"), other, "id").select("id", "matched_id").collect()) == [(1, 2), (6, 2)]
    one = spark.createDataFrame([(0, "a", True, True, [1, 2, 3, 4, 5]), (1, "b", True, False, [1, 2, 3, 4, 5, 6]), (2, "c", False, True, [1, 2, 3, 4, 5, 7])], "sid long, set_id string, asks boolean, answers boolean, shingles array<long>")
    assert sorted((r["a"], r["b"]) for r in N.similar_sets(one).collect()) == [("a", "c"), ("b", "a")]


def test_rows_are_looked_up_among_themselves_once(spark):
    """detect() with its own rows as index makes their context once; another table's views are written before shingles ask for them."""
    from unittest.mock import patch

    from glyphtrace.operators import detect as DT
    from glyphtrace.plans.corpus import _rule_weights

    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    rows = spark.createDataFrame([(1, "x", " ".join(words)), (2, "y", " ".join(words)), (3, "x", "short"), (4, "z", None)], "id int, author string, text string")
    with patch.object(DT.documents, "context", wraps=DT.documents.context) as made:
        one = DT.detect(rows, "id", weights_from=_rule_weights, index=rows)
        assert made.call_count == 1
        two = DT.detect(rows, "id", weights_from=_rule_weights, index=rows.select("*"))
        assert made.call_count == 3
    found = lambda df: sorted((r["id"], r["verdict"], str(r["rules"])) for r in df.collect())
    assert found(one) == found(two) and sum("near_duplicate" in x[2] for x in found(one)) == 2


def test_shingles_dont_make_words_again(spark):
    """Which rows have shingles isn't asked below the words, where the whole context would be made again."""
    from glyphtrace.operators import near_duplicate as N

    s = N.shingled(D.context(spark.createDataFrame([(1, "a b c d e f"), (2, "a b")], "id int, text string")), "id")
    assert not any("Filter" in x and "regexp_extract_all" in x for x in plan(s).splitlines())
    assert [(r["id"], r["n_tokens"], len(r["shingles"])) for r in s.collect()] == [(1, 6, 2)]


def test_authors_texts_go_in_steps(spark):
    """An author's long row is written between the steps that each hold copies of it; arrays made from written views are the context's."""
    from unittest.mock import patch

    from glyphtrace.operators import detect as DT
    from glyphtrace.plans.corpus import _rule_weights

    draw = random.Random(3)
    words = "the market was good and very far away, so we went home!! İstanbul'da Σας was it? As an AI language model.\n\n- **Bold words**: more... overall may".split(" ")
    messages = spark.createDataFrame([(a, i, " ".join(draw.choices(words, k=draw.randrange(60)))) for a in ("ann", "bob") for i in range(30)] + [("cy", 1, None)], "author string, message long, text string")
    context = D.context(DT.authors.joined(messages), {"shape": "prose"})
    arrays = ("tokens", "lower", "lines", "lines_with_words", "paragraphs", "sentences", "sentence_words", "listed", "segmentation_suspect")
    parts = D.parts(DT.written(context.select("author", *D.VIEWS)))
    assert sorted(map(str, parts.select("author", *arrays).collect())) == sorted(map(str, context.select("author", *arrays).collect()))
    with patch.object(DT, "written", wraps=DT.written) as steps:
        DT.detect_authors(messages, weights_from=_rule_weights)
    held = [set(c.args[0].columns) for c in steps.call_args_list]
    assert sum("folded" in x for x in held) == 4 and not any({"raw", "tokens"} <= x for x in held)  # one before


def test_frames_are_asked_for_once(spark):
    """The pattern of all frames matches where one does, whatever stands around."""
    from glyphtrace.operators import rules as R

    en, tr = tuple(p for p, _ in R.EN_FRAMES), R.TR_FRAMES
    said = """as a language model|i'm just an llm|being a large language model|since i am an ai language model|as an ai|im an ai|i am only an ai|my training data|my knowledge cutoff|i do not have access to real-time|dont have realtime|cannot have real time
    |am unable to browse the web|can't have access to internet|i cannot browse|here's your revised version|here is a polished draft|i have rewritten it|i was trained on data|as of my last update|being an ai model|as an artificial intelligence|as a machine learning model
    |my replies are generated|i don't have personal opinions|i do not have feelings|i have no way to access|i'm not able to browse the web|i was built by openai|i am an automated system
    |bir yapay zeka dil modeliyim|bir yapay zeka modeliyim|yapay zekâ asistanı olarak|eğitim verilerim|bilgi kesim tarihi|gerçek zamanlı erişim yok|bir yapay zeka olarak|ben bir yapay zekayım|kişisel deneyimim yok|yanıtlarım otomatik olarak üretildi|gerçek zamanlı verilere erişimim yok|duygularım veya tercihlerim yok"""
    said = [x.strip() for x in said.split("|")]
    texts = [f"{a}{x}{b}" for x in said for a in ("", "x", "x ", "é", ".") for b in ("", "y", " y")] + ["nothing here", "abc deg hik"]
    df = T.barrier(spark.createDataFrame([(x,) for x in texts], "t string"))
    for some in (en, tr):
        assert all(p.startswith(R._B) for p in some)
        rows = df.select("t", F.col("t").rlike(R._any(some)).alias("one"), F.col("t").rlike(R._spaced("|".join(some))).alias("each")).collect()
        assert all(r["one"] == r["each"] for r in rows)
    hit = df.select(*(F.max(F.col("t").rlike(R._spaced(p)).cast("int")) for p in en + tr)).first()
    assert all(hit)  # an example for every frame
