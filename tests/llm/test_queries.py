"""The registered queries over small tables with odd rows, against brute force or what their contracts say."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_operators import EDGES, base, brute_near, frame

VOCABULARY = {"en": "the of and to in house water green walk seven", "de": "der die und nicht haus wasser mit gehen sieben", "fr": "le la et pas maison eau avec aller sept"}


def rows_of(draw):
    rows = list(EDGES)
    for i in range(100, 400):
        lang = draw.choice(sorted(VOCABULARY))
        words = [draw.choice(VOCABULARY[lang].split()) + draw.choice(("", "", "en", "er", "ly")) for _ in range(draw.randint(8, 60))]
        if i % 10 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(("rotter", "wretch", "vermin")))
        if i % 7 == 0:
            words = [w.upper() + "!!$$" for w in words]
        rows.append((i, " ".join(words), lang, draw.choice("abc")))
        if i % 25 == 0:
            rows.append((i + 1000, " ".join(words), lang, "c"))
    rows.append((5000, " ".join(draw.choice(VOCABULARY["en"].split()) for _ in range(60_000)), "en", "b"))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    rows = rows_of(random.Random(4))
    frame(spark, rows).write.parquet(f"{top}/documents.parquet")
    labels = [(i, int(i % 7 != 0), int(i % 10 == 0), 1.5) for i, *_ in rows if i is not None] + [(None, 1, 1, 0.0), (101, None, None, 0.0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score double").write.parquet(f"{top}/labels.parquet")
    return top, rows


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("none"))
    frame(spark, []).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return top


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def crc(i, parts):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % parts


def test_empty_tables(spark, no_rows):
    from glyphtrace.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, no_rows).count() == 0, name


def test_pii_query(spark, tables):
    from glyphtrace.llm.pii import op1_pii

    top, rows = tables
    got = op1_pii(spark, top)
    assert dict(got.dtypes)["n_email"] == "bigint"
    want = Counter((i, sha(base(t or ""))) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got.collect()) == want


@pytest.mark.parametrize(("name", "parts", "held"), [("toxicity", 4, 2), ("quality", 5, 0)])
def test_classifier_queries(spark, tables, name, parts, held):
    from glyphtrace.llm.queries import QUERIES

    top, rows = tables
    got = QUERIES[{"toxicity": "op2_toxicity", "quality": "op3_quality"}[name]](spark, top)
    assert {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items() <= dict(got.dtypes).items()
    found = got.collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"], parts) == held) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    again = {r["doc_id"]: r["score"] for r in QUERIES[{"toxicity": "op2_toxicity", "quality": "op3_quality"}[name]](spark, top).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in found if r["doc_id"] != 8)  # 8 stands on several texts


def test_distances_against_brute_force():
    """Differences and features by compressing every window anew, without what is kept between windows."""
    import zstandard

    from glyphtrace.llm import quality as Q
    from glyphtrace.llm import toxicity as X

    filler = " ".join(f"{chr(97 + i % 23)}{i * 7919}" for i in range(100)).encode()
    toxic, ordinary = filler + b" wretchedness  rotterdammer  verminously ", filler + b" house  water  green  seven  walk "
    d = X.Distance(toxic, ordinary)

    def size(content, window):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + X.ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=X.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(X.ANCHOR + b" " + window.encode() + b" "))

    text = "The house, you wretchedness! Water and verminously; WRETCHEDNESS " + "walk " * 50
    words = [w for w in re.split(r"[\s.,!?|;:()$%&*#\"]+", text.lower()) if w]
    differences = sorted((size(ordinary, w) - size(toxic, w) for w in words), reverse=True)
    n, f = len(words), d.features(text)
    assert f[0] == differences[0] and any(differences) and f[1] == pytest.approx(sum(differences[:3]) / 3) and f[2] == pytest.approx(sum(differences[:10]) / 10) and f[3] == pytest.approx(sum(differences) / n)
    assert f[4 : 4 + len(X.STEPS)] == pytest.approx([sum(x >= s for x in differences) / n for s in X.STEPS]) and f[-1] == math.log(n)
    draw = random.Random(1)
    good, bad = (zstandard.train_dictionary(2048, [" ".join(draw.choice(v.split()) for _ in range(30)).encode() for _ in range(500)]).as_bytes() for v in (VOCABULARY["en"], VOCABULARY["de"]))
    text = " ".join(draw.choice(VOCABULARY["de"].split()) for _ in range(900))
    b = text.encode()
    sizes = []
    for content in (good, bad):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), level=Q.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append([len(c.compress(b[i : i + Q.PIECE])) for i in range(0, len(b), Q.PIECE)])
    g, w = map(np.array, sizes)
    got = Q.Sizes(good, bad).features(text)
    assert got[0] == pytest.approx((g.sum() - w.sum()) / max(g.sum(), w.sum())) and got[0] > 0 and got[1:3] == pytest.approx([((g - w) / np.maximum(g, w)).max(), ((g - w) / np.maximum(g, w)).min()])


def test_audio_query(spark, tables):
    from glyphtrace.llm import mpeg_audio as M

    top, rows = tables
    found = M.op4_mpeg_audio(spark, top).collect()

    def want(i, t):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        media = M.write(padded)
        parsed = M.parse(media)
        assert M.payload_of(media, parsed) == padded
        return i, len(raw), len(padded), sha(padded), zlib.crc32(padded[-64:]), len(media), sha(media), parsed["micros"], tuple(parsed["offsets"])

    fields = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "duration_micros")
    assert Counter((*(r[f] for f in fields), tuple(r["frame_offsets"])) for r in found) == Counter(want(i, t) for i, t, _, _ in rows)
    assert all(re.search(r"crc=(\d+)/\1;", r["feature"]) for r in found)


def test_bpe_query(spark, tables):
    import public_tokenizers as P
    import tiktoken

    from glyphtrace.llm import byte_bpe as B

    top, rows = tables
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter((i, len(x := enc.encode_ordinary(t or "")), sha(",".join(map(str, x))), sha(t or "")) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.op6_byte_bpe(spark, top).collect()) == want


def test_language_query(spark, tables):
    from glyphtrace.llm import language_id as L

    top, rows = tables
    found = L.op8_language_id(spark, top).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in found)
    truth = {i: la for i, _, la, _ in rows if i is not None and 100 <= i < 400}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)


def test_language_scores_by_hand():
    """A prediction by loops over the letter n-grams of each word, each hashed on its own."""
    from glyphtrace.llm import language_id as L

    model = L.Model([(" ".join(random.Random(i).choices(v.split(), k=20)), la) for i in range(40) for la, v in VOCABULARY.items()])
    for text in ("The house and 7 water", "nicht das haus-wasser", "é à la maison", "x"):
        words = ["\0" + w + "\0" for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        total, n = np.zeros(len(model.languages)), 0
        for w in words:
            for size in L.NGRAMS:
                for i in range(len(w) - size + 1):
                    g = w[i : i + size]
                    if g != "\0":
                        h = size
                        for c in g:
                            h = ((h ^ (ord(c) if c != "\0" else 0)) * 0x9E3779B97F4A7C15) % (1 << 64)
                            h ^= h >> 29
                        total += model.table[h % L.BUCKETS]
                        n += 1
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        with np.errstate(over="ignore"):
            lang, score = model.predict(text, L.letter_table())
        assert lang == model.languages[p.argmax()] and score == pytest.approx(p.max(), rel=1e-4)


def test_every_language_is_learned(spark):
    from glyphtrace.llm import language_id as L

    docs = frame(spark, [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}x " * 4, f"l{i % 300:03}", "a") for i in range(900)])
    assert len(L.fit(docs).languages) == 300


def test_sample_is_bounded_and_told_by_text(spark):
    from glyphtrace.llm.fitting import by_id, label_counts, labelled_sample

    docs = frame(spark, [(7, f"text {i}", "en", "a") for i in range(500)] + [(8, "same", "en", "a")] * 300 + [(9, "x" * 50, "en", "a"), (None, "no id", "en", "a")])
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (8, 1), (9, 0), (None, 1)], "doc_id long, label int")
    rows = by_id(docs, labels)
    counts = label_counts(rows)
    assert counts == {1: 500, 0: 301}
    got = labelled_sample(rows, counts, {1: 20, 0: 20}, 40, 1)
    assert sum(y == 1 for _, y in got) == 20 and [t for t, y in got if y == 0] in ([], ["same"]) and got == labelled_sample(rows.repartition(5), counts, {1: 20, 0: 20}, 40, 1)


def test_near_query_with_odd_ids(spark, tables):
    from glyphtrace.llm.minhash import op10_minhash

    top, rows = tables
    pairs = [(i, t) for i, t, _, _ in rows]
    want = Counter((i, n, i if n == 0 else c) for (i, _), (n, c) in zip(pairs, brute_near(pairs), strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op10_minhash(spark, top).collect()) == want


def test_near_lists_in_blocks(spark, monkeypatch):
    """A passage that many documents share, ids that are null or taken: cells of a few rows lose no link."""
    from glyphtrace.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 4)
    draw = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    texts = []
    for _ in range(40):  # four fifths are the passage, so that lists are long and few of them link
        own = [draw.choice(words) for _ in range(14)]
        texts.append(passage + " " + " ".join(own))
        if draw.random() < 0.4:
            own[draw.randrange(14)] = draw.choice(words)
            texts.append(passage + " " + " ".join(own))
    rows = [(None if i % 9 == 0 else i // 2 if i % 5 == 0 else 100 + i, t, "en", "a") for i, t in enumerate(texts)]
    want = Counter((n, c) for n, c in brute_near([(i, t) for i, t, _, _ in rows], 5))
    assert Counter((r["n_shingles"], r["component_id"]) for r in minhash.near_rows(frame(spark, rows)).collect()) == want
    kept = minhash.drop_near_copies(frame(spark, [*rows, *rows[:3], (1, "", "en", "a"), (1, None, "en", "a")]))
    texts_of = {t: c for (_, t, _, _), c in zip(rows, component_numbers(rows), strict=True)}
    got = [texts_of[r["text"]] for r in kept.collect() if r["text"]]
    assert sorted(got) == sorted(set(texts_of.values())) and kept.where("coalesce(text, '') = ''").count() == 2


def component_numbers(rows):
    """A number for each row's component, whatever the ids."""
    return [c for _, c in brute_near([(i, t) for i, (_, t, _, _) in enumerate(rows)], 5)]


def test_pipeline_on_odd_rows(spark, tables):
    import corpus_pipeline as P

    top, rows = tables
    docs = spark.read.parquet(f"{top}/documents.parquet")
    first = P.by_language(spark, docs, top)
    assert first.columns == P.COLUMNS and {r["text"] for r in first.collect()} >= {t for i, t, *_ in rows if i is not None and 100 <= i < 400}
    second = P.exact(spark, docs, top)
    squeezed = Counter(re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "") for r in second.collect())
    assert set(squeezed.values()) == {1} and set(squeezed) == {re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t, *_ in rows}
    third = P.near(spark, docs, top)
    numbers = component_numbers(rows)
    own = {t: c for (_, t, *_), c in zip(rows, numbers, strict=True)}
    got = Counter(own[r["text"]] for r in third.collect() if (r["text"] or "").strip())
    assert set(got.values()) == {1} and len(got) == len({own[t] for _, t, *_ in rows if (t or "").strip()})
    fourth = P.mixed(spark, docs, top)
    assert fourth.columns == P.COLUMNS and fourth.count() > 0
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert abs(sum(size(r["text"]) for r in fourth.collect()) - 1.5 * sum(size(t) for _, t, *_ in rows)) < 5
    out = P.run(spark, top)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 100


def test_recall_against_all_pairs(spark):
    """Every link of sf0.001's documents, and of their components, is found."""
    from glyphtrace.llm.minhash import op10_minhash

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in op10_minhash(spark, f"{DATA}/sf0.001").collect()}
    assert all(got[i] == (c if n else i) for (i, _), (n, c) in zip(rows, brute_near(rows), strict=True))


def test_sample_of_labels_by_id(spark):
    """The same as joining texts with labels first: ids that repeat, copies, nulls, long and empty texts."""
    from glyphtrace.llm.fitting import by_id, label_counts, sample_by_id

    docs = [(k, f"text {k}", 9) for k in range(60)] + [(k, "same", 9) for k in range(60, 90)] + [(7, "other text of 7", 9), (None, "no id", 9), (90, None, 9), (91, "", 9), (92, "x" * 50, 9)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, label long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(95)] + [(3, 0), (5, None), (None, 1)], "doc_id long, label int")
    rows = by_id(docs, labels)
    got, counts = sample_by_id(docs, labels, {0: 1000, 1: 1000}, 40, 1)
    assert counts == label_counts(rows)
    want = {(r["text"][:40], r["label"]) for r in rows.where("length(text) > 0").collect()}  # the long text is of one letter
    assert set(got) == want and len(got) == len(want) and ("other text of 7", 1) in want and ("text 3", 0) in want
    few, _ = sample_by_id(docs.repartition(7), labels, {0: 5, 1: 8}, 40, 1)
    assert set(few) <= want and 0 < sum(y == 0 for _, y in few) <= 5 and sum(y == 1 for _, y in few) <= 8
    assert few == sample_by_id(docs, labels, {0: 5, 1: 8}, 40, 1)[0] and sample_by_id(docs.limit(0), labels, {0: 5, 1: 8}, 40, 1) == ([], {})
