"""Leak-free sides against union-find, and medians of coverage."""

import random
import statistics

from glyphtrace.operators import evaluation as E
from glyphtrace.operators import splits as P
from pyspark.sql import functions as F

SCHEMA = "group string, key string, label int, recorded string, n_tokens int"


def test_sides_against_union_find(spark):
    draw = random.Random(3)
    rows = [(f"g{draw.randrange(300):03}", f"k{draw.randrange(250):03}" if draw.random() < 0.7 else None, draw.choice([0, 0, 0, 0, 1, None]), "test" if draw.random() < 0.03 else draw.choice(["fit", None]), draw.randrange(90)) for _ in range(500)]
    rows += [(f"c{i:03}", f"chain{i + d:03}", 0, None, 5) for i in range(60) for d in (0, 1)]  # a long chain is one component
    rows += [(None, "k001", 0, None, 1), ("lone", None, None, None, None)]
    parent = {g: g for g, *_ in rows}

    def find(g):
        while parent[g] != g:
            g = parent[g]
        return g

    by_key = {}
    for g, k, *_ in rows:
        if g is not None and k is not None:
            a, b = find(g), find(by_key.setdefault(k, g))
            parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r["group"]: r for r in P.leak_free_sides(table.withColumn("side", F.lit("?"))).collect()}
    assert {g: r["component"] for g, r in got.items()} == {g: g if g is None else find(g) for g in parent}
    labels = {}
    for _, k, y, *_ in rows:
        if k and y is not None:
            labels.setdefault(k, set()).add(y)
    for component in {r["component"] for r in got.values()}:
        inside = [r for r in rows if (r[0] if r[0] is None else find(r[0])) == component]
        forced, tested = any(len(labels.get(r[1], ())) > 1 for r in inside), any(r[3] == "test" for r in inside)
        some = [r for r in got.values() if r["component"] == component]
        assert len({r["side"] for r in some}) == 1 and {r["why"] for r in some} == {"collision" if forced else "recorded" if tested else "hash"}
        assert forced or not tested or some[0]["side"] == "test"
    met = table.where("group IS NOT NULL AND key IS NOT NULL").join(spark.createDataFrame([(g, r["side"]) for g, r in got.items() if g], "group string, side string"), "group")
    assert {r["kind"]: r["n"] for r in E.split_leaks(met, "key", "side", "group").collect()} == {"key": 0, "group": 0}
    assert P.leak_free_sides(table.limit(0)).count() == 0


def test_coverage_medians(spark):
    draw = random.Random(1)
    rows = [(f"g{draw.randrange(9)}", None, draw.randrange(3), None, draw.choice([None, *range(12)])) for _ in range(200)] + [("g1", None, 7, None, None)]
    got = {r["label"]: r for r in P.coverage(spark.createDataFrame(rows, SCHEMA), ["label"]).collect()}
    for label in {r[2] for r in rows}:
        some = [r for r in rows if r[2] == label]
        values = [r[4] for r in some if r[4] is not None]
        assert (got[label]["rows"], got[label]["groups"], got[label]["median"]) == (len(some), len({r[0] for r in some}), statistics.median(values) if values else None)
