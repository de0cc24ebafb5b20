"""Near duplicates by word shingles: a prefix-filtered equi-join, exact Jaccard similarity, the nearest for each row.

Each side's shingles are ordered by how many rows hold them, rarest first; rows with a similarity of at least
`least` share one of each other's first n - ceil(least * n) + 1 shingles, so only these meet. Sizes must agree
within the same ratio. Rows with equal shingle sets are one row in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import sized, written

SHINGLE, LEAST, MIN_TOKENS = 5, 0.80, 20
#: Ids of sets that are broadcast, at most.
MOST_IDS = 500_000


def shingled(ctx: DataFrame, key: str, author: str | None = None, n: int = SHINGLE) -> DataFrame:
    """key, author, n_tokens, shingles (sorted hashes) of rows with a shingle. ctx: key, folded."""
    words = T.words(F.col("folded"))
    rows = ctx.select(key, (F.col(author) if author else F.lit(None)).cast("string").alias("author"), words.alias("w"))
    rows = T.barrier(rows).select(key, "author", F.size("w").alias("n_tokens"), T.shingles(F.col("w"), n).alias("s"))
    # the words decide which rows have shingles; a filter on them would move below to where the text is made, and make it again
    some = T.barrier(rows.select(key, "author", "n_tokens", F.explode_outer(F.array(F.when(F.col("n_tokens") >= n, F.col("s")))).alias("s")).where("s IS NOT NULL"))
    return some.select(key, "author", "n_tokens", F.array_sort(F.array_distinct(F.transform("s", lambda x: F.xxhash64(x)))).alias("shingles"))


def _postings(sets: DataFrame) -> DataFrame:
    """shingle, sid, n of every set, dealt by shingle: the one exchange that counts and postings both read."""
    return sets.select("sid", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")).repartition("shingle")


def _prefixes(posted: DataFrame, shared: DataFrame, least: float) -> DataFrame:
    """sid, n (its size), i (place of the shingle), shingle of each set's prefix, as far as other sets hold its shingles.

    Shingles that no other set holds come first in the order; they are counted, not carried.
    """
    held = posted.join(shared, "shingle")
    lists = held.groupBy("sid").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("p"))
    alone = F.col("n") - F.size("p")
    some = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1 - alone
    lists = lists.where(some > 0).select("sid", "n", alone.alias("alone"), F.posexplode(F.slice("p.shingle", F.lit(1), some)).alias("i", "shingle"))
    return lists.select("sid", "n", (F.col("i") + F.col("alone")).alias("i"), "shingle")


def similar_sets(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b, jaccard of the pairs of distinct shingle sets (sid, set_id, asks, answers, shingles) with at least that similarity; a and b are set_ids.

    A pair's a asks and its b answers. Sizes and places travel with the postings, so sets that can't be similar enough,
    judged by their sizes or by what is left behind a shared place, are dropped inside the join. A similar pair passes
    at its first shared shingle. Of the sets' shingles only those of pairs are read again, if their ids are few enough.
    """
    posted = _postings(sets)
    shared = posted.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    prefixes = written(_prefixes(posted, shared, least))
    roles = sets.select("sid", "asks", "answers")
    kept = lambda role, i: prefixes.join(sized(roles.where(~F.col(role)).select("sid"), MOST_IDS), "sid", "left_anti").select("shingle", F.col("sid").alias(i), F.col("n").alias(f"n_{i}"), F.col("i").alias(f"i_{i}"))
    left, right = kept("asks", "a"), kept("answers", "b")
    sizes = (F.col("n_a") >= F.col("n_b") * least - 1e-9) & (F.col("n_b") >= F.col("n_a") * least - 1e-9)
    ahead = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    pairs = written(left.join(right, "shingle").where((F.col("a") != F.col("b")) & sizes & (ahead * (1 + least) >= (F.col("n_a") + F.col("n_b")) * least - 1e-9)).select("a", "b").distinct())
    ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    some = sets.join(sized(ids, MOST_IDS), "sid", "left_semi")
    side = lambda i, xs: some.select(F.col("sid").alias(i), F.col("set_id").alias(f"set_{i}"), F.col("shingles").alias(xs))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return met.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), (F.col("common") / (F.size("x") + F.size("y") - F.col("common"))).alias("jaccard")).where(F.col("jaccard") >= least)


def nearest(probe: DataFrame, build: DataFrame, key: str, least: float = LEAST, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """key, matched_id, jaccard: the most similar row of build, ties by the smallest id as text.

    A row never matches itself or another row of its author. probe, build: shingled(). Shingles are written once with
    their rows; the first row of a set stands for it, and its place (side and key) is the set's short name.
    """
    by_set = lambda x, asks, answers: x.withColumns({"set_id": F.md5(F.array_join(F.transform("shingles", lambda s: s.cast("string")), ",").cast("binary")), "asks": asks, "answers": F.lit(answers)})
    asks = F.col("n_tokens") >= min_tokens
    rows = by_set(build, asks, True) if probe is build else by_set(probe.where(asks), asks, False).unionByName(by_set(build, F.lit(False), True))
    rows = written(rows.withColumn("sid", F.monotonically_increasing_id()))
    b, p = rows.where("answers"), rows.where("asks")
    sets = rows.groupBy("set_id").agg(F.min("sid").alias("sid"), F.max("asks").alias("asks"), F.max("answers").alias("answers"), F.count("*").alias("rows"))
    more = written(sets.where("rows > 1"))
    others = rows.select("sid", "set_id").join(sized(more.select("set_id", F.col("sid").alias("first")), MOST_IDS), "set_id").where("sid <> first").select("sid")
    roles = sized(more.select("sid", F.col("asks").alias("_asks"), F.col("answers").alias("_answers")), MOST_IDS)
    one = rows.join(sized(others, MOST_IDS), "sid", "left_anti").join(roles, "sid", "left")
    one = one.select("sid", "set_id", "shingles", F.coalesce("_asks", "asks").alias("asks"), F.coalesce("_answers", "answers").alias("answers"))
    near = similar_sets(one, least)
    every = near.unionByName(p.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("jaccard")).distinct())
    return _best(p, b, every, key)


def _best(p: DataFrame, b: DataFrame, every: DataFrame, key: str) -> DataFrame:
    # Of the rows of a set, a probe needs the least id of another author, never all: for each author the least two
    # ids, and of these the first few authors by their least id. Equal rows never make pairs.
    name = F.struct(F.col(key).cast("string").alias("t"), F.col(key).alias("id"))
    by_author = b.groupBy("set_id", "author").agg(F.min(name).alias("first"))
    second = b.join(by_author.select("set_id", F.col("author").alias("_a"), F.col("first.id").alias("_f")), "set_id").where(F.col("author").eqNullSafe(F.col("_a")) & (F.col(key) != F.col("_f"))).groupBy("set_id", "author").agg(F.min(name).alias("second"))
    some = by_author.select("set_id", "author", F.col("first").alias("n")).unionByName(second.where("author IS NULL").select("set_id", "author", F.col("second").alias("n")))
    least = some.groupBy("set_id").agg(F.min(F.struct("n", "author")).alias("one"))
    other = some.join(least, "set_id").where((F.col("n") != F.col("one.n")) & ~F.coalesce(F.col("author") == F.col("one.author"), F.lit(False))).groupBy("set_id").agg(F.min(F.struct("n", "author")).alias("two"))
    lists = least.join(other, "set_id", "left").select(F.col("set_id").alias("b"), "one", "two")
    cand = p.select(key, F.col("author").alias("_author"), F.col("set_id").alias("a")).join(every, "a").join(lists, "b")
    fits = lambda c: F.col(f"{c}.n.id").isNotNull() & (F.col(f"{c}.n.id") != F.col(key)) & ~F.coalesce(F.col(f"{c}.author") == F.col("_author"), F.lit(False))
    met = cand.withColumn("m", F.when(fits("one"), F.col("one.n")).when(fits("two"), F.col("two.n"))).where("m IS NOT NULL")
    order = F.struct((-F.col("jaccard")).alias("j"), F.col("m.t").alias("t"), F.col("m.id").alias("id"))
    return met.groupBy(key).agg(F.min(order).alias("m")).select(key, F.col("m.id").alias("matched_id"), (-F.col("m.j")).alias("jaccard"))
