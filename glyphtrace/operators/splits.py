"""Sides that leak nothing: rows that share a group or a text key, directly or by others, are of one side.

Groups and keys are the two kinds of nodes of a graph whose edges are rows. Its components are found by hooking each
label to the least label that it meets over a key, and halving the chains that arise; a component is then a unit of
the split. No group or key is ever gathered in one place: a key that half of all groups share is one minimum.

Cases: rows with a null group or key make no edge by it (a null group is a group of its own, a null key none); repeated
rows are one edge; an empty table gives an empty result; columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from .evaluation import side_of_group


def components(edges: DataFrame) -> DataFrame:
    """group, component (the least group that is reached) of every group. edges: group, key, both as text; a null key is none."""
    edges = written(edges.select("group", "key").distinct())
    groups = edges.select("group").distinct().withColumn("label", F.col("group"))
    joined = edges.where("group IS NOT NULL AND key IS NOT NULL")
    # keys of one group join nothing
    shared = joined.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    joined = written(joined.join(shared, "key", "left_semi"))
    labels = written(groups.where("group IS NOT NULL"))
    while True:
        met = joined.join(labels, "group")
        least = met.groupBy("key").agg(F.min("label").alias("to"))
        hooks = written(met.select("key", "label").distinct().join(least, "key").groupBy("label").agg(F.min("to").alias("to")).where("to < label"))
        if hooks.isEmpty():
            break
        # hooks form chains to ever lesser labels; each label takes its hook's hook
        further = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
        jumped = hooks.join(further, "to", "left").select("label", F.coalesce("next", "to").alias("to"))
        labels = written(labels.join(jumped, "label", "left").select("group", F.coalesce("to", "label").alias("label")))
    alone = groups.where("group IS NULL").select("group", F.lit(None).cast("string").alias("component"))
    return labels.select("group", F.col("label").alias("component")).unionByName(alone)


def leak_free_sides(rows: DataFrame, seed: str = "split") -> DataFrame:
    """group, component, side, why (collision, recorded or hash) of every group.

    rows: group, key, label, recorded (the side an earlier split gave the row, or null). A component that holds a key
    under two labels takes the side of the least such key; else one that holds a row recorded as test goes to test
    whole; else the hash of its least group decides.
    """
    rows = written(rows.select(F.col("group").cast("string").alias("group"), F.col("key").cast("string").alias("key"), "label", "recorded"))
    found = components(rows)
    collisions = rows.where("key IS NOT NULL AND label IS NOT NULL").groupBy("key").agg(F.count_distinct("label").alias("labels")).where("labels > 1").select("key")
    forced = rows.join(collisions, "key", "left_semi").groupBy("group").agg(F.min("key").alias("forced"))
    tested = rows.groupBy("group").agg(F.max(F.coalesce(F.col("recorded") == "test", F.lit(False))).alias("tested"))
    facts = tested.join(forced.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g")), "left").drop("_g")
    met = found.withColumnRenamed("group", "_g").join(facts, F.col("_g").eqNullSafe(F.col("group"))).drop("_g")
    each = met.groupBy("component").agg(F.min("forced").alias("forced"), F.max("tested").alias("tested"))
    why = F.when(F.col("forced").isNotNull(), "collision").when(F.col("tested"), "recorded").otherwise("hash")
    side = F.when(F.col("forced").isNotNull(), side_of_group(F.concat(F.lit("collision|"), "forced"), seed)).when(F.col("tested"), "test").otherwise(side_of_group(F.coalesce("component", F.lit("")), seed))
    each = each.select(F.col("component").alias("_c"), side.alias("side"), why.alias("why"))
    return found.join(each, F.col("component").eqNullSafe(F.col("_c"))).drop("_c")


def coverage(rows: DataFrame, by: list[str], value: str = "n_tokens") -> DataFrame:
    """by, rows, groups, and the exact median of value (the mean of the middle two), by ranks, not by gathering values."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    total = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct("group").alias("groups"), F.count(value).alias("valued"))
    # distinct values of a kind are few (lengths); their counts are summed up to the middle
    upto = Window.partitionBy(*by).orderBy(value)
    summed = counts.where(F.col(value).isNotNull()).withColumn("upto", F.sum("n").over(upto)).withColumn("below", F.col("upto") - F.col("n"))
    met = summed.join(total, by)
    low, high = F.floor((F.col("valued") + 1) / 2), F.ceil((F.col("valued") + 1) / 2)
    holds = lambda rank: (F.col("below") < rank) & (rank <= F.col("upto"))
    middle = met.groupBy(*by).agg(F.max(F.when(holds(low), F.col(value))).alias("a"), F.max(F.when(holds(high), F.col(value))).alias("b"))
    return total.join(middle, by, "left").select(*by, "rows", "groups", ((F.col("a") + F.col("b")) / 2).alias("median"))
