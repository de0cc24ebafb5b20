"""Mixing sources to target weights.

Every row gets a hash-random key. Within each source the rows are dealt to key ranges (about the square root of
the source's rows, so ranges and rows of a range stay small together, for a source of any size); a prefix sum
over the ranges' word counts and one within each range give each row the words that stand before it. A source's
budget is cut exactly there: whole passes over the source first, then the rows up to the cut.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, ...; the sum of targets is `share` times all
words; no source gets more than `most` times its own words, what is above goes to the others by weight. That is
the level L with sum(min(cap, L * weight)) = total, found with window sums over the table of sources, which has
one row a source.

Cases: null or empty texts have size 0 and take 0; null doc_ids and repeated rows get keys by their content, equal
rows may change places with each other; ties of key and digest are rows that are equal; a very long text is one row
with its count of words; a source without words has target 0; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2, "mix-1"


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from a table with one row for each source (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(share),
        "caps": F.coalesce(F.sum("cap").over(below), F.lit(0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0)),
    })
    # the levels tried rise up to the right one, and fall after it
    s = s.withColumn("try", (F.col("total") - F.col("caps")) / F.col("rest"))
    s = s.withColumn("found", F.max(F.when(F.col("try") <= F.col("level"), F.col("try"))).over(everything))
    target = F.when(F.col("level") < F.col("found"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("found")))
    return s.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, digest of the text, source, size, source_size, target, taken of every row."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = cut(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.md5(text_of().cast("binary")).alias("text_md5")))
    sources = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")))
    targets = with_targets(sources, weights, share, most).withColumnRenamed("source", "_source")
    plan = cut(sources.join(targets.drop("source_size"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("ranges", F.ceil(F.sqrt("source_rows")).cast("long")))
    p = plan.withColumnRenamed("source", "_source")
    dealt = rows.join(p, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.col("ranges")).cast("long"))
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("key", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    passes = F.least(passes, F.lit(most))
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("inner")))
    taken = F.when(F.col("source_size") > 0, passes * F.col("size") + part).otherwise(F.lit(0)).cast("long")
    return placed.select("doc_id", "text_md5", "source", "size", "source_size", "target", taken.alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key, md5(coalesce(text, '')) AS text_md5
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS level,
         sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM w),
f AS (SELECT *, max(CASE WHEN (total - caps) / rest <= level THEN (total - caps) / rest END) OVER () AS found FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * found)::DOUBLE AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
         + greatest(0, least(size, budget % source_size - prior)) END)::BIGINT AS taken
FROM p
"""
