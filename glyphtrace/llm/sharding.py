"""Shards by rendezvous hashing of stable record keys.

Every record draws a number for every shard, from a hash of its key and the shard alone; the least of the draws
-ln(u) / weight has the record. So a shard gets records in proportion to its weight, and a shard that is added or
removed changes no draw of the others: it takes records only into itself, or gives away only its own. Nothing but the
key decides, so any task finds the shard of any record, in any run.

Within a shard, records are numbered without gaps by key, checksum and size, with one sort by ranges over all shards
(common.ranked): a shard that holds a third of all rows, or a key that many rows share, is many tasks' work.

Cases: rows with a null key have the key 'null' and are of one shard, like all repeated keys, as the key decides; rows
that tie in key, checksum and size are told by nothing in the result; a null or empty text has 16 bytes and checksum 0;
a text of any length is one row; an empty table gives an empty result; other columns are not read (write_shards()
carries all of them, and refuses a table that has a column named as its own: shard, slot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, table, text_of

SHARDS, SEED = 40, "shard-1"
#: Bytes that a record has besides its text.
OVERHEAD = 16


def draws(key: Column, weights: list[float], seed: str = SEED) -> Column:
    """The draws of a record, an array of (draw, shard), from 52 bits of a hash of seed, shard and key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    hashed = lambda i: F.md5(F.concat(F.lit(f"{seed}:"), i.cast("string"), F.lit(":"), key).cast("binary"))
    uniform = lambda i: (F.conv(F.substring(hashed(i), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.transform(F.array(*map(F.lit, map(float, weights))), lambda w, i: F.struct((-F.log(uniform(i)) / w).alias("draw"), i.cast("int").alias("shard")))


def placed(docs: DataFrame, key: str, weights: list[float], grown: float | None = None, seed: str = SEED) -> DataFrame:
    """docs with shard, and grown_shard: the shard if one more, of weight `grown`, stood after the others (null without it)."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    d = docs.withColumn("draws__", draws(name, [*weights, *([grown] if grown else [])], seed))
    d = d.withColumn("shard", F.array_min(F.slice("draws__", 1, len(weights)))["shard"])
    more = F.array_min("draws__")["shard"] if grown else F.lit(None).cast("int")
    return d.withColumn("grown_shard", more).drop("draws__")


def shards(docs: DataFrame, weights: list[float], grown: float | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (the number within the shard, from 0), grown_shard of every row."""
    data = F.encode(text_of(), "utf-8")
    slim = docs.select("doc_id", (F.octet_length(text_of()) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return ranked(placed(slim, "doc_id", weights, grown, seed), ["shard"], [F.col("doc_id").asc_nulls_last(), "text_crc32", "size"])


def write_shards(docs: DataFrame, path: str, weights: list[float], seed: str = SEED, files: int = 1) -> None:
    """docs as Parquet under path/shard=N, each shard in about `files` files of rising keys."""
    if clash := {"shard", "grown_shard"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are named as those of the shards")
    rows = placed(docs, "doc_id", weights, None, seed).drop("grown_shard")
    rows.repartitionByRange(len(weights) * files, "shard", "doc_id", F.xxhash64("text")).sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, 1.0)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The checksum goes byte by byte through the table of the reversed polynomial 0xEDB88320.
SQL = r"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, coalesce(doc_id::VARCHAR, 'null') AS key,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(coalesce(text, '')), '..')]),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc),
p AS (
  SELECT doc_id, size, text_crc32, key,
         [-ln((('0x' || substr(md5('shard-1:' || i || ':' || key), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) FOR i IN range(41)] AS draws
  FROM d),
s AS (
  SELECT *, list_position(draws, list_min(draws[1:40])) - 1 AS shard, list_position(draws, list_min(draws)) - 1 AS grown_shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM s
"""
