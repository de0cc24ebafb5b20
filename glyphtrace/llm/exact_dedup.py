"""Exact deduplication against a minimal perfect hash over the digests seen before.

History is kept as an index: its distinct digests are dealt to shards of a few hundred keys, and each shard
holds a minimal perfect hash (levels of bit arrays; a key sits at its first level without a collision, its slot
is the rank of its bit). A slot holds the full digest and the locator of the winning row. New digests, grouped
first, are looked up in their shard and compared byte by byte: members merge with the slot's group, nonmembers
stay groups of their own. Shards are bounded, so no task ever holds more than a few hundred kB at once, and a
hot digest is one row after the map-side aggregation.

A locator is the winner's id and its row number in the written table of keys, so of rows that are equal in everything
one is the winner, and no step makes an array of them.

Cases: a null text is an empty text, and all empty or blank texts are one group; rows repeated with the same
doc_id and text stay once (one of the repeats has kept = true); a null doc_id loses against any other; a text of any
length is hashed whole and is not carried on; an empty table gives an empty result; other columns are not read, and
what returns the caller's rows leaves all of them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, sized, table, text_of

#: Mean number of keys of a shard.
SHARD_KEYS = 512
#: Bits per key left, at each level.
GAMMA = 2.0
DIGEST = 32

INDEX_SCHEMA = "shard long, sizes array<int>, bits binary, digests binary, keep_ids array<long>, keep_rows array<long>, n_points array<long>, counts array<long>"
GROUP_SCHEMA = "digest binary, keep_id long, keep_row long, n_points long, group_size long"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").cast("binary"), 256))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_points (code points of the original text), row (a number that no other row has) of every row. To be written before it is used twice."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"), F.char_length(text_of()).cast("long").alias("n_points"), F.monotonically_increasing_id().alias("row"))


def grouped(rows: DataFrame) -> DataFrame:
    """A row for each digest: the winner has the most code points, then the smallest doc_id, then the least row number."""
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg_id"), (-F.col("row")).alias("neg_row")))
    found = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    return found.select("digest", (-F.col("best.neg_id")).alias("keep_id"), (-F.col("best.neg_row")).alias("keep_row"), F.col("best.n_points").alias("n_points"), "group_size")


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest; the shard number uses other bytes."""
    words = np.ascontiguousarray(digests).view("<u8")
    return words[:, 1], words[:, 2] | np.uint64(1)


def _position(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a + b * np.uint64(level * 2 + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, the bits of all levels, and the slot of each digest. digests: n x 32 bytes, distinct."""
    a, b = _words(digests)
    left, sizes, levels, place = np.arange(len(digests)), [], [], np.zeros(len(digests), np.int64)
    start = 0
    while len(left):
        size = max(1, int(np.ceil(GAMMA * len(left))))
        at = _position(a[left], b[left], len(sizes), size)
        hits = np.bincount(at, minlength=size)
        alone = hits[at] == 1
        place[left[alone]] = start + at[alone]
        levels.append(hits == 1)
        sizes.append(size)
        start += size
        left = left[~alone]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return sizes, bits, (np.cumsum(bits) - 1)[place] if len(digests) else place


def lookup_mph(sizes: list[int], bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level has its bit. A slot is only a candidate: its digest must be compared."""
    a, b = _words(digests)
    ranks, slots, left, start = np.cumsum(bits) - 1, np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = start + _position(a[left], b[left], level, size)
        found = bits[at]
        slots[left[found]] = ranks[at[found]]
        left, start = left[~found], start + size
        if not len(left):
            break
    return slots


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)


def _shard_index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _matrix(pdf["digest"])
    sizes, bits, slots = build_mph(keys)
    order = np.argsort(slots)
    rows = pdf.iloc[order]
    ids = [None if pd.isna(x) else int(x) for x in rows["keep_id"]]
    return pd.DataFrame([{"shard": key[0], "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": keys[order].tobytes(), "keep_ids": ids, "keep_rows": rows["keep_row"].tolist(), "n_points": rows["n_points"].tolist(), "counts": rows["group_size"].tolist()}])


def _better(n: int, i: int | None, m: int, j: int | None) -> bool:
    """Whether the row with n code points and id i wins against m and j."""
    return n > m or n == m and i is not None and (j is None or i < j)


def _merge(key: tuple, new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The groups of a shard: each slot of the index merged with the new group of the same digest, then the nonmembers."""
    columns = ["digest", "keep_id", "keep_row", "n_points", "group_size"]
    fresh = list(zip(new["digest"], (None if pd.isna(x) else int(x) for x in new["keep_id"]), *(new[c].tolist() for c in columns[2:]), strict=True))
    if not len(index):
        return pd.DataFrame(fresh, columns=columns).astype({"keep_id": "Int64"})
    r = index.iloc[0]
    sizes, total = [int(x) for x in r["sizes"]], sum(map(int, r["sizes"]))
    held = [r["digests"][i : i + DIGEST] for i in range(0, len(r["digests"]), DIGEST)]
    slot_rows = zip(held, r["keep_ids"], r["keep_rows"], r["n_points"], r["counts"], strict=True)
    out = [[d, None if i is None or pd.isna(i) else int(i), int(at), int(n), int(c)] for d, i, at, n, c in slot_rows]
    bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=total).astype(bool)
    slots = lookup_mph(sizes, bits, _matrix(new["digest"])) if len(new) else []
    apart = []
    for slot, (d, i, at, n, c) in zip(slots, fresh, strict=True):
        if slot >= 0 and held[slot] == d:
            o = out[slot]
            if _better(n, i, o[3], o[1]):
                o[1:4] = i, at, n
            o[4] += c
        else:
            apart.append([d, i, at, n, c])
    return pd.DataFrame(out + apart, columns=columns).astype({"keep_id": "Int64"})


def _shard(n: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(n))


def build_index(history: DataFrame, shards: int | None = None) -> tuple[DataFrame, int]:
    """The index over the distinct digests of keyed rows, one row for each shard, and the number of shards."""
    groups = cut(grouped(history))
    shards = shards or max(1, -(-groups.count() // SHARD_KEYS))
    return groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_shard_index, INDEX_SCHEMA), shards


def merge_with_index(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All groups of history and keyed new rows: digest, keep_id, keep_row (in the table that it is of), n_points, group_size."""
    new = grouped(rows).withColumn("shard", _shard(shards))
    return new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_merge, GROUP_SCHEMA)


def repeats_of_history(docs: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Rows of docs with keep_id and group_size of their group over history and docs (`_keep_id`, ... where docs has such columns); for a corpus that arrives in batches."""
    groups = cut(merge_with_index(cut(keyed(docs)), index, shards))
    added = [groups[n].alias(free_name(docs, n)) for n in ("keep_id", "group_size")]
    return docs.join(groups, digest_of(F.coalesce(docs["text"], F.lit(""))) == groups["digest"]).select(*(docs[c] for c in docs.columns), *added)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_points, keep_id, group_size, kept of every row of docs.

    Half of the rows, by hash, play the history that is indexed; the others are looked up. The result doesn't
    depend on how the halves are drawn.
    """
    rows = cut(keyed(docs))
    old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    index, shards = build_index(rows.where(old))
    groups = cut(merge_with_index(rows.where(~old), index, shards).where("group_size > 1"))
    # rows of a digest of their own need no partner; each of the others meets one row, by broadcast while these are few
    met = rows.join(sized(groups.select(F.col("digest").alias("same"), "keep_id", "keep_row", "group_size")), F.col("digest") == F.col("same"), "left")
    alone = F.col("same").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return met.select("doc_id", "digest", "n_points", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that an equal text replaces; the columns stay as they are.

    The losers' keys are joined by broadcast while they are few, else by a shuffle.
    """
    key = F.struct("doc_id", "digest", "n_points").alias("key")
    found = cut(exact_groups(docs).where("group_size > 1"))
    lost, won = cut(found.where("NOT kept").select(key).distinct()), found.where("kept").select(key)
    # a key that has both a kept and a dropped row is a repeated row: of these one stays
    repeated = cut(lost.join(won, "key", "left_semi"))
    text = F.coalesce(docs["text"], F.lit(""))
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), digest_of(text).alias("digest"), F.char_length(text).cast("long").alias("n_points"))
    kept = docs.join(sized(lost), own == lost["key"], "left_anti")
    if not repeated.isEmpty():
        name = free_name(docs, "key")
        once = docs.join(sized(repeated), own == repeated["key"], "left_semi").withColumn(name, own).dropDuplicates([name]).drop(name)
        kept = kept.unionByName(once)
    return kept


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
