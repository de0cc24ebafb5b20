"""Near-duplicates: an inverted join over signature coordinates, exact confirmation, connected components.

Texts with equal shingle sets are one class first (an exact key), so copies never meet in a join. Each class posts
its MinHash signature (COORDINATES values) as coordinate-value pairs. Pairs that only one class has can't collide:
they are skipped, and so are classes with fewer than MATCHES shared pairs left. The others are ordered by frequency,
rarest first, and only the prefix is posted: two classes with at least MATCHES common pairs share one within their
first (pairs - MATCHES + 1). Retained pairs have at least MATCHES equal coordinates; then the full sets decide.

MATCHES is 36 of 64: at a similarity of 0.8 fewer are equal once in about 240,000 links (binomial; 4.2e-6), fewer above it.

A posting list is never turned into all its pairs. Each list has a hub, its most central class (most frequent
coordinates): all members are compared with the hub, the links found are merged into components, and this is done
again with hubs of other components. After that only pairs of classes from different components matter. The join of
a list with itself has bounds in its condition, so that few pairs come out that aren't links: by parity sketches of
the sets (their bits differ in no more places than the sets), and by what a component shares with others: a class
whose shingles are shared outside its component in too small a number can't link there, whatever the partner
(|x and y| >= 4/9 (|x| + |y|) at 0.8), so spread-out members of a large group, which have shingles of their own, leave
before any pair is made. Both steps lose no link. A list of many rows is joined in cells of BLOCK by BLOCK rows, so a
hot list is many tasks' work.

Cases: a null or empty text has an empty set and links with nothing; texts under the shingle length are one shingle;
repeated rows and ids are of one class; null ids are kept, the smallest id of a component ignores them; a text of
any length is cut into words in blocks; an empty table gives an empty result; other columns are not read, and
drop_near_copies() returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sized, table
from .components import components

COORDINATES, MATCHES = 64, 36
HUB_ROUNDS = 2
#: Classes whose rows a task of the later steps takes.
TASK_CLASSES = 5_000
#: Rows of a posting list that one block of its self-join holds.
BLOCK = 512
#: Bits of a set's sketch by which most pairs that don't link are told without the sets.
PARITY_BITS = 1024
#: Bytes of text that are hashed at once in a task.
SLICE = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


_INVERSE = pow(int(_BASE), -1, 1 << 64)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of the bytes, A-Z as a-z: a polynomial by prefix sums, then mixed."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(int(_BASE), n), out=sums[1:])
    words = (sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts]
    return _mix(words + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed_words(data: np.ndarray) -> np.ndarray:
    """word_hashes() of a text of any length, in slices that end at white space (a longer word is hashed whole)."""
    if len(data) <= SLICE:
        return word_hashes(data)
    parts, start = [], 0
    while start < len(data):
        end = min(start + SLICE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(word_hashes(data[start:end]))
        start = end
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of n words in a row; of all words if there are fewer; sorted."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : len(words) - n + 1 + i])
    return np.unique(out)


_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, COORDINATES, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over the set, as 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (_A[:, None] * (shingles[None, i : i + 4096] ^ _B[:, None])).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_key(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the whole set."""
    a, b = _mix(shingles + np.uint64(1)).sum(dtype=np.uint64), _mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text, null as empty, without copies."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid is None or valid[i] else data[:0]


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_md5, n_shingles, key (of the set, null if empty), signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            with np.errstate(over="ignore"):
                for data in _texts(batch.column(2)):
                    s = shingle_set(hashed_words(data), words)
                    sizes.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))], names=["doc_id", "text_md5", "n_shingles", "key", "signature"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_md5"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_md5 string, n_shingles long, key binary, signature array<int>")


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, each toggled by the shingles that fall on it. Two sets differ in at least as many shingles as bits."""
    odd = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """key, shingles (sorted hashes), bits (parity_bits()) of every row with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                found = [s for data in _texts(batch.column(0)) if len(s := shingle_set(hashed_words(data), words))]
                keys = [set_key(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([parity_bits(s) for s in found], pa.list_(pa.int64()))], names=["key", "shingles", "bits"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key binary, shingles array<long>, bits array<long>")


def postings(classes: DataFrame, matches: int = MATCHES) -> tuple[DataFrame, DataFrame]:
    """The posting lists of the prefixes (pair, key, central, n_shingles), and the classes in them with signature and prefix.

    classes: key, rep, n_shingles, signature, one row for each distinct set.
    """
    pair = F.posexplode("signature").alias("at", "value")
    every = classes.select("key", pair).select("key", F.xxhash64("at", "value").alias("pair"))
    shared = cut(every.groupBy("pair").agg(F.count("*").alias("df")).where("df > 1"))
    held = every.join(shared, "pair").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "pair"))).alias("pairs"), F.sum("df").alias("central"))
    held = held.where(F.size("pairs") >= matches)
    prefix = F.slice("pairs", F.lit(1), F.size("pairs") - matches + 1)
    held = cut(held.join(classes.select("key", "rep", "n_shingles", "signature"), "key").select("key", "rep", "n_shingles", "signature", "central", prefix.alias("prefix")))
    lists = held.select("key", "central", "n_shingles", F.explode("prefix.pair").alias("pair"))
    return lists, held.select("key", "signature", F.col("prefix.pair").alias("prefix"))


def confirmed(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, least: int, matches: int = MATCHES) -> DataFrame:
    """The pairs (u, v) of distinct classes with enough equal coordinates whose sets have 100 |u and v| >= least |u or v|."""
    s = signatures.select("key", "signature")
    p = pairs.join(s.select(F.col("key").alias("u"), F.col("signature").alias("su")), "u").join(s.select(F.col("key").alias("v"), F.col("signature").alias("sv")), "v")
    equal = F.size(F.filter(F.zip_with("su", "sv", lambda a, b: a == b), lambda x: x))
    p = p.where(equal >= matches).select("u", "v")
    p = p.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("xu")), "u").join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("xv")), "v")
    common = F.size(F.array_intersect("xu", "xv"))
    return p.where(100 * common >= least * (F.size("xu") + F.size("xv") - common)).select("u", "v")


def _near_size(a: str, b: str, least: int) -> object:
    return (F.col(a) * 100 >= F.col(b) * least) & (F.col(b) * 100 >= F.col(a) * least)


def links(docs: DataFrame, classes: DataFrame, words: int, least: int = 80, matches: int = MATCHES, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """Edges (u, v) between keys of classes, enough to connect all that the exact links connect."""
    lists, signatures = postings(classes, matches)
    # what the rounds write is a few rows for each class in a list; tasks are as many as these need
    tasks = max(8, -(-signatures.count() // TASK_CLASSES))
    reps = sized(cut(classes.join(signatures.select("key"), "key", "left_semi").select("rep").distinct()))
    # the texts of the classes that are left; a repeated or null id may bring others along, which the key drops
    some = docs.select("doc_id", "text").join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = cut(sets_of(some, words).join(signatures.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    edges = None
    labelled = lists.withColumn("label", F.col("key"))
    done = None
    for _ in range(hub_rounds):
        open_lists = labelled if done is None else labelled.join(done, "label", "left_anti")
        hubs = open_lists.groupBy("pair").agg(F.max(F.struct("central", "key", "label", "n_shingles")).alias("hub"))
        tried = labelled.join(hubs, "pair").where((F.col("label") != F.col("hub.label")) & _near_size("n_shingles", "hub.n_shingles", least))
        tried = tried.select(F.col("hub.key").alias("u"), F.col("key").alias("v"), F.col("hub.label").alias("hub_label"))
        tried = cut(tried.distinct().coalesce(tasks))
        found = cut(confirmed(tried.select("u", "v"), signatures, sets, least, matches).coalesce(tasks))
        edges = found if edges is None else edges.unionByName(found)
        names = cut(components(edges).coalesce(tasks))
        hub_nodes = tried.select(F.col("u").alias("node")).distinct().join(names, "node", "left").select(F.coalesce("label", "node").alias("label")).distinct()
        labelled = lists.join(names.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        labelled = cut(labelled.coalesce(tasks))
        done = cut(hub_nodes.coalesce(tasks))
        # a component's edges are as good as those that were found
        edges = names.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    return edges.unionByName(across(labelled, signatures, sets, least, matches, tasks))


def across(labelled: DataFrame, signatures: DataFrame, sets: DataFrame, least: int, matches: int, tasks: int) -> DataFrame:
    """The links between classes of different components. labelled: pair, key, label, n_shingles."""
    mixed = labelled.groupBy("pair").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("pair")
    left = cut(labelled.join(mixed, "pair", "left_semi").coalesce(tasks))
    nodes = cut(left.select("key", "label", "n_shingles").distinct().coalesce(tasks))
    for _ in range(2):
        held = nodes.join(sets, "key").select("key", "label", "n_shingles", F.explode("shingles").alias("shingle"))
        outside = held.groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("shingle")
        counted = held.join(outside, "shingle").groupBy("key", "label", "n_shingles").agg(F.count("*").alias("outside"))
        nodes = cut(counted.where(F.col("outside") * 100 >= F.col("n_shingles") * least).coalesce(tasks))
    # lists that still hold two components
    left = left.select("pair", "key").join(nodes, "key")
    mixed = left.groupBy("pair").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("pair")
    left = cut(left.join(mixed, "pair", "left_semi").join(signatures.select("key", "prefix"), "key").join(sets.select("key", "bits"), "key").coalesce(tasks))
    # classes of a list's largest component meet only the list's other classes
    largest = left.groupBy("pair", "label").agg(F.count("*").alias("n")).groupBy("pair").agg(F.max(F.struct("n", "label"))["label"].alias("largest"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    columns = ("key", "label", "n_shingles", "outside", "prefix", "bits")
    rows = cut(left.join(largest, "pair").coalesce(tasks))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    x = rows.where("label <> largest").select("pair", "largest", block.alias("i"), every.alias("j"), *(F.col(c).alias(f"{c}_x") for c in columns))
    y = rows.select("pair", every.alias("i"), block.alias("j"), *(F.col(c).alias(f"{c}_y") for c in columns))
    # common shingles are outside ones of both; at least `need` / (100 + least) of them for a link
    need = (F.col("n_shingles_x") + F.col("n_shingles_y")) * least
    enough = (F.col("outside_x") * (100 + least) >= need) & (F.col("outside_y") * (100 + least) >= need) & _near_size("n_shingles_x", "n_shingles_y", least)
    apart = (F.col("label_x") != F.col("label_y")) & ((F.col("label_y") == F.col("largest")) | (F.col("key_x") < F.col("key_y")))
    # the sets differ in at least as many shingles as bits; a link has at most this share of both
    differ = F.aggregate(F.zip_with("bits_x", "bits_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, n: a + n)
    close = differ * (100 + least) <= (F.col("n_shingles_x") + F.col("n_shingles_y")) * (100 - least)
    once = F.element_at(F.array_intersect("prefix_x", "prefix_y"), 1) == x["pair"]  # of the lists with both, the first
    cell = (x["pair"] == y["pair"]) & (x["i"] == y["i"]) & (x["j"] == y["j"])
    pairs = x.join(y, cell & apart & enough & close & once).select(F.col("key_x").alias("u"), F.col("key_y").alias("v"))
    return confirmed(cut(pairs), signatures, sets, least, matches)


def near_rows(docs: DataFrame, words: int = 5, least: int = 80) -> DataFrame:
    """doc_id, text_md5, n_shingles, label (the component's, null for an empty set), component_id (its smallest doc_id) of every row; least: the similarity in hundredths."""
    rows = cut(signed(docs, words))
    classes = cut(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    names = components(links(docs, classes, words, least)).withColumnRenamed("node", "key")
    labelled = classes.select("key", "rep").join(names, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least_id = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = labelled.join(least_id, "label").select("key", "label", "component_id")
    return rows.select("doc_id", "text_md5", "n_shingles", "key").join(of_class, "key", "left").select("doc_id", "text_md5", "n_shingles", "label", "component_id")


def near_groups(docs: DataFrame, words: int = 5, least: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; least: the similarity in hundredths."""
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return near_rows(docs, words, least).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("label").isNull(), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, least: int = 80) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id (null last), then text digest. Rows with an empty set stay; the columns stay as they are."""
    rows = cut(near_rows(docs, words, least).where("label IS NOT NULL"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")
    grouped = rows.groupBy("label").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_md5") == F.col("first.text_md5"))
    met = rows.join(grouped, "label").select(F.struct("doc_id", "text_md5").alias("key"), stays.alias("stays"))
    lost = cut(met.where("NOT stays").select("key").distinct())
    again = cut(met.where("stays").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    key = lambda x: F.struct(x["doc_id"].cast("long").alias("doc_id"), F.md5(F.coalesce(x["text"].cast("string"), F.lit("")).cast("binary")).alias("text_md5"))
    kept = docs.join(sized(lost), key(docs) == lost["key"], "left_anti")
    if again.isEmpty():
        return kept
    # rows that are repeated whole are met by their content, one stays
    some = kept.join(sized(again), key(kept) == again["key"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(sized(again), key(kept) == again["key"], "left_anti").unionByName(some)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=4)
