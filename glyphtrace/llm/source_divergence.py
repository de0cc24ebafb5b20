"""How far the words of a source stand from those of its language's other sources and of the language itself.

The terms of a language that enough of its documents have are sorted by bytes and numbered; blocks of BLOCK sorted
terms become minimal acyclic transducers (incremental construction: a state is registered once for each distinct
right language; an arc adds the number of terms that sort before it, so that the sum along a term's path is its
ordinal). The texts are then streamed through the transducers, all terms of a slice side by side in numpy, and only
(group, ordinal) pairs with their counts leave the tasks. Ordinals break ties: they sort as the terms do.

Transducers are broadcast in rounds of at most ROUND_BYTES of measured size; a vocabulary that is larger takes more
rounds over the texts, none loses a term. The sums over all terms for all pairs of sources are taken in tiles of
about TILE by TILE sources and SPAN terms, from the terms that occur in a tile; the others of its span have the same
value for a pair and are counted. All arithmetic is of integers.

Cases: null texts, languages and sources are empty ones; a source without kept terms is compared like all; repeated
rows and ids are documents of their own; a text of any length is streamed in slices that end between terms; equal
values rank by item in UTF-8 order; a language without kept terms gives pairs of value 0 and no terms; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ranked, sized, table, text_of

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term is kept if so many documents of the language have it; so many terms of a group are reported.
LEAST, TOP = 10, 10
SMOOTH, UNIT = 2, 1_000_000_000
#: Terms of a transducer; bytes of transducers that are broadcast at once; bytes of text that are walked at once.
BLOCK, ROUND_BYTES, SLICE = 65_536, 64_000_000, 4_000_000
#: Sources along a tile's side, and terms of its span.
TILE, SPAN = 32, 4096

_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_IN_TERM = (_LOWER >= 97) & (_LOWER <= 122) | (_BYTE >= 128)


@dataclass
class Transducer:
    """Arcs sorted by (state, byte): keys (state * 256 + byte), targets, what an arc adds to the ordinal; final states; the start."""

    keys: np.ndarray
    targets: np.ndarray
    adds: np.ndarray
    final: np.ndarray
    start: int

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in rising order of bytes."""
        register: dict[tuple, int] = {}
        arcs: list[tuple] = []
        final: list[bool] = []
        sizes: list[int] = []

        def state(ends: bool, out: list) -> int:
            key = (ends, tuple(out))
            found = register.get(key)
            if found is None:
                found = register[key] = len(final)
                final.append(ends)
                sizes.append(ends + sum(sizes[to] for _, to in out))
                arcs.append(key[1])
            return found

        path: list[list] = [[False, []]]  # the states of the last term, whose right language may still grow
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                ends, out = path.pop()
                path[-1][1].append((last[len(path) - 1], state(ends, out)))

        for term in terms:
            common = 0
            while common < min(len(last), len(term)) and last[common] == term[common]:
                common += 1
            close(common)
            path.extend([False, []] for _ in range(len(term) - common))
            path[-1][0] = True
            last = term
        close(0)
        start = state(*path[0])
        keys, targets, adds = [], [], []
        for number, out in enumerate(arcs):
            before = int(final[number])
            for byte, to in out:
                keys.append(number * 256 + byte)
                targets.append(to)
                adds.append(before)
                before += sizes[to]
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(adds, np.int32), np.array(final, bool), start)

    def pack(self) -> bytes:
        head = np.array([len(self.keys), len(self.final), self.start], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.targets, self.adds, self.final))

    @classmethod
    def unpack(cls, data: bytes) -> Transducer:
        n, m, start = (int(x) for x in np.frombuffer(data, np.int64, 3))
        at = [24, 24 + 8 * n, 24 + 12 * n, 24 + 16 * n]
        return cls(np.frombuffer(data, np.int64, n, at[0]), np.frombuffer(data, np.int32, n, at[1]), np.frombuffer(data, np.int32, n, at[2]), np.frombuffer(data, bool, m, at[3]), start)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of each term data[start:end], -1 for one that isn't held. No term is empty."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        which, at, state, total = np.arange(len(starts)), starts.copy(), np.full(len(starts), self.start, np.int64), np.zeros(len(starts), np.int64)
        while len(which):
            key = state * 256 + data[at]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            on = np.flatnonzero(self.keys[arc] == key)
            which, at, arc = which[on], at[on] + 1, arc[on]
            state, total = self.targets[arc].astype(np.int64), total[on] + self.adds[arc]
            over = at == ends[which]
            held = over & self.final[state]
            out[which[held]] = total[held]
            on = np.flatnonzero(~over)
            which, at, state, total = which[on], at[on], state[on], total[on]
        return out


class Vocabulary:
    """The transducers of a language's blocks: (first ordinal, least term, transducer), by rising ordinals."""

    def __init__(self, blocks: list[tuple[int, bytes, Transducer]]) -> None:
        self.blocks = sorted(blocks, key=lambda b: b[0])
        self.heads = self._heads(np.frombuffer(b"".join(b[1][:8].ljust(8, b"\0") for b in self.blocks), np.uint8), np.arange(len(blocks)) * 8, np.arange(1, len(blocks) + 1) * 8)

    @staticmethod
    def _heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The first 8 bytes of each term as a number that sorts as they do."""
        head = np.zeros(len(starts), np.uint64)
        for i in range(8):
            at = starts + i
            head = head * np.uint64(256) + np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
        return head

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.blocks) == 1:
            found = self.blocks[0][2].ordinals(data, starts, ends)
            return np.where(found < 0, found, found + self.blocks[0][0])
        out, head = np.full(len(starts), -1, np.int64), self._heads(data, starts, ends)
        # equal heads leave the block open: all that come into question are tried
        low, high = np.searchsorted(self.heads, head, "left") - 1, np.searchsorted(self.heads, head, "right") - 1
        for number, (first, _, transducer) in enumerate(self.blocks):
            some = np.flatnonzero((low <= number) & (number <= high))
            found = transducer.ordinals(data, starts[some], ends[some])
            out[some[found >= 0]] = found[found >= 0] + first
        return out


def slices(texts: Iterable[tuple[int, np.ndarray]], most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts of the texts' pieces, their numbers) of about `most` bytes; a zero byte ends each piece."""
    held, numbers, size = [], [], 0
    for number, text in texts:
        at = 0
        while at < len(text):
            end = min(at + most, len(text))
            while end < len(text) and _IN_TERM[text[end]]:
                end += 1
            if held and size + end - at > most:
                yield _joined(held, numbers)
                held, numbers, size = [], [], 0
            held.append(text[at:end])
            numbers.append(number)
            size += end - at
            at = end
    if held:
        yield _joined(held, numbers)


def _joined(held: list[np.ndarray], numbers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.zeros(sum(len(x) + 1 for x in held), np.uint8)
    starts = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
    for start, x in zip(starts, held, strict=True):
        data[start : start + len(x)] = x
    return data, starts, np.array(numbers)


def counted(vocabulary: Vocabulary, texts: Iterable[tuple[int, np.ndarray]], most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text's group, ordinal, occurrences) of the held terms, for each slice of the texts."""
    for data, pieces, numbers in slices(texts, most):
        data = _LOWER[data]
        edge = np.diff(np.concatenate(([False], _IN_TERM[data])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ordinal = vocabulary.ordinals(data, starts, ends)
        held = ordinal >= 0
        group = numbers[np.searchsorted(pieces, starts[held], "right") - 1]
        order = np.lexsort((ordinal[held], group))
        group, ordinal = group[order], ordinal[held][order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(group) != 0) | (np.diff(ordinal) != 0)))) if len(group) else np.zeros(0, np.int64)
        yield group[first], ordinal[first], np.diff(np.append(first, len(group)))


def plain(docs: DataFrame) -> DataFrame:
    """lang, source, text, nulls as empty strings."""
    return docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))


def kept_terms(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, slot (the term's ordinal in the language) of the terms in at least `least` documents of a language."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    seen = rows.select("lang", F.explode(terms).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("docs"))
    return ranked(seen.where(F.col("docs") >= least).select("lang", "term"), ["lang"], ["term"])


def transducers(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, first (ordinal), head (the least term), data (a packed transducer), size of each block of sorted terms."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        terms = [t.encode() for t in pdf["term"]]
        data = Transducer.build(terms).pack()
        return pd.DataFrame([{"lang": pdf["lang"].iloc[0], "first": int(pdf["slot"].iloc[0]), "head": terms[0], "data": data, "size": len(data)}])

    blocks = vocabulary.withColumn("block", F.floor(F.col("slot") / block))
    return blocks.groupBy("lang", "block").applyInPandas(build, "lang string, first long, head binary, data binary, size long")


def rounds_of(sizes: list[tuple[str, int, int]], most: int = ROUND_BYTES) -> list[list[tuple[str, int]]]:
    """The blocks (lang, first), of (lang, first, size), dealt to rounds of at most `most` bytes (a larger block is alone)."""
    rounds, held = [], 0
    for lang, first, size in sorted(sizes):
        if not rounds or held + size > most:
            rounds.append([])
            held = 0
        rounds[-1].append((lang, first))
        held += size
    return rounds


def recounted(rows: DataFrame, blocks: DataFrame, most: int = ROUND_BYTES) -> DataFrame:
    """lang, source, ordinal, n: how often each kept term occurs in each group; rows: lang, source, text."""
    spark, found = rows.sparkSession, None
    sizes = [(r["lang"], r["first"], r["size"]) for r in blocks.select("lang", "first", "size").collect()]  # a row for each 65,536 terms
    for some in rounds_of(sizes, most) or [[]]:
        wanted = spark.createDataFrame(some, "lang string, first long")
        held = spark.sparkContext.broadcast([(r["lang"], r["first"], bytes(r["head"]), bytes(r["data"])) for r in blocks.join(F.broadcast(wanted), ["lang", "first"]).collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            by_lang: dict[str, list] = {}
            for lang, first, head, data in held.value:
                by_lang.setdefault(lang, []).append((first, head, Transducer.unpack(data)))
            vocabularies = {lang: Vocabulary(b) for lang, b in by_lang.items()}
            for batch in batches:
                langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
                lang_of, source_of = langs.indices.to_numpy(), sources.indices.to_numpy()
                names, offsets = sources.dictionary.to_pylist(), _offsets(batch.column(2))
                buffer = batch.column(2).buffers()[2]
                data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
                for number, lang in enumerate(langs.dictionary.to_pylist()):
                    if lang not in vocabularies:
                        continue
                    texts = ((source_of[i], data[offsets[i] : offsets[i + 1]]) for i in np.flatnonzero(lang_of == number))
                    for group, ordinal, n in counted(vocabularies[lang], texts):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(group), pa.string()), pa.array([names[g] for g in group], pa.string()), pa.array(ordinal, pa.int64()), pa.array(n, pa.int64())], names=["lang", "source", "ordinal", "n"])

        part = rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal long, n long").groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
        part = cut(part)
        held.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)); decimals, as counts of a large corpus times UNIT leave 64 bits."""
    whole = lambda c: c.cast("decimal(20,0)")
    below = whole(total) + whole(terms) * F.lit(SMOOTH)
    return F.when(terms > 0, F.lit(1) + F.call_function("div", (whole(n) + F.lit(SMOOTH)) * F.lit(UNIT).cast("decimal(12,0)"), below)).otherwise(F.lit(1)).cast("long")


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(groups: DataFrame, entries: DataFrame, tile: int = TILE, span: int = SPAN) -> DataFrame:
    """lang, source, item (another source of the lang), value. groups: lang, source, terms, rest (p of a term that doesn't occur); entries: lang, source, ordinal, p."""
    sides = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    g = groups.join(sized(cut(sides)), "lang").withColumn("k", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    g = cut(g.select("lang", "source", "terms", "rest", "tiles", "k"))
    spans = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("terms") / span).cast("int") - 1)))
    marks = g.withColumn("span", spans).select("lang", "source", "tiles", "k", "span", F.lit(None).cast("long").alias("ordinal"), F.col("rest").alias("p"), F.least(F.lit(span), F.col("terms") - F.col("span") * span).cast("long").alias("length"))
    held = entries.join(sized(g.select("lang", "source", "tiles", "k")), ["lang", "source"]).select("lang", "source", "tiles", "k", F.floor(F.col("ordinal") / span).cast("int").alias("span"), "ordinal", "p", F.lit(None).cast("long").alias("length"))
    rows = marks.unionByName(held).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", "source", "k", "span", "ordinal", "p", "length", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"))

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mark = pdf["ordinal"].isna()
        heads = pdf[mark].sort_values(["k", "source"])
        names, side = heads["source"].tolist(), heads["k"].to_numpy()
        at = {s: n for n, s in enumerate(names)}
        terms, column = np.unique(pdf.loc[~mark, "ordinal"].to_numpy(np.int64), return_inverse=True)
        p = np.repeat(heads["p"].to_numpy(np.int64)[:, None], len(terms) + 1, axis=1)  # the last column: a term that none has
        p[pdf.loc[~mark, "source"].map(at).to_numpy(np.int64), column] = pdf.loc[~mark, "p"].to_numpy(np.int64)
        weight = np.append(np.ones(len(terms), np.int64), int(heads["length"].iloc[0]) - len(terms)) if len(heads) else None
        out = []
        for a in range(len(names)):
            mates = np.flatnonzero((side == key[3]) & (np.arange(len(names)) > a)) if side[a] == key[2] else np.zeros(0, int)
            if not len(mates):
                continue
            apart = p[mates] - p[a]
            value = (apart * apart // (p[mates] + p[a])) @ weight
            for b, v in zip(mates, value, strict=True):
                out += [(key[0], names[a], names[b], int(v)), (key[0], names[b], names[a], int(v))]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    tiles = rows.groupBy("lang", "span", "i", "j").applyInPandas(sums, "lang string, source string, item string, value long")
    return tiles.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    rows = plain(docs)
    vocabulary = kept_terms(rows, least)
    vocabulary = cut(vocabulary)
    counts = recounted(rows, cut(transducers(vocabulary)))
    sizes = sized(cut(vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms"])
    groups = cut(groups.withColumn("rest", _share(F.lit(0), F.col("total"), F.col("terms"))))
    entries = cut(counts.join(sized(groups), ["lang", "source"]).select("lang", "source", "ordinal", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p")))

    of_lang = cut(counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n")))
    lang_totals = sized(cut(of_lang.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))))  # every kept term occurs
    shares = of_lang.join(lang_totals, "lang").select("lang", "ordinal", _share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    over = entries.join(shares, ["lang", "ordinal"]).where("p > q").withColumn("value", _distance(F.col("p"), F.col("q")))
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    best = cut(over.select("lang", "source", "ordinal", "value").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top))
    terms = vocabulary.withColumnRenamed("slot", "ordinal").join(sized(best), ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_sums(groups, entries).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10),
words AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(w.n, 0) AS n, sum(coalesce(w.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k USING (lang) LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term),
p AS (SELECT lang, source, term, n, (1 + 1000000000 * (n + 2)::HUGEINT // (total + 2 * v))::BIGINT AS p FROM grid JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM grid GROUP BY lang, term),
q AS (SELECT lang, term, (1 + 1000000000 * (n + 2)::HUGEINT // (total + 2 * v))::BIGINT AS q FROM l JOIN v USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
