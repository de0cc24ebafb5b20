"""Conversations brought back to the grammar (s?(ua)+)? of role initials, at the least cost.

The turns are aligned (Wagner-Fischer) to the alternating string of every feasible length: keep costs 0, a new role 3,
an insertion 3, a deletion 4; blank and repeated turns must be deleted, a truncated turn that stays adds 3. All
lengths that end alike share their last symbols, so one table of (turns left, symbols left) for each last symbol holds
the alignments to all of them. The cost of a plain repair (the incumbent) bounds how far turns and symbols left may
differ: cells outside these Ukkonen bands are never made. The cheapest lengths are traced back, each to its least
audit, and the audits are compared.

A conversation of up to CHUNK turns is one group. A longer one is ranked by a distributed sort and cut into chunks:
each chunk's costs between the four states at its ends (nothing yet, after s, after u, after a) are composed, which
gives every chunk the costs of all that follows; with these its own alignment is the whole one's, ties included, as
only the last chunk inserts after its last turn. The hash of a repaired conversation is taken over its chunks in
order, a batch at a time, so no task ever holds a whole long conversation; its audit is one string, as asked.

Cases: null roles and texts are one space (so a null text is blank), null turns come first and have no part in gaps; a
null conv_id is a conversation; turns of one number stand by role, then text; repeated rows are duplicates; an initial
other than s, u, a is never kept, s only at the start; long texts are read whole; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, ranked, sized, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns that are aligned in one group.
CHUNK = 2048
#: States: nothing emitted, after s, after u, after a. Only the first and the last may end a conversation.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
LAST = (0, math.inf, math.inf, 0)
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, kept of rows after damage by crc32('conv_id:turn') % 20; a dropped row has kept = false."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "utf-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), times.alias("kept"))


def faults(rows: list[tuple[str, str]], repeated: list[bool] | None = None) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated or none; repeated: whether role and text stand earlier, if known."""
    seen, out = set(), []
    for number, row in enumerate(rows):
        end = row[1].rstrip(BLANKS)
        again = repeated[number] if repeated is not None else row in seen
        out.append("blank" if not end else "duplicate" if again else "truncated" if end[-1] not in ".!?" else "")
        if repeated is None:
            seen.add(row)
    return out


class Alignment:
    """The tables of a chunk's turns against the alternating strings that end in u and in a.

    ends: what follows costs, by the state at the chunk's end. trailing: insertions after the last turn are of this
    chunk. margin widens the bands, for costs between any two states. table[e][i] holds (least symbols left, costs).
    """

    def __init__(self, rows: list[tuple[str, str]], found: list[str], ends: tuple = LAST, trailing: bool = True, starts: Iterable[int] = (NOTHING,), margin: int = 0) -> None:
        self.initials = [role[:1] for role, _ in rows]
        self.forced = [f in ("blank", "duplicate") for f in found]
        self.extra = [TRUNCATED if f == "truncated" else 0 for f in found]
        self.n, self.ends, self.trailing = len(rows), ends, trailing
        self._bands(max(self._incumbent(q) for q in starts) + margin)
        self.table = {e: self._filled(e) for e in (AFTER_U, AFTER_A)}
        self.first_s = {e: self._with_s(e) for e in (AFTER_U, AFTER_A)}

    def _incumbent(self, state: int) -> float:
        """The cost of a plain repair: what doesn't fit gets the missing turn before it, or another role."""
        cost = 0
        for initial, forced, extra in zip(self.initials, self.forced, self.extra, strict=True):
            if forced:
                cost += DELETE
                continue
            cost += extra
            due = "a" if state == AFTER_U else "u"
            if initial == "s" and state == NOTHING:
                state = AFTER_S
            elif initial in ("u", "a"):
                cost += INSERT * (initial != due)
                state = AFTER_U if initial == "u" else AFTER_A
            else:
                cost += REROLE
                state = AFTER_U if due == "u" else AFTER_A
        if not self.trailing:
            return cost + self.ends[state]
        return cost + min(self.ends[state], INSERT + self.ends[AFTER_A if state == AFTER_U else AFTER_U], 2 * INSERT + self.ends[AFTER_U if state == AFTER_U else AFTER_A])

    def _bands(self, most: float) -> None:
        """The least and most symbols left for each number of turns passed, if no alignment costs over `most`."""
        least = DELETE * sum(self.forced) + min(self.ends)
        truncated = sum(x for x, f in zip(self.extra, self.forced, strict=True) if not f)
        # a deletion beyond the forced ones costs 4, or 1 more than what a truncated turn costs in any case
        fewer = int(min((most - least) // DELETE, most - least - truncated)) + 1
        more = int((most - least - truncated) // INSERT) + 1
        left, self.low, self.high = 0, [0] * (self.n + 1), [0] * (self.n + 1)
        for i in range(self.n, -1, -1):
            left += i < self.n and not self.forced[i]
            self.low[i], self.high[i] = max(0, left - fewer), left + more

    def cost(self, e: int, i: int, r: int) -> float:
        return self.table[e][i][r - self.low[i]] if self.low[i] <= r <= self.high[i] else math.inf

    @staticmethod
    def symbol(e: int, r: int) -> str:
        """The first of the last r symbols."""
        return "a" if (r % 2 == 1) == (e == AFTER_A) else "u"

    def _filled(self, e: int) -> list[list[float]]:
        inf, rows = math.inf, [[]] * (self.n + 1)
        rows[self.n] = [self.ends[e] + INSERT * r if not r or self.trailing else inf for r in range(self.low[self.n], self.high[self.n] + 1)]
        for i in range(self.n - 1, -1, -1):
            below, shift, top, initial, forced, extra = rows[i + 1], self.low[i + 1], self.high[i + 1], self.initials[i], self.forced[i], self.extra[i]
            row, last = [], inf
            for r in range(self.low[i], self.high[i] + 1):
                best = last + INSERT
                if shift <= r <= top:
                    best = min(best, below[r - shift] + DELETE)
                if not forced and r and shift <= r - 1 <= top:
                    best = min(best, below[r - 1 - shift] + extra + (0 if initial == self.symbol(e, r) else REROLE))
                row.append(best)
                last = best
            rows[i] = row
        return rows

    def _with_s(self, e: int) -> list[list[float]]:
        """Costs of the turns from i on against s and the last r symbols, r > 0: only a turn with this initial can be s, what stands before is deleted."""
        rows = [[]] * (self.n + 1)
        rows[self.n] = [math.inf] * (self.high[self.n] - self.low[self.n] + 1)
        for i in range(self.n - 1, -1, -1):
            can = self.initials[i] == "s" and not self.forced[i]
            row = []
            for r in range(self.low[i], self.high[i] + 1):
                later = rows[i + 1][r - self.low[i + 1]] + DELETE if self.low[i + 1] <= r <= self.high[i + 1] else math.inf
                row.append(min(later, self.extra[i] + self.cost(e, i + 1, r)) if can else later)
            rows[i] = row
        return rows

    def _traced(self, e: int, r: int, i: int = 0) -> str:
        """The least audit of the cheapest alignment of the turns from i on to the last r symbols."""
        out = []
        while i < self.n or r:
            now = self.cost(e, i, r)
            if i < self.n and self.cost(e, i + 1, r) + DELETE == now:
                out.append("D")
                i += 1
            elif r and (i < self.n or self.trailing) and self.cost(e, i, r - 1) + INSERT == now:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.initials[i] == self.symbol(e, r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)

    def _traced_s(self, e: int, r: int) -> str:
        i = 0
        while True:
            now = self.first_s[e][i][r - self.low[i]]
            if i + 1 <= self.n and self.low[i + 1] <= r <= self.high[i + 1] and self.first_s[e][i + 1][r - self.low[i + 1]] + DELETE == now:
                i += 1
            else:
                return "D" * i + "K" + self._traced(e, r, i + 1)

    def candidates(self, start: int) -> Iterator[tuple[float, int, object]]:
        """(cost, state at the end, a function that gives the audit) for each feasible length."""
        if start in (NOTHING, AFTER_S):
            yield DELETE * self.n + self.ends[start], start, lambda: "D" * self.n
        due = "a" if start == AFTER_U else "u"
        for e in (AFTER_U, AFTER_A):
            for r in range(self.low[0], self.high[0] + 1):
                if r and self.symbol(e, r) == due or not r and start == e:
                    yield self.cost(e, 0, r), e, lambda e=e, r=r: self._traced(e, r)
                if r and start == NOTHING and self.symbol(e, r) == "u":
                    yield self.first_s[e][0][r - self.low[0]], e, lambda e=e, r=r: self._traced_s(e, r)
        if start == NOTHING and self.ends[AFTER_S] < math.inf:
            alone = [(self.extra[i], -i) for i in range(self.n) if self.initials[i] == "s" and not self.forced[i]]
            if alone:  # the latest of the cheapest has the least audit
                extra, at = min(alone)
                yield DELETE * (self.n - 1) + extra + self.ends[AFTER_S], AFTER_S, lambda: "D" * -at + "K" + "D" * (self.n - 1 + at)

    def best(self, start: int = NOTHING) -> tuple[int, str, int]:
        """The least cost (with what follows), its least audit, and the state at the end."""
        found = list(self.candidates(start))
        least = min(c for c, _, _ in found)
        audit, end = min((audit(), end) for c, end, audit in found if c == least)
        return int(least), audit, end

    def costs(self, start: int) -> list[float]:
        """The least cost to each state at the end."""
        out = [math.inf] * 4
        for cost, end, _ in self.candidates(start):
            out[end] = min(out[end], cost)
        return out


def repaired(rows: list[tuple[str, str]], audit: str, start: int = NOTHING) -> list[str]:
    """The role:text of the turns that the edits of the audit give."""
    out, i, state = [], 0, start
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = ("", "") if edit == "I" else rows[i]
        if edit == "K" and state == NOTHING and role[:1] == "s":
            state = AFTER_S
        else:
            due = "a" if state == AFTER_U else "u"
            role = role if edit == "K" else ROLES[due]
            state = AFTER_U if due == "u" else AFTER_A
        i += edit != "I"
        out.append(f"{role}:{text}")
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def gaps(turns: Iterable[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of neighbouring rows with the same first columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, some in groupby(rows, key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in some]


def _streamed(df: DataFrame, keys: list[str], order: list, run, schema: T.StructType) -> DataFrame:
    """run(key, rows of the key in their order) -> rows, for each key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = schema.fieldNames(), []
        for key, rows in _groups(batches, len(keys)):
            held += run(key, rows)
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], arrow)

    arrow = to_arrow_schema(schema)
    return df.repartition(*keys).sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys), *order).mapInArrow(each, schema)


def _schema(key: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", key), *T.StructType.fromDDL(rest)])


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(key: tuple, rows: list[tuple]) -> list[tuple]:
    rows = [r[:3] for r in rows if r[3]]
    turns = [r[1:] for r in rows]
    found = faults(turns)
    cost, audit, _ = Alignment(turns, found).best()
    sha = hashlib.sha256("\n".join(repaired(turns, audit)).encode()).hexdigest()
    return [(*key, gaps(r[0] for r in rows), *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal([r[0][:1] for r in turns]), cost, audit, sha)]


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id and REPORT of every conversation. rows: conv_id, turn, role, text, kept (false: only tells that the conversation exists)."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    long = sized(cut(sizes.select(F.col("conv_id").alias("c"))))
    met = F.col("conv_id").eqNullSafe(F.col("c"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    key = rows.schema["conv_id"].dataType
    short = _streamed(rows.join(long, met, "left_anti"), ["conv_id"], order, _report, _schema(key, REPORT))
    return short if long.isEmpty() else short.unionByName(_long(cut(rows.join(long, met, "left_semi")), order, chunk))


def _long(rows: DataFrame, order: list, chunk: int) -> DataFrame:
    """repair() of conversations of many chunks."""
    key = rows.schema["conv_id"].dataType
    turns = cut(ranked(rows.where("kept").drop("kept").withColumn("digest", F.sha2("text", 256)), ["conv_id"], order))
    firsts = cut(turns.groupBy("conv_id", "role", "digest").agg(F.min("slot").alias("first"), F.count("*").alias("n")).where("n > 1"))
    firsts = sized(firsts.select(F.struct("conv_id", "role", "digest").alias("same"), "first"))
    count = cut(turns.groupBy("conv_id").agg(F.max("slot").alias("top")))
    met = turns.join(firsts, F.struct("conv_id", "role", "digest").eqNullSafe(F.col("same")), "left")
    met = met.join(sized(count.select(F.struct("conv_id").alias("of"), "top")), F.struct("conv_id").eqNullSafe(F.col("of")))
    at = F.floor(F.col("slot") / chunk)
    turns = cut(met.select("conv_id", at.alias("chunk"), "slot", "turn", "role", "text", F.coalesce(F.col("slot") > F.col("first"), F.lit(False)).alias("again"), (at == F.floor(F.col("top") / chunk)).alias("last")))

    def costs(key: tuple, rows: list[tuple]) -> list[tuple]:
        """What a chunk has, and its costs between all states (-1: none)."""
        pairs, numbers = [r[2:4] for r in rows], [r[1] for r in rows if r[1] is not None]
        found, last = faults(pairs, [r[4] for r in rows]), rows[0][5]
        table = Alignment(pairs, found, (0, 0, 0, 0), last, range(4), 12)  # 12: no end is more than four edits from another
        between = [-1 if math.isinf(c) else int(c) for q in range(4) for c in table.costs(q)]
        initials = [r[0][:1] for r in pairs]
        return [(*key, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal(initials), initials[0], initials[-1], numbers[0] if numbers else None, numbers[-1] if numbers else None, len(set(numbers)), between)]

    summary = "chunk long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long, between array<long>"
    chunks = cut(_streamed(turns, ["conv_id", "chunk"], ["slot"], costs, _schema(key, summary)))

    def composed(key: tuple, rows: list[tuple]) -> list[tuple]:
        """The costs of all that follows each chunk, by the state at its end, and the counts of the whole (on its first chunk)."""
        follow, out = LAST, []
        for r in reversed(rows):
            out.append((*key, r[0], [-1 if math.isinf(x) else int(x) for x in follow]))
            table = [[math.inf if r[10][q * 4 + e] < 0 else r[10][q * 4 + e] for e in range(4)] for q in range(4)]
            follow = tuple(min(table[q][e] + follow[e] for e in range(4)) for q in range(4))
        known = [(r[7], r[8], r[9]) for r in rows if r[7] is not None]
        distinct = sum(k[2] for k in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:], strict=False))
        gap = known[-1][1] - known[0][0] + 1 - distinct if known else 0
        across = sum(a[6] + b[5] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
        whole = (gap, *(sum(r[i] for r in rows) for i in (1, 2, 3)), sum(r[4] for r in rows) + across, int(follow[NOTHING]))
        return [(*r, *(whole if r[1] == 0 else [None] * 6)) for r in out]

    ends = cut(_streamed(chunks, ["conv_id"], ["chunk"], composed, _schema(key, "chunk long, ends array<long>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")))
    turns = turns.withColumn("of", F.struct("conv_id", "chunk"))
    held = sized(cut(ends.select(F.struct("conv_id", "chunk").alias("same"), "ends")))
    turns = cut(turns.join(held, F.col("of").eqNullSafe(F.col("same"))).drop("of", "same"))
    finite = lambda x: tuple(math.inf if v < 0 else v for v in x)

    def ways(key: tuple, rows: list[tuple]) -> list[tuple]:
        """Where the best repair of a chunk ends, by the state that it starts in."""
        pairs = [r[2:4] for r in rows]
        table = Alignment(pairs, faults(pairs, [r[4] for r in rows]), finite(rows[0][6]), rows[0][5], range(4))
        return [(*key, [table.best(q)[2] for q in range(4)])]

    def chained(key: tuple, rows: list[tuple]) -> list[tuple]:
        state, out = NOTHING, []
        for at, to in rows:
            out.append((*key, at, state))
            state = to[state]
        return out

    steps = cut(_streamed(turns, ["conv_id", "chunk"], ["slot"], ways, _schema(key, "chunk long, ends_in array<int>")))
    starts = cut(_streamed(steps, ["conv_id"], ["chunk"], chained, _schema(key, "chunk long, start int")))
    starts = sized(starts.select(F.struct("conv_id", "chunk").alias("same"), "start"))
    turns = turns.join(starts, F.struct("conv_id", "chunk").eqNullSafe(F.col("same"))).drop("same")

    def pieces(key: tuple, rows: list[tuple]) -> list[tuple]:
        pairs = [r[2:4] for r in rows]
        _, audit, _ = Alignment(pairs, faults(pairs, [r[4] for r in rows]), finite(rows[0][6]), rows[0][5], (rows[0][7],)).best(rows[0][7])
        told = repaired(pairs, audit, rows[0][7])
        return [(*key, audit, "\n".join(told) if told else None)]

    parts = cut(_streamed(turns, ["conv_id", "chunk"], ["slot"], pieces, _schema(key, "chunk long, audit string, piece string")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = ["conv_id", "audit", "repaired_sha256"], (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for conv, some in groupby(rows, key=lambda r: r[0]):
            sha, audit, first = hashlib.sha256(), [], True
            for _, _, edits, piece in some:
                audit.append(edits)
                if piece is not None:
                    sha.update((piece if first else f"\n{piece}").encode())
                    first = False
            yield pa.RecordBatch.from_pylist([dict(zip(names, (conv, "".join(audit), sha.hexdigest()), strict=True))], to_arrow_schema(hashed))

    hashed = _schema(key, "audit string, repaired_sha256 string")
    whole = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk").mapInArrow(joined, hashed).select(F.struct("conv_id").alias("same"), "audit", "repaired_sha256")
    counts = ends.where("chunk = 0").drop("chunk", "ends").join(whole, F.struct("conv_id").eqNullSafe(F.col("same"))).drop("same")
    names = rows.select("conv_id").distinct().select(F.struct("conv_id").alias("every"))
    out = names.join(counts, F.struct("conv_id").eqNullSafe(F.col("every")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("every.conv_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: The same repair by another way: after each turn the cheapest (cost, audit) of each state, up to two insertions before it.
SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')), '..')]),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM conversations, crc),
e AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE kind <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         right(rtrim(text, E' \t\n\x0B\x0C\r'), 1) AS tail FROM e),
f AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS initial, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS next
  FROM n),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS turns,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (initial || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
ins AS (
  SELECT * FROM (VALUES ('', '', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
    ('', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('a', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']),
    ('', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:']), ('a', 'a', 6, 'II', ['user:', 'assistant:']),
    ('u', 'u', 6, 'II', ['assistant:', 'user:'])) v(q, q1, more, edits, added)),
best(conv_id, n, q, b) AS (
  SELECT conv_id, 0::BIGINT, '', {'cost': 0, 'audit': '', 'told': []::VARCHAR[]} FROM c
  UNION ALL
  SELECT conv_id, n, q2, min(b) FROM (
    SELECT f.conv_id, f.n, CASE op WHEN 'D' THEN q1 WHEN 'K' THEN initial ELSE CASE q1 WHEN 'u' THEN 'a' ELSE 'u' END END AS q2,
           {'cost': s.b.cost + more + CASE op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN op <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
            'audit': s.b.audit || edits || op,
            'told': s.b.told || added || CASE op WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text]
                      ELSE [CASE q1 WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text] END} AS b
    FROM best s JOIN ins ON ins.q = s.q JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n + 1, (VALUES ('D'), ('K'), ('R')) o(op)
    WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate')
      AND (op = 'R' OR initial = CASE q1 WHEN 'u' THEN 'a' ELSE 'u' END OR initial = 's' AND q1 = ''))
  GROUP BY conv_id, n, q2),
done AS (
  SELECT c.conv_id, min({'cost': b.cost + more, 'audit': b.audit || edits, 'told': b.told || added}) AS b
  FROM c JOIN best s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.n = c.turns JOIN ins ON ins.q = s.q WHERE q1 IN ('', 'a') GROUP BY c.conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(array_to_string(coalesce(b.told, []), chr(10))) AS repaired_sha256
FROM every LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM every.conv_id
"""
