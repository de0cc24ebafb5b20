"""op11 against the cheapest edits found by exhaustive search, whole and in chunks."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from glyphtrace.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns, found):
    """(cost, audit, repaired), by searching all edits in order of cost and audit. States: '', s, u, a."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, "\n".join(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        heapq.heappush(heap, (cost + 3, audit + "I", i, due, (*out, f"{name}:")))
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if found[i] not in ("blank", "duplicate"):
                extra = 3 * (found[i] == "truncated")
                if role[:1] == due or role[:1] == "s" and not state:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, due, (*out, f"{name}:{text}")))
    raise AssertionError


def brute(rows):
    """The report of every conversation from undamaged (conv_id, turn, role, text)."""
    every = {}
    for conv, turn, role, text in rows:
        kept = every.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    for conv, kept in every.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, found, seen = [r[1:] for r in kept], [], set()
        for role, text in turns:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            found.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
            seen.add((role, text))
        known = {r[0] for r in kept if r[0] is not None}
        cost, audit, whole = cheapest(turns, found)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        yield conv, max(known) - min(known) + 1 - len(known) if known else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(whole.encode()).hexdigest()


def invented(draw, conversations, most):
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randint(1, most)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]) if draw.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = draw.choice(["Yes.", "No", "So it is!", "", None, " \t\n", "Çok iyi. 😀", f"{draw.random()}.", f"{draw.random()}?", f"{draw.random()}."])
            rows.append((None if conv == 3 else conv, draw.choice([turn, turn, turn, turn + 5, None]), role, text))
    return rows


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("chunk", [2048, 3, 1, 7])
def test_reports_against_search(spark, chunk):
    rows = invented(random.Random(chunk), 150 if chunk > 100 else 60, 24)
    rows.append((900, zero(900), "user", "This turn goes."))
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, slot string, kept int")
    got = R.repair(R.damaged(table), chunk)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def zero(conv):
    """A turn of this conversation that is dropped."""
    return next(t for t in range(1000) if zlib.crc32(f"{conv}:{t}".encode()) % 20 == 0)


def test_long_alignment_in_bands():
    """Bands give what the search gives for long conversations with many faults, and stay narrow."""
    draw = random.Random(2)
    turns = [(("user", "assistant")[i % 2] if draw.random() > 0.1 else draw.choice(["user", "system"]), f"{draw.random()}." if draw.random() > 0.1 else f"{draw.random()}") for i in range(600)]
    found = R.faults(turns)
    table = R.Alignment(turns, found)
    cost, audit, _ = table.best()
    want = cheapest(turns, found)
    assert (cost, audit, "\n".join(R.repaired(turns, audit))) == want
    assert max(h - low for low, h in zip(table.low, table.high)) < 150


def test_damage(spark):
    rows = [(1, t, "system", "A. B! C?") for t in range(200)] + [(None, None, None, None)]
    got = R.damaged(spark.createDataFrame(rows, SCHEMA)).groupBy("conv_id", "turn").agg(F.collect_list(F.struct("role", "text", "kept")).alias("r")).collect()
    for r in got:
        kind = zlib.crc32((f"1:{r['turn']}" if r["conv_id"] else " : ").encode()) % 20
        role, text = ("system", "A. B! C?") if r["conv_id"] else (" ", " ")
        want = {0: [(role, text, False)], 1: [(role, "", True)], 2: [(role, "A B C" if r["conv_id"] else " ", True)], 3: [(role, text, True)] * 2, 4: [("user", text, True)]}.get(kind, [(role, text, True)])
        assert [tuple(x) for x in r["r"]] == want


def test_no_conversations(spark):
    assert R.repair(R.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
