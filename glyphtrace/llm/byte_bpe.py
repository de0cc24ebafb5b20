"""Byte-level BPE by corpus-level merge replay.

The texts of a block (a few MB) are cut into words by the tokenizer's pattern, and the block's distinct words are
laid end to end as one array of symbols. An inverted index maps each merge (by rank) to the positions of its pairs
in that array. Merges are then replayed in rank order over all words at once: for each rank, its positions from
left to right; a merge looks only at its two neighbours and files the new pairs under their ranks. A new pair of a
lower rank sends the word's remaining positions back, so each word sees its merges exactly as if encoded alone.
The tokens of a word don't depend on the block, so blocks can be any size and need no shuffle.

A word that is in the vocabulary as a whole is that one token, before any merge, as in the tiktoken library.

Cases: a null or empty text has no tokens; a word of any length costs n log n; an empty table gives an empty
result; nulls in other columns and repeated rows are kept as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Code points of a block; the block ends with the text that reaches it.
BLOCK_POINTS = 4_000_000
#: A task forgets the tokens of words between blocks when it knows more words than this.
KEPT_WORDS = 200_000
#: Bytes of a word up to which all words are merged together, as arrays.
SHORT_WORD = 128


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a .tiktoken file by their bytes."""
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}


def replay_long(words: Iterable[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The merges over words of any length, a position at a time: a word costs n log n."""
    whole = [ranks.get(w) for w in words]
    parts = [w for w, r in zip(words, whole, strict=True) if r is None]
    data = b"".join(parts)
    n = len(data)
    piece: list[bytes | None] = [data[i : i + 1] for i in range(n)]  # the symbol that starts here, None inside one
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    word = [0] * n
    start = 0
    for k, w in enumerate(parts):
        for i in range(start, start + len(w)):
            word[i] = k
        if w:
            before[start] = -1
            start += len(w)
            after[start - 1] = -1
    index: dict[int, list[int]] = {}
    pair_rank = ranks.get
    for i in range(n):
        if (j := after[i]) >= 0 and (r := pair_rank(piece[i] + piece[j])) is not None:
            index.setdefault(r, []).append(i)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        positions = index.pop(rank, None)
        if not positions:
            continue
        positions.sort()
        back: dict[int, list[int]] = {}
        lower: set[int] = set()  # words that have a merge of a lower rank first
        for i in positions:
            if piece[i] is None or (j := after[i]) < 0 or pair_rank(piece[i] + piece[j]) != rank:
                continue
            if word[i] in lower:
                back.setdefault(rank, []).append(i)
                continue
            piece[i] += piece[j]
            piece[j] = None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := pair_rank(piece[i] + piece[k])) is not None:
                    back.setdefault(r, []).append(i)
                    if r < rank:
                        lower.add(word[i])
            if (h := before[i]) >= 0 and (r := pair_rank(piece[h] + piece[i])) is not None:
                back.setdefault(r, []).append(h)
                if r < rank:
                    lower.add(word[i])
        for r, where in back.items():
            if r in index:
                index[r] += where
            else:
                index[r] = where
                heapq.heappush(heap, r)
    out: list[list[int]] = []
    at = 0
    for w, r in zip(words, whole, strict=True):
        if r is not None:
            out.append([r])
        else:
            out.append([ranks[p] for p in piece[at : at + len(w)] if p is not None])
            at += len(w)
    return out


class Merges:
    """The ranks by bytes, and by pair of token ids as sorted arrays. A token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.base = max(ranks.values()) + 1
        pairs = {}
        for b, r in ranks.items():
            for i in range(1, len(b)):
                left, right = ranks.get(b[:i]), ranks.get(b[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], np.int32(-1))


def replay_short(words: list[bytes], merges: Merges) -> list[list[int]]:
    """The merges over all words at once, a rank at a time; of a word's equal pairs, the first one in each turn."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n, ends = len(data), np.cumsum(lengths)
    token = merges.byte[data]
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    after[ends - 1] = -1
    before[ends - lengths] = -1
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    alive = np.ones(n, bool)
    rank_at = np.full(n, -1, np.int32)  # of the pair that starts here
    inner = np.flatnonzero(after >= 0).astype(np.int32)
    rank_at[inner] = merges.of(token[inner], token[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(positions: np.ndarray, ranks: np.ndarray) -> None:
        keep = ranks >= 0
        positions, ranks = positions[keep], ranks[keep]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for a, b, r in zip(bounds, bounds[1:], ranks[[0, *cuts.tolist()]].tolist(), strict=False):
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                heapq.heappush(heap, r)

    file(inner, rank_at[inner])
    while heap:
        rank = heapq.heappop(heap)
        filed = index.pop(rank)
        at = filed[0] if len(filed) == 1 else np.sort(np.concatenate(filed))
        at = at[rank_at[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            if not first.all():
                index[rank] = [at[~first]]
                heapq.heappush(heap, rank)
                at = at[first]
        gone = after[at]
        right = after[gone]
        token[at] = rank
        alive[gone] = False
        rank_at[gone] = -1
        after[at] = right
        rank_at[at] = -1
        more = right >= 0
        a, k = at[more], right[more]
        before[k] = a
        left = before[at]
        less = left >= 0
        h, b = left[less], at[less]
        places = np.concatenate((a, h))
        ranks = merges.of(np.concatenate((token[a], token[h])), np.concatenate((token[k], token[b])))
        rank_at[places] = ranks
        file(places, ranks)
    left_over = token[alive].tolist()
    counts = np.add.reduceat(alive, ends - lengths) if n else []
    out, start = [], 0
    for c in counts.tolist():
        out.append(left_over[start : start + c])
        start += c
    return out


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """The tokens of each word (not empty)."""
    ranks, out = merges.ranks, [None] * len(words)
    short, long = [], []
    for i, w in enumerate(words):
        if (r := ranks.get(w)) is not None:
            out[i] = [r]
        else:
            (short if len(w) <= SHORT_WORD else long).append(i)
    for some, ids in ((short, replay_short([words[i] for i in short], merges) if short else []), (long, replay_long([words[i] for i in long], ranks))):
        for i, x in zip(some, ids, strict=True):
            out[i] = x
    return out


def character_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for value, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = value
    return out


#: The pattern that split_words follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def split_words(text: str, classes: np.ndarray) -> list[str]:
    """The matches of PATTERN: runs of one class, with a single space before; apostrophe endings; white space."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return []
    kind = classes[points]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3))  # the last white space before something else
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quotes = np.flatnonzero((points == 39) & start[:n])
    for q in quotes.tolist():
        end = q + 2 if text[q + 1 : q + 2] in ("s", "t", "m", "d") else q + 3 if text[q + 1 : q + 3] in ("re", "ve", "ll") else 0
        if end:
            start[q + 1] = False
            start[end] = True
    at = np.flatnonzero(start).tolist()
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


class Encoder:
    """Encodes and decodes blocks of texts; keeps the tokens of short words between blocks."""

    def __init__(self, merges: Merges, pattern: str, classes: np.ndarray) -> None:
        import regex

        self.merges = merges
        self.words_of = (lambda t: split_words(t, classes)) if pattern == PATTERN else regex.compile(pattern).findall
        self.bytes_of = {r: b for b, r in merges.ranks.items()}
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def learn(self, words: list[str]) -> None:
        """Replays the merges over new words: ids joined by commas, their number, their bytes."""
        for w, ids in zip(words, replay([w.encode() for w in words], self.merges), strict=True):
            self.known[w] = ",".join(map(str, ids)), len(ids), b"".join(map(self.bytes_of.__getitem__, ids))

    def block(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Number of tokens, their ids joined by commas, the decoded bytes of each text."""
        same: dict[str, str] = {}
        words = []
        for t in texts:
            each = self.words_of(t)
            words.append(list(map(same.setdefault, each, each)))
        self.learn([w for w in same if w not in self.known])
        known = self.known.__getitem__
        for each in words:
            found = list(map(known, each))
            yield sum([x[1] for x in found]), ",".join([x[0] for x in found]), b"".join([x[2] for x in found])
        self.known = {} if len(self.known) > KEPT_WORDS else {w: x for w, x in self.known.items() if len(w) <= SHORT_WORD}


def blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """Lists of texts of about BLOCK_POINTS code points."""
    block, points = [], 0
    for t in texts:
        block.append(t)
        points += len(t)
        if points >= BLOCK_POINTS:
            yield block
            block, points = [], 0
    if block:
        yield block


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with ids=True the ids and the decoded text.

    path: a .tiktoken file on the driver; its ranks (a few MB, fixed by the vocabulary) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(path), character_classes()))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, classes = shared.value
        encoder = Encoder(Merges(ranks), pattern, classes)
        for batch in batches:
            rows = []
            for texts in blocks(t.as_py() or "" for t in batch.column(1)):
                for n, joined, decoded in encoder.block(texts):
                    row = (n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append(row + ([int(x) for x in joined.split(",") if x], decoded.decode("utf-8", "replace")) if ids else row)
            columns = [pa.array(c, type=f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())[: 5 if ids else 3], strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
