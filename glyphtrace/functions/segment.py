"""Sentences: one pass over the marks of a text that may end one, in Arrow batches, and the same as a table function.

A text is cut into units (lines of a chat; of prose, lines that go on in lower case or with a conjunction are one), a
unit at its marks: full stops and the like, soft marks in prose, emoji before a capital or an end. A full stop inside
a decimal, after an ordinal, an abbreviation or an initial, or in an address ends nothing.

Cases: a null text has no sentences, like one without words; what a unit has after its last mark is a sentence; a text
of any length is passed once, a token's kind being found once for all full stops in it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import text as T
from .text import ABBREVIATIONS

# Marks that end a sentence, marks that end one in prose, what may close after them, conjunctions that lines go on with.
HARD = ".!?؟۔‼⁉！？。…"
SOFT = ";؛"
CLOSING = "\"”’')]»›"
CONJUNCTIONS = ("and", "but", "or", "so", "because", "which", "that", "ve", "ama", "fakat", "ancak", "çünkü", "ki", "veya", "ya da")
TOP_LEVEL = ("com", "net", "org", "edu", "gov", "info", "io", "co", "tr", "de", "uk", "fr", "nl", "ru")
#: A sentence of more words is nearly always one that wasn't cut.
SUSPECT = 120

SENTENCE = StructType().add("text", "string").add("words", "integer").add("listed", "boolean").add("terminator", "string").add("run", "string")

_SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_EMOJI = r"\p{Extended_Pictographic}"
_MARK = regex.compile(rf"[{HARD}{SOFT}]|{_EMOJI}(?:{_EMOJI}|[\ufe0f\u200d\U0001f3fb-\U0001f3ff])*")
_RUN, _CLOSE = regex.compile(f"[{HARD}]+"), regex.compile(f"[{regex.escape(CLOSING)}]*")
_TOKEN = regex.compile(rf"[^{_SPACE}]*"), regex.compile(rf"(?r)[^{_SPACE}]*")
_WEB = regex.compile(rf"://|@|(?i:\.(?:{'|'.join(TOP_LEVEL)})(?![A-Za-z0-9_]))")
_GOES_ON = regex.compile(rf"[{_SPACE}]*(?:{'|'.join(CONJUNCTIONS)})(?![\p{{L}}\p{{M}}\p{{N}}_])", regex.IGNORECASE)
_LISTED = regex.compile(rf"[{_SPACE}]*(?:[-*•+‣·]|\p{{Nd}}{{1,2}}[.)])[{_SPACE}]+")
_WORD = regex.compile(r"(?!\u0640)[\p{L}\p{M}][\p{L}\p{M}\u0640'\u2019-]*")
_LINE, _BLANKS, _INLINE = regex.compile(r"\r?\n"), regex.compile(f"[{_SPACE}]*"), regex.compile(rf"[^\S\n]*")
_TRIM = "".join(map(chr, [*range(9, 14), 32, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def _kind(c: str) -> str:
    """The general category; characters past the basic plane are no letters or digits here."""
    return unicodedata.category(c) if c and c <= "\uffff" else ""


def units(text: str, shape: str) -> Iterator[str]:
    """The lines of a chat; the paragraphs' runs of lines that go on."""
    held: list[str] = []
    for line in _LINE.split(text):
        bare = line.strip(_TRIM)
        if shape == "chat":
            if bare:
                yield line
        elif not bare:
            if held:
                yield " ".join(held)
            held = []
        elif held and (_kind(bare[0])[:1] == "L" and _kind(bare[0]) != "Lu" or _GOES_ON.match(line)):
            held.append(bare)
        else:
            if held:
                yield " ".join(held)
            held = [line]
    if held:
        yield " ".join(held)


class _Unit:
    def __init__(self, text: str) -> None:
        self.text, self.token, self.web = text, (0, -1), False

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def stops(self, i: int) -> bool:
        """Whether the full stop at i may end a sentence."""
        before, after = _kind(self.at(i - 1)), _kind(self.at(i + 1))
        if before == after == "Nd" or before == "Nd" and self.ordinal(i):
            return False
        if before[:1] == "L":
            start = i
            while _kind(self.at(start - 1))[:1] == "L":
                start -= 1
            if self.text[start:i].replace("İ", "i").replace("I", "ı").lower() in ABBREVIATIONS:
                return False
        if not self.token[0] <= i < self.token[1]:
            self.token = _TOKEN[1].match(self.text, 0, i).start(), _TOKEN[0].match(self.text, i).end()
            self.web = bool(_WEB.search(self.text[self.token[0] : self.token[1]]))
        return not self.web and not (before == "Lu" and _kind(self.at(i - 2))[:1] != "L")

    def ordinal(self, i: int) -> bool:
        """One or two digits before i, and a word in lower case after it."""
        digits = 1 + (_kind(self.at(i - 2)) == "Nd")
        if digits == 2 and _kind(self.at(i - 3)) == "Nd" or _kind(self.at(i - 1 - digits))[:1] == "L":
            return False
        following = _kind(self.at(_INLINE.match(self.text, i + 1).end()))
        return following[:1] == "L" and following != "Lu"

    def pieces(self, shape: str) -> Iterator[tuple[int, int, str | None, str]]:
        """start, end, terminator, run of each piece."""
        text, start, at = self.text, 0, 0
        while mark := _MARK.search(text, at):
            i, c = mark.start(), mark.group()[0]
            at = i + 1
            if c in HARD:
                if c == "." and not self.stops(i):
                    continue
                run = _RUN.match(text, i)
                at = _CLOSE.match(text, run.end()).end()
                yield start, at, c, run.group()
                start = at
            elif c in SOFT:
                if shape == "prose":
                    yield start, at, c, c
                    start = at
            else:
                at = mark.end()
                following = _BLANKS.match(text, at).end()
                if (i == 0 or text[i - 1] not in HARD) and (following == len(text) or _kind(text[following]) == "Lu"):
                    yield start, at, "emoji", ""
                    start = at
        if start < len(text):
            yield start, len(text), None, ""


def segment(text: str | None, shape: str | None) -> list[tuple[str, int, bool, str | None, str]]:
    """text, words, listed, terminator, run of each sentence; shape is chat or prose."""
    out = []
    for unit in units(text or "", shape or "prose"):
        marker = _LISTED.match(unit)
        for start, end, terminator, run in _Unit(unit).pieces(shape or "prose"):
            piece = unit[start:end]
            words = len(_WORD.findall(piece))
            if words:
                listed = marker is not None and start <= marker.end() or _LISTED.match(piece) is not None
                out.append((piece.strip(_TRIM), words, listed, terminator, run))
    return out


#: Sentences that are held as Python's objects at once, before they go into Arrow's columns.
HELD = 4_096
_ARROW = pa.struct([("text", pa.string()), ("words", pa.int32()), ("listed", pa.bool_()), ("terminator", pa.string()), ("run", pa.string())])


@F.arrow_udf(ArrayType(SENTENCE))
def _segmented(texts: pa.Array, shapes: pa.Array) -> pa.Array:
    """A batch's sentences as columns: beside the batch, only HELD sentences and those of one text are objects at a time."""
    done, held, ends = [], [], [0]

    def packed() -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], fields=list(_ARROW)) if held else pa.array([], _ARROW)

    for t, k in zip(texts, shapes, strict=True):
        found = segment(t.as_py(), k.as_py())
        ends.append(ends[-1] + len(found))
        held += found
        if len(held) >= HELD:
            done.append(packed())
            held = []
    done.append(packed())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(done))


def segmented(text: Column, shape: Column) -> Column:
    """The sentences of a text (in NFC) as an array of SENTENCE."""
    return _segmented(text, shape)


class Sentences:
    """sentences(TABLE(...)): the table's columns, number (from 0) and SENTENCE's fields, a row for each sentence.

    The table needs a column text; a column shape (chat or prose) is used if there is one. A column of the table that
    is named like one of the sentence's is kept under its name with an underscore before it.
    """

    @staticmethod
    def analyze(table):  # noqa: ANN001, ANN205
        from pyspark.sql.udtf import AnalyzeResult

        added, out = ["number", "sentence", *SENTENCE.names[1:]], StructType()
        if "text" not in table.dataType.names:
            raise ValueError("sentences() needs a table with a column text")
        for field in table.dataType.fields:
            out = out.add(f"_{field.name}" if field.name in added else field.name, field.dataType, True)
        out = out.add("number", "integer").add("sentence", "string")
        for field in SENTENCE.fields[1:]:
            out = out.add(field.name, field.dataType, True)
        return AnalyzeResult(schema=out)

    def eval(self, row):  # noqa: ANN001, ANN201
        shape = row["shape"] if "shape" in row else None
        text = row["text"] if row["text"] is None else unicodedata.normalize("NFC", row["text"])
        for number, sentence in enumerate(segment(text, shape)):
            yield (*row, number, *sentence)


def register(spark: SparkSession) -> None:
    """Names for SQL: sentences(TABLE(...)) and the functions nfc, folded, segmented, n_words, length_bucket."""
    spark.udtf.register("sentences", F.udtf(Sentences))
    spark.udf.register("nfc", T._nfc)
    spark.udf.register("segmented", _segmented)
    # what columns can express stays an expression that Spark folds into the query
    ours = {
        "n_words": f"INT RETURN regexp_count(text, r'{T.WORD.replace(chr(39), chr(92) + 'x27')}')",
        "folded": f"STRING RETURN replace(lower(regexp_replace(translate(text, '{T.ALEF_FORMS}{T.APOSTROPHES.replace(chr(39), '')}{T.TATWEEL}', concat(repeat('ا', {len(T.ALEF_FORMS)}), repeat(char(39), {len(T.APOSTROPHES)}))), r'{T.TASHKEEL}', '')), 'i̇', 'i')",
    }
    for name, body in ours.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION length_bucket(n INT) RETURNS STRING RETURN CASE WHEN n < 20 THEN '<20' WHEN n < 50 THEN '20-49' WHEN n < 150 THEN '50-149' WHEN n < 500 THEN '150-499' ELSE '500+' END")
