"""MPEG audio columns: frames, tags, tables, checksums, exact durations and seek offsets.

Reading resynchronises: a header counts where the next frame follows (or the stream ends) and its CRC, if it has
one, agrees; anything between frames is skipped and counted. ID3v2 and ID3v1 tags and the Xing/Info and VBRI
tables are parsed; a table's frame count is checked against the frames that are there. The duration is the sum of
the frames' samples over the sample rate, in exact microseconds (rounded down), and every frame's offset is known.

Writing stores any payload losslessly as a playable stream: an ID3v2 tag with the payload's length, an Info
frame with the counts and the seek table, then MPEG-1 layer III frames with CRC whose side information says
"no main data" (silence), so that the rest of each frame is ancillary data, which holds the payload. Long payloads
use the largest frame; the last frame is the smallest one that holds the rest, zero-filled.

Cases: null text is empty text, which is stored as 64 zero bytes; equal payloads give equal streams; a null media
column gives null features; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

# Fixed values of the MPEG audio formats (ISO/IEC 11172-3, 13818-3): kbit/s by version, layer and index; Hz by version.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}

HEADER, CRC, SIDE = 4, 2, 17
#: Where the payload starts in a frame that this module writes (mono).
BODY = HEADER + CRC + SIDE
PAD = 64


def _crc_table() -> list[int]:
    """CRC-16 with the polynomial 0x8005, highest bit first, as MPEG audio has it."""
    out = []
    for crc in range(256):
        crc <<= 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


CRC_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for x in data:
        crc = crc << 8 & 0xFFFF ^ CRC_TABLE[crc >> 8 ^ x]
    return crc


class Frame:
    """What a header says: version (1, 2, 2.5), layer, sample rate, samples, length in bytes, side information's size."""

    __slots__ = ("version", "layer", "kbits", "rate", "channels", "samples", "length", "protected", "side")

    def __init__(self, v: int, layer: int, bits: int, rate: int, padding: int, protected: bool, channels: int) -> None:
        low = v != 3
        self.version, self.layer, self.rate, self.protected, self.channels = {0: 2.5, 2: 2, 3: 1}[v], layer, rate, protected, channels
        self.kbits = KBITS[2 if low else 1, layer][bits]
        self.samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
        self.length = (12 * self.kbits * 1000 // rate + padding) * 4 if layer == 1 else self.samples // 8 * self.kbits * 1000 // rate + padding
        self.side = 0 if layer != 3 else (9 if channels == 1 else 17) if low else (17 if channels == 1 else 32)


_HEADERS: dict[bytes, Frame | None] = {}


def header(four: bytes) -> Frame | None:
    """The frame that these four bytes announce, or None. Free-format and reserved values are not frames."""
    if four not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[four] = _header(four)
    return _HEADERS[four]


def _header(four: bytes) -> Frame | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    v, layer, bits, rate = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if v == 1 or layer == 4 or bits in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    return Frame(v, layer, bits, RATES[v][rate], four[2] >> 1 & 1, not four[1] & 1, 1 if four[3] >> 6 == 3 else 2)


def _crc_agrees(data: bytes, at: int, frame: Frame) -> bool | None:
    """None where the CRC's extent isn't known from the header alone (layers I and II) or there is none."""
    if not frame.protected or frame.layer != 3 or at + HEADER + CRC + frame.side > len(data):
        return None
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + frame.side]
    return crc16(covered) == int.from_bytes(data[at + 4 : at + 6], "big")


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def parse_tag(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag at the start, and the tag's length."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 0x80 for x in data[6:10]):
        return {}, 0
    end, major, at, out = min(len(data), 10 + _synchsafe(data[6:10])), data[3], 10, {}
    if data[5] & 0x40 and len(data) >= 14:
        at += _synchsafe(data[10:14]) if major == 4 else 4 + int.from_bytes(data[10:14], "big")
    while at + 10 <= end and data[at] and major >= 3:
        size = _synchsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            out[name] = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").rstrip("\0")
        at += 10 + size
    return out, end


def parse_table(frame: bytes, side: int, protected: bool) -> dict | None:
    """The variable-bitrate table in a first frame: kind, frames, bytes, toc (100 steps for Xing/Info, the entries for VBRI)."""
    for at in {HEADER + side, HEADER + CRC * protected + side}:
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "toc": []}
            for bit, field in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[field] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        number = lambda a, n: int.from_bytes(frame[a : a + n], "big")
        entries, scale, width = number(54, 2), number(56, 2), number(58, 2)
        toc = [number(62 + i * width, width) * scale for i in range(entries) if 62 + (i + 1) * width <= len(frame)] if width else []
        return {"kind": "VBRI", "bytes": number(46, 4), "frames": number(50, 4), "toc": toc}
    return None


def parse(data: bytes) -> dict:
    """All that is known of a stream: offsets and lengths of frames, tags, table, checks, duration, bytes skipped."""
    tags, at = parse_tag(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) - 128 >= at else len(data)
    out = {"tags": tags, "id3v1": end < len(data), "table": None, "offsets": [], "frames": [], "bad_crc": 0, "checked": 0, "resyncs": 0, "skipped": 0, "micros": 0}
    synced, ticks, first = False, {}, True
    while at < end:
        frame = header(data[at : at + 4])
        good = frame is not None and at + frame.length <= end
        crc = _crc_agrees(data, at, frame) if good else None
        if good and not synced:  # after a gap, a frame is believed if the next one follows and its own CRC doesn't object
            after = at + frame.length
            good = crc is not False and (after == end or header(data[after : after + 4]) is not None)
        if not good:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out["skipped"] += found - at
            out["resyncs"] += synced
            synced, at = False, found
            continue
        synced = True
        table = parse_table(data[at : at + frame.length], frame.side, frame.protected) if first else None
        first = False
        if crc is not None:
            out["checked"] += 1
            out["bad_crc"] += not crc
        if table:
            out["table"] = table | {"offset": at, "length": frame.length}
        else:
            out["offsets"].append(at)
            out["frames"].append(frame)
            ticks[frame.rate] = ticks.get(frame.rate, 0) + frame.samples
        at += frame.length
    out["micros"] = sum(n * 1_000_000 // rate for rate, n in ticks.items())
    return out


def seek(parsed: dict, micros: int) -> int | None:
    """The offset of the frame that plays at a time."""
    t = 0
    for at, f in zip(parsed["offsets"], parsed["frames"], strict=True):
        t += f.samples * 1_000_000 / f.rate
        if micros < t:
            return at
    return None


def _head(bits: int) -> bytes:
    """MPEG-1 layer III, CRC, 32 kHz, mono, no padding."""
    return bytes((0xFF, 0xFA, bits << 4 | 2 << 2, 0xC0))


_SIZES = {b: _header(_head(b)).length for b in range(1, 15)}
_FULL = _SIZES[14] - BODY
_START = {}
for _b in _SIZES:
    _START[_b] = _head(_b) + crc16(_head(_b)[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


def write(payload: bytes) -> bytes:
    """A stream that holds the payload."""
    length = str(len(payload)).encode()
    text = b"\x00" + b"payload_bytes\x00" + length
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = len(tag)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tag
    full, rest = divmod(len(payload), _FULL)
    parts = [_START[14] + payload[i * _FULL : (i + 1) * _FULL] for i in range(full)]
    if rest:
        bits = next(b for b in _SIZES if _SIZES[b] - BODY >= rest)
        parts.append((_START[bits] + payload[full * _FULL :]).ljust(_SIZES[bits], b"\0"))
    body = b"".join(parts)
    info_bits = 6  # the first size that holds the table
    total = _SIZES[info_bits] + len(body)
    starts = [_SIZES[info_bits] + i * _SIZES[14] for i in range(len(parts))] or [0]
    toc = bytes(min(255, starts[min(len(starts) - 1, k * len(starts) // 100)] * 256 // total) for k in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + len(parts).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return tag + (_START[info_bits] + info).ljust(_SIZES[info_bits], b"\0") + body


def payload_of(data: bytes, parsed: dict) -> bytes:
    """The payload of a stream that write() made, read back from its frames."""
    found = b"".join([data[at + BODY : at + f.length] for at, f in zip(parsed["offsets"], parsed["frames"], strict=True)])
    return found[: int(parsed["tags"]["TXXX"].partition("\0")[2])]


def feature(parsed: dict) -> str:
    """The digest of what was parsed: counts, checks, duration, the seek offsets' hash."""
    f, t = parsed["frames"], parsed["table"]
    offsets = hashlib.sha256(",".join(map(str, parsed["offsets"])).encode()).hexdigest()[:16]
    return (
        f"frames={len(f)};micros={parsed['micros']};rate={f[0].rate if f else 0};kbits={min((x.kbits for x in f), default=0)}-{max((x.kbits for x in f), default=0)}"
        f";crc={parsed['checked'] - parsed['bad_crc']}/{parsed['checked']};table={t['kind'] if t else '-'}:{t['frames'] if t else '-'};resyncs={parsed['resyncs']};skipped={parsed['skipped']};offsets={offsets}"
    )


STORE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_micros long, frame_offsets array<long>"
PARSE_SCHEMA = "frames long, micros long, sample_rate int, vbr_table string, table_frames long, checked long, bad_crc long, resyncs long, skipped long, offsets array<long>, tags map<string,string>"


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text stored as a stream, read back and parsed; with keep_media=True also the stream (media binary)."""
    schema = STORE_SCHEMA + ", media binary" * keep_media
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), *([pa.binary()] if keep_media else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_py() or b""
                media = write(raw + bytes(-len(raw) % PAD if raw else PAD))
                parsed = parse(media)
                back = payload_of(media, parsed)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(parsed), parsed["micros"], parsed["offsets"], media)[: len(types)])
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("_bytes")).mapInArrow(run, schema)


def media_columns(df: DataFrame, key: str, media: str) -> DataFrame:
    """The parsed columns of a column of MPEG audio streams, with the key's column before them."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = parse(m) if m is not None else None
                t = p and p["table"] or {}
                rows.append({key: k} | ({} if p is None else {"frames": len(p["frames"]), "micros": p["micros"], "sample_rate": p["frames"][0].rate if p["frames"] else None, "vbr_table": t.get("kind"), "table_frames": t.get("frames"), "checked": p["checked"], "bad_crc": p["bad_crc"], "resyncs": p["resyncs"], "skipped": p["skipped"], "offsets": p["offsets"], "tags": list(p["tags"].items())}))
            schema = pa.schema([pa.field(key, batch.schema.field(0).type), pa.field("frames", pa.int64()), pa.field("micros", pa.int64()), pa.field("sample_rate", pa.int32()), pa.field("vbr_table", pa.string()), pa.field("table_frames", pa.int64()), *(pa.field(n, pa.int64()) for n in ("checked", "bad_crc", "resyncs", "skipped")), pa.field("offsets", pa.list_(pa.int64())), pa.field("tags", pa.map_(pa.string(), pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select(key, media).mapInArrow(run, f"{key} {kind}, {PARSE_SCHEMA}")


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
