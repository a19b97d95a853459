"""Media columns: MPEG audio.

The writer stores bytes losslessly in a variable-bitrate Layer III stream: an ID3v2 tag with the length, a frame with
the variable-bitrate table, then frames whose side information says that they hold no audio and whose remaining bytes,
which decoders skip as ancillary data, are the payload. Each frame has its checksum. The reader takes any MPEG audio
stream, free format included: it parses tags (ID3v2 at either end, ID3v1) and variable-bitrate tables (Xing, Info,
VBRI), finds frame headers again after damage, verifies checksums, and gives the exact duration and the byte offset of
every frame.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunspan.llm._arrow import add_columns, texts

UNIT = 64
# Fixed values of the MPEG audio format: kbit/s by index, and samples a second by index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)
OWNER = b"sunspan.payload\0"


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


CRC = _crc_table()


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ CRC[(crc >> 8) ^ b]
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 3 for 2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    joint: bool
    bound: int
    length: int
    samples: int
    side: int  # bytes of side information, Layer III only


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none, or of free format."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 3, 2: 2, 3: 1}.get(word[1] >> 3 & 3)
    layer = 4 - (word[1] >> 1 & 3)
    index, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    kbit = BITRATES[min(version, 2), layer][index]
    hz = SAMPLE_RATES[rate] >> (version - 1)
    pad, mode = word[2] >> 1 & 1, word[3] >> 6
    if layer == 1:
        length, samples = (12000 * kbit // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version > 1 else 1152
        length = samples * 125 * kbit // hz + pad
    mono = mode == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, not word[1] & 1, kbit, hz, mono, mode == 1, 4 * ((word[3] >> 4 & 3) + 1), length, samples, side)


@lru_cache(maxsize=32)
def _head(index: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information of a mono frame at 48 kHz, and the bytes that are left in it."""
    word = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    start = word + struct.pack(">H", crc16(word[2:] + side)) + side
    return start, header(word).length - len(start)


TOP = 14


@lru_cache(maxsize=1024)
def _smallest(n: int) -> int:
    return next(i for i in range(1, TOP + 1) if _head(i)[1] >= n)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write(data: bytes) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of 64, as a stream."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    payload = data.ljust(size, b"\0")
    start, room = _head(TOP)
    frames = [start + payload[at : at + room] for at in range(0, size - room + 1, room)]
    at = len(frames) * room
    if at < size:
        last, left = _head(_smallest(size - at))
        frames.append(last + payload[at:].ljust(left, b"\0"))
    private = OWNER + struct.pack(">QQ", len(data), size)
    body = b"PRIV" + struct.pack(">IH", len(private), 0) + private
    tag = b"ID3\x03\x00\x00" + _syncsafe(len(body)) + body
    head, left = _head(9)
    total = sum(map(len, frames)) + len(head) + left
    ends = np.cumsum([len(head) + left, *map(len, frames)])
    toc = bytes(min(255, int(256 * (ends[(len(ends) - 1) * i // 100 - 1] if (len(ends) - 1) * i // 100 else 0) / total)) for i in range(100))
    table = head + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return tag + table.ljust(len(head) + left, b"\0") + b"".join(frames)


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of the audio frames
    samples: int = 0
    rate: int = 0
    kbits: set[int] = field(default_factory=set)
    checked: int = 0
    bad: int = 0
    skipped: int = 0  # bytes that belong to nothing
    tag_bytes: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str | None = None  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: list[int] = field(default_factory=list)  # the table's places in the stream, in bytes from its frame on
    payload: bytes | None = None
    length: int | None = None  # of the payload, as stored
    missing: int | None = None  # bytes that the payload is shorter than was stored

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _unsyncsafe(b: bytes) -> int:
    return sum((x & 0x7F) << s for x, s in zip(b, (21, 14, 7, 0), strict=True))


def _text(b: bytes) -> str:
    """A text of an ID3v2 frame: a byte for its encoding, then the text up to a zero."""
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0] if b else 0, "latin-1")
    return b[1:].decode(code, "replace").split("\0")[0]


def _parse_id3v2(tag: bytes, out: Stream) -> None:
    """Text frames and the payload's length from a whole ID3v2 tag; frames that do not fit end it."""
    version, flags, body = tag[3], tag[5], tag[10:]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at, wide = 0, version > 2
    if flags & 0x40 and wide and len(body) >= 4:  # an extended header
        at = _unsyncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    head = 10 if wide else 6
    while at + head <= len(body) and body[at] != 0:
        name = body[at : at + (4 if wide else 3)]
        size = body[at + len(name) : at + 2 * len(name)]
        size = _unsyncsafe(size) if version == 4 else int.from_bytes(size, "big")
        data = body[at + head : at + head + size]
        if not name.isalnum() or len(data) < size:
            return
        if name[:1] == b"T" and name not in (b"TXXX", b"TXX"):
            out.tags.setdefault(name.decode(), _text(data))
        elif name == b"PRIV" and data.startswith(OWNER) and len(data) >= len(OWNER) + 16:
            out.length = struct.unpack_from(">QQ", data, len(OWNER))[1]
        at += head + size


def _parse_id3v1(tag: bytes, out: Stream) -> None:
    clean = lambda b: b.split(b"\0")[0].decode("latin-1").rstrip()
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97), ("COMM", 97, 127)):
        if clean(tag[a:b]):
            out.tags.setdefault(name, clean(tag[a:b]))
    if tag[125] == 0 and tag[126]:
        out.tags.setdefault("TRCK", str(tag[126]))


def _table(data: bytes, at: int, h: Header, body: int, out: Stream) -> bool:
    """Whether the first frame holds a variable-bitrate table, which is then parsed."""
    end = at + h.length
    if data[body : body + 4] in (b"Xing", b"Info") and body + 8 <= end:
        out.table, flags, p = data[body : body + 4].decode(), int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
        if flags & 1:
            out.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4 and out.table_bytes is not None:
            out.seek = [x * out.table_bytes // 256 for x in data[p : min(p + 100, end)]]
        return True
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= end:
        out.table = "VBRI"
        _, _, _, out.table_bytes, out.table_frames, entries, scale, width, _ = struct.unpack_from(">HHHIIHHHH", data, p + 4)
        if 1 <= width <= 4:
            sizes = [int.from_bytes(data[p + 26 + i * width : p + 26 + (i + 1) * width], "big") * scale for i in range(min(entries, (end - p - 26) // width))]
            out.seek = np.cumsum(sizes).tolist()
        return True
    return False


#: Bytes in which the next frame of a stream of free format is looked for.
FREE = 8192


def _free(data: bytes, at: int, end: int) -> Header | None:
    """The header of a frame of free format: its length is the distance to the next header of the same kind."""
    word = data[at : at + 4]
    if len(word) < 4 or word[0] != 0xFF or word[2] >> 4:
        return None
    like = header(word[:2] + bytes([word[2] | 0x10]) + word[3:])  # the same with a bitrate
    if like is None:
        return None
    same = lambda p: data[p : p + 2] == word[:2] and p + 3 < end and data[p + 2] & 0xFD == word[2] & 0xFD
    low, p = at + 4 + like.side, data.find(word[:2], at + 4 + like.side, min(end, at + FREE))
    while p >= low:
        size = p - at
        pad = (word[2] >> 1 & 1) * (4 if like.layer == 1 else 1)
        after = p + size - pad + (data[p + 2] >> 1 & 1 if p + 2 < end else 0) * (4 if like.layer == 1 else 1)
        if same(p) and (after == end or same(after)):
            return replace(like, length=size, bitrate=(size - pad) * like.rate // (125 * like.samples))
        p = data.find(word[:2], p + 1, min(end, at + FREE))
    return None


def _checksum_ok(data: bytes, at: int, h: Header) -> bool | None:
    """None for Layer II, whose checksum covers a part that only decoding finds."""
    if h.layer == 2:
        return None
    if h.layer == 3:
        covered = data[at + 6 : at + 6 + h.side]
    else:
        bits = 128 if h.mono else 4 * (32 + (h.bound if h.joint else 32))
        covered = data[at + 6 : at + 6 + bits // 8]
    return crc16(data[at + 2 : at + 4] + covered) == int.from_bytes(data[at + 4 : at + 6], "big")


def read(data: bytes) -> Stream:
    """What a stream holds. Bytes that are no frame are skipped up to a header that another one, or the end, follows.

    A tag at the end counts only where no frame reaches over it: audio or payload may hold its three letters.
    """
    out, at, end = Stream(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = 10 + _unsyncsafe(data[at + 6 : at + 10])
        _parse_id3v2(data[at : at + size], out)
        size += 10 if data[at + 5] & 0x10 else 0  # a footer
        out.tag_bytes += min(size, end - at)
        at += size
    tags = {}  # where a tag at the end begins, and its length
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags[end - 128] = 128
    last = min(tags, default=end)
    if last - at >= 20 and data[last - 10 : last - 7] == b"3DI" and (size := 20 + _unsyncsafe(data[last - 4 : last])) <= last - at and data[last - size : last - size + 3] == b"ID3":
        tags[last - size] = size
    pieces, good, first, free = [], False, True, None
    while at < end:
        if at in tags:
            size = tags[at]
            (_parse_id3v1 if size == 128 and data[at : at + 3] == b"TAG" else _parse_id3v2)(data[at : at + size], out)
            out.tag_bytes += size
            at += size
            continue
        h = header(data[at : at + 4])
        if h is None and data[at] == 0xFF:
            h = _free(data, at, end)
            if h is None and free is not None and data[at : at + 2] == free[0] and at + free[1].length in (end, *tags):
                h = free[1]  # the last frame of a stream of free format
            free = (data[at : at + 2], h) if h else free
        after = at + h.length if h else 0
        over = any(at < t < after for t in tags)  # a frame over what may be a tag says itself that it is none
        if h and after <= end and ((good and not over) or after == end or after in tags or header(data[after : after + 4]) or (free and data[after : after + 2] == free[0])):
            good = True
            extra = 2 if h.protected else 0
            body = at + 4 + extra + h.side
            if not (first and h.layer == 3 and _table(data, at, h, body, out)):
                out.offsets.append(at)
                out.samples += h.samples
                out.rate = out.rate or h.rate
                out.kbits.add(h.bitrate)
                if out.length is not None and h.layer == 3:
                    pieces.append(data[body : at + h.length])
            first = False
            if h.protected and (ok := _checksum_ok(data, at, h)) is not None:
                out.checked += 1
                out.bad += not ok
            at += h.length
            continue
        good = False
        nxt = data.find(b"\xff", at + 1, end)
        nxt = min([nxt if nxt >= 0 else end, *(t for t in tags if t > at)])
        out.skipped += nxt - at
        at = nxt
    if out.length is not None:
        out.payload = b"".join(pieces)[: out.length]
        out.missing = out.length - len(out.payload)
    return out


def store_text(df: DataFrame, text_col: str, media_col: str = "media", bytes_col: str = "n_bytes") -> DataFrame:
    """``df`` without its text, with the stream that stores it (UTF-8) and its length in bytes; null is empty.

    An empty text is a payload of 64 bytes 0. Each row has a stream of its own whatever its length; equal texts give
    equal streams; columns of these two names are replaced; an empty table stays empty.
    """

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data = [t.encode("utf-8", "surrogatepass") for t in texts(batch, text_col)]
        return {media_col: pa.array(map(write, data), pa.binary()), bytes_col: pa.array(map(len, data), pa.int64())}

    fields = [T.StructField(media_col, T.BinaryType()), T.StructField(bytes_col, T.LongType())]
    return add_columns(df, fn, fields, [text_col], drop=(text_col,))


FIELDS = [
    T.StructField("payload", T.BinaryType()),
    T.StructField("payload_missing", T.LongType()),
    T.StructField("samples", T.LongType()),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("frame_offsets", T.ArrayType(T.LongType())),
    T.StructField("crc_checked", T.IntegerType()),
    T.StructField("crc_bad", T.IntegerType()),
    T.StructField("skipped_bytes", T.LongType()),
    T.StructField("tag_bytes", T.LongType()),
    T.StructField("table_frames", T.LongType()),
    T.StructField("table_bytes", T.LongType()),
    T.StructField("table_seek", T.ArrayType(T.LongType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
]


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with what each stream holds (the columns in FIELDS, which replace input columns of these names).

    payload is null unless the stream was made by store_text(); a null or empty stream has no frames and duration 0.
    Damage never raises here: frames that cannot be found count as skipped bytes, wrong checksums as crc_bad, and what
    the payload lacks of its stored size as payload_missing; whole_payload() raises where that is more than 0. tags
    holds the text frames by their ID3v2 names, the first of equal ones. Rows are read one by one, whatever their
    length, so repeated rows get equal values; other columns pass through; an empty table stays empty.
    """

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        s = [read(x or b"") for x in batch.column(media_col).to_pylist()]
        return {
            "payload": pa.array([x.payload for x in s], pa.binary()),
            "payload_missing": pa.array([x.missing for x in s], pa.int64()),
            "samples": pa.array([x.samples for x in s], pa.int64()),
            "sample_rate": pa.array([x.rate for x in s], pa.int32()),
            "duration_s": pa.array([x.seconds for x in s], pa.float64()),
            "frame_offsets": pa.array([x.offsets for x in s], pa.list_(pa.int64())),
            "crc_checked": pa.array([x.checked for x in s], pa.int32()),
            "crc_bad": pa.array([x.bad for x in s], pa.int32()),
            "skipped_bytes": pa.array([x.skipped for x in s], pa.int64()),
            "tag_bytes": pa.array([x.tag_bytes for x in s], pa.int64()),
            "table_frames": pa.array([x.table_frames for x in s], pa.int64()),
            "table_bytes": pa.array([x.table_bytes for x in s], pa.int64()),
            "table_seek": pa.array([x.seek for x in s], pa.list_(pa.int64())),
            "tags": pa.array([list(x.tags.items()) for x in s], pa.map_(pa.string(), pa.string())),
        }

    return add_columns(df, fn, FIELDS, [media_col])


def whole_payload() -> Column:
    """The payload of read_media(); an error where it is shorter than was stored."""
    return F.when(F.col("payload_missing") > 0, F.raise_error("payload is shorter than its stored size").cast("binary")).otherwise(F.col("payload"))
