"""Media columns of MPEG audio: a container for payloads, and a reader of any such stream.

Writing: a payload becomes the ancillary data of silent MPEG-1 Layer III frames. Each frame carries a
checksum; a leading frame holds the table for variable bit rates, and a tag the payload's length and
checksum. Reading: tags and the table are parsed, frame headers are followed and found again after
foreign bytes, checksums are verified, and exact durations and the byte offset of each frame are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: kbit/s by (version is 1, layer) and index, Hz by version and index.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSION_NAME = {3: "1", 2: "2", 0: "2.5"}
OWNER = b"loomgraph.payload\0"
UNIT = 64


@dataclass(frozen=True)
class Header:
    version: int  # as coded: 3, 2 or 0
    layer: int
    crc: bool
    kbits: int
    hertz: int
    channels: int
    mode: int
    extension: int
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        return (17 if self.channels == 1 else 32) if self.version == 3 else (9 if self.channels == 1 else 17)

    def like(self, other: "Header") -> bool:
        return (self.version, self.layer, self.hertz) == (other.version, other.layer, other.hertz)


@lru_cache(maxsize=4096)
def parse_header(raw: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none (or have no fixed size)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, coded = raw[1] >> 3 & 3, raw[1] >> 1 & 3
    if version == 1 or coded == 0:
        return None
    layer, bits, rate, pad = 4 - coded, raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1
    if bits in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    kbits, hertz = KBITS[version == 3, layer][bits], HERTZ[version][rate]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12000 * kbits // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + pad
    mode = raw[3] >> 6
    return Header(version, layer, not raw[1] & 1, kbits, hertz, 1 if mode == 3 else 2, mode, raw[3] >> 4 & 3, size, samples)


def _table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        x = byte << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return tuple(out)


_CRC = _table()


@lru_cache(maxsize=8192)
def crc16(data: bytes) -> int:
    x = 0xFFFF
    for b in data:
        x = (x << 8 & 0xFFFF) ^ _CRC[x >> 8 ^ b]
    return x


def protected(head: Header, frame: bytes) -> bytes | None:
    """What the frame's checksum covers, in whole bytes; None for Layer II, whose tables aren't held here."""
    if head.layer == 3:
        return frame[2:4] + frame[6 : 6 + head.side]
    if head.layer == 1:
        bound = 4 * (head.extension + 1) if head.mode == 1 else 32
        bits = 4 * (bound * head.channels + (32 - bound)) if head.channels == 2 else 128
        return frame[2:4] + frame[6 : 6 + bits // 8]
    return None


def _frame(bits: int, crc: bool) -> bytes:
    """Header, checksum and empty side information of a mono frame at 44.1 kHz."""
    head = bytes((0xFF, 0xFA if crc else 0xFB, bits << 4, 0xC0))
    return head + (struct.pack(">H", crc16(head[2:4] + bytes(17))) if crc else b"") + bytes(17)


_FRONT = {i: _frame(i, True) for i in range(1, 15)}
_ROOM = {i: parse_header(_FRONT[i][:4]).size - len(_FRONT[i]) for i in range(1, 15)}


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data with zero bytes up to a positive multiple of unit."""
    return data + bytes(unit - len(data) % unit if len(data) % unit or not data else 0)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """A stream of frames that holds the payload; equal payloads give equal streams."""
    frames, room = [], _ROOM[14]
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        i = 14 if len(part) == room else next(i for i in range(1, 15) if _ROOM[i] >= len(part))
        frames.append(_FRONT[i] + part + bytes(_ROOM[i] - len(part)))
    first = _frame(5, False)
    size = parse_header(first[:4]).size
    sizes = [size, *map(len, frames)]
    total, ends, toc = sum(sizes), [0], bytearray()
    for n in sizes:
        ends.append(ends[-1] + n)
    for i in range(100):
        toc.append(min(255, 256 * ends[i * len(sizes) // 100] // total))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + _synchsafe(len(private)) + b"\0\0" + private
    return b"ID3\4\0\0" + _synchsafe(len(tag)) + tag + first + table + bytes(size - len(first) - len(table)) + b"".join(frames)


@dataclass
class Audio:
    """What a stream holds. offsets: of each frame but that with the table; skipped: foreign bytes."""

    version: str = ""
    layer: int = 0
    hertz: int = 0
    channels: int = 0
    frames: int = 0
    samples: int = 0
    seconds: Fraction = Fraction(0)
    offsets: list[int] = field(default_factory=list)
    tags: dict[str, bytes] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    checked: int = 0
    bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    payload: bytes | None = None


def _id3v2(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Parses a tag in front of the frames; where it ends."""
    size = lambda raw: sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0)))
    version, flags, end = data[at + 3], data[at + 5], min(len(data), at + 10 + size(data[at + 6 : at + 10]))
    x = at + 10
    if flags & 0x40:  # an extended header, whose size counts itself in version 4 only
        x += size(data[x : x + 4]) if version == 4 else 4 + int.from_bytes(data[x : x + 4], "big")
    wide = version != 2
    while x + (10 if wide else 6) <= end and data[x]:
        name = data[x : x + (4 if wide else 3)].decode("latin-1")
        n = size(data[x + 4 : x + 8]) if version == 4 else int.from_bytes(data[x + 4 : x + 8] if wide else data[x + 3 : x + 6], "big")
        x += 10 if wide else 6
        tags[name] = data[x : min(end, x + n)]
        x += n
    return end + 10 * bool(flags & 0x10)


def _vbr_table(head: Header, frame: bytes, out: Audio) -> bool:
    at = 4 + 2 * head.crc + head.side
    name = frame[at : at + 4]
    if name in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            out.table_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 2:
            out.table_bytes, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out.toc = frame[at : at + 100]
    elif frame[36:40] == b"VBRI" and len(frame) >= 62:
        name = b"VBRI"
        out.table_bytes, out.table_frames, n, _, width = struct.unpack(">IIHHH", frame[46:60])
        out.toc = frame[62 : 62 + n * width]
    else:
        return False
    out.table = name.decode()
    return True


def read(data: bytes) -> Audio:
    """Parses any stream of MPEG audio frames; a payload comes back if encode() wrote the stream.

    Bytes that belong to no tag and no frame are skipped until a header that the next one, or the end,
    confirms. A frame cut off by the end counts as foreign bytes. Empty data give an Audio without frames.
    The word TAG starts a tag of 128 bytes at the end, unless it stands in a frame and the frames go on to
    the end, so that it belongs to their payload.
    """
    tag = len(data) - 128
    if tag < 0 or data[tag : tag + 3] != b"TAG":
        return _read(data, len(data))[0]
    out, frames = _read(data, len(data))
    inside = any(at < tag < to for at, to in frames) and frames[-1][1] == len(data)
    return out if inside else _read(data, tag)[0]


def _read(data: bytes, end: int) -> tuple[Audio, list[tuple[int, int]]]:
    """What read() gives if a tag begins at end, or if there is none and the data end there; where each frame begins and ends."""
    out, at, frames = Audio(), 0, []
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _id3v2(data, at, out.tags)
    if end < len(data):
        if at <= end:
            out.tags["TAG"] = data[end:]
        else:
            end = len(data)
    first: Header | None = None
    synced, bodies, seen = True, [], False
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        good = head and at + head.size <= end and (first is None or head.like(first))
        if good and (not synced or first is None) and at + head.size + 4 <= end:
            after = parse_header(data[at + head.size : at + head.size + 4])
            good = after is not None and after.like(head)
        if not good:
            out.resyncs += synced
            synced, found = False, data.find(b"\xff", at + 1, end)
            out.skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        synced = True
        frame = data[at : at + head.size]
        frames.append((at, at + head.size))
        if first is None:
            first = head
        if not seen and head.layer == 3 and _vbr_table(head, frame, out):
            seen = True
        else:
            seen = True
            if head.crc and (over := protected(head, frame)) is not None:
                out.checked += 1
                out.bad += crc16(over) != int.from_bytes(frame[4:6], "big")
            out.offsets.append(at)
            out.samples += head.samples
            bodies.append(frame[4 + 2 * head.crc + (head.side if head.layer == 3 else 0) :])
        at += head.size
    if at < end:
        out.skipped += end - at
    out.frames = len(out.offsets)
    if first:
        out.version, out.layer, out.hertz, out.channels = VERSION_NAME[first.version], first.layer, first.hertz, first.channels
        out.seconds = Fraction(out.samples, first.hertz)
    private = out.tags.get("PRIV", b"")
    if private.startswith(OWNER) and len(private) == len(OWNER) + 12:
        n, crc = struct.unpack(">QI", private[len(OWNER) :])
        payload = b"".join(bodies)[:n]
        if len(payload) == n and zlib.crc32(payload) == crc:
            out.payload = payload
    return out, frames


def feature(a: Audio) -> str:
    """The stream's properties in one line; the duration is exact, in samples by the rate."""
    seek = hashlib.md5(b",".join(b"%d" % x for x in a.offsets)).hexdigest()
    return f"mpeg={a.version};layer={a.layer};hertz={a.hertz};channels={a.channels};frames={a.frames};duration={a.samples}/{a.hertz};table={a.table}:{a.table_frames}:{a.table_bytes};checked={a.checked};bad={a.bad};resyncs={a.resyncs};skipped={a.skipped};seek={seek}"


def _parts(batch: pa.RecordBatch, most: int = 16_000_000):
    """Slices of a batch whose binary column has at most so many bytes, or one row."""
    start, held = 0, 0
    for i, v in enumerate(batch.column(1)):
        n = len(v.as_buffer()) if v.is_valid else 0
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def with_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded to a positive multiple of 64, as a stream.

    Null texts are empty. Null ids stay null, repeated rows repeat, an empty table gives no rows, other
    columns aren't looked at. Very long texts are stored as a whole; a stream is about 1.03 times its
    text, and Spark holds up to 2 GB in a value, so a text of more than 1.9 GB fails with Spark's error.
    """

    def store(batches):
        for whole in batches:
            for batch in _parts(whole):
                raw = [v.as_py() or b"" for v in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array((encode(padded(x)) for x in raw), pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek_offsets array<long>"


def audio_features(media: DataFrame) -> DataFrame:
    """Reads the media column back; one row for each of its rows, with SCHEMA behind doc_id.

    A stream without a whole payload has null in the three payload columns. Null streams are empty ones;
    equal streams have equal values; an empty table gives no rows.
    """

    def load(batches):
        for whole in batches:
            for batch in _parts(whole):
                rows = []
                for v in batch.column(1):
                    data = v.as_py() or b""
                    a = read(data)
                    p = a.payload
                    rows.append((None, None, None) if p is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:])))
                    rows[-1] += (len(data), hashlib.sha256(data).hexdigest(), feature(a), a.offsets)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media", "n_bytes").mapInArrow(load, f"doc_id {kind}, {SCHEMA}")
