"""Media columns: MPEG audio streams.

The parser reads any MPEG-1, 2 or 2.5 stream of layer I, II or III with a stated bitrate (free format counts as no frame): it skips and reads ID3 tags (v1, v2.2 to v2.4, with
extended headers and unsynchronisation), resynchronises on frame headers (out of step, a header counts only if the next one, or the end, stands where its
length says), reads Xing, Info and VBRI tables with their seek points, verifies each protected frame's CRC-16 over what its layer covers, and returns the exact
duration (samples over rate) with the byte offset of every frame.

The writer stores a payload losslessly: silent layer III frames (48 kHz, mono, protected) whose ancillary bytes are the payload, the
last frame at the least bitrate that holds the rest, after an ID3v2 tag with the payload's length and CRC-32 and
a Xing frame with counts and a seek table; an ID3v1 tag ends the stream.

Cases: null text is stored like an empty one (64 zero bytes); equal texts give equal bytes; a null doc_id stays null; an empty table gives no
rows; other columns are ignored. A stream without any frame parses to zero frames and no payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import bounded_batches

# Fixed values of the format: kbit/s by bitrate index 1 to 14, for (MPEG-1?, layer), and sampling rates.
RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    """What four header bytes say. version: 3 MPEG-1, 2 MPEG-2, 0 MPEG-2.5. bound: the first subband that both channels share in layers I and II."""

    version: int
    layer: int
    protected: bool
    rate: int
    mono: bool
    length: int
    samples: int
    kbps: int
    bound: int

    @property
    def side(self) -> int:
        """Bytes of side information in layer III."""
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """None: these bytes begin no frame (free format counts as none)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, sampling, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or bitrate in (0, 15) or sampling == 3 or four[3] & 3 == 2:
        return None
    rate = SAMPLING[version][sampling]
    bits = RATES[version == 3, layer][bitrate - 1] * 1000
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12 * bits // rate + padding) * 4 if layer == 1 else samples // 8 * bits // rate + padding
    bound = (four[3] >> 4 & 3) * 4 + 4 if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, rate, four[3] >> 6 == 3, length, samples, bits // 1000, bound)


def _crc_table() -> list[int]:
    table = []
    for value in range(256):
        value <<= 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


CRC_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def crc16(covered: bytes) -> int:
    value = 0xFFFF
    for octet in covered:
        value = (value << 8 ^ CRC_TABLE[value >> 8 ^ octet]) & 0xFFFF
    return value


def crc16_bits(covered: bytes, bits: int) -> int:
    """The same over the first ``bits`` bits."""
    value = crc16(covered[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        bit = covered[k // 8] >> 7 - k % 8 & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if value >> 15 ^ bit else 0)
    return value


# Fixed values of the format: bits of a layer II allocation by subband, as (bits, subbands) runs: MPEG-1, its low rates, MPEG-2.
ALLOCATION = {"usual": ((4, 11), (3, 12), (2, 7)), "low": ((4, 2), (3, 10)), "half": ((4, 4), (3, 7), (2, 19))}


def allocation_bits(head: Header) -> list[int]:
    """Bits of each subband's allocation in layers I and II."""
    if head.layer == 1:
        return [4] * 32
    kbps = head.kbps // (1 if head.mono else 2)
    if head.version != 3:
        kind, bands = "half", 30
    elif kbps < 56:
        kind, bands = "low", 12 if head.rate == 32000 else 8
    else:
        kind, bands = "usual", 30 if kbps >= 96 and head.rate != 48000 else 27
    return [bits for bits, run in ALLOCATION[kind] for _ in range(run)][:bands]


def covered_bits(frame: bytes, head: Header) -> int:
    """How many bits after the CRC it covers: side information (III), allocation (I), allocation and scale factor selection (II)."""
    if head.layer == 3:
        return 8 * head.side
    channels, at, used = 1 if head.mono else 2, 48, 0
    for band, bits in enumerate(allocation_bits(head)):
        for _ in range(channels if band < head.bound else 1):
            value = int.from_bytes(frame[at // 8 : at // 8 + 2].ljust(2, b"\0"), "big") >> 16 - at % 8 - bits & (1 << bits) - 1
            used += (value > 0) * (1 if band < head.bound else channels)
            at += bits
    return at - 48 + (2 * used if head.layer == 2 else 0)


def checksum(frame: bytes, head: Header) -> int | None:
    """The CRC-16 that a protected frame should have; None if it is too short to hold what that covers."""
    bits = covered_bits(frame, head)
    if 6 + -(-bits // 8) > len(frame):
        return None
    return crc16_bits(frame[2:4] + frame[6 : 6 + -(-bits // 8)], 16 + bits)


@dataclass
class Stream:
    """A parsed stream. checked and wrong count protected frames; skipped: bytes outside frames and tags."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    rate: int = 0
    version: int = 0
    layer: int = 0
    samples: int = 0
    checked: int = 0
    wrong: int = 0
    resyncs: int = 0
    skipped: int = 0
    lengths: set[int] = field(default_factory=set)
    offsets: list[int] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    @property
    def payload(self) -> bytes:
        """The bytes that the writer stored; ValueError if they don't match the tag."""
        data = b"".join(self.parts)[: int(self.tags.get("payload_bytes", 0))]
        if len(data) != int(self.tags.get("payload_bytes", 0)) or zlib.crc32(data) != int(self.tags.get("payload_crc32", 0)):
            raise ValueError("the stored payload is damaged")
        return data


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _plain(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read the tag at ``at``; where it ends."""
    major, flags, size = data[at + 3], data[at + 5], _plain(data[at + 6 : at + 10])
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    place, wide = 0, 3 if major == 2 else 4
    if flags & 0x40 and major > 2:  # an extended header; its length counts itself in v2.4
        place = _plain(body[:4]) if major >= 4 else 4 + int.from_bytes(body[:4], "big")
    start = 6 if major == 2 else 10
    while place + start <= len(body) and body[place]:
        name = body[place : place + wide].decode("latin-1")
        length = _plain(body[place + 4 : place + 8]) if major >= 4 else int.from_bytes(body[place + wide : place + 2 * wide], "big")
        inner = body[place + start : place + start + length]
        if major >= 4 and (flags & 0x80 or body[place + 9] & 2):
            inner = inner.replace(b"\xff\0", b"\xff")
        if name[:1] == "T" and inner:
            text = inner[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(inner[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = value.rstrip("\0")
        place += start + length
    return at + 10 + size + (10 if flags & 0x10 else 0)


def _vbr_table(frame: bytes, head: Header) -> dict[str, object]:
    at = 4 + head.side + 2 * head.protected
    for place in {4 + head.side, at}:
        if frame[place : place + 4] in (b"Xing", b"Info"):
            flags, rest, found = int.from_bytes(frame[place + 4 : place + 8], "big"), place + 8, {"kind": frame[place : place + 4].decode()}
            for bit, name, length in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    raw = frame[rest : rest + length]
                    found[name] = list(raw) if name == "toc" else int.from_bytes(raw, "big")
                    rest += length
            return found
    if frame[36:40] == b"VBRI":
        entries, scale, wide = (int.from_bytes(frame[k : k + 2], "big") for k in (54, 56, 58))
        sizes = [scale * int.from_bytes(frame[62 + k * wide : 62 + k * wide + wide], "big") for k in range(entries)]
        return {
            "kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"),
            "frames_per_entry": int.from_bytes(frame[60:62], "big"), "toc": np.cumsum(sizes).tolist(),
        }
    return {}


def parse(data: bytes) -> Stream:
    """Parse a whole stream."""
    stream, at, end = Stream(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _id3v2(data, at, stream.tags)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        stream.tags.setdefault("title", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    synced, first, resyncing = False, True, False
    while at < end:
        head = header(data[at : at + 4])
        if head is not None and at + head.length <= end and (synced or at + head.length == end or header(data[at + head.length : at + head.length + 4]) is not None):
            synced, resyncing = True, False
            frame = data[at : at + head.length]
            place = 4
            if head.protected:
                place = 6
                stream.checked += 1
                stream.wrong += checksum(frame, head) != int.from_bytes(frame[4:6], "big")
            table = _vbr_table(frame, head) if first else {}
            if first:
                stream.rate, stream.version, stream.layer, first = head.rate, head.version, head.layer, False
            if table:
                stream.table = table
            else:
                stream.offsets.append(at)
                stream.samples += head.samples
                stream.lengths.add(head.length)
                stream.parts.append(frame[place + head.side :])
            at += head.length
            continue
        stream.resyncs += not resyncing
        synced, resyncing = False, True
        following = data.find(b"\xff", at + 1, end)
        following = end if following < 0 else following
        stream.skipped += following - at
        at = following
    return stream


#: Of the frames that the writer makes: 48 kHz, where a frame has 3 bytes for each kbit/s.
SIDE = 17


def _head(index: int) -> bytes:
    """Header, CRC and empty side information of a protected mono layer III frame at 48 kHz."""
    four = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(SIDE)
    return four + crc16(four[2:4] + side).to_bytes(2, "big") + side


HEADS = [_head(k) for k in range(1, 15)]
SIZES = [3 * r for r in RATES[True, 3]]
ROOM = SIZES[-1] - len(HEADS[-1])


def store(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream."""
    full, rest = divmod(len(payload), ROOM)
    frames = np.zeros((full, SIZES[-1]), dtype=np.uint8)
    frames[:, : len(HEADS[-1])] = np.frombuffer(HEADS[-1], np.uint8)
    frames[:, len(HEADS[-1]) :] = np.frombuffer(payload, np.uint8, full * ROOM).reshape(full, ROOM)
    body = frames.tobytes()
    sizes = [SIZES[-1]] * full
    if rest:
        k = next(k for k, size in enumerate(SIZES) if size - len(HEADS[k]) >= rest)
        body += (HEADS[k] + payload[full * ROOM :]).ljust(SIZES[k], b"\0")
        sizes.append(SIZES[k])
    texts = {"payload_bytes": len(payload), "payload_crc32": zlib.crc32(payload)}
    bodies = [b"\x03" + f"{name}\0{value}".encode() for name, value in texts.items()]
    inner = b"".join(b"TXXX" + _syncsafe(len(b)) + b"\0\0" + b for b in bodies)
    tag = b"ID3\x04\0\0" + _syncsafe(len(inner)) + inner
    total = SIZES[2] + len(body)
    starts = SIZES[2] + np.cumsum([0, *sizes[:-1]])
    toc = bytes(min(255, int(256 * int(starts[len(sizes) * k // 100]) // total)) for k in range(100))
    table = b"Xing" + struct.pack(">III", 15, len(sizes), total) + toc + struct.pack(">I", 100)
    lead = (HEADS[2] + table).ljust(SIZES[2], b"\0")
    return tag + lead + body + b"TAG" + b"payload".ljust(125, b"\0")


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, and those with zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


SCHEMA = (
    "doc_id long, n_bytes long, media binary, payload binary, sample_rate int, samples long, seconds double, frames int,"
    " vbr boolean, crc_wrong int, resyncs int, seek_offsets array<long>, feature string"
)


def features(stream: Stream, media: bytes) -> dict[str, object]:
    """The columns that a parsed stream gives."""
    vbr = len(stream.lengths) > 1
    seek = zlib.crc32(np.array(stream.offsets, "<i8").tobytes())
    agreed = stream.table.get("frames") == len(stream.offsets) if stream.table else None
    feature = (
        f"mpeg={stream.version};layer={stream.layer};rate={stream.rate};frames={len(stream.offsets)};samples={stream.samples};seconds={stream.seconds:.6f};"
        f"vbr={int(vbr)};table={stream.table.get('kind', 'none')}:{agreed};crc={stream.checked - stream.wrong}/{stream.checked};resyncs={stream.resyncs};seek={seek:08x}"
    )
    return {
        "sample_rate": stream.rate, "samples": stream.samples, "seconds": stream.seconds, "frames": len(stream.offsets), "vbr": vbr,
        "crc_wrong": stream.wrong, "resyncs": stream.resyncs, "seek_offsets": stream.offsets, "feature": feature,
    }


def media_columns(docs: DataFrame) -> DataFrame:
    """Store each whole text as an audio stream, read it back, and return both with the stream's features."""
    kinds = {"sample_rate": pa.int32(), "samples": pa.int64(), "seconds": pa.float64(), "frames": pa.int32(), "vbr": pa.bool_(), "crc_wrong": pa.int32(), "resyncs": pa.int32(), "seek_offsets": pa.list_(pa.int64()), "feature": pa.string()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            sizes, media, back, found = [], [], [], []
            for text in batch.column(1).to_pylist():
                size, payload = padded(text)
                data = store(payload)
                stream = parse(data)
                sizes.append(size)
                media.append(data)
                back.append(stream.payload)
                found.append(features(stream, data))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary())]
            columns += [pa.array([f[name] for f in found], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "payload", *kinds])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, SCHEMA)


def op8_mpegaudio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_columns(docs).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES = {"op8_mpegaudio": op8_mpegaudio}
