import hashlib
import random
import zlib

import pytest

from nearfold.llm import mpegaudio as m

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [0, 1, 64, 73, 74, 936, 937, 938, 1874, 5000, 100_000])
def test_round_trip(size):
    rng = random.Random(size)
    payload = rng.randbytes(size)
    data = m.store(payload)
    stream = m.parse(data)
    assert stream.payload == payload
    assert stream.wrong == 0 and stream.resyncs == 0 and stream.skipped == 0
    assert stream.table["frames"] == len(stream.offsets) and stream.table["bytes"] == len(data) - 128 - (data.find(b"\xff\xfa"))
    assert stream.samples == 1152 * len(stream.offsets) and stream.seconds == stream.samples / 48000
    assert stream.checked == len(stream.offsets) + 1
    assert stream.tags["title"] == "payload" and len(stream.table["toc"]) == 100
    for at in stream.offsets:
        assert m.header(data[at : at + 4]).rate == 48000


def test_resynchronises_and_sees_damage():
    payload = bytes(range(256)) * 40
    data = m.store(payload)
    start = m.parse(data).offsets[3]
    cut = data[:start] + b"\xff\xfb junk \xff" * 3 + data[start:]
    stream = m.parse(cut)
    assert stream.resyncs >= 1 and stream.skipped == 27 and stream.payload == payload
    broken = bytearray(data)
    broken[start + 8] ^= 1
    assert m.parse(bytes(broken)).wrong == 1
    broken = bytearray(data)
    broken[start + 300] ^= 1
    with pytest.raises(ValueError):
        _ = m.parse(bytes(broken)).payload
    assert m.parse(b"").offsets == [] and m.parse(b"no audio at all" * 50).offsets == []


def test_headers():
    assert m.header(bytes([0xFF, 0xFB, 0x90, 0x00])) == m.Header(3, 3, False, 44100, False, 417, 1152, 128, 32)
    assert m.header(bytes([0xFF, 0xFB, 0x92, 0xC0])).length == 418
    assert m.header(bytes([0xFF, 0xFD, 0xA4, 0x00])) == m.Header(3, 2, False, 48000, False, 576, 1152, 192, 32)
    assert m.header(bytes([0xFF, 0xFF, 0x98, 0x00])) == m.Header(3, 1, False, 32000, False, 432, 384, 288, 32)
    assert m.header(bytes([0xFF, 0xF3, 0x80, 0xC0])) == m.Header(2, 3, False, 22050, True, 208, 576, 64, 32)
    assert m.header(bytes([0xFF, 0xE2, 0x84, 0x00])) == m.Header(0, 3, True, 12000, False, 384, 576, 64, 32)
    for bad in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xfe\xfb\x90\x00", b"\xff\xfb", b"\xff\xfb\x90\x02"):
        assert m.header(bad) is None


def test_layer_two_stream_and_old_tags():
    frame = bytes([0xFF, 0xFD, 0xA4, 0x00]) + bytes(572)
    tag = b"ID3\x03\0\0" + m._syncsafe(10 + 6) + b"TIT2" + (6).to_bytes(4, "big") + b"\0\0\0Title"
    stream = m.parse(tag + frame * 5)
    assert stream.tags["TIT2"] == "Title" and stream.layer == 2 and stream.samples == 5 * 1152 and stream.offsets == [26 + 576 * k for k in range(5)]
    # The checksum's definition: the remainder of the polynomial division, from all ones.
    value = 0xFFFF
    for bit in "".join(f"{b:08b}" for b in b"123456789"):
        value = (value << 1 & 0xFFFF) ^ (0x8005 if (value >> 15) ^ int(bit) else 0)
    assert m.crc16(b"123456789") == value


def bits_of(*fields):
    """(value, width) fields as bytes."""
    text = "".join(f"{value:0{width}b}" for value, width in fields)
    return text, int(text.ljust(-(-len(text) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(text) // 8), "big")


def divided(bits):
    value = 0xFFFF
    for bit in bits:
        value = (value << 1 & 0xFFFF) ^ (0x8005 if (value >> 15) ^ int(bit) else 0)
    return value


@pytest.mark.parametrize(
    "four,widths,channels,bound",
    [
        (bytes([0xFF, 0xFE, 0x64, 0xC0]), [4] * 32, 1, 32),  # layer I, mono
        (bytes([0xFF, 0xFE, 0x64, 0x00]), [4] * 32, 2, 32),  # stereo
        (bytes([0xFF, 0xFE, 0x64, 0x50]), [4] * 32, 2, 8),  # joint stereo, shared from subband 8 on
        (bytes([0xFF, 0xFC, 0xA4, 0x00]), [4] * 11 + [3] * 12 + [2] * 4, 2, 32),  # layer II, 96 kbit/s a channel at 48 kHz
        (bytes([0xFF, 0xFC, 0xA0, 0x60]), [4] * 11 + [3] * 12 + [2] * 7, 2, 12),  # at 44.1 kHz, joint
        (bytes([0xFF, 0xFC, 0x28, 0xC0]), [4] * 2 + [3] * 10, 1, 32),  # 48 kbit/s at 32 kHz
        (bytes([0xFF, 0xFC, 0x24, 0xC0]), [4] * 2 + [3] * 6, 1, 32),  # and at 48 kHz
        (bytes([0xFF, 0xF4, 0x84, 0x00]), [4] * 4 + [3] * 7 + [2] * 19, 2, 32),  # MPEG-2
    ],
)
def test_checksums_of_layers_one_and_two(four, widths, channels, bound):
    rng = random.Random(sum(four))
    head = m.header(four)
    fields, used = [], 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            value = rng.choice([0, rng.randrange(1 << width)])
            fields.append((value, width))
            used += (value > 0) * (1 if band < bound else channels)
    fields += [(rng.randrange(4), 2) for _ in range(used if head.layer == 2 else 0)]
    text, body = bits_of(*fields)
    crc = divided("".join(f"{b:08b}" for b in four[2:4]) + text)
    frame = (four + crc.to_bytes(2, "big") + body + rng.randbytes(3)).ljust(head.length, b"\x55")
    stream = m.parse(frame * 3)
    assert (stream.checked, stream.wrong, len(stream.offsets)) == (3, 0, 3)
    broken = bytearray(frame * 3)
    broken[head.length + 7] ^= 0x10
    assert m.parse(bytes(broken)).wrong == 1


def test_tags_of_other_versions_and_seek_tables():
    frame = bytes([0xFF, 0xFD, 0xA4, 0x00]) + bytes(572)
    old = b"TT2" + (5).to_bytes(3, "big") + b"\0Name" + b"TXX" + (8).to_bytes(3, "big") + b"\0key\0val"
    assert m.parse(b"ID3\x02\0\0" + m._syncsafe(len(old)) + old + frame * 2).tags == {"TT2": "Name", "key": "val"}
    body = b"TIT2" + (3).to_bytes(4, "big") + b"\0\0\0\xff\xe0"
    spread = body.replace(b"\xff", b"\xff\0")
    assert m.parse(b"ID3\x03\0\x80" + m._syncsafe(len(spread)) + spread + frame * 2).tags == {"TIT2": "\xff\xe0"}
    extended = (6).to_bytes(4, "big") + bytes(6) + body
    assert m.parse(b"ID3\x03\0\x40" + m._syncsafe(len(extended)) + extended + frame * 2).tags == {"TIT2": "\xff\xe0"}
    extended = m._syncsafe(6) + b"\1\0" + b"TIT2" + m._syncsafe(4) + b"\0\2\0\xff\0\xe0"
    assert m.parse(b"ID3\x04\0\x40" + m._syncsafe(len(extended)) + extended + frame * 2).tags == {"TIT2": "\xff\xe0"}
    table = b"VBRI" + bytes(6) + (9000).to_bytes(4, "big") + (40).to_bytes(4, "big") + b"\0\3\0\2\0\2\0\x0a" + b"\0\5\1\0\0\1"
    first = (bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(32) + table).ljust(417, b"\0")
    stream = m.parse(first + (bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)) * 2)
    assert stream.table == {"kind": "VBRI", "bytes": 9000, "frames": 40, "frames_per_entry": 10, "toc": [10, 522, 524]} and len(stream.offsets) == 2


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = m.op8_mpegaudio(spark, DATA).collect()
    assert len(found) == len(docs)
    for r in found:
        raw = docs[r["doc_id"]].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = m.store(payload)
        assert tuple(r)[:7] == (r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert "resyncs=0" in r["feature"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "\u00e9" * 70_000), (3, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int")
    found = m.media_columns(docs).collect()
    assert len(found) == 5
    by = {(r["doc_id"], r["n_bytes"]): r for r in found}
    assert by[1, 0]["media"] == by[2, 0]["media"] and by[1, 0]["payload"] == bytes(64)
    assert by[None, 1]["media"] == by[3, 1]["media"] and by[3, 140_000]["payload"][:2] == "\u00e9".encode()
    assert m.media_columns(docs.limit(0)).count() == 0
