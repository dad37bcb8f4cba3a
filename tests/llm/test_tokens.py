import io
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearfold.llm import bitpack, encoding, packing
from nearfold.llm.common import store_of
from nearfold.sources.store import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a  b", "a \n b", " x ", "\u00e9 \u00e0 b c", "\0 a \0b \0", "<|endoftext|> hi there", "tab\t \tq", "I'm don't we 'll", "a\x1c b \x1d c", "\n\n a\n \nb", "\u65e5\u672c \u8a9e  \u30c6",
    "that's. it's, a'b' c'. (d) e!?. 'f' g.' \"h\" 12. 3, x\u00b2, y\u00b2.", " \u00f6. \u00df, \u00e9; \u00abb\u00e9\u00bb \u00e9\u00bb. \u0153. \ufb01.", "x\u00a0y \u2003z", "w" * 3000, "\u00ff\u00c0 \u00d7 \u00f7 \u00d8\u00f8.",
]


def plain(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def ids(texts, coder=None):
    return [np.frombuffer(b, np.uint32).tolist() for b in (coder or encoding.Encoder(PATH)).encode(texts)]


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(encoding, "MOST_PIECES", 20)
    coder = encoding.Encoder(PATH)
    assert coder.by_piece
    rng = random.Random(1)
    words = ["the", "th\u00e9,", "Stra\u00dfe.", "12", "it's", "a\nb", "(x)", "\u2014", "caf\u00e9!", "longer" * 9, "."]
    for _ in range(20):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(8)] + ODD
        assert ids(texts, coder) == plain(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \u00e9\u00df.,'\n\t\u00a0\u2028x1-"), max_size=40), max_size=5))
def test_encoder_on_any_text(texts):
    assert ids(texts, encoding.encoder(PATH)) == plain(texts)


def test_words_are_encoded_apart_from_signs_and_line_ends(monkeypatch):
    """Combinations of a few words cost no call of the library for each (the cost of op3_bitpack and op7_packing)."""
    coder, whole = encoding.Encoder(PATH), []
    monkeypatch.setattr(coder, "_whole", lambda texts, own=coder._whole: (whole.extend(texts), own(texts))[1])
    words = ["the", "Stra\u00dfe", "caf\u00e9", "s", "ll", "Nightingale", "\u00d1and\u00fa", "I"]
    signs = ["", ".", "***", ".&&&", "'", "'\"", "%%%", "-"]
    texts = [f"x {a}{s}\n{b}{t} {a}{s}{t}" for a in words for b in words for s in signs for t in signs]
    for _ in range(2):
        assert ids(texts, coder) == plain(texts)
    assert len([t for t in whole if t != "x"]) < 400  # signs alone; the texts hold 4096 such pairs of words


def test_white_space_beside_a_space():
    white = [c for c in map(chr, range(0x110000)) if c.isspace()]
    black = ["a", ".", "\u00ad", "\u200b", "\ufeff", "\u0301", "\0", "\x1b", "\u2027"]
    for texts, beside in (([f"a {c}b" for c in white], True), ([f"a{c} b" for c in white], True), ([f"a {c} b" for c in black], False), ([f"a{c}b" for c in white], False)):
        assert set(pc.match_substring_regex(pa.array(texts), encoding.BESIDE).to_pylist()) == {beside}


def test_encoder_takes_arrow_columns():
    coder = encoding.Encoder(PATH, 20)
    column = pa.array(["cut off", *ODD, "cut off"]).slice(1, len(ODD))
    assert ids(column, coder) == ids(column.cast(pa.large_string()), coder) == plain(ODD)
    assert coder.encode(column.slice(0, 0)) == []


def test_other_tokenizers_encode_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = encoding.Encoder(path)
    assert not coder.by_piece
    assert ids(ODD, coder) == [e.ids for e in Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)]


@pytest.mark.parametrize("width", range(1, 33))
def test_packing_of_bits(width):
    rng = np.random.default_rng(width)
    values = rng.integers(0, 1 << width, 640, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack(values, width)
    assert len(data) == 640 * width // 8
    assert bitpack.unpack(data, width).tolist() == values.tolist()
    number = int.from_bytes(data, "little")
    assert [number >> k * width & (1 << width) - 1 for k in (0, 1, 63, 64, 639)] == [int(values[k]) for k in (0, 1, 63, 64, 639)]


def test_file_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [(None, np.empty(0, np.uint32))] + [(k, rng.integers(0, 1000, int(n), dtype=np.uint32)) for k, n in enumerate(rng.integers(0, 900, 200))]
    out = io.BytesIO()
    writer = bitpack.Writer(out, 1000, block_ids=128)
    for doc_id, values in docs:
        writer.add(doc_id, values)
    assert writer.finish() == sum(len(v) for _, v in docs)
    reader = bitpack.Reader(pa.BufferReader(out.getvalue()))
    assert reader.width == 10 and reader.doc_ids == [d for d, _ in docs]
    for k in (150, 0, 200, 77):
        assert reader.document(k).tolist() == docs[k][1].tolist()
    assert [v.tolist() for k, run in reader.runs(500) for v in run] == [v.tolist() for _, v in docs]
    damaged = bytearray(out.getvalue())
    damaged[5000] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(bitpack.Reader(pa.BufferReader(bytes(damaged))).runs())
    with pytest.raises(ValueError):
        bitpack.Reader(pa.BufferReader(out.getvalue()[:-8]))
    with pytest.raises(ValueError):
        writer.add(1, np.array([1024], np.uint32))
    empty = io.BytesIO()
    bitpack.Writer(empty, 50257).finish()
    assert list(bitpack.Reader(pa.BufferReader(empty.getvalue())).runs()) == []
    assert bitpack.width_for(50257) == 16 and bitpack.width_for(65537) == 17 and bitpack.width_for(1) == 1


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_documents_through_files(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "again"), (None, "no id"), (90, None), *[(None, f"many {k}") for k in range(40)], (None, "many 7")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, ids int")
    folder = new_folder(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = bitpack.write_ids(docs, folder, PATH)
    files = sorted(os.listdir(folder.removeprefix("file://")))
    assert len(files) == manifest.count() > 1 and all(f.endswith(".tok") for f in files)
    again = bitpack.write_ids(docs, folder, PATH)  # as a second attempt: the same files, none touched
    assert sorted(os.listdir(folder.removeprefix("file://"))) == files and sorted(again.collect()) == sorted(manifest.collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = bitpack.read_ids(manifest).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], int(np.uint64(xxhash.xxh64_intdigest(r[1] or "", 42)).view(np.int64)), r[1] or ""))
    start = 0
    for row, (doc_id, text), values in zip(found, ordered, plain([t or "" for _, t in ordered]), strict=True):
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, start, len(values) + 1)
        assert np.frombuffer(row["ids"], "<u4").tolist() == [*values, 0]
        start += len(values) + 1
    assert bitpack.read_ids(bitpack.write_ids(docs.limit(0), new_folder(spark, "test"), PATH)).count() == 0


def test_bitpack_query(spark):
    found = bitpack.op3_bitpack(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for row, doc, values in zip(found, docs, plain([d["text"] or "" for d in docs]), strict=True):
        assert tuple(row) == (doc["doc_id"], start, len(values) + 1, crc([*values, 0]))
        start += len(values) + 1


def check_pieces(pieces, texts, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == texts.keys()
    for (doc_id, text), values in zip(texts.items(), plain([t or "" for t in texts.values()]), strict=True):
        values, at = [*values, 0], 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(values)
            assert np.frombuffer(p["ids"], "<u4").tolist() == values[at : at + p["length"]]
            at += p["length"]
        assert at == len(values)
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
    return sum(p["length"] for p in pieces) / (capacity * len(by_sequence))


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    assert check_pieces(packing.pack_documents(docs, PATH).collect(), texts, 1024) > 0.99
    rows = dict(enumerate(ODD)) | {77: None}
    odd = spark.createDataFrame([(k, t, 0.5) for k, t in rows.items()], "doc_id long, text string, cost double").coalesce(1)
    check_pieces(packing.pack_documents(odd, PATH, capacity=16, block_tokens=64).collect(), rows, 16)
    assert packing.pack_documents(odd.limit(0), PATH).count() == 0


def test_packing_query(spark):
    """Every piece of the query against the library's ids: start, length, checksum, document length, and gapless offsets."""
    texts = dict(map(tuple, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()))
    values = {d: [*v, 0] for d, v in zip(texts, plain([t or "" for t in texts.values()]), strict=True)}
    by_doc, by_sequence = {}, {}
    for r in packing.op7_packing(spark, "/root/testdata/sf0.001").collect():
        own = values[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == values.keys()
    for parts, end in [(by_doc[d], len(v)) for d, v in values.items()] + [(p, None) for p in by_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == end if end is not None else at <= 1024
    assert sum(map(len, values.values())) / (1024 * len(by_sequence)) > 0.97


def test_stores():
    assert store_of("dbfs:/a/b") == (pafs.LocalFileSystem(), "/dbfs/a/b") and store_of("file:///x/y")[1] == "/x/y"
    for uri, path in (("s3a://bucket/a/b?region=us-east-1", "bucket/a/b"), ("s3n://bucket/c?region=us-east-1", "bucket/c")):
        store, found = store_of(uri)
        assert store.type_name == "s3" and found == path
    with pytest.raises(ValueError, match="weird"):
        store_of("weird://cluster/a")


def test_assignment_balances_cost():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 3000, 500)
    pieces = packing.assign(lengths, 1024)
    loads = {}
    for _, _, n, s, _ in pieces:
        loads[s] = loads.get(s, 0) + n
    assert sum(loads.values()) == lengths.sum() and max(loads.values()) <= 1024
    assert len(loads) <= sum(n // 1024 for n in lengths.tolist()) + -(-sum(n % 1024 for n in lengths.tolist()) // 1024)
    # A document goes to the lowest-cost sequence with room: the first three open three sequences, the fourth joins the cheapest.
    found = packing.assign(np.array([700, 600, 500, 300, 300, 300]), 1024)
    assert [(d, s) for d, _, _, s, _ in found][:5] == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 1)]
    assert packing.assign(np.empty(0, np.int64), 1024) == []
