"""Token-ID files: fixed-width bit packing with block offsets.

A file holds the ids of whole documents in order, each id in the least number of bits that its vocabulary
needs. Ids are packed in blocks of ``BLOCK_IDS`` (a multiple of 64, so a block is a whole number of 64-bit
words); value k of a block takes bits k*width to (k+1)*width, counted from the least bit of the first word.

    "NFTOK1\\0\\0"  u32 width  u32 block ids  u64 vocabulary     header, 24 bytes
    packed blocks, one after the other (the last one filled up with zeros)
    i64 doc_id[n_docs]  u8 id_is_null[n_docs]  u64 first_id[n_docs + 1]
    u64 block_offset[n_blocks + 1]  u32 block_crc32[n_blocks]
    u64 n_docs  u64 n_blocks  u64 footer offset  "NFTOK1\\0\\0"    trailer, 32 bytes

Writers stream: memory holds one block run, plus about 20 bytes a document. Readers find any document from the
footer, read only its blocks, verify their checksums and unpack them with vectorised numpy shifts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfold.llm.common import bounded_batches, keep, store_of
from nearfold.llm.encoding import encoder
from nearfold.sources.store import new_folder

MAGIC = b"NFTOK1\0\0"
HEADER, TRAILER = struct.Struct("<8sIIQ"), struct.Struct("<QQQ8s")
BLOCK_IDS = 4096


def width_for(vocabulary: int) -> int:
    """Least bits that hold ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Pack ids (their count a multiple of 64) at ``width`` bits each, 1 to 32."""
    lanes = ids.astype(np.uint64).reshape(-1, 64)
    words = np.zeros((len(lanes), width), dtype=np.uint64)
    for k in range(64):
        word, bit = divmod(k * width, 64)
        words[:, word] |= lanes[:, k] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= lanes[:, k] >> np.uint64(64 - bit)
    return words.astype("<u8").tobytes()


def unpack(data: bytes | memoryview, width: int) -> np.ndarray:
    """The ids of whole blocks, as unsigned 32-bit integers."""
    words = np.frombuffer(data, dtype="<u8").reshape(-1, width)
    lanes = np.empty((len(words), 64), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, bit = divmod(k * width, 64)
        value = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - bit)
        lanes[:, k] = value & mask
    return lanes.reshape(-1)


class Writer:
    """Streams documents to one open output."""

    def __init__(self, out, vocabulary: int, block_ids: int = BLOCK_IDS):
        self.out, self.width, self.block_ids = out, width_for(vocabulary), block_ids
        self.doc_ids: list[int | None] = []
        self.first, self.offsets, self.sums = [0], [HEADER.size], []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        out.write(HEADER.pack(MAGIC, self.width, block_ids, vocabulary))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id of document {doc_id} needs more than {self.width} bits")
        self.doc_ids.append(doc_id)
        self.first.append(self.first[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * self.block_ids:
            self._flush(self.held // self.block_ids * self.block_ids)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        now, rest = ids[:count], ids[count:]
        self.waiting, self.held = [rest], len(rest)
        if short := -len(now) % self.block_ids:
            now = np.concatenate([now, np.zeros(short, now.dtype)])
        data, size = pack(now, self.width), self.block_ids * self.width // 8
        for at in range(0, len(data), size):
            self.sums.append(zlib.crc32(data[at : at + size]))
            self.offsets.append(self.offsets[-1] + size)
        self.out.write(data)

    def finish(self) -> int:
        """Write what is left and the footer; the number of ids. ``digest`` tells the files of different documents apart."""
        if self.held:
            self._flush(self.held)
        parts = [
            np.array([d or 0 for d in self.doc_ids], "<i8"), np.array([d is None for d in self.doc_ids], "u1"),
            np.array(self.first, "<u8"), np.array(self.offsets, "<u8"), np.array(self.sums, "<u4"),
        ]
        footer = b"".join(p.tobytes() for p in parts) + TRAILER.pack(len(self.doc_ids), len(self.sums), self.offsets[-1], MAGIC)
        self.out.write(footer)
        self.digest = xxhash.xxh3_128_hexdigest(footer)  # it holds the checksums of all blocks
        return self.first[-1]


class Reader:
    """Random access to the documents of one file; ``source`` needs seek, read and size as pyarrow's input files have."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - TRAILER.size)
        n_docs, n_blocks, footer, magic = TRAILER.unpack(source.read(TRAILER.size))
        source.seek(0)
        first_magic, self.width, self.block_ids, self.vocabulary = HEADER.unpack(source.read(HEADER.size))
        if magic != MAGIC or first_magic != MAGIC:
            raise ValueError("not a token-id file, or cut short")
        source.seek(footer)
        data, at = source.read(size - TRAILER.size - footer), 0
        tables = []
        for kind, count in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs + 1), ("<u8", n_blocks + 1), ("<u4", n_blocks)):
            tables.append(np.frombuffer(data, kind, count, at))
            at += tables[-1].nbytes
        ids, null, self.first, self.offsets, self.sums = tables
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; reads only their blocks."""
        if stop <= start:
            return np.empty(0, np.uint32)
        low, high = start // self.block_ids, -(-stop // self.block_ids)
        self.source.seek(int(self.offsets[low]))
        data = memoryview(self.source.read(int(self.offsets[high] - self.offsets[low])))
        for k in range(low, high):
            if zlib.crc32(data[int(self.offsets[k] - self.offsets[low]) : int(self.offsets[k + 1] - self.offsets[low])]) != self.sums[k]:
                raise ValueError(f"block {k} is damaged")
        return unpack(data, self.width)[start - low * self.block_ids : stop - low * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))

    def runs(self, most_ids: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Consecutive documents with about ``most_ids`` ids together: the first one's number, and each one's ids."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            stop = max(k + 1, int(np.searchsorted(self.first, self.first[k] + np.uint64(most_ids), side="right")) - 1)
            stop = min(stop, n)
            ids = self.ids(int(self.first[k]), int(self.first[stop]))
            yield k, [ids[int(self.first[j] - self.first[k]) : int(self.first[j + 1] - self.first[k])] for j in range(k, stop)]
            k = stop


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode whole texts (null: empty), add ``end_id`` to each, write them in ascending doc_id order; return the manifest.

    One file for each range partition, in ``folder`` on a store that all executors share. A file is written under a name of its own and then renamed to one that its content
    gives, and one that is there already is left alone, so tasks can run again while others read. Rows with a null
    doc_id come first; equal doc_ids, which many tasks may share, are ordered by a hash of the text, then by text. An empty table gives an empty manifest. Other columns are ignored.
    Manifest: file int, path string, n_docs long, n_ids long.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, writer = encoder(tokenizer), TaskContext.get().partitionId(), None
        store, root = store_of(folder)
        end = np.array([end_id], np.uint32)
        temporary = f"{root}/{uuid.uuid4().hex}.writing"
        try:
            for batch in bounded_batches(batches, "text"):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(temporary)
                    writer = Writer(out, coder.vocabulary)
                for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                    writer.add(doc_id, np.concatenate([np.frombuffer(ids, np.uint32), end]))
            if writer is None:
                return
            total = writer.finish()
            out.close()
            name = f"part-{part:05d}-{writer.digest}.tok"
            if store.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                store.move(temporary, f"{root}/{name}")
        finally:
            if writer is not None and store.get_file_info(temporary).type != pafs.FileType.NotFound:
                out.close()
                store.delete_file(temporary)
        columns = [[part], [f"{folder}/{name}"], [len(writer.doc_ids)], [total]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["file", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th", "text").drop("th")
    return keep(ordered.mapInArrow(each, "file int, path string, n_docs long, n_ids long"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) for each document of the files; ids: little-endian unsigned 32-bit, start: ids before it."""
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    placed = manifest.select("file", "path", F.coalesce(before, F.lit(0)).alias("before"))
    files = manifest.count()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = store_of(row["path"])
                with store.open_input_file(path) as source:
                    reader = Reader(source)
                    for k, run in reader.runs():
                        starts = [int(reader.first[k + j]) + row["before"] for j in range(len(run))]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.doc_ids[k : k + len(run)], pa.int64()), pa.array(starts, pa.int64()),
                                pa.array([len(x) for x in run], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in run], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    return placed.repartition(max(1, files), "file").mapInArrow(each, "doc_id long, start long, n_tokens long, ids binary")


def op3_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_ids(docs, new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op3_bitpack": op3_bitpack}
