"""Cost-balanced packing of documents into sequences of a fixed token length.

Each task packs the documents it reads, a block of about ``BLOCK_TOKENS`` tokens at a time, so nothing is shuffled
and memory is bounded. In a block, runs of whole sequences are cut from long documents; the rest of each
document has an estimated cost of linear + quadratic attention work, and in descending order goes to the lowest-cost
sequence that has room for it. A rest that fits nowhere is cut over the sequences with the most room. A block opens only as
many sequences as its tokens fill, so at most one sequence's worth of padding is left in each block.

Cases: null and empty texts are a document of the end id alone; rows with a null doc_id are packed like others; ties go
to the earlier row and the lower sequence; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import bounded_batches, release_memory
from nearfold.llm.encoding import encoder

#: Tokens that are packed together, and pieces of a batch of results.
BLOCK_TOKENS, BATCH = 1 << 20, 256
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"


def cost(length: np.ndarray | int, capacity: int) -> np.ndarray | float:
    """Attention work of a piece, in units of a linear token: n + n^2 / capacity."""
    return length + length * (length / capacity)


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths; (document, start, length, sequence, offset) for each piece."""
    pieces: list[tuple[int, int, int, int, int]] = []
    full, rest = np.divmod(lengths, capacity)
    sequence = 0
    for doc in np.flatnonzero(full):
        for k in range(int(full[doc])):
            pieces.append((int(doc), k * capacity, capacity, sequence, 0))
            sequence += 1
    count = -(-int(rest.sum()) // capacity)
    load, room = np.zeros(count), np.full(count, capacity, dtype=np.int64)

    def put(doc: int, start: int, length: int, target: int) -> None:
        pieces.append((doc, start, length, sequence + target, capacity - int(room[target])))
        room[target] -= length
        load[target] += cost(length, capacity)

    for doc in np.argsort(-rest, kind="stable"):
        start, left = int(full[doc]) * capacity, int(rest[doc])
        if not left:
            break
        target = int(np.argmin(np.where(room >= left, load, np.inf)))
        if room[target] >= left:
            put(int(doc), start, left, target)
            continue
        while left:
            target = int(np.argmax(room))
            length = min(left, int(room[target]))
            put(int(doc), start, length, target)
            start, left = start + length, left - length
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, block_tokens: int = BLOCK_TOKENS, cache_pieces: int | None = None, most_bytes: int = 4 << 20) -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit integers.

    sequence_id is the task's number times 2^32 plus a counter; offset is the piece's place in its sequence, gapless from 0.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        coder, next_id = encoder(tokenizer, cache_pieces), TaskContext.get().partitionId() << 32
        end = np.array([end_id], np.uint32).tobytes()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            pieces = assign(lengths, capacity)
            for at in range(0, len(pieces), BATCH):
                part = pieces[at : at + BATCH]
                columns = [
                    pa.array([doc_ids[d] for d, *_ in part], pa.int64()), *(pa.array([p[k] for p in part], pa.int64()) for k in (1, 2)),
                    pa.array([int(lengths[p[0]]) for p in part], pa.int64()), pa.array([next_id + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                    pa.array([float(cost(p[2], capacity)) for p in part], pa.float64()), pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in part], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])
            next_id += max((p[3] for p in pieces), default=-1) + 1
            doc_ids.clear()
            ids.clear()
            held = 0

        for batch in bounded_batches(batches, "text", most_bytes, 1024):
            for doc_id, found in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                doc_ids.append(doc_id)
                ids.append(found + end)
                held += len(found) // 4 + 1
            if held >= block_tokens:
                yield from flush()
        if ids:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(each, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op7_packing": op7_packing}
