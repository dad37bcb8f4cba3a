"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles. Equal fingerprints are merged
first, so a group of copies costs one comparison row however large it is. Distinct fingerprints are dealt
into tiles by population count; since |popcount(x) - popcount(y)| <= distance(x, y), only tiles whose counts
differ by at most the radius meet. A tile holds at most about ``TILE_ROWS`` rows (512 KB), so a task's
memory is bounded; inside it numpy compares 512 x 512 blocks by exclusive-or and bit count and skips blocks
whose four 16-bit population counts prove them too far apart. A task returns a spanning forest of its links,
never the pairs of a group.

Cases: null text counts as empty; a text without words has fingerprint 0 and links like any other; rows with a
null doc_id take part and get the least non-null id reachable, or null; repeated rows stay repeated; extra
columns pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import bounded_batches, connected_components, keep, local_forest, release_memory, small

TILE_ROWS = 65_536
BLOCK = 512
#: Words of the fingerprints that deduplicate() compares, and the bits in which those of a long pair at similarity 0.8 differ at most: mean 39, sd 6.
WIDE, RADIUS, SPAN = 4, 64, 32
#: Few shingles leave the bits of a fingerprint more to chance (at worst, 4 of 5 in common, the mean is 48), so up to so many more bits may differ.
SHORT, SHORT_MORE, HALF_MORE = 64, 12, 8
#: Candidates of a document that the first comparison lists at most; all others are listed by a second one.
FEW = 8
FIELDS, CONTENT, LINK = tuple(f"f{k}" for k in range(WIDE)), ("c0", "c1"), ("cid", "other", "bits", "n")
#: Rows from which bits are counted by byte value.
MANY = 1000
#: The bits that are set in each byte value, as a 256 x 8 table.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned. Bytes.split() cuts at exactly 0x20 and 0x09 to 0x0D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends)], dtype="<u8")
    return int(majority(hashes.reshape(-1, 1))[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows, for rows of unsigned 64-bit words."""
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    if len(hashes) < MANY:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    else:
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(octets.shape[1])])
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def mixed(words: np.ndarray) -> np.ndarray:
    """Other pseudo-random words for pseudo-random words: the finaliser of the splitmix64 generator."""
    words = words + np.uint64(0x9E3779B97F4A7C15)
    words = (words ^ (words >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    words = (words ^ (words >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return words ^ (words >> np.uint64(31))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the 64-bit pattern as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            found = [fingerprint(t, width, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fps >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(4)], axis=1).astype(np.int16)


def _sorted_blocks(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in the order of their quarter counts; each block's start and least and largest counts."""
    counts = _quarters(fps)
    order = np.lexsort(counts.T[::-1])
    fps, counts = fps[order], counts[order]
    starts = np.arange(0, len(fps), BLOCK)
    return fps, starts, np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles of uint64, or within one (right is None)."""
    own = right is None
    a, a_at, a_low, a_high = _sorted_blocks(left)
    b, b_at, b_low, b_high = (a, a_at, a_low, a_high) if own else _sorted_blocks(right)
    us, vs, held = [], [], 0
    for i, start in enumerate(a_at):
        apart = np.maximum(0, np.maximum(a_low[i] - b_high, b_low - a_high[i])).sum(axis=1)
        part = a[start : start + BLOCK]
        for j in np.flatnonzero(apart <= radius):
            if own and j < i:
                continue
            other = b[b_at[j] : b_at[j] + BLOCK]
            near = np.bitwise_count(part[:, None] ^ other[None, :]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                us.append(part[x])
                vs.append(other[y])
                held += len(x)
                if held > 1_000_000:
                    u, v = local_forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], len(u)
    if not us:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return local_forest(np.concatenate(us), np.concatenate(vs))


def links(distinct: DataFrame, radius: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct fp to (a, b): links that connect exactly the fingerprints within ``radius`` bits of each other."""
    tiled = distinct.select("fp", F.bit_count("fp").cast("int").alias("pop"))
    sizes = dict(tiled.groupBy("pop").count().collect())  # 65 rows at most
    slices = [-(-sizes.get(p, 0) // tile_rows) for p in range(65)]
    per = F.array(*[F.lit(n) for n in slices])
    tiled = tiled.withColumn("tile", F.col("pop").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("fp"), F.get(per, F.col("pop"))))
    partners = F.expr(
        f"flatten(transform(sequence(greatest(pop - {radius}, 0), least(pop + {radius}, 64)),"
        " q -> transform(filter(sequence(0, get(per, q)), j -> j < get(per, q)), j -> q * 4294967296L + j)))"
    )
    dealt = tiled.withColumn("per", per).select("fp", "tile", F.explode(partners).alias("other")).select(
        F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), (F.col("tile") > F.col("other")).alias("second"), "fp"
    )

    def match(table: pa.Table) -> pa.Table:
        fps, second = _column(table, "fp").view(np.uint64), _column(table, "second")
        own = table.column("t0")[0] == table.column("t1")[0]
        left, right = fps[~second], None if own else fps[second]
        u = v = np.empty(0, np.uint64)
        if len(left) and (right is None or len(right)):
            u, v = tile_links(left, right, radius)
        return pa.table({"a": u.view(np.int64), "b": v.view(np.int64)})

    return dealt.groupBy("t0", "t1").applyInArrow(match, "a long, b long")


def components(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the least doc_id reachable by links."""
    marked = keep(fingerprints(docs, width, seed))
    classes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    forest = connected_components(links(classes, radius, tile_rows))
    rooted = classes.join(forest.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, width: int = 5) -> list[bytes]:
    """The distinct word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    width = min(width, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    return list({joined[s:e]: None for s, e in zip(starts.tolist(), (starts + lengths)[width - 1 :].tolist())})


def wide_fingerprint(text: str | None, width: int = 5) -> tuple[np.ndarray, int]:
    """256 majority bits over the XXH3-128 values of the distinct shingles and a mix of them, as four unsigned words (all 0 without words), and how many shingles.

    A shingle counts once however often it stands in the text, as in ``similarity``.
    """
    found = shingles(text, width)
    if not found:
        return np.zeros(WIDE, dtype=np.uint64), 0
    words = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), "<u8").reshape(-1, WIDE // 2)
    return majority(np.hstack([words, mixed(words)])), len(found)


def similarity(a: str | set[bytes], b: str | set[bytes], width: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles; 1 for two texts without words."""
    x, y = (t if isinstance(t, set) else set(shingles(t, width)) for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def content(text: str | None) -> bytes:
    """128 bits that are equal for texts with the same lower-cased words in the same order."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, th, text for rows with a doc_id; rows with equal (doc_id, th) are the same document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("doc_id is not null")


def wide_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, th, c0, c1, f0 .. f3, size) for rows with a doc_id: c0 and c1 hold the ``content``, size the number of distinct shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text", 1 << 20):
            texts = batch.column(2).to_pylist()
            same = np.frombuffer(b"".join(map(content, texts)), np.int64).reshape(-1, 2)
            found = [wide_fingerprint(text, width) for text in texts]
            bits = np.array([f for f, _ in found]).reshape(-1, WIDE).view(np.int64)
            columns = [pa.array(x[:, k].copy()) for x in (same, bits) for k in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array([n for _, n in found], pa.int64())], ["doc_id", "th", *CONTENT, *FIELDS, "size"])
        release_memory()

    return _rows(docs).mapInArrow(each, "doc_id long, th long, " + ", ".join(f"{f} long" for f in (*CONTENT, *FIELDS)) + ", size long")


def reach(a: np.ndarray, b: np.ndarray, threshold: float, radius: int) -> np.ndarray:
    """Bits in which the fingerprints of two sets of these sizes may differ and be candidates; -1 if the sizes alone rule a similarity of ``threshold`` out.

    Sets as similar as that have ``need`` shingles in common. If that is all of the larger one, they are equal.
    """
    need = np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)
    most = np.where(np.minimum(a, b) > SHORT, radius, radius + SHORT_MORE)
    return np.where(need > np.minimum(a, b), -1, np.where(need == np.maximum(a, b), 0, most))


def candidate_links(classes: DataFrame, threshold: float, radius: int, most: int | None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(cid, other, bits, n): for each class the ``most`` nearest candidates with a smaller cid, by pair of tiles; n, on the first of them, says how many there are.

    most None: instead, all candidates (n = 0) of classes marked ``asked`` whose roots differ. classes: cid, f0 .. f3, size, root, asked.
    Tiles are ranges of ``SPAN`` population counts within classes of size, in slices of bounded size. Tiles whose counts are more than the radius apart never meet, nor those whose
    sizes differ by more than the threshold, and neither do blocks within them.
    """
    farthest, base = radius + SHORT_MORE, math.log(1 / threshold)
    count = sum((F.bit_count(f) for f in FIELDS[1:]), F.bit_count(FIELDS[0]))
    spans = 64 * WIDE // SPAN + 1
    kind = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(base) + F.lit(1e-9)).cast("int")
    tiled = classes.withColumn("span", F.floor(count / SPAN).cast("int")).withColumn("place", kind * spans + F.col("span"))
    sizes = dict(tiled.groupBy("place").count().collect())  # a row for each class of size and span, some hundreds
    places = max(sizes, default=0) + 3 * spans
    per = F.array(*[F.lit(-(-sizes.get(k, 0) // tile_rows)) for k in range(places)])
    tiled = tiled.withColumn("per", per).withColumn("tile", F.col("place").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("cid"), F.get(per, F.col("place"))))
    near = -(-farthest // SPAN)
    partners = F.expr(
        f"flatten(transform(filter(flatten(transform(sequence(-1, 1), k -> transform(sequence(greatest(span - {near}, 0), least(span + {near}, {spans - 1})), q -> place - span + k * {spans} + q))), p -> p >= 0),"
        " p -> transform(filter(sequence(0, get(per, p)), j -> j < get(per, p)), j -> p * 4294967296L + j)))"
    )
    columns = ["cid", *FIELDS, "size", *(("root", "asked") if most is None else ())]
    dealt = tiled.select(*columns, "tile", F.explode(partners).alias("other_tile")).select(
        F.least("tile", "other_tile").alias("t0"), F.greatest("tile", "other_tile").alias("t1"), (F.col("tile") > F.col("other_tile")).alias("second"), *columns
    )

    def match(table: pa.Table) -> pa.Table:
        own = table.column("t0")[0] == table.column("t1")[0]
        second = _column(table, "second")
        sides = [Side(table, which) for which in (~second, second)]
        best = Nearest(most)
        if own or len(sides[0].cid) and len(sides[1].cid):
            a, b = sides[0], sides[0] if own else sides[1]
            for x, y, bits in near_pairs(a, b, threshold, radius, own):
                i, j = a.cid[x], b.cid[y]
                if most is None:
                    asked = np.where(i > j, a.asked[x], b.asked[y]) & (a.root[x] != b.root[y])
                    i, j, bits = i[asked], j[asked], bits[asked]
                best.add(np.maximum(i, j), np.minimum(i, j), bits)
        release_memory()
        return best.table()

    return dealt.groupBy("t0", "t1").applyInArrow(match, "cid long, other long, bits long, n long")


class Side:
    """One tile of a pair, in order of size."""

    def __init__(self, table: pa.Table, rows: np.ndarray):
        order = np.flatnonzero(rows)
        order = order[np.argsort(_column(table, "size")[order], kind="stable")]
        self.cid, self.size = _column(table, "cid")[order], _column(table, "size")[order]
        self.bits = [np.ascontiguousarray(_column(table, f)[order]).view(np.uint64) for f in FIELDS]
        self.count = sum(np.bitwise_count(f).astype(np.int16) for f in self.bits)
        if "root" in table.column_names:
            self.root, self.asked = _column(table, "root")[order], _column(table, "asked")[order]


class Nearest:
    """Gathers links (later, other, bits), and keeps the nearest few of each later one, or all."""

    def __init__(self, most: int | None):
        self.most, self.held = most, 0
        self.parts: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 4]

    def add(self, later: np.ndarray, other: np.ndarray, bits: np.ndarray) -> None:
        self.parts.append((later, other, bits, np.full(len(later), self.most is not None, np.int64)))
        self.held += len(later)
        if self.most is not None and self.held > 500_000:
            self._reduce()
            self.held = 0

    def _reduce(self) -> None:
        later, other, bits, n = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((other, bits, later))
        later, other, bits, n = later[order], other[order], bits[order], n[order]
        starts = np.flatnonzero(np.append(True, later[1:] != later[:-1])) if len(later) else np.empty(0, np.int64)
        lengths = np.diff(np.append(starts, len(later)))
        totals = np.add.reduceat(n, starts) if len(later) else n
        rank = np.arange(len(later)) - np.repeat(starts, lengths)
        n = np.zeros(len(later), np.int64)
        n[starts] = totals
        few = rank < self.most
        self.parts = [(later[few], other[few], bits[few], n[few])]

    def table(self) -> pa.Table:
        if self.most is not None:
            self._reduce()
        return pa.table(dict(zip(LINK, (np.concatenate(c).astype(np.int64) for c in zip(*self.parts)))))


def near_pairs(a: Side, b: Side, threshold: float, radius: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, bits) of the candidates between two tiles, or within one (own), by block; each pair once.

    A pair in reach differs by at most ``HALF_MORE`` bits more than half of the farthest reach in the first half of its bits.
    """
    farthest = radius + SHORT_MORE
    half = farthest // 2 + HALF_MORE
    for s in range(0, len(a.cid), BLOCK):
        t = min(s + BLOCK, len(a.cid))
        first = int(np.searchsorted(b.size, math.floor(a.size[s] * threshold)))
        last = int(np.searchsorted(b.size, math.ceil(a.size[t - 1] / threshold), side="right"))
        low, high = a.count[s:t].min(), a.count[s:t].max()
        for p in range(s if own else first, last, BLOCK):
            q = min(p + BLOCK, last)
            if max(b.count[p:q].min() - high, low - b.count[p:q].max()) > farthest:
                continue
            bits = np.bitwise_count(a.bits[0][s:t, None] ^ b.bits[0][None, p:q])
            bits += np.bitwise_count(a.bits[1][s:t, None] ^ b.bits[1][None, p:q])
            x, y = np.nonzero(bits <= half)
            x, y = x + s, y + p
            total = sum(np.bitwise_count(f[x] ^ g[y]).astype(np.int64) for f, g in zip(a.bits, b.bits))
            near = total <= reach(a.size[x], b.size[y], threshold, radius)
            near &= (x < y) if own else (a.cid[x] != b.cid[y])
            if near.any():
                yield x[near], y[near], total[near]


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """Those of the pairs (cid, other) whose whole texts have at least this similarity."""
    keys = classes.select("cid", "doc_id", "th")
    named = pairs.select("cid", "other").distinct().join(keys, "cid").join(keys.select(F.col("cid").alias("other"), F.col("doc_id").alias("d2"), F.col("th").alias("t2")), "other")
    named = keep(named)
    rows = _rows(docs)
    # The text of each named document once, also where its row is repeated.
    theirs = rows.join(small(named.select(F.col("d2").alias("doc_id"), F.col("t2").alias("th"), "other").distinct()), ["doc_id", "th"])
    mine = rows.join(small(named.select("doc_id", "th", "cid", "other")), ["doc_id", "th"]).select("cid", "other", "text")
    if theirs.select("other").groupBy("other").count().where("count > 1").limit(1).count():
        theirs = theirs.groupBy("other").agg(F.first("text").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in bounded_batches(batches, "text", 1 << 20):
            passed = []
            for other, mine_, theirs_ in zip(batch.column(1).to_pylist(), *(batch.column(k).to_pylist() for k in (2, 3))):
                if other != last:
                    last, held = other, set(shingles(theirs_, width))
                passed.append(similarity(mine_, held, width) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(passed, pa.bool_()))
        release_memory()

    both = mine.join(theirs.select("other", F.col("text").alias("other_text")), "other").select("cid", "other", "text", "other_text")
    return keep(both.mapInArrow(each, "cid long, other long"))


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with ``root``, the least cid that verified links (cid, other) reach."""
    forest = connected_components(links.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    return keep(classes.drop("root").join(forest.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))


def deduplicate(docs: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The rows of docs that stay: of each group that links of a similarity of ``threshold`` or more connect, the document with the least doc_id.

    Similarity is Jaccard's, of word shingles of whole texts. Candidates are pairs of 256-bit fingerprints within ``radius`` bits, or ``SHORT_MORE`` bits more where
    a text has ``SHORT`` distinct shingles or fewer (a long pair at 0.8 differs by 39 on average, standard deviation 6). The nearest
    earlier one of each document is checked on whole texts, and the links that hold are joined up; then all other candidates in different groups are
    checked, so every candidate counts, but pairs within a group needn't be listed. Texts with the same words in the same order, letter case
    aside, are copies, and a group of copies costs one row; equal fingerprints alone decide nothing. Rows with the same doc_id and text are one
    document, and stay or go together; of different texts with one doc_id each is a document of its own, and of those that tie for the least doc_id one stays. The columns of docs
    come back unchanged; rows with a null doc_id stay, for nothing orders them.
    """
    marked = keep(wide_fingerprints(docs, width))
    first = F.min(F.struct("doc_id", "th")).alias("rep")
    classes = marked.groupBy(*CONTENT, *FIELDS, "size").agg(first).select(*CONTENT, *FIELDS, "size", "rep.doc_id", "rep.th", F.monotonically_increasing_id().alias("cid"))
    classes = keep(classes)
    found = keep(candidate_links(classes, threshold, radius, FEW, tile_rows))
    per = found.groupBy("cid").agg(F.min(F.struct("bits", "other")).alias("best"), F.sum("n").alias("n"), F.count("*").alias("listed"))
    nearest = keep(per.select("cid", F.col("best.other").alias("other"), "n", "listed"))
    linked = similar(nearest, classes, docs, threshold, width)
    rooted = _rooted(classes, linked)
    root = rooted.select("cid", "root")
    rest = found.select("cid", "other").join(nearest.select("cid", "other"), ["cid", "other"], "left_anti").join(root, "cid")
    pairs = rest.join(root.select(F.col("cid").alias("other"), F.col("root").alias("other_root")), "other").where("root <> other_root").select("cid", "other")
    open_ = nearest.where("n > listed").select("cid", F.lit(True).alias("asked"))
    if open_.limit(1).count():
        asked = rooted.join(open_, "cid", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        pairs = pairs.unionByName(candidate_links(asked, threshold, radius, None, tile_rows).select("cid", "other").join(nearest.select("cid", "other"), ["cid", "other"], "left_anti"))
    pairs = keep(pairs)
    if pairs.limit(1).count():
        more = similar(pairs, classes, docs, threshold, width)
        if more.limit(1).count():
            rooted = _rooted(classes, linked.unionByName(more))
    # Of each group the least (doc_id, th) stays.
    least = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("keep"))
    named = rooted.join(least, "root").select(*CONTENT, "keep")
    out = marked.join(named, list(CONTENT)).where(F.struct("doc_id", "th") != F.col("keep")).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct()
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    gone = small(keep(out))
    return docs.withColumn("__th", th).join(gone, (docs["doc_id"].cast("long") == gone["__d"]) & (F.col("__th") == gone["__t"]), "left_anti").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = components(docs, width=3, seed=42, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
