import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from nearfold.llm import simhash
from nearfold.llm.common import connected_components


def plain_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


TEXTS = ["", None, "a", "A\tb", "\u00c9t\u00e9 \u0130x Z\u00df", "x\u00a0y z", "one two three four", "one two three five", "a b c " * 50, "\x1c\x1d q", "w" * 5000]


def test_fingerprints_equal_the_definition():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def near_fingerprints(n, seed):
    rng = random.Random(seed)
    found = {0, (1 << 64) - 1}
    while len(found) < n:
        base = rng.getrandbits(64)
        for _ in range(5):
            found.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    return sorted(found)


def test_tiles_link_exactly_the_near_ones(spark):
    fps = near_fingerprints(400, 2)
    expected = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    distinct = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for tile_rows in (7, 100_000):
        rows = connected_components(simhash.links(distinct, 2, tile_rows)).collect()
        found = {f: f for f in fps} | {int(np.int64(r["node"]).view(np.uint64)): int(np.int64(r["root"]).view(np.uint64)) for r in rows}
        groups = {}
        for f, r in found.items():
            groups.setdefault(r, set()).add(f)
        wanted = {}
        for f, r in expected.items():
            wanted.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_blocks_within_a_tile():
    fps = np.array(near_fingerprints(3000, 4), dtype=np.uint64)
    u, v = simhash.tile_links(fps, None, 2)
    pairs = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    linked = set(fps[(pairs.sum(axis=1) > 1)].tolist())
    assert set(u.tolist()) | set(v.tolist()) == linked
    half = len(fps) // 2
    u, v = simhash.tile_links(fps[:half], fps[half:], 2)
    assert bool(len(u)) == bool(pairs[:half, half:].any())


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 1000 + k) for k in range(200)] + [(3, 3), (9, 8), (8, 9)]
    rng.shuffle(edges)
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {k: 100 for k in range(100, 161)} | {7: 7} | {1000 + k: 7 for k in range(200)} | {8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_with_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "A\tb"), (None, ""), (50, "one two three four"), (None, "lonely text here")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    found = simhash.components(docs).collect()
    assert len(found) == len(rows)
    fps = {plain_fingerprint(t) for _, t in rows}
    root = components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, t in rows:
        r = root[plain_fingerprint(t)]
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    expected = sorted((str(d), plain_fingerprint(t), str(least[root[plain_fingerprint(t)]])) for d, t in rows)
    assert sorted((str(r["doc_id"]), int(np.int64(r["fp"]).view(np.uint64)), str(r["component_id"])) for r in found) == expected
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2 and 50 not in ids and 6 in ids and 1 not in ids
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    assert simhash.components(docs.limit(0)).count() == 0


def test_query(spark):
    found = simhash.op1_simhash(spark, "/root/testdata/sf0.001")
    rows = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in found.collect()}
    texts = dict(map(tuple, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()))
    assert {d: f for d, (f, _) in rows.items()} == {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {d: c for d, (_, c) in rows.items()} == components(sorted(rows), lambda a, b: (rows[a][0] ^ rows[b][0]).bit_count() <= 2)


def plain_similarity(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_documents_that_stay(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            words = list(words)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {k for k, t in enumerate(texts) if not any(plain_similarity(t, texts[j]) >= 0.8 for j in range(k))}
    for tile_rows in (16, 100_000):
        assert {r["doc_id"] for r in simhash.deduplicate(docs, tile_rows=tile_rows).collect()} == expected


def random_words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_equal_fingerprints_alone_drop_nothing(spark, monkeypatch):
    """Different texts whose fingerprints are equal in every bit stay; copies that differ in case and white space go."""
    rng = random.Random(9)
    run = ["-"] * 250
    texts = [" ".join(random_words(rng, 200) + run) for _ in range(4)]
    texts.append(texts[2].upper().replace(" ", "\n"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == [0, 1, 2, 3]
    alike = simhash.wide_fingerprints
    monkeypatch.setattr(simhash, "wide_fingerprints", lambda docs, *a: alike(docs, *a).withColumns({f: F.lit(5).cast("long") for f in simhash.FIELDS}))
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == [0, 1, 2, 3]


def test_groups_keep_their_first_document(spark):
    """Documents that only a later one links are one group; brute force over components."""
    rng = random.Random(10)
    texts, links = [], 0
    for _ in range(12):
        middle = random_words(rng, 100)
        ends = [middle[9:] + random_words(rng, 1), random_words(rng, 1) + middle[:-9]]
        group = [*ends, middle] if rng.random() < 0.7 else ends
        links += len(group) == 3
        texts += [" ".join(words) for words in group]
        assert plain_similarity(texts[-1], texts[-2]) < 0.8 or len(group) == 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = components(range(len(texts)), lambda a, b: plain_similarity(texts[a], texts[b]) >= 0.8)
    assert len(set(root.values())) == 24 - links and links > 3
    for tile_rows in (8, 100_000):
        assert {r["doc_id"] for r in simhash.deduplicate(docs, tile_rows=tile_rows).collect()} == set(root.values())


def test_short_and_repetitive_near_duplicates_go(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(150):  # 9 words against 8: 4 of 5 shingles
        words = random_words(rng, 9)
        texts += [" ".join(words), " ".join(words[:-1])]
    for _ in range(60):  # up to 80 shingles, 0.8 or just below
        words = random_words(rng, rng.randint(6, 84))
        texts += [" ".join(words), " ".join(words[: len(words) - rng.randint(0, (len(words) - 4) // 4)])]
    for _ in range(10):
        words, sentence = random_words(rng, 200), random_words(rng, 8)
        texts += [" ".join(words + sentence * 40), " ".join(words + sentence * 2)]
    texts += ["over and " * 6, "over and " * 9, "one", "one two", "ONE two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = components(range(len(texts)), lambda a, b: plain_similarity(texts[a], texts[b]) >= 0.8)
    assert {r["doc_id"] for r in simhash.deduplicate(docs).collect()} == set(root.values())


def test_different_texts_with_one_doc_id_are_documents_of_their_own(spark):
    rng = random.Random(12)
    a, b = random_words(rng, 60), random_words(rng, 60)
    rows = [(1, " ".join(a)), (7, " ".join([*a, "more"])), (7, " ".join(b)), (9, " ".join(b).upper()), (9, " ".join(b).upper()), (None, " ".join(a))]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted([("1", rows[0][1]), ("7", rows[2][1]), ("None", rows[0][1])])
    # Rows that repeat a document stay or go together; of texts that tie for the least doc_id one stays.
    rows = [(3, "one two three"), (3, "one two three"), (3, "ONE two three"), (5, "one two three")]
    kept = [r["text"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert kept in (["one two three"] * 2, ["ONE two three"])


def test_near_duplicates_at_the_threshold_are_found(spark):
    """Pairs of all lengths at a similarity of 0.8 to 0.82, half of them with a sentence that repeats: all are found."""
    rng = random.Random(13)
    texts = []
    for k in range(120):
        n = rng.randint(9, 400)
        shingles = n - 4
        words = random_words(rng, n)
        other = words[: n - shingles // 5] if k % 2 else words
        sentence = random_words(rng, 8) if not k % 2 else []
        texts += [" ".join(words + sentence * 30), " ".join(other + sentence * 2)]
    similar = [plain_similarity(texts[k], texts[k + 1]) >= 0.8 for k in range(0, len(texts), 2)]
    assert sum(similar) > 100
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {k for k in range(len(texts)) if k % 2 == 0 or not similar[k // 2]}
