import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from nearfold.llm import langid

ROOT = Path(__file__).resolve().parents[2]


def plain_vector(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    framed = " " + " ".join(letters.split()) + " "
    total = np.zeros(langid.DIMENSIONS)
    for k in range(len(framed) - 2):
        a, b, c = (np.random.default_rng([langid.SEED, ord(x)]).integers(0, 2, langid.DIMENSIONS, dtype=np.int8) * 2.0 - 1 for x in framed[k : k + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def plain_counts(text, known={}):
    """The same from counted n-grams, for long texts; None without letters."""
    letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    framed = f" {letters} "
    if not letters:
        return None
    total = np.zeros(langid.DIMENSIONS)
    for gram, n in Counter(framed[k : k + 3] for k in range(len(framed) - 2)).items():
        if gram not in known:
            a, b, c = (np.random.default_rng([langid.SEED, ord(x)]).integers(0, 2, langid.DIMENSIONS, dtype=np.int8) * 2.0 - 1 for x in gram)
            known[gram] = np.roll(a, 2) * np.roll(b, 1) * c
        total += n * known[gram]
    return total


def test_vectors_equal_the_definition(monkeypatch):
    texts = ["Hello, world", "  d\u00e9j\u00e0  vu 12 ", "a", "\u65e5\u672c\u8a9e \u0440\u0443\u0441", "x-y_z", "", " 9 " * 5, "ab  cd " * 9 + "e"]
    for stretch, chunk in ((langid.STRETCH, langid.CHUNK), (1, 2), (2, 3), (3, 1), (7, 5)):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        monkeypatch.setattr(langid, "CHUNK", chunk)
        vectors, lettered = langid.bundle(texts)
        assert lettered.tolist() == [True] * 5 + [False, False, True]
        for text, row, has in zip(texts, vectors, lettered):
            assert row.tolist() == (plain_vector(text).tolist() if has else [0.0] * langid.DIMENSIONS)


def test_a_long_text_in_a_large_alphabet_takes_bounded_memory():
    code = """
import random, resource
from nearfold.llm import langid
rng = random.Random(3)
text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(400_000))
langid.bundle(["warm"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
langid.bundle([text] * 2)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout.split()[-1]) < 250


def test_training_and_prediction(spark):
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), (None, "en"), ("text", None), ("!!", "xx"), ("the the of", "en")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    sums = {"en": plain_vector(rows[0][0]) + plain_vector(rows[6][0]), "fr": plain_vector(rows[1][0]), "de": plain_vector(rows[2][0])}
    for name, row in zip(model.languages, model.prototypes):
        assert np.allclose(row, sums[name] / np.linalg.norm(sums[name]))
    asked = [(1, "le chat"), (2, None), (3, ""), (4, "42 %"), (5, "and the of"), (1, "le chat"), (None, "und der hund " * 20_000)]
    docs = spark.createDataFrame([(d, t, "old") for d, t in asked], "doc_id long, text string, score string")
    found = langid.identify(docs, model).collect()
    assert [r["lang_pred"] for r in found] == ["fr", "und", "und", "und", "en", "fr", "de"]
    assert all(0 <= r["score"] <= 1 for r in found) and found[1]["score"] == 0
    v = plain_vector("le chat")
    assert abs(found[0]["score"] - v @ (sums["fr"] / np.linalg.norm(sums["fr"])) / np.linalg.norm(v)) < 1e-5
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = langid.op10_langid(spark, sf).collect()
    assert len(found) == len(docs)
    # Every prediction against a plain model: prototypes of the documents that aren't held out, and the largest cosine.
    sums = {}
    vectors = {d: plain_counts(r["text"] or "") for d, r in docs.items()}
    for d, r in docs.items():
        if zlib.crc32(str(d).encode()) % 4 != 2 and r["lang"] is not None and vectors[d] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[d]
    names = sorted(sums)
    prototypes = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    for r in found:
        v = vectors[r["doc_id"]]
        if v is None:
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        cosines = prototypes @ v / np.linalg.norm(v)
        assert abs(r["score"] - max(0, cosines.max())) < 1e-5 and cosines[names.index(r["lang_pred"])] > cosines.max() - 1e-6
    right = Counter()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["held_out"] and r["lang_pred"] != "und":
            right[r["lang_pred"] == docs[r["doc_id"]]["lang"]] += 1
    assert right[True] / sum(right.values()) > 0.97, right


def test_a_held_out_label_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = langid.held_out(F.col("doc_id"))
    wrong = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    a, b = langid.train(docs.where(~held)), langid.train(wrong.where(~held))
    assert a.languages == b.languages and np.array_equal(a.prototypes, b.prototypes)
