"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from a seed and its code point. An n-gram's vector binds its letters' vectors by
multiplication, each permuted (rotated) by its place; a text's vector bundles (sums) those of all its n-grams, and a language's
prototype bundles all its training texts. A text gets the language whose prototype has the largest cosine with its vector.

Bundling is linear, so texts are summed by matrix products of n-gram counts with n-gram vectors, ``CHUNK`` n-grams at a time whatever the
alphabet, over stretches of ``STRETCH`` letters, so memory is bounded for texts of any length. Training adds up whole numbers over all
labelled rows, so it doesn't depend on the order of rows; a model has languages x ``dimensions`` numbers.

Cases: null text, or text without letters, gets ``und`` with score 0; so does every text if nothing is labelled; equal cosines go to the
lower code point; letters are lower-cased, anything else is a word end; extra columns pass through, but for earlier
columns named lang_pred or score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import bounded_batches, release_memory

DIMENSIONS, GRAM, SEED = 1024, 3, 29
MOST_LANGUAGES = 2000
#: Texts of a call, letters that are counted together, and n-grams whose vectors are made at a time (some 20 MB).
TOGETHER, STRETCH, CHUNK = 256, 1 << 20, 4096
SPACE = 32


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """For each code point: itself if it is a letter, else the space."""
    return np.array([k if chr(k).isalpha() else SPACE for k in range(0x110000)], dtype=np.uint32)


@lru_cache(maxsize=4096)
def letter(code: int) -> np.ndarray:
    """The vector of a letter."""
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def bound(grams: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, rows of GRAM code points: each letter's vector rotated by its place from the end, multiplied."""
    codes, places = np.unique(grams, return_inverse=True)
    letters = np.stack([letter(c) for c in codes.tolist()]).astype(np.int8)
    places = places.reshape(grams.shape)
    out = letters[places[:, GRAM - 1]]
    for k in range(GRAM - 1):
        out *= np.roll(letters, GRAM - 1 - k, axis=1)[places[:, k]]
    return out


def stretches(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, code points) in order: letters, with one space for what stands between, before and after them; a long text comes in several
    stretches, each but the first beginning with the GRAM - 1 symbols before it. Texts without letters give nothing."""
    for k, text in enumerate(texts):
        lowered = text.lower()
        tail = np.array([], dtype=np.uint32)
        held = False
        for at in range(0, len(lowered) + 1, STRETCH):
            folded = folding()[np.frombuffer(lowered[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
            last = at + STRETCH > len(lowered)
            framed = np.concatenate([tail if held else [SPACE], folded, [SPACE] * last]).astype(np.uint32)
            # Of a run of spaces the first stays.
            framed = framed[np.append(True, (framed[1:] != SPACE) | (framed[:-1] != SPACE))]
            if not held and len(framed) == 1:
                continue  # no letter yet
            held = True
            tail = framed[-(GRAM - 1) :]
            if len(framed) >= GRAM:
                yield k, framed


def bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x dimensions) vectors, and which texts have letters."""
    vectors, lettered = np.zeros((len(texts), DIMENSIONS)), np.zeros(len(texts), dtype=bool)
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0
    for owner, codes in stretches(texts):
        lettered[owner] = True
        waiting.append((owner, codes))
        held += len(codes)
        if held >= STRETCH:
            _add(vectors, waiting)
            waiting, held = [], 0
    if waiting:
        _add(vectors, waiting)
    return vectors, lettered


def _add(vectors: np.ndarray, waiting: list[tuple[int, np.ndarray]]) -> None:
    """Add the n-grams of these stretches to their texts' vectors."""
    together = np.concatenate([codes for _, codes in waiting])
    present = np.flatnonzero(np.bincount(together))
    number = np.zeros(int(present[-1]) + 1, dtype=np.int64)
    number[present] = np.arange(len(present))
    size = len(present)
    keys = []
    for _, codes in waiting:
        symbols = number[codes]
        key = symbols[: len(symbols) - GRAM + 1]
        for k in range(1, GRAM):
            key = key * size + symbols[k : len(symbols) - GRAM + 1 + k]
        keys.append(key)
    if size**GRAM <= 1 << 22:
        seen = np.flatnonzero(np.bincount(np.concatenate(keys), minlength=1))
        place = np.zeros(int(seen[-1]) + 1, dtype=np.int32)
        place[seen] = np.arange(len(seen))
        found = [place[key] for key in keys]
    else:
        seen, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        found = np.split(inverse.astype(np.int32), np.cumsum([len(key) for key in keys])[:-1])
    owners = np.array([owner for owner, _ in waiting])
    # A text in several stretches takes several turns, so that no turn has it twice.
    nth = np.arange(len(owners)) - np.searchsorted(owners, owners)
    turns = [np.flatnonzero(nth == k) for k in range(int(nth.max()) + 1)]
    for low in range(0, len(seen), CHUNK):
        rest, digits = seen[low : low + CHUNK], []
        wide = len(rest)
        for _ in range(GRAM):
            digits.append(present[rest % size])
            rest = rest // size
        table = np.zeros((len(waiting), wide), dtype=np.float32)
        for k, places in enumerate(found):
            mine = places if wide == len(seen) else places[(places >= low) & (places < low + wide)] - low
            table[k] = np.bincount(mine, minlength=wide)
        sums = table @ bound(np.stack(digits[::-1], axis=1)).astype(np.float32)
        for rows in turns:
            vectors[owners[rows]] += sums[rows]


@dataclass
class Model:
    languages: list[str]
    prototypes: np.ndarray  # languages x dimensions, each of length 1


def train(labelled: DataFrame) -> Model:
    """Fit prototypes on all rows of labelled (text, lang); rows where either is null or the text has no letters add nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in bounded_batches(batches, "text", 1 << 20, TOGETHER):
            langs = batch.column(1).to_pylist()
            vectors, lettered = bundle(batch.column(0).to_pylist())
            for name in {x for x, has in zip(langs, lettered) if has}:
                own = np.array([x == name for x in langs]) & lettered
                sums[name] = sums.get(name, 0) + vectors[own].sum(axis=0)
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(each, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    total = parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    fitted = sorted((r["lang"], [e["x"] for e in r["v"]]) for r in total.limit(MOST_LANGUAGES + 1).collect())
    if len(fitted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    prototypes = np.array([v for _, v in fitted]).reshape(len(fitted), DIMENSIONS)
    lengths = np.sqrt((prototypes**2).sum(axis=1, keepdims=True))
    return Model([name for name, _ in fitted], prototypes / np.where(lengths == 0, 1, lengths))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, cosine cut to 0..1) for each text."""
    best, score = ["und"] * len(texts), np.zeros(len(texts))
    vectors, lettered = bundle([t or "" for t in texts])
    if model.languages and lettered.any():
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        cosines = (vectors @ model.prototypes.T) / np.where(lengths == 0, 1, lengths)[:, None]
        top = np.argmax(cosines, axis=1)
        for k in np.flatnonzero(lettered):
            best[k], score[k] = model.languages[top[k]], min(1.0, max(0.0, float(cosines[k, top[k]])))
    return best, score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred string and score double, from the text alone."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs: list[str] = []
            scores: list[float] = []
            whole = pa.RecordBatch.from_arrays([texts], ["text"])
            for part in bounded_batches(iter([whole]), "text", 1 << 20, TOGETHER):
                best, score = predict(model, part.column(0).to_pylist())
                langs += best
                scores += score.tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        release_memory()

    docs = docs.drop("lang_pred", "score")
    guessed = docs.withColumn("__guess", guess(F.col("text").cast("string")))
    return guessed.select(*docs.columns, F.col("__guess.lang_pred").alias("lang_pred"), F.col("__guess.score").alias("score"))


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by a checksum of the id; these are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    guessed = identify(docs.select("doc_id", "text"), model)
    return guessed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_langid": op10_langid}
