"""Token ids of whole texts through the tokenizers library, with an exact per-word cache.

For a byte-level BPE file with its usual split pattern and no added prefix space, a token never crosses a
place where one space stands between two characters that aren't white space: the pattern takes that space
together with what follows it. So a text is cut there, each distinct piece is encoded once, and the ids are
joined; the result equals encoding the whole text. In a piece, Latin words, ASCII signs and a line end are encoded apart. Other tokenizer files are applied to whole texts, and
so are texts that hold an added token's string or white space beside a space.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: White space to regular expressions of either library, as Arrow's (RE2) spell it, and that beside a space.
WHITE = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BESIDE = f" [{WHITE}]|[{WHITE}] "
#: Pieces in each of the cache's two generations (some 80 MB each); longer pieces, which seldom recur, aren't kept.
MOST_PIECES, LONGEST_PIECE = 500_000, 11
#: Words that the pattern never cuts, of Latin letters only, and ASCII signs: it always cuts between them and, unless other white space follows, around a line end.
LATIN, SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-/:-@\[-`{-~]*"
PARTS = re.compile(f"({LATIN})({SIGNS})(?:(\n)({LATIN})({SIGNS}))?")


def _byte_letters() -> dict[int, int]:
    """The usual byte alphabet: printable Latin-1 stands for itself, other bytes for U+0100 onwards in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 0x100 + k for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()
#: The letters that LATIN takes beyond ASCII, spelt in the byte alphabet.
SPELT = {c: "".join(chr(BYTE_LETTERS.get(b, b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
#: Words that are encoded in one call, as an input that is split already; an even number.
TOGETHER = 500


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, pieces: int | None = None):
        self.most = pieces or MOST_PIECES
        about = json.loads(Path(path).read_text("utf-8"))
        split = about.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_file(path)
        self.unsplit = Tokenizer(self.tokenizer.model)  # for single words, already in the byte alphabet
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_piece = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
            and about.get("normalizer") is None and not about["model"].get("dropout") and not about["model"].get("ignore_merges")
        )
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, dtype=bool)
        self.begins[[k for token, k in self.tokenizer.get_vocab().items() if token[:1] == "Ġ"]] = True
        self.apart = "|".join([BESIDE, *(re.escape(t["content"]) for t in about.get("added_tokens", []))])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _ids(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return self._ids(self.tokenizer, texts)

    def _words(self, words: list[str], bare: bool = False) -> list[bytes]:
        """Ids of Latin words with a space before each, or without it if ``bare``.

        That space's letter begins a token only where a word begins; before a bare word it is encoded alone and left out.
        """
        spelt = [w if w.isascii() else w.translate(SPELT) for w in words]
        spelt = [x for w in spelt for x in ("Ġ", w)] if bare else ["Ġ" + w for w in spelt]
        out: list[bytes] = []
        for e in self.unsplit.encode_batch_fast([spelt[k : k + TOGETHER] for k in range(0, len(spelt), TOGETHER)], is_pretokenized=True, add_special_tokens=False):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            out += [data[x:y] for x, y in zip(ends, ends[1:])]
        return [x[4:] for x in out] if bare else out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as bytes; no text is null."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.by_piece:
            return self._whole(column.to_pylist())
        safe = pc.invert(pc.match_substring_regex(column, self.apart))
        whole = iter(self._whole(column.filter(pc.invert(safe)).to_pylist()))
        cut = iter(self._joined(column.filter(safe)))
        return [next(cut if s else whole) for s in safe.to_pylist()]

    def _joined(self, texts: pa.Array) -> list[bytes]:
        """Cut at every space; each distinct piece is looked up once and its ids are gathered by numpy."""
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        pieces, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices, dtype=np.int64).copy()
        heads = [pieces[k] for k in codes[bounds[:-1]]]  # the first piece has no space before it
        codes[bounds[:-1]] = np.arange(len(pieces), len(pieces) + len(heads))
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        table = self._cached(pieces, self._pieces) + self._whole(heads)
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        tokens = np.frombuffer(b"".join(table), dtype=np.uint32)
        counts = sizes[codes]
        ends = np.cumsum(counts)
        shift = (np.cumsum(sizes) - sizes)[codes] - (ends - counts)
        ids = tokens[np.repeat(shift, counts) + np.arange(ends[-1])]
        stops = ends[bounds[1:] - 1]
        return [ids[x:y].tobytes() for x, y in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def _cached(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """What the cache holds for distinct keys, in the young generation afterwards; ``make`` finds the others, which stay there unless they are long."""
        found = list(map(self.young.get, keys))
        missing = [k for k, x in zip(keys, found) if x is None]
        older = list(map(self.old.get, missing))
        new = [k for k, x in zip(missing, older) if x is None]
        made = iter(make(new))
        older = [next(made) if x is None else x for x in older]
        for k, x in zip(missing, older, strict=True):
            if len(k) <= LONGEST_PIECE:
                self.young[k] = x
        later = iter(older)
        return [next(later) if x is None else x for x in found]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces with a space before each: their words and signs apart, any others whole."""
        plain: list[str] = []
        others: list[str] = []
        for p in pieces:
            (plain if p.isascii() and p.isalpha() else others).append(p)
        parts = [m and m.groups("") for m in map(PARTS.fullmatch, others)]
        found = dict(zip(plain, self._words(plain), strict=True))
        words = list({m[0] for m in parts if m}.difference(found))
        found.update(zip(words, self._cached(words, self._words), strict=True))
        bare = list({m[3] + " " for m in parts if m and m[2]})  # no piece holds a space
        found.update(zip(bare, self._cached(bare, lambda new: self._words([w[:-1] for w in new], bare=True)), strict=True))
        signs = list({m[1] + m[2] for m in parts if m} | {m[4] for m in parts if m})
        sign = dict(zip(signs, self._whole(signs), strict=True))
        rest = iter(self._whole([" " + p for p, m in zip(others, parts) if not m]))
        for p, m in zip(others, parts):
            if not m:
                found[p] = next(rest)
            elif m[2]:
                found[p] = found[m[0]] + sign[m[1] + m[2]] + found[m[3] + " "] + sign[m[4]]
            else:
                found[p] = found[m[0]] + sign[m[1]]
        return [found[p] for p in pieces]


@lru_cache(maxsize=2)
def encoder(path: str, pieces: int | None = None) -> Encoder:
    """One encoder for each worker process, file and size of cache."""
    return Encoder(path, pieces)
