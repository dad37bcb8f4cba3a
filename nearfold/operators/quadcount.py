"""Quadtrees from counts that fit the driver: the same trees as the tables of ``operators.quadtree``, by integer prefixes in numpy.

An address of D quadrants is a number of D base-4 digits; its prefix of d digits is that number without its last 2 (D - d) bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def digits(code: int, depth: int) -> str:
    return np.base_repr(code, 4).rjust(depth, "0")[-depth:] if depth else ""


def codes_of(addresses: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array([int(a, 4) if a else 0 for a in addresses.to_pylist()], dtype=np.int64)


class Counted:
    """Points by full address."""

    def __init__(self, table: pa.Table, depth: int):
        codes, n = codes_of(table.column("address")), table.column("n").to_numpy()
        order = np.argsort(codes)
        self.codes, self.n, self.depth = codes[order], n[order], depth

    @classmethod
    def of(cls, counted: DataFrame, depth: int) -> Counted:
        """From ``addresses`` on the driver; made once for a frame."""
        if not hasattr(counted, "_nearfold_counted"):
            counted._nearfold_counted = cls(counted._nearfold_table, depth)
        return counted._nearfold_counted

    def level(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(prefixes, counts) of the nodes at depth d that hold points."""
        prefixes = self.codes >> 2 * (self.depth - d)
        if not len(prefixes):
            return prefixes, self.n
        starts = np.flatnonzero(np.append(True, prefixes[1:] != prefixes[:-1]))
        return prefixes[starts], np.add.reduceat(self.n, starts)

    def split(self, capacity: int, kind: str) -> list[np.ndarray]:
        """The split nodes by depth."""
        crowded = []
        for d in range(self.depth):
            prefixes, counts = self.level(d)
            crowded.append(prefixes[counts > capacity])
        if kind == "all_children":
            return crowded[:1] + [np.unique((own >> 2)[:, None] * 4 + np.arange(4)) for own in crowded[1:]]
        if kind == "average_width":
            widths = [0.5 ** d for d, own in enumerate(leaves(crowded)) if len(own)]
            mean = sum(widths) / len(widths)
            return [np.arange(4**d) if 0.5**d > mean else own for d, own in enumerate(crowded)]
        return crowded

    def cells(self, split: list[np.ndarray]) -> dict[str, int]:
        """Points by leaf, for leaves that hold some."""
        depth = sum(np.isin(self.codes >> 2 * (self.depth - d), own).astype(np.int64) for d, own in enumerate(split) if len(own))
        depth = np.broadcast_to(depth, self.codes.shape)
        found: dict[str, int] = {}
        for d in np.unique(depth):
            at = depth == d
            prefixes, place = np.unique(self.codes[at] >> 2 * (self.depth - d), return_inverse=True)
            counts = np.bincount(place, weights=self.n[at]).astype(np.int64)
            found |= {digits(int(p), int(d)): int(c) for p, c in zip(prefixes, counts)}
        return found


def leaves(split: list[np.ndarray]) -> list[np.ndarray]:
    """The leaves by depth, empty ones too; the root if nothing is split."""
    if not split or not len(split[0]):
        return [np.zeros(1, np.int64)]
    out = [np.empty(0, np.int64)]
    for d, own in enumerate(split):
        children = (own[:, None] * 4 + np.arange(4)).ravel()
        out.append(np.setdiff1d(children, split[d + 1]) if d + 1 < len(split) else children)
    return out


def names(levels: list[np.ndarray]) -> list[str]:
    return [digits(int(code), d) for d, own in enumerate(levels) for code in own]
