"""Merging of shards' Burrows-Wheeler transforms by interleave refinement.

This is the method that op10 was to use. It gives right results, and the tests hold them against brute force; the README
has what it costs, which is why :mod:`cadenza.llm.repeats` does not work by it. A shard's transform lists the symbol
before each suffix in suffix order. Two shards merge without sorting their suffixes again: an interleave, which says what
shard each suffix of the merged order is from, starts with the one shard before the other, and each pass refines it by one
more symbol, by dealing its entries stably to the symbols before them. Where neighbours part for the first time in pass
k, their common prefix has k - 1 symbols; what never parts in ``depth`` passes are intervals of strings of that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbol that ends a text; bytes count from 1.
END = 0


@dataclass
class Shard:
    """Suffixes in the order of their first symbols: the symbol before each, its place in the shards' bytes, and whether an interval of equal prefixes begins there."""

    before: np.ndarray
    place: np.ndarray
    starts: np.ndarray
    texts: int


def build(texts: list[bytes], base: int = 0) -> Shard:
    """The transform of one shard, whose first byte is number ``base`` of all; each text and its end mark take their length and one."""
    symbols = np.concatenate([np.append(np.frombuffer(t, dtype=np.uint8).astype(np.int16) + 1, np.int16(END)) for t in texts])
    n, ends = len(symbols), symbols == END
    # End marks differ: each is a rank of its own, in text order.
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + len(texts))
    order, step = np.argsort(rank, kind="stable"), 1
    while step < n:
        following = np.append(rank[step:], np.full(min(step, n), -1))[:n]
        order = np.lexsort((following, rank))
        fresh = np.append(True, (rank[order][1:] != rank[order][:-1]) | (following[order][1:] != following[order][:-1]))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            break
        step *= 2
    return Shard(np.append(symbols[-1:], symbols[:-1])[order], order + base, np.ones(n, dtype=bool), len(texts))


def merge(a: Shard, b: Shard, depth: int) -> tuple[Shard, np.ndarray]:
    """The merged shard, ordered by the first ``depth`` symbols, and each suffix's common prefix with the one before it (``depth`` or more count as depth)."""
    n, texts = len(a.before) + len(b.before), a.texts + b.texts
    source = np.repeat(np.array([0, 1], dtype=np.uint8), (len(a.before), len(b.before)))
    block, common = np.zeros(n, dtype=np.int32), np.full(n, depth, dtype=np.int32)
    ends = np.repeat(np.array([0, 1], dtype=np.uint8), (a.texts, b.texts))
    symbols = np.empty(n, dtype=np.int16)
    for k in range(depth):
        symbols[source == 0], symbols[source == 1] = a.before, b.before
        order = np.argsort(symbols, kind="stable")
        source, dealt, symbol = source[order], block[order], symbols[order]
        source[:texts] = ends
        apart = np.append(True, (symbol[1:] != symbol[:-1]) | (dealt[1:] != dealt[:-1]))
        apart[: texts + 1] = True
        common[apart & (common == depth)] = k
        block = np.cumsum(apart, dtype=np.int32)
    before, place = np.empty(n, dtype=np.int16), np.empty(n, dtype=np.int64)
    for s, shard in enumerate((a, b)):
        before[source == s], place[source == s] = shard.before, shard.place
    return Shard(before, place, common < depth, texts), common


def repeated(shard: Shard) -> np.ndarray:
    """Places of the suffixes in intervals of at least two, in text order: their first ``depth`` symbols start elsewhere too."""
    alone = shard.starts & np.append(shard.starts[1:], True)
    return np.sort(shard.place[~alone])
