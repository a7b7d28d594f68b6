"""Merge rounds over the symbols of many pieces at once, in flat arrays.

A symbol is a number: bytes are 0 to 255, products of merges follow. ``MergeTable`` holds the merges as sorted pair keys;
a round looks up all neighbouring pairs, takes the lowest rank of each piece and merges it wherever it occurs. Pieces
without a pair leave the arrays, so a round costs what is still to be merged.

Merging every occurrence at once equals merging pair by pair unless a merge makes a pair of lower rank than its own,
which only merge lists do whose products are used before they are made. Such pieces, and long ones, go through a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

from ..functions.bytelevel import alphabet, from_symbols

#: Symbols from which a piece is merged by the heap: n log n, where rounds over one piece can take n * n steps.
LONG = 256
NEVER = np.int32(2**31 - 1)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << 32) | right.astype(np.int64)


def alternate(hit: np.ndarray) -> np.ndarray:
    """Of runs of neighbouring hits every second one, the first included: pairs of equal symbols overlap."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at
    first = np.concatenate([[True], np.diff(at) > 1])
    begin = at[first][np.cumsum(first) - 1]
    return at[(at - begin) % 2 == 0]


class MergeTable:
    """Merges (left, right) by rank, and the symbol number of each string that they use or make."""

    def __init__(self, merges: Sequence[tuple[str, str]]) -> None:
        number = {s: b for b, s in enumerate(alphabet())}
        for a, b in merges:
            for s in (a, b, a + b):
                number.setdefault(s, len(number))
        self.symbols = list(number)
        keys = np.array([(number[a] << 32) | number[b] for a, b in merges], np.int64)
        made = np.array([number[a + b] for a, b in merges], np.int32)
        # of a pair that is listed twice the first rank counts
        self.keys, rank = np.unique(keys, return_index=True)
        self.rank, self.made = rank.astype(np.int32), made[rank] if len(rank) else made

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or ``NEVER``, place in the table) of pairs."""
        key = pair_keys(left, right)
        if not len(self.keys):
            return np.full(len(key), NEVER), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER), at

    def one(self, parts: list[int]) -> list[int]:
        """One piece, pair by pair: lowest rank first, then leftmost."""
        parts = list(parts)
        n = len(parts)
        if n < 2:
            return parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, place = self.find(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(int(r), k, parts[k], parts[k + 1], int(self.made[p])) for k, (r, p) in enumerate(zip(rank, place, strict=True)) if r != NEVER]
        heapq.heapify(heap)
        table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True)) if heap else {}
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[k], parts[j] = made, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n and (found := table.get((parts[x] << 32) | parts[after[x]])):
                    heapq.heappush(heap, (found[0], x, parts[x], parts[after[x]], found[1]))
        return [p for p in parts if p >= 0]

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, offsets) of pieces given as bytes with offsets."""
        lens = np.diff(offs)
        piece = np.repeat(np.arange(len(lens)), lens)
        alone = np.flatnonzero(lens >= LONG)
        keep = ~np.isin(piece, alone) if len(alone) else np.ones(len(piece), bool)
        sym, piece = data[keep].astype(np.int32), piece[keep]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        slow: list[int] = alone.tolist()
        while len(sym):
            rank = np.full(len(sym), NEVER)
            place = np.zeros(len(sym), np.int64)
            inner = np.flatnonzero(piece[1:] == piece[:-1])
            rank[inner], place[inner] = self.find(sym[inner], sym[inner + 1])
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            size = np.diff(np.append(first, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            settled = best == NEVER
            if settled.any():
                done.append((sym[settled], piece[settled]))
                live = ~settled
                sym, piece, rank, place, best = sym[live], piece[live], rank[live], place[live], best[live]
                if not len(sym):
                    break
            at = alternate(rank == best)
            follows = at[(at + 2 < len(sym)) & (piece[np.minimum(at + 2, len(sym) - 1)] == piece[at])]
            made = self.made[place]
            early = self.find(made[follows], sym[follows + 2])[0] < best[follows]
            odd = piece[follows[early]]
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            back = at[(at > 0)]
            left = np.maximum(np.where(stay[back - 1], back - 1, back - 2), 0)  # where merged, the product lies two back
            same = piece[left] == piece[back]
            early = self.find(sym[left[same]], sym[back[same]])[0] < best[back[same]]
            odd = np.concatenate([odd, piece[back[same][early]]])
            if len(odd):
                slow += np.unique(odd).tolist()
                stay &= ~np.isin(piece, odd)
            sym, piece = sym[stay], piece[stay]
        for p in slow:
            parts = np.array(self.one(data[offs[p] : offs[p + 1]].tolist()), np.int32)
            done.append((parts, np.full(len(parts), p)))
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(lens) + 1, np.int64)
        sym, piece = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(piece, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=len(lens)))])


class Encoder:
    """Pieces to token ids; -1 stands for a symbol that is no token."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]]) -> None:
        self.merges = MergeTable(merges)
        self.ids = np.array([vocab.get(s, -1) for s in self.merges.symbols], np.int64)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sym, offs = self.merges(data, offs)
        return self.ids[sym], offs


class Decoder:
    """Token ids to bytes."""

    def __init__(self, vocab: dict[str, int]) -> None:
        raw = {i: from_symbols(s) for s, i in vocab.items()}
        self.known = np.array(sorted(raw), np.int64)
        parts = [raw[i] for i in self.known.tolist()]
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def __call__(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of lists of ids."""
        at = np.minimum(np.searchsorted(self.known, ids), max(len(self.known) - 1, 0))
        if len(ids) and (not len(self.known) or (self.known[at] != ids).any()):
            raise ValueError("an id is no token")
        lens = self.offs[at + 1] - self.offs[at] if len(ids) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lens)])
        take = np.repeat(self.offs[at] - ends[:-1], lens) + np.arange(ends[-1]) if len(ids) else np.zeros(0, np.int64)
        return self.data[take], ends[offs]
