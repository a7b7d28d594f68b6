"""BPE training over a dictionary that no machine holds: the pieces stay a table, rounds try several merges ahead.

The driver knows the counts of pairs above a threshold (``HOT`` pairs about); every other pair, and every new one until it
reaches the threshold, is less frequent than all of them. So it knows the next merge, and guesses those after it: what a merge
does to other counts is estimated on a sample of pieces (``HEAD``). A round applies the guesses to all pieces, one after
the other, and sends changes of counts by guess: of known pairs, and of new ones. With these the driver tells whether each guess
is the most frequent pair in its turn; the first that is not ends the round, and what follows is left out. So the merges are those
of merging one by one, whatever is guessed; good guesses make rounds fewer. When no known pair is left, or a product
is a token already (its old pairs then grow), the pairs are counted anew. Merged pieces are written
every ``REWRITE`` merges; between these, tasks repeat the merges since, which a lost executor does not disturb.

A row of the table is a block of pieces, so that a round costs what its arrays cost, nothing by piece.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import flat
from ..functions.bytelevel import alphabet, initial_alphabet
from ..sources.scratch import dropped, staged
from .bpe import Tokenizer
from .bpe_flat import alternate, pair_keys

#: Pairs whose counts the driver knows, about.
HOT = 32_768
#: Merges after which the merged pieces are written.
REWRITE = 16
#: Merges that a round tries at most, pieces on which they are guessed, and pairs among which.
AHEAD, HEAD, WIDE = 32, 40_000, 1024
#: Weight of an occurrence within a segment; one across segments weighs 1 - alpha of it.
UNIT = 1000
#: Entries of counts that a task holds before it adds them up.
HELD = 1 << 20

Merge = tuple[int, int, int]
Batch = list[Merge]
#: Symbols, the piece of each, whether a segment begins there (or None: nowhere), and how often each piece occurs.
Pieces = tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]


def select_batch(counts: dict[tuple[int, int], int], names: list[str], known: set[str], most: int) -> Batch:
    """The next merges (left, right, -1), at most ``most``: a prefix of the pairs by falling count and names, as far as
    no pair's count or place depends on a merge before it in the batch."""
    order = sorted(counts, key=lambda p: (-counts[p], names[p[0]], names[p[1]]))
    firsts, lasts, made, batch, k = set(), set(), set(), [], 0
    while k < len(order) and len(batch) < most:
        n = counts[order[k]]
        ties = list(takewhile(lambda p: counts[p] == n, islice(order, k, None)))  # noqa: B023
        begins = {a for a, _ in ties}
        for a, b in ties:
            # pairs that begin with a batch's right part may leave a new pair of this very count and a smaller name
            if len(batch) == most or batch and (b in firsts or a in lasts or begins & lasts):
                return batch
            batch.append((a, b, -1))
            firsts.add(a)
            lasts.add(b)
            product = names[a] + names[b]
            if a == b or product in known or product in made:
                return batch
            made.add(product)
        k += len(ties)
    return batch


def merged(pieces: Pieces, merge: Merge) -> tuple[Pieces, np.ndarray]:
    """The pieces after a merge, and which of them it changed."""
    sym, piece, cut, cnt = pieces
    a, b, made = merge
    hit = np.zeros(len(sym), bool)
    hit[:-1] = (sym[:-1] == a) & (sym[1:] == b) & (piece[1:] == piece[:-1])
    begin = alternate(hit) if a == b else np.flatnonzero(hit)  # a pair of equal symbols overlaps itself
    if not len(begin):
        return pieces, begin
    touched = piece[begin]
    stay = np.ones(len(sym), bool)
    stay[begin + 1] = False
    sym = sym.copy()
    sym[begin] = made
    return (sym[stay], piece[stay], None if cut is None else cut[stay], cnt), touched


def weighed_pairs(pieces: Pieces, across: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(pair keys, weights): neighbours in a piece, by how often the piece occurs and whether a segment begins between.
    ``of``: only of pieces that it marks."""
    sym, piece, cut, cnt = pieces
    if of is not None:
        mine = of[piece]
        sym, piece, cut = sym[mine], piece[mine], None if cut is None else cut[mine]
    inner = np.flatnonzero(piece[1:] == piece[:-1])
    weights = cnt[piece[inner]]
    return pair_keys(sym[inner], sym[inner + 1]), weights * (UNIT if cut is None else np.where(cut[inner + 1] > 0, across, UNIT))


def changed(before: Pieces, after: Pieces, touched: np.ndarray, across: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair keys, weights) that a merge takes and gives."""
    flag = np.zeros(len(before[3]), bool)
    flag[touched] = True
    taken, given = weighed_pairs(before, across, flag), weighed_pairs(after, across, flag)
    return _totals(np.concatenate([taken[0], given[0]]), np.concatenate([-taken[1], given[1]]))


def _totals(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


class _Sums:
    """Counts of a task by step and pair; equal ones are added up now and then."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size, self.most = 0, HELD

    def add(self, step: int, keys: np.ndarray, weights: np.ndarray) -> None:
        self.parts.setdefault(step, []).append((keys, weights))
        self.size += len(keys)
        if self.size > self.most:
            self.size = sum(len(self.total(k)[0]) for k in self.parts)
            self.most = max(HELD, 2 * self.size)

    def total(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        self.parts[step] = [_totals(*(np.concatenate(x) for x in zip(*self.parts[step], strict=True)))]
        return self.parts[step][0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for step in self.parts:
            keys, n = self.total(step)
            keys, n = keys[n != 0], n[n != 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), step, np.int32)), pa.array(n)], names=["pair", "step", "n"])


#: A block of pieces: all symbols (int32), symbols of each piece (int32), begins of segments (bytes, or none), counts (int64).
TABLE = "sym binary, size binary, cut binary, cnt binary"


def _block(sym: np.ndarray, size: np.ndarray, cut: np.ndarray | None, cnt: np.ndarray) -> pa.RecordBatch:
    parts = [sym.astype(np.int32), size.astype(np.int32), np.zeros(0, np.uint8) if cut is None else cut.astype(np.uint8), cnt.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["sym", "size", "cut", "cnt"])


def _blocks(batch: pa.RecordBatch) -> Iterator[Pieces]:
    for row in range(batch.num_rows):
        sym, size, cut, cnt = (np.frombuffer(batch.column(k)[row].as_buffer(), kind) for k, kind in enumerate((np.int32, np.int32, np.uint8, np.int64)))
        yield sym, np.repeat(np.arange(len(size), dtype=np.int32), size), cut if len(cut) else None, cnt


def symbol_table(counts: DataFrame, least: int) -> DataFrame:
    """Blocks of a dictionary (piece, cnt, perhaps cuts: the bytes at which a segment begins)."""
    cuts = F.col("cuts").cast("array<int>") if "cuts" in counts.columns else F.lit(None).cast("array<int>")
    rows = counts.where((F.col("cnt") >= least) & (F.octet_length("piece") > 1)).select(F.col("piece").cast("binary").alias("raw"), "cnt", cuts.alias("cuts"))

    def run(it):
        for batch in it:
            data, offs = flat(batch.column(0))
            lists, cut = batch.column(2), None
            if lists.null_count < len(lists):
                cut = np.zeros(len(data), np.uint8)
                for k, at in enumerate(lists):
                    places = np.array(at.as_py() or [], np.int64)
                    cut[offs[k] + places[(places > 0) & (places < offs[k + 1] - offs[k])]] = 1
            yield _block(data, np.diff(offs), cut, np.asarray(batch.column(1), np.int64))

    return rows.mapInArrow(run, TABLE)


def _written(table: DataFrame, merges: Batch) -> DataFrame:
    """The pieces after some merges, those of one symbol left out."""

    def run(it):
        for batch in it:
            for pieces in _blocks(batch):
                for m in merges:
                    pieces = merged(pieces, m)[0]
                sym, piece, cut, cnt = pieces
                size = np.bincount(piece, minlength=len(cnt))
                keep = size > 1
                mine = keep[piece]
                yield _block(sym[mine], size[keep], None if cut is None else cut[mine], cnt[keep])

    return table.mapInArrow(run, TABLE)


def _head(table: DataFrame, most: int) -> Pieces:
    """At most about ``most`` pieces to guess with, of all blocks, in proportion to how often they occur; together they stand for all."""

    def total(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in batch.column(3)], pa.int64())], names=["n"])

    unit = max(1, (table.mapInArrow(total, "n bigint").agg(F.sum("n")).first()[0] or 0) // most)

    def run(it):
        for batch in it:
            for sym, piece, cut, cnt in _blocks(batch):
                ends = np.cumsum(np.bincount(piece, minlength=len(cnt)))
                took = np.cumsum(np.minimum(cnt, unit)) // unit
                at = np.flatnonzero(np.diff(took, prepend=0)).tolist()
                spans = [(int(ends[k - 1]) if k else 0, int(ends[k])) for k in at]
                cuts = [b"" if cut is None else cut[a:b].tobytes() for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([sym[a:b].tobytes() for a, b in spans], pa.binary()), pa.array(cuts, pa.binary()), pa.array(np.maximum(cnt[at], unit))], names=["sym", "cut", "n"])

    rows = table.mapInArrow(run, "sym binary, cut binary, n bigint").collect()
    parts = [np.frombuffer(r.sym, np.int32) for r in rows]
    flags = [np.frombuffer(r.cut, np.uint8) if r.cut else np.zeros(len(p), np.uint8) for r, p in zip(rows, parts, strict=True)]
    piece = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    cut = np.concatenate(flags) if any(r.cut for r in rows) else None
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), piece.astype(np.int64), cut, np.array([r.n for r in rows], np.int64)


def pair_counts(table: DataFrame, across: int = UNIT) -> DataFrame:
    """(pair, n) of all pieces, combined in tasks first."""

    def run(it):
        sums = _Sums()
        for batch in it:
            for pieces in _blocks(batch):
                sums.add(0, *_totals(*weighed_pairs(pieces, across)))
        yield from sums.batches()

    return table.mapInArrow(run, "pair bigint, step int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0")


def changes(table: DataFrame, before: Batch, steps: Batch, hot: np.ndarray, first_new: int, across: int = UNIT) -> DataFrame:
    """(pair, by): how each of ``steps`` changes counts after the merges ``before`` and the steps before it, of pairs in ``hot``
    (sorted) and of pairs with a symbol from ``first_new`` on."""

    def run(it):
        sums = _Sums()
        for batch in it:
            for pieces in _blocks(batch):
                for m in before:
                    pieces = merged(pieces, m)[0]
                for k, m in enumerate(steps):
                    after, touched = merged(pieces, m)
                    if len(touched):
                        keys, w = changed(pieces, after, touched, across)
                        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                        asked = (hot[at] == keys) | ((keys >> 32) >= first_new) | ((keys & 0xFFFFFFFF) >= first_new)
                        sums.add(k, keys[asked], w[asked])
                    pieces = after
        yield from sums.batches()

    by = [F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)) for k in range(len(steps))]
    return table.mapInArrow(run, "pair bigint, step int, n bigint").groupBy("pair").agg(F.array(*by).alias("by"))


def best(counts: dict[tuple[int, int], int], names: list[str]) -> tuple[int, int]:
    """The most frequent pair; of several the one with the smallest names."""
    n = max(counts.values())
    return min((p for p, m in counts.items() if m == n), key=lambda p: (names[p[0]], names[p[1]]))


def foreseen(counts: dict[tuple[int, int], int], names: list[str], number: dict[str, int], head: Pieces, most: int, across: int) -> Batch:
    """The next merge and guesses of those after it, at most ``most``. One whose product is there already is the last."""
    counts, names, number, steps = dict(counts), list(names), dict(number), []
    while counts and len(steps) < most:
        a, b = best(counts, names)
        if counts[a, b] <= 0:
            break
        product = names[a] + names[b]
        steps.append((a, b, number.get(product, len(names))))
        if product in number:
            break
        c = number[product] = len(names)
        names.append(product)
        after, touched = merged(head, steps[-1])
        if len(touched):
            for key, n in zip(*(x.tolist() for x in changed(head, after, touched, across)), strict=True):
                p = (key >> 32, key & 0xFFFFFFFF)
                if p in counts or c in p:
                    counts[p] = counts.get(p, 0) + n
        head = after
        counts.pop((a, b))
    return steps


def _unpacked(rows) -> dict[tuple[int, int], int]:
    return {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.n for r in rows}


def _top(counts: DataFrame, hot: int) -> tuple[dict[tuple[int, int], int], int]:
    """The most frequent pairs, and the count that all others are below."""
    while True:
        rows = counts.orderBy(F.desc("n")).limit(hot).collect()
        if len(rows) < hot:
            return _unpacked(rows), 1
        floor = rows[-1].n + 1
        found = _unpacked(r for r in rows if r.n >= floor)
        if found:
            return found, floor
        hot *= 2  # all of one count


def train(counts: DataFrame, size: int, least: int = 2, alpha: float = 0.0, hot: int = HOT, rewrite: int = REWRITE) -> Tokenizer:
    """A tokenizer of at most ``size`` tokens from a dictionary (piece, cnt): bytes, then products of the most frequent pairs.

    Ties go to the smaller pair. With ``cuts`` (array<int>) in the dictionary, an occurrence of a pair with a segment's
    begin between its parts weighs ``1 - alpha``: 0 is plain BPE, 1 never merges across segments.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha is between 0 and 1")
    across = round(UNIT * (1 - alpha))
    names, vocab = list(alphabet()), {s: k for k, s in enumerate(initial_alphabet())}
    number = {s: k for k, s in enumerate(names)}
    table = staged(symbol_table(counts, least), "bpe-pieces")
    head = _head(table, HEAD)
    merges: list[tuple[str, str]] = []
    pending: Batch = []
    known, floor, ahead = None, 1, AHEAD // 2
    while len(vocab) < size:
        if known is None:
            if pending:
                table, pending = dropped(table, staged(_written(table, pending), "bpe-pieces")), []
            known, floor = _top(pair_counts(table, across), hot)
            if not known:
                break
        ready = {p: n for p, n in known.items() if n >= floor}
        if not ready:
            known = None  # pairs below the threshold come next
            continue
        least_wide = min(heapq.nlargest(WIDE, ready.values()))
        wide = {p: n for p, n in ready.items() if n >= least_wide}
        sure = select_batch(wide, names, set(vocab), size - len(vocab))
        if len({names[a] + names[b] for a, b, _ in sure} - vocab.keys()) == size - len(vocab):  # the last ones need no counts
            for a, b, _ in sure:
                merges.append((names[a], names[b]))
                vocab[names[a] + names[b]] = len(vocab)
            break
        steps, first_new, told = foreseen(wide, names, number, head, min(ahead, size - len(vocab)), across), len(names), None
        came = len(merges)
        for k, (a, b, c) in enumerate(steps):
            ready = {p: n for p, n in known.items() if n >= floor}
            if not ready or best(ready, names) != (a, b):
                break
            product = names[a] + names[b]
            merges.append((names[a], names[b]))
            pending.append((a, b, c))
            head = merged(head, (a, b, c))[0]
            vocab.setdefault(product, len(vocab))
            if product in number:
                known = None  # pairs of a token that was there already have grown unseen
                break
            number[product] = c
            names.append(product)
            if len(vocab) >= size:
                break
            if told is None:
                keys = np.array(sorted((x << 32) | y for x, y in known), np.int64)
                found = changes(table, pending[:-1], steps, keys, first_new, across)
                old = (F.shiftright("pair", 32) < first_new) & (F.col("pair").bitwiseAND(0xFFFFFFFF) < first_new)
                # a new pair grows in one step, that of its younger symbol
                rows = found.where(old | (F.array_max("by") >= floor)).toArrow()
                pairs, told = rows["pair"].to_numpy(), rows["by"].combine_chunks().flatten().to_numpy().reshape(-1, len(steps))
            (at,) = told[:, k].nonzero()
            for key, n in zip(pairs[at].tolist(), told[at, k].tolist(), strict=True):
                p = (key >> 32, key & 0xFFFFFFFF)
                known[p] = known.get(p, 0) + n
            known.pop((a, b), None)
        ahead = min(AHEAD, max(4, 2 * (len(merges) - came)))
        if known is not None and len(known) > 4 * hot:  # the least frequent of them are left to the next count
            floor = sorted(known.values())[-2 * hot] + 1
            known = {p: n for p, n in known.items() if n >= floor}
        if len(pending) >= rewrite:
            table, pending = dropped(table, staged(_written(table, pending), "bpe-pieces")), []
    dropped(table, None)
    return Tokenizer(vocab, tuple(merges))
