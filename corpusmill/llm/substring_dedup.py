"""Substring dedup by relative Lempel-Ziv factors against the documents with smaller ids.

Documents are dealt to buckets by id: buckets are the reference blocks that hold words. An index of all windows of
``WINDOW`` words is cut into fragments of the hash space; a bucket sums up what it sends there: each distinct anchor or
window once. Every window has an anchor, the least hash of the half-size runs in it; equal windows have equal
anchors, so only windows whose anchor two documents have can occur in the reference. For those the index
tells the first place, by id and position, and the block that holds it. A window that all documents share is one
entry for each bucket, there and back.

A document is then parsed from left to right. Windows with a place in an earlier document, on one diagonal (source and
shift), are a candidate. Its words are fetched from the source's block, each range once for a bucket, with as many words
more on both sides, and compared: a factor runs as far as the words are equal. From the first window that a candidate
covers the parse takes the longest factor and jumps to its end; there it checks the windows across the end, which may lie
in another factor. So every word that is removed has been compared with a word of the source, and hashes only tell
where to compare. Candidates are the first places of windows, not all of them, and a factor grows by no more
than its candidate's length (at least ``GROW`` words) on each side: a factor may be shorter than the longest that any
document allows. The words removed do not depend on that: each window with a place lies in the factor of its own candidate.

Defined results: a null text has no words; documents shorter than a window are kept whole; a document
is never its own source, nor is a row with the same id; rows that repeat an id with one text get one
result each; a null id counts as the smallest number (as a source it is shown so, and nothing is
removed from it); an empty table gives an empty table; further columns, whatever their names, do not matter; a
long text is one slice of work of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, batches, fragments, gram_hashes, gram_starts, hexes, mix, numbers, ragged, release, stored, texts, word_hashes, word_spans
from .packed import CELLS, KNOWN, Known, cells, counted, dealt, joined, lengths, parts_of, prime, shared, short_keys, whole_numbers

WINDOW = 50

#: Words that a factor may grow by on each side of its candidate, at least.
GROW = 50

WINDOWS = "part int, bucket int, hashes binary, checks binary, docs binary, text binary, pos binary, more binary"
FOUND = "bucket int, part int, hashes binary, checks binary, src binary, src_text binary, src_pos binary, home binary"
#: Of a bucket and the block that holds the sources: candidates, and the ranges of words that they need together.
CANDIDATES = "bucket int, home int, doc binary, doc_text binary, begin binary, size binary, src binary, src_text binary, shift binary, from_src binary, from_text binary, low binary, high binary"
#: Words of sources for a bucket.
WORDS = "bucket int, home int, src binary, src_text binary, low binary, sizes binary, words binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,words:int,src:long,src_start:int>>"


def anchors(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows, anchor hash of each): the least hash of the runs of half a window in it."""
    half = window // 2
    starts = np.flatnonzero(gram_starts(first, window))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    m = gram_hashes(words, half)
    width, have = window - half + 1, 1
    while 2 * have <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return starts, m[starts]


def _text_slices(table: pa.Table):
    """(ids, bytes, offsets, hashes of the texts) of slices of documents."""
    for batch in table.select(["doc_id", "text", "h"]).to_batches():
        for ids, data, offs, i, whole in batches([batch]):
            yield ids, data, offs, np.asarray(whole.column(2).slice(i, len(ids))).view(np.uint64)


def _anchor_runs(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, document of each, where runs of one anchor in one document begin, their anchors)"""
    starts, h = anchors(words, first, window)
    doc = np.searchsorted(first, starts, side="right") - 1
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return starts, doc, head, h[head]


def _anchor_counts(window: int, n_parts: int):
    """Of one bucket: its distinct anchors by fragment, with their numbers of documents."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = []
        for _, data, offs, _ in _text_slices(table):
            words, first = word_hashes(data, offs)
            _, doc, head, h = _anchor_runs(words, first, window)
            if len(head):
                key, d = short_keys(h, n_parts), doc[head]
                order = np.lexsort((key, d))
                key, d = key[order], d[order]
                keys.append(key[np.concatenate([[True], (key[1:] != key[:-1]) | (d[1:] != d[:-1])])])
        out = counted(bucket, np.concatenate(keys) if keys else np.zeros(0, U))
        release()
        return out

    return run


def _fragment(table: pa.Table) -> pa.Table:
    out = shared(table)
    release()
    return out


def window_checks(words: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """32 bits of a hash of its own of the windows at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    return (gram_hashes(mix(words ^ U(0x2545F4914F6CDD1D)), window)[starts] >> U(32)).astype(np.uint32)


def _window_cells(window: int, n_parts: int):
    """Of one bucket: each distinct window with a live anchor, with its first place in the bucket and
    whether it is in more documents of it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, found = Known(right), []
        bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
        for ids, data, offs, text in _text_slices(left):
            words, first = word_hashes(data, offs)
            starts, doc, head, h = _anchor_runs(words, first, window)
            live = np.repeat(known(short_keys(h, n_parts))[0], np.diff(np.append(head, len(starts))))
            starts, doc = starts[live], doc[live]
            if len(starts):
                found.append((gram_hashes(words, window)[starts], window_checks(words, window, starts), numbers(ids)[doc], text[doc], (starts - first[doc]).astype(np.uint32)))
        g, c, d, t, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, k) for k in (U, np.uint32, np.int64, U, np.uint32))
        order = np.lexsort((t, p, d, c, g))
        g, c, d, t, p = g[order], c[order], d[order], t[order], p[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        head = np.flatnonzero(new)
        more = (d[np.append(head[1:], len(g)) - 1] != d[head]).astype(np.uint8) if len(g) else np.zeros(0, np.uint8)
        g, c, d, t, p = g[head], c[head], d[head], t[head], p[head]
        part = parts_of(g, n_parts).astype(np.int64)
        order = np.lexsort((p, d, part))  # neighbours in a document stay together: they shrink well
        columns = {"hashes": g, "checks": c, "docs": d, "text": t, "pos": p, "more": more}
        out = cells(part[order], bucket, {k: x[order] for k, x in columns.items()})
        release()
        return out

    return run


def _first_places(table: pa.Table) -> pa.Table:
    """Of one block: for each bucket, its windows that occur in another document, and the first place of each."""
    g, c = joined(table, "hashes", np.uint64), joined(table, "checks", np.uint32)
    d, p, more = joined(table, "docs", np.int64), joined(table, "pos", np.uint32), joined(table, "more", np.uint8)
    t = joined(table, "text", np.uint64)
    who = np.repeat(whole_numbers(table, "bucket"), lengths(table, "hashes", np.uint64))
    part = int(table.column("part")[0].as_py()) if table.num_rows else 0
    order = np.lexsort((t, p, d, c, g))
    g, c, d, t, p, more, who = g[order], c[order], d[order], t[order], p[order], more[order], who[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    first, n = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(g)))
    src, text, at, home = (np.repeat(x[first], n) for x in (d, t, p, who.astype(np.int32)))
    need = (d > src) | (more > 0)
    g, c, src, text, at, home, who = g[need], c[need], src[need], text[need], at[need], home[need], who[need]
    order = np.lexsort((at, src, who))
    columns = {"hashes": g, "checks": c, "src": src, "src_text": text, "src_pos": at, "home": home}
    out = cells(who[order], part, {k: x[order] for k, x in columns.items()}, ("bucket", "part"))
    release()
    return out


class Places:
    """The first places of a bucket's windows."""

    def __init__(self, table: pa.Table) -> None:
        g = joined(table, "hashes", np.uint64)
        order = np.argsort(g)
        self.g, self.c = g[order], joined(table, "checks", np.uint32)[order]
        self.src, self.at = joined(table, "src", np.int64)[order], joined(table, "src_pos", np.uint32)[order].astype(np.int64)
        self.text, self.home = joined(table, "src_text", np.uint64)[order], joined(table, "home", np.int32)[order]
        # most windows have no place: a table of bits answers for them
        self.mask = U((1 << max(10, (16 * len(g)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[g & self.mask] = True

    def __call__(self, words: np.ndarray, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the windows at ``starts`` have a place, where its entry is)"""
        if not len(self.g) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = gram_hashes(words, window)[starts]
        which = np.flatnonzero(self.maybe[g & self.mask])
        at = np.minimum(np.searchsorted(self.g, g[which]), len(self.g) - 1)
        same = self.g[at] == g[which]
        which, at = which[same], at[same]
        good = self.c[at] == window_checks(words, window, starts[which])
        return which[good], at[good]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _stops(head: np.ndarray, n: int) -> np.ndarray:
    """Where runs end that start at ``head``."""
    return np.append(head[1:], n)[: len(head)]


def merged_ranges(src: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one source that touch become one."""
    order = np.lexsort((low, text, src))
    src, text, low, high = src[order], text[order], low[order], high[order]
    of = np.zeros(len(src), np.int64)
    of[_runs(src, text)] = 1
    apart = np.cumsum(of) * (int(high.max(initial=0)) + 2)  # sources follow each other on one axis
    reach = np.maximum.accumulate(high + apart) if len(high) else high
    new = np.ones(len(src), bool)
    new[1:] = (low + apart)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return src[head], text[head], low[head], (reach - apart)[_stops(head, len(src)) - 1]


def _candidates(window: int, grow: int):
    """Of one bucket: the diagonals on which its documents' windows have their places, by the block of the source."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        places, found = Places(right), []
        bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
        for ids, data, offs, text in _text_slices(left):
            if not len(places.g):
                break
            words, first = word_hashes(data, offs)
            begin = np.flatnonzero(gram_starts(first, window))
            which, entry = places(words, window, begin)
            begin = begin[which]
            doc = np.searchsorted(first, begin, side="right") - 1
            pos, own = begin - first[doc], numbers(ids)[doc]
            earlier = places.src[entry] < own
            doc, pos, entry, own = doc[earlier], pos[earlier], entry[earlier], own[earlier]
            src, source, shift = places.src[entry], places.text[entry], places.at[entry] - pos
            order = np.lexsort((pos, shift, source, src, doc))
            doc, pos, own, src, source, shift, home = (x[order] for x in (doc, pos, own, src, source, shift, places.home[entry]))
            far = np.cumsum(np.concatenate([[0], np.diff(pos) > window])) if len(pos) else pos
            head = _runs(doc, src, source, shift, far)
            last = _stops(head, len(pos)) - 1
            found.append((own[head], text[doc[head]], pos[head], pos[last] - pos[head] + window, src[head], source[head], shift[head], home[head]))
        kinds = (np.int64, U, np.int64, np.int64, np.int64, U, np.int64, np.int32)
        c = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, k) for k in kinds]
        order = np.argsort(c[7], kind="stable")
        c = [x[order] for x in c]
        rows = []
        heads = _runs(c[7])
        for i, j in zip(heads.tolist(), _stops(heads, len(c[7])).tolist(), strict=True):
            doc, text, begin, size, src, source, shift, home = (x[i:j] for x in c)
            more = np.maximum(size, grow)
            ranges = merged_ranges(src, source, np.maximum(begin + shift - more, 0), begin + shift + size + more)
            rows.append([bucket, int(home[0]), *(x.tobytes() for x in (doc, text, begin, size, src, source, shift, *ranges))])
        release()
        names = [x.split(" ")[0] for x in CANDIDATES.split(", ")]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def flat_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of words, each with one space after it."""
    lens = ends - starts + 1
    stop = np.cumsum(lens)
    flat = np.append(data, np.uint8(32))[ragged(starts, lens)]
    flat[stop - 1] = 32
    return flat, np.concatenate([[0], stop])


def _replies(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one block: the ranges of words that buckets need of its documents."""
    who = np.repeat(whole_numbers(left, "bucket"), lengths(left, "from_src", np.int64))
    src, text, low, high = (joined(left, n, k) for n, k in (("from_src", np.int64), ("from_text", U), ("low", np.int64), ("high", np.int64)))
    home = int(left.column("home")[0].as_py()) if left.num_rows else 0
    order = np.lexsort((text, src))
    who, src, text, low, high = who[order], src[order], text[order], low[order], high[order]
    head = _runs(src, text)
    stop = _stops(head, len(src))
    wanted = {(int(src[i]), int(text[i])): (i, j) for i, j in zip(head.tolist(), stop.tolist(), strict=True)}
    out: dict[int, list] = {}
    for ids, data, offs, texts_ in _text_slices(right):
        if not wanted:
            break
        asked = [(d, wanted.pop(key)) for d, key in enumerate(zip(numbers(ids).tolist(), texts_.tolist(), strict=True)) if key in wanted]
        if not asked:
            continue
        starts, ends, first = word_spans(data, offs)
        for d, (i, j) in asked:
            a, b = int(first[d]), int(first[d + 1])
            flat, at = flat_words(data, starts[a:b], ends[a:b])
            for k in range(i, j):
                x, y = min(int(low[k]), b - a), min(int(high[k]), b - a)
                out.setdefault(int(who[k]), []).append((src[k], text[k], low[k], int(at[y] - at[x]), flat[at[x] : at[y]].tobytes()))
    release()
    names = [x.split(" ")[0] for x in WORDS.split(", ")]
    rows = [
        [bucket, home, *(np.array([f[c] for f in found], kind).tobytes() for c, kind in enumerate((np.int64, U, np.int64, np.int64))), b"".join(f[4] for f in found)]
        for bucket, found in out.items()
    ]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


class Sources:
    """Words of sources that a bucket has been sent."""

    def __init__(self, table: pa.Table) -> None:
        self.src, self.text, self.low = joined(table, "src", np.int64), joined(table, "src_text", U), joined(table, "low", np.int64)
        sizes, self.flat = joined(table, "sizes", np.int64), joined(table, "words", np.uint8)
        starts, ends, self.first = word_spans(self.flat, np.concatenate([[0], np.cumsum(sizes)]))
        self.hashes, _ = word_hashes(self.flat, np.concatenate([[0], np.cumsum(sizes)]))
        self.at = np.append(starts, len(self.flat))
        order = np.lexsort((self.low, self.text, self.src))
        self.of: dict[tuple[int, int], list[int]] = {}
        for k in order.tolist():
            self.of.setdefault((int(self.src[k]), int(self.text[k])), []).append(k)

    def range_at(self, src: int, text: int, place: int) -> tuple[int, int, int]:
        """(position of the first word that is here, where it is, how many words there are) of the range with a word."""
        for k in self.of.get((src, text), ()):
            low, n = int(self.low[k]), int(self.first[k + 1] - self.first[k])
            if low <= place < low + n:
                return low, int(self.first[k]), n
        return place, 0, 0


def equal_runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs [i, j) of at least ``least`` true entries."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return [(i, j) for i, j in edge.reshape(-1, 2).tolist() if j - i >= least]


def greedy(runs: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, end, src, src_start) of runs (start, end, src, src_start): from the first window that a run
    covers the longest run, then from its end, where windows across the end are checked."""
    runs = sorted(runs)
    out, least, waiting, k = [], 0, [], 0
    while True:
        while k < len(runs) and runs[k][0] <= least:
            waiting.append(runs[k])
            k += 1
        waiting = [r for r in waiting if r[1] >= least + window]
        if not waiting:
            if k == len(runs):
                return out
            least = max(least, runs[k][0])
            continue
        a, end, src, at = min(waiting, key=lambda r: (-r[1], r[2], r[3] - r[0]))
        out.append((least, end, src, at + least - a))
        least = end - window + 1


def _compared(window: int, grow: int, size: int, flat: np.ndarray, at: np.ndarray, hashes: np.ndarray, sources: Sources, candidate: tuple) -> list[tuple[int, int, int, int]]:
    """Runs of equal words along a candidate's diagonal, in a document of ``size`` words."""
    begin, length, src, text, shift = candidate
    low, where, n = sources.range_at(src, text, begin + shift)
    grow = max(length, grow)
    a, b = max(begin - grow, low - shift, 0), min(begin + length + grow, low + n - shift, size)
    if b - a < window:
        return []
    begin_src = where + a + shift - low
    found = []
    for i, j in equal_runs(hashes[a:b] == sources.hashes[begin_src : begin_src + b - a], window):
        x, y = flat[at[a + i] : at[a + j]], sources.flat[sources.at[begin_src + i] : sources.at[begin_src + j]]
        if np.array_equal(x, y):
            found.append((a + i, a + j, src, a + i + shift))
        else:  # words of one hash: compared one by one
            words, others = (bytes(z).split(b" ") for z in (x, y))
            same = np.array([p == q for p, q in zip(words, others, strict=True)][: j - i])
            found += [(a + i + p, a + i + q, src, a + i + p + shift) for p, q in equal_runs(same, window)]
    return found


def _removed(window: int, grow: int):
    """Parse the documents of a bucket and take away what the factors cover."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = right.filter(pa.compute.is_valid(right.column("doc")))
        sources, out = Sources(right.filter(pa.compute.is_null(right.column("doc")))), []
        c = [joined(mine, n, k) for n, k in (("doc", np.int64), ("doc_text", U), ("begin", np.int64), ("size", np.int64), ("src", np.int64), ("src_text", U), ("shift", np.int64))]
        of: dict[tuple[int, int], list[tuple]] = {}
        for d, t, *rest in zip(*(x.tolist() for x in c), strict=True):
            of.setdefault((d, t), []).append(tuple(rest))
        for ids, data, offs, texts_ in _text_slices(left):
            starts, ends, first = word_spans(data, offs)
            flat, at = flat_words(data, starts, ends)
            n, factors, cover = np.diff(first), [], np.zeros(len(starts) + 1, np.int64)
            hashes = word_hashes(data, offs)[0] if of else None
            valid = np.asarray(ids.is_valid())
            for d, key in enumerate(zip(numbers(ids).tolist(), texts_.tolist(), strict=True)):
                a, b = int(first[d]), int(first[d + 1])
                runs = []
                for candidate in of.get(key, ()) if valid[d] else ():
                    runs += _compared(window, grow, b - a, flat, at[a : b + 1], hashes[a:b], sources, candidate)
                parsed = greedy(runs, window)
                for i, j, *_ in parsed:
                    cover[a + i] += 1
                    cover[a + j] -= 1
                factors.append(parsed)
            gone = np.cumsum(cover[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            kept = np.flatnonzero(~gone)
            rest = flat[ragged(at[kept], at[kept + 1] - at[kept])] if gone.any() else flat
            edge = np.concatenate([[0], np.cumsum(at[kept + 1] - at[kept])])[np.searchsorted(kept, first)]
            shas = [hashlib.sha256(rest[x : max(x, y - 1)].tobytes()).digest() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            every = [f for fs in factors for f in fs]
            start, end, src, place = (np.array([f[k] for f in every], np.int64) for k in range(4))
            items = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(src), pa.array(place.astype(np.int32))], names=["start", "words", "src", "src_start"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in factors])]).astype(np.int32)), items)
            out.append(pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(total[first[1:]] - total[first[:-1]]), hexes(shas), lists], names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors"]))
        release()
        item = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("src", pa.int64()), ("src_start", pa.int32())])
        empty = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", pa.list_(item))])
        return pa.Table.from_batches(out, empty) if out else empty.empty_table()

    return run


def parse(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", grow: int = GROW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the factors of every document."""
    t = texts(docs, id_col, text_col)
    n_parts = fragments(t)
    t = dealt(t, prime(n_parts)).withColumn("h", F.xxhash64("text"))
    live = t.groupBy("bucket").applyInArrow(_anchor_counts(window, n_parts), CELLS).groupBy("part").applyInArrow(_fragment, KNOWN)
    windows = t.groupBy("bucket").cogroup(live.groupBy("bucket")).applyInArrow(_window_cells(window, n_parts), WINDOWS)
    found = windows.groupBy("part").applyInArrow(_first_places, FOUND)
    candidates = stored(t.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_candidates(window, grow), CANDIDATES), "candidates")
    ranges = candidates.select("bucket", "home", "from_src", "from_text", "low", "high")
    words = ranges.groupBy("home").cogroup(t.groupBy("bucket")).applyInArrow(_replies, WORDS)
    own = candidates.select("bucket", "doc", "doc_text", "begin", "size", "src", "src_text", "shift")
    sent = own.unionByName(words.select("bucket", "src", "src_text", "low", "sizes", "words"), allowMissingColumns=True)
    return t.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(_removed(window, grow), RESULT)
