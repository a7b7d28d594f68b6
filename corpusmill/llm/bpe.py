"""Byte-level BPE: batched numpy merge rounds over the distinct pieces of a slice of documents.

Pieces are cut by array operations on code point classes (the result is that of the usual
byte-level pattern: contractions, an optional leading space, runs of letters, numbers or other
characters, white space that leaves its last character to the next piece). The symbols of all new
pieces lie in one flat array; each round finds the lowest-rank pair of every piece by binary search
over the sorted pair keys and merges it everywhere in that piece. A long piece is merged on its own: its
pairs wait by rank, and a round touches only the places of the lowest rank and their neighbours.
Pieces seen before come from a bounded cache of the worker.

Defined results: a null or empty text has no ids; a byte that is no UTF-8 becomes U+FFFD, as if the text had
it; every row has its result, also rows that repeat and rows without an id; an empty table gives an
empty table; further columns, whatever their names, do not matter; long texts are slices of work of their own, and the
work for a long piece grows as n log n. The tokenizer's file travels with the task, so executors need no path of their own.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import _Q, batches, hexes, ragged, span_hashes, texts

_BIG = np.int64(1) << 60
#: Pieces that a worker keeps, and bytes of them.
CACHE, CACHE_BYTES = 150_000, 16 << 20
#: Pieces of more bytes are merged on their own, and not kept.
LONG = 512

codecs.register_error("corpusmill-byte", lambda e: ("\ufffd", e.start + 1))

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_classes = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        points = np.arange(0x110000, dtype="<u4")
        points[0xD800:0xE000] = 0x21
        text = points.tobytes().decode("utf-32-le")
        out = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_NUMBER, r"\p{N}+"), (_LETTER, r"\p{L}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, text):
                out[m.start() : m.end()] = kind
        _classes = out
    return _classes


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def piece_starts(points: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where pieces start among code points; ``docs``: where texts start, and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[docs[docs < n]] = True
    first[n] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    blank = points == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first[:n]
    # the last of a run of white space, with more of the text after it
    start = run & space
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~first[1:]
    last[-1] = False
    start |= last
    start |= run & ~space & ~after_blank
    # contractions: an apostrophe that starts a piece and is a run of its own, before the letters of one
    at = np.flatnonzero((points == 0x27) & start)
    at = at[at + 1 < n]
    at = at[run[at + 1] & ~first[at + 1] & (kind[at + 1] == _LETTER)]
    if len(at):
        one = points[at + 1]
        two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n)], points[np.minimum(at + 2, n - 1)], 0)
        size = np.zeros(len(at), np.int64)
        for c in "stmd":
            size[one == ord(c)] = 1
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        rest = at + 1 + size
        start[rest[rest < n]] = True
    return np.flatnonzero(start)


class Bpe:
    """A tokenizer from the text of its JSON file."""

    def __init__(self, spec: str) -> None:
        t = json.loads(spec)
        vocab: dict[str, int] = t["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.special = sorted(((a["content"].encode(), a["id"]) for a in t.get("added_tokens", [])), key=lambda x: -len(x[0]))
        size = max([*vocab.values(), *(i for _, i in self.special)]) + 1
        table = [b""] * size
        for s, i in vocab.items():
            table[i] = bytes(back[c] for c in s)
        for s, i in self.special:
            table[i] = s
        self.token_len = np.array([len(b) for b in table], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in t["model"]["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.size = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.made_by_rank = made
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts, self.lens = array("q"), array("q")

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), sizes)
        done_word, done_sym, done_pos = [], [], []
        while len(sym):
            same = word[1:] == word[:-1]
            keys = np.where(same, sym[:-1] * self.size + sym[1:], -1)
            i = np.searchsorted(self.keys, keys)
            i[i == len(self.keys)] = 0
            rank = np.where(self.keys[i] == keys, self.rank[i], _BIG)
            rank = np.append(rank, _BIG)
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(rank, head)
            lens = np.diff(np.append(head, len(sym)))
            live = best < _BIG
            hit = (rank == np.repeat(best, lens)) & (rank < _BIG)
            at = np.flatnonzero(hit)
            if len(at):
                # of hits in a row (equal symbols), every second one stays
                fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
                group = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - group) % 2 == 0]
                sym[at] = self.made[i[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            keep_live = np.repeat(live, lens)
            over = ~keep_live
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
            stay &= keep_live
            sym, word = sym[stay], word[stay]
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        w, s = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(w, kind="stable")
        return s[order].astype(np.int32), np.bincount(w, minlength=len(pieces))

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece: places wait by the rank of their pair, and each round takes the lowest rank."""
        n = len(piece)
        sym = self.byte_id[np.frombuffer(piece, np.uint8)]
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def rank_of(at: np.ndarray) -> np.ndarray:
            nxt = after[at]
            keys = np.where(nxt < n, sym[at] * self.size + sym[np.minimum(nxt, n - 1)], -1)
            i = np.searchsorted(self.keys, keys)
            i[i == len(self.keys)] = 0
            return np.where(self.keys[i] == keys, self.rank[i], _BIG)

        def wait(at: np.ndarray) -> None:
            r = rank_of(at)
            at, r = at[r < _BIG], r[r < _BIG]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            for k, i, j in zip(r[head].tolist(), head.tolist(), [*head[1:].tolist(), len(r)], strict=True):
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(ranks, k)
                waiting[k].append(at[i:j])

        wait(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            found = waiting.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[alive[at]]
            at = at[rank_of(at) == r]
            if not len(at):
                continue
            # of places in a row (equal symbols), every second one stays
            fresh = np.concatenate([[True], at[1:] != after[at[:-1]]])
            group = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - group) % 2 == 0]
            gone = after[at]
            nxt = after[gone]
            sym[at] = self.made_by_rank[r]
            alive[gone] = False
            after[at] = nxt
            before[nxt[nxt < n]] = at[nxt < n]
            left = before[at]
            wait(np.unique(np.concatenate([left[left >= 0], at])))
        return sym[alive].astype(np.int32)

    def _put(self, at: int, ids: np.ndarray) -> int:
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at : at + len(ids)] = ids
        return at + len(ids)

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece lie in ``flat``, and how many there are, until the next call."""
        short = [p for p in pieces if len(p) <= LONG]
        new = [p for p in short if p not in self.known]
        size = sum(map(len, new))
        if len(self.known) + len(new) > CACHE or self.known_bytes + size > CACHE_BYTES:
            self.clear()
            new = short
            size = sum(map(len, new))
        if new:
            ids, lens = self.merge(new)
            at = self.used + np.cumsum(lens) - lens
            self.used = self._put(self.used, ids)
            for k, p in enumerate(new):
                self.known[p] = len(self.starts) + k
            self.starts.extend(at.tolist())
            self.lens.extend(lens.tolist())
            self.known_bytes += size
            for s, i in self.special:
                if s in self.known and (self.lens[k := self.known[s]] != 1 or self.flat[self.starts[k]] != i):
                    self.flat[self.starts[k]] = i
                    self.lens[k] = 1
        k = np.array([self.known[p] for p in short], np.int64)
        starts, lens = np.array(self.starts, np.int64)[k], np.array(self.lens, np.int64)[k]
        if len(short) == len(pieces):
            return starts, lens
        is_short = np.array([len(p) <= LONG for p in pieces])
        all_starts, all_lens = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        all_starts[is_short], all_lens[is_short] = starts, lens
        end = self.used
        for k in np.flatnonzero(~is_short).tolist():
            ids = self.merge_long(pieces[k])
            all_starts[k], all_lens[k] = end, len(ids)
            end = self._put(end, ids)
        return all_starts, all_lens

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a slice of documents, and where each document's ids begin."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        raw = data.tobytes()
        try:
            told = raw.decode("utf-8")
        except UnicodeDecodeError:
            texts = [raw[a:b].decode("utf-8", "corpusmill-byte") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            told, parts = "".join(texts), [t.encode() for t in texts]
            raw, offs = b"".join(parts), np.cumsum([0] + [len(p) for p in parts])
            data = np.frombuffer(raw, np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(told.encode("utf-32-le"), "<u4")
        cuts = [np.searchsorted(lead, offs)]
        inside = []
        if self.special:
            pattern = regex.compile(b"|".join(regex.escape(s) for s, _ in self.special))
            for m in pattern.finditer(raw):
                d = int(np.searchsorted(offs, m.start(), side="right"))
                if m.end() <= offs[d]:
                    a, b = np.searchsorted(lead, [m.start(), m.end()])
                    cuts.append(np.array([a, b]))
                    inside.append((a, b))
        at = piece_starts(points, np.unique(np.concatenate(cuts)))
        if inside:
            drop = np.zeros(len(points) + 1, bool)
            for a, b in inside:
                drop[a + 1 : b] = True
            at = at[~drop[at]]
        starts = lead[at]
        ends = np.append(starts[1:], len(data))
        h = span_hashes(data, starts, ends)
        _, first, inv = np.unique(h, return_index=True, return_inverse=True)
        h2 = span_hashes(data, starts, ends, _Q)
        if not np.array_equal(h2[first][inv], h2):  # two pieces with one hash
            _, first, inv = np.unique(np.array([raw[a:b].hex() for a, b in zip(starts, ends, strict=True)]), return_index=True, return_inverse=True)
        begin, lens = self._ids_of([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        n = lens[inv]
        ids = self.flat[ragged(begin[inv], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The decoded text of each run of ids, in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        lens = self.token_len[ids]
        flat = self.token_bytes[ragged(self.token_at[ids], lens)]
        at = np.concatenate([[0], np.cumsum(lens)])[bounds]
        out = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        try:
            for x in out:
                x.decode("utf-8")
        except UnicodeDecodeError:
            out = [x.decode("utf-8", "replace").encode() for x in out]
        return out


_made: dict[str, Bpe] = {}


def tokenizer(spec: str) -> Bpe:
    """The worker's tokenizer for this file."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(spec)
    return _made[key]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every whole text."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    def run(it):
        t = tokenizer(spec)
        for ids, data, offs, _, _ in batches(it):
            flat, at = t.encode(data, offs)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    def run(it):
        t = tokenizer(spec)
        for ids, data, offs, _, _ in batches(it, 1 << 20):
            flat, at = t.encode(data, offs)
            packed = flat.astype("<u4")
            shas = [hashlib.sha256(packed[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            back = [hashlib.sha256(x).digest() for x in t.decode(flat, at)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), hexes(shas), hexes(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
