"""Byte-level BPE: encoding and decoding in Arrow batches, without a shuffle.

Also plain training on the driver (``bpe_training`` has the one for corpora), reachability of tokens and merges, and the
tokenizer's files.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytelevel import alphabet, from_symbols, initial_alphabet, to_symbols
from ..functions.pretok import pretokenize, repair_bytes, with_prefix_space
from ..sources.scratch import dropped, staged
from .bpe_flat import Decoder, Encoder


@dataclass(frozen=True)
class Tokenizer:
    """Vocabulary (token -> id) and merges in order of priority."""

    vocab: dict[str, int]
    merges: tuple[tuple[str, str], ...]
    prefix_space: bool = False
    recover: bool = False

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {m: k for k, m in reversed(list(enumerate(self.merges)))}

    @staticmethod
    def from_files(vocab_path: str, merges_path: str, **kw) -> Tokenizer:
        with open(vocab_path, encoding="utf-8") as f:
            pairs = json.load(f, object_pairs_hook=list)
        if len({t for t, _ in pairs}) != len(pairs):
            raise ValueError("a token occurs twice")
        with open(merges_path, encoding="utf-8") as f:
            lines = [x.rstrip("\n") for x in f]
        merges = tuple(tuple(x.split(" ", 1)) for x in lines if x and not x.startswith("#version"))
        return Tokenizer(dict(pairs), merges, **kw)

    @staticmethod
    def from_json(path: str, **kw) -> Tokenizer:
        """The model of a ``tokenizer.json``; its special tokens are not looked for in texts."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = tuple(tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"])
        return Tokenizer(model["vocab"], merges, **kw)

    def save(self, vocab_path: str, merges_path: str) -> None:
        with open(vocab_path, "w", encoding="utf-8") as f:
            json.dump(self.vocab, f, ensure_ascii=False)
        with open(merges_path, "w", encoding="utf-8") as f:
            f.write("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in self.merges))

    def piece(self, text: str) -> list[int] | None:
        """Ids of one pre-token; None where a symbol is no token. Pairs wait in a heap by rank and place."""
        parts: list[str | None] = list(to_symbols(text.encode()))
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = ((self.ranks.get((a, b)), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        heap = [(r, k) for r, k in found if r is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if parts[k] is None or j >= n or self.merges[r] != (parts[k], parts[j]):
                continue  # one of the two has been merged since
            parts[k], parts[j] = parts[k] + parts[j], None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n and (r := self.ranks.get((parts[x], parts[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x))
        ids = [self.vocab.get(p) for p in parts if p is not None]
        return None if None in ids else ids

    def decode(self, ids: list[int]) -> str:
        back = {i: t for t, i in self.vocab.items()}
        return repair_bytes(from_symbols("".join(back[i] for i in ids)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted((i, t) for t, i in self.vocab.items()), "id long, token string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(self.merges)], "rank int, left string, right string")


def encode(docs: DataFrame, t: Tokenizer, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tokens). Pieces come from the JVM's regular expression; merges run in Arrow batches over the distinct pieces
    of about ``SLICE`` symbols at a time, so no token is shuffled. The merge table reaches each worker once.

    A piece with an unknown symbol fails the job or, with ``recover``, makes its whole document empty.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc).alias("doc"), pretokenize(with_prefix_space(c) if t.prefix_space else c).alias("pieces"))
    table, recover = docs.sparkSession.sparkContext.broadcast(Encoder(t.vocab, t.merges)), t.recover

    def run(it):
        for batch in it:
            pieces = batch.column(1)
            begin = np.asarray(pieces.offsets, np.int64)
            for i, j in _slices(np.asarray(pc.fill_null(pc.list_value_length(pieces), 0), np.int64)):
                ids, offs = _encoded(table.value, pieces.values.slice(begin[i], begin[j] - begin[i]), begin[i : j + 1] - begin[i], recover)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc", "tokens"])

    return rows.mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, tokens array<int>")


#: Entries (pieces, tokens) that one numpy step works on, but for a longer document.
SLICE = 1 << 18


def _slices(lens: np.ndarray):
    """Ranges of rows with at most ``SLICE`` entries together, or one row."""
    ends = np.cumsum(lens)
    i = 0
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, side="right")))
        yield i, j
        i = j


def _encoded(encoder: Encoder, pieces: pa.Array, offs: np.ndarray, recover: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by document) of pieces with offsets by document; each distinct piece is merged once."""
    coded = pieces.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary())
    _, o, d = words.buffers()
    at = np.frombuffer(o, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(d, np.uint8)[at[0] : at[-1]] if len(words) and d is not None and d.size else np.zeros(0, np.uint8)
    ids, ends = encoder(data, at - at[0])
    which = np.asarray(coded.indices, np.int64)
    lens = np.diff(ends)[which]
    total = np.concatenate([[0], np.cumsum(lens)])
    flat = ids[np.repeat(ends[:-1][which] - total[:-1], lens) + np.arange(total[-1])]
    out = total[offs]
    if (flat < 0).any():
        if not recover:
            raise ValueError("unknown symbol")
        row = np.repeat(np.arange(len(out) - 1), np.diff(out))
        lost = np.unique(row[flat < 0])
        flat, size = flat[~np.isin(row, lost)], np.diff(out)
        size[lost] = 0
        out = np.concatenate([[0], np.cumsum(size)])
    return flat, out


def decode(tokens: DataFrame, t: Tokenizer) -> DataFrame:
    """(doc, text) of (doc, tokens): bytes of the tokens, joined in Arrow batches; broken UTF-8 is repaired."""
    table = tokens.sparkSession.sparkContext.broadcast(Decoder(t.vocab))

    def run(it):
        for batch in it:
            lists = batch.column(1)
            begin = np.asarray(lists.offsets, np.int64)
            for i, j in _slices(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)):
                ids = np.asarray(lists.values.slice(begin[i], begin[j] - begin[i])).astype(np.int64)
                data, offs = table.value(ids, begin[i : j + 1] - begin[i])
                raw = data.tobytes()
                texts = [repair_bytes(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(texts, pa.string())], names=["doc", "text"])

    kind = dict(tokens.dtypes)["tokens"]
    rows = tokens.select("doc", F.col("tokens").cast("array<int>" if kind == "array<int>" else "array<long>").alias("tokens"))  # ints stay as small as they are
    return rows.mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, text string")


def reachable(vocab: dict[str, int], merges) -> set[str]:
    """Tokens that merging can make: symbols, then concatenations of reachable pairs, in one pass by rank."""
    found = {s for s in initial_alphabet() if s in vocab}
    for a, b in merges:
        if a in found and b in found:
            found.add(a + b)
    return found


def reach_ranks(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """(token, since): tokens that merging can make, and the rank of the first merge that makes each (-1: a symbol).

    A merge counts where merges of lower ranks, or the alphabet, make both its parts: one pass in the order of ranks, as a
    fixpoint. Each round joins the merges with what is reached so far, keeps the least rank of each product and is
    written; it ends when a round reaches nothing new or earlier. Rounds are as many as merges build on each other.
    """
    spark = vocab.sparkSession
    symbols = spark.createDataFrame([(s,) for s in initial_alphabet()], "token string")
    found = staged(vocab.join(F.broadcast(symbols), "token", "left_semi").select("token", F.lit(-1).alias("since")).distinct(), "reach")
    size, before = found.agg(F.count(F.lit(1)), F.sum(F.col("since").cast("long"))).first(), None
    while size != before:
        left, right = found.toDF("left", "l"), found.toDF("right", "r")
        made = merges.join(left, "left").join(right, "right").where("l < rank AND r < rank").select(F.concat("left", "right").alias("token"), F.col("rank").alias("since"))
        after = staged(found.union(made).groupBy("token").agg(F.min("since").alias("since")), "reach")
        found, before = dropped(found, after), size
        size = found.agg(F.count(F.lit(1)), F.sum(F.col("since").cast("long"))).first()
    return found


def token_reach(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, token, reachable) of a vocabulary (id, token) and its merges (rank, left, right)."""
    r = reach_ranks(vocab, merges).select("token", F.lit(True).alias("reachable"))
    return vocab.join(r, "token", "left").select("id", "token", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def merge_reach(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """(rank, left, right, reachable): whether the product is reachable, by whatever merge."""
    r = reach_ranks(vocab, merges).select("token", F.lit(True).alias("reachable"))
    return merges.withColumn("token", F.concat("left", "right")).join(r, "token", "left").select("rank", "left", "right", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def reachable_tokens(t: Tokenizer, spark: SparkSession) -> DataFrame:
    return token_reach(t.table(spark), t.merge_table(spark))


def reachable_merges(t: Tokenizer, spark: SparkSession) -> DataFrame:
    return merge_reach(t.table(spark), t.merge_table(spark))


def train(counts: DataFrame, size: int, least: int = 2) -> Tokenizer:
    """Plain BPE over a dictionary (piece, cnt): Spark counts the corpus, the driver merges.

    The driver holds the dictionary's pieces with at least ``least`` occurrences. Ties go to the
    smaller pair.
    """
    words = [(list(to_symbols(r.piece.encode())), r.cnt) for r in counts.where(F.col("cnt") >= least).toLocalIterator()]
    vocab = {s: k for k, s in enumerate(initial_alphabet())}
    pairs: Counter = Counter()
    where: dict = defaultdict(set)
    for k, (parts, n) in enumerate(words):
        for p in zip(parts, parts[1:], strict=False):
            pairs[p] += n
            where[p].add(k)
    merges = []
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    while len(vocab) < size and heap:
        n, pair = heapq.heappop(heap)
        if pairs.get(pair, 0) != -n or n >= 0:
            continue  # its count has changed since; the new one is in the heap too
        merges.append(pair)
        vocab.setdefault(pair[0] + pair[1], len(vocab))
        changed = set()
        for k in list(where.pop(pair)):
            parts, n = words[k]
            for p in zip(parts, parts[1:], strict=False):
                pairs[p] -= n
                changed.add(p)
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            words[k] = (out, n)
            for p in zip(out, out[1:], strict=False):
                pairs[p] += n
                where[p].add(k)
                changed.add(p)
        pairs.pop(pair, None)
        for p in changed:
            if pairs.get(p, 0) > 0:
                heapq.heappush(heap, (-pairs[p], p))
            else:
                pairs.pop(p, None)
    return Tokenizer(vocab, tuple(merges))


def trim_tokenizer(t: Tokenizer, size: int, config: str = "") -> tuple[Tokenizer, str]:
    """Tokens below ``size`` and their merges; the old size in a configuration text becomes the new one."""
    vocab = {s: i for s, i in t.vocab.items() if i < size}
    kept = tuple(m for m in t.merges if m[0] + m[1] in vocab)
    return Tokenizer(vocab, kept, t.prefix_space, t.recover), re.sub(rf"\b{len(t.vocab)}\b", str(size), config)


def unused_by_design() -> list[int]:
    """Fixed ids 177 to 187: the places of U+00F5 to U+00FF, bytes that UTF-8 never has."""
    order = initial_alphabet()
    ids = [order.index(alphabet()[b]) for b in range(0xF5, 0x100)]
    assert ids == list(range(177, 188))
    return ids


def unused_tokens(t: Tokenizer, spark: SparkSession) -> DataFrame:
    """Ids that merging cannot reach."""
    return reachable_tokens(t, spark).where(~F.col("reachable")).select("id")
