"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

1. Documents are dealt to buckets by id. Every document's set of shingle hashes is cut into fragments of
   the hash space; a bucket sends each distinct shingle once, with its number of documents, and the
   fragment tells back which shingles two documents have and how many. So a shingle of all documents
   is one entry for each bucket. Shingles of one document only cannot be shared: they are counted
   (they come first in the global order, rarest first) and go no further.
2. A document that shares too few n-grams to reach the threshold with anything is done. The others
   keep their shared n-grams and the prefix of the global order that any linked pair must meet in.
3. Documents with the same set form one class, of which the smallest id stands for all.
4. Candidates meet by prefix n-gram: first each document with the first of its posting (a star, not
   all pairs); partial overlaps are counted in each vertical fragment and summed per pair. Then only
   pairs of one posting are counted whose ends the stars' links have not already connected. The members of
   a long posting are dealt to blocks, and pairs of blocks are compared apart from each other. Every
   link joins documents that the result has in one component, and no pair within a large group is
   listed twice.

Defined results: null and wordless texts have an empty set and no link; texts of fewer words than a
shingle have their whole sequence; rows that repeat an id are one document for links (their shingles are united)
and have the size of their own text each; a row without an id cannot be named by a component: it has its
size, a null component and no link. An empty table gives an empty table; further columns, whatever their names,
do not matter; long texts are hashed by arrays of their own. Hashes have 64 bits; a pair is compared on its own
sets, so a wrong match takes two n-grams of one pair with one hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, batches, discard, fragments, gram_hashes, gram_starts, numbers, release, stored, texts, word_hashes
from .components import components
from .packed import CELLS, KNOWN, Known, counted, dealt, prime, shared, short_keys, take_ranges

SHINGLE = 5
PERCENT = 75
#: Vertical fragments in which the overlap of a pair is counted.
VERTICAL = 8
#: 64-bit words of the bitmap of a document's shared n-grams.
WORDS = 8
#: Places that the members of a class are dealt to.
SALT = 64
#: Members of a posting that meet in one task, about.
BLOCK = 1024

SETS = "doc long, n_shingles long, row boolean, n long, shared long, bits array<long>, same string, prefix array<long>, segments array<array<long>>"


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice, and where each set begins."""
    words, first = word_hashes(data, offs, lower=True)
    n = np.diff(first)
    docs = len(n)
    per = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(per)])
    vals = np.zeros(at[-1], U)
    long = np.repeat(n >= k, per)
    if len(words) >= k:
        vals[long] = gram_hashes(words, k)[np.flatnonzero(gram_starts(first, k))]
    for w in range(1, k):
        few = np.flatnonzero(n == w)
        if len(few):
            vals[at[few]] = gram_hashes(words, w)[first[few]]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        vals[a:b].sort()
    new = np.ones(len(vals), bool)
    new[1:] = vals[1:] != vals[:-1]
    new[at[:-1][per > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    assert docs + 1 == len(at)
    return vals[new], total[at]


def _text_slices(table: pa.Table):
    for batch in table.select(["doc_id", "text"]).to_batches():
        yield from batches([batch])


def _counts(k: int, n_parts: int):
    """Of one bucket: its distinct shingles by fragment, with their numbers of documents."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = []
        for ids, data, offs, _, _ in _text_slices(table):
            vals, at = shingle_sets(data, offs, k)
            if ids.null_count:  # no document without an id
                vals = vals[np.repeat(np.asarray(ids.is_valid()), np.diff(at))]
            keys.append(short_keys(vals, n_parts))
        out = counted(bucket, np.concatenate(keys) if keys else np.zeros(0, U))
        release()
        return out

    return run


def _fragment(table: pa.Table) -> pa.Table:
    out = shared(table)
    release()
    return out


def _sets(k: int, percent: int, n_parts: int):
    """Of one bucket: a row for each text with the size of its set and, where the document could reach the
    threshold, its prefix and fragments. A repeated id has one more row, which is no text's, with its set."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = Known(right), []
        every = left.column("doc_id").drop_null().to_numpy()
        ids, n = np.unique(every, return_counts=True)
        twice, held = ids[n > 1], {}
        for ids, data, offs, _, _ in _text_slices(left):
            vals, at = shingle_sets(data, offs, k)
            size, number = np.diff(at), numbers(ids)
            own = np.asarray(ids.is_valid())
            if len(twice):
                again = own & np.isin(number, twice)
                for d in np.flatnonzero(again).tolist():
                    held.setdefault(int(number[d]), []).append(vals[at[d] : at[d + 1]])
                own &= ~again
            out.append(_rows(ids, size, True, vals, at, own, known, percent, n_parts))
        if held:
            union = [np.unique(np.concatenate(x)) for x in held.values()]
            at = np.cumsum([0] + [len(x) for x in union])
            out.append(_rows(pa.array(list(held), pa.int64()), np.diff(at), False, np.concatenate(union), at, np.ones(len(union), bool), known, percent, n_parts))
        release()
        return pa.concat_tables(out) if out else _EMPTY.empty_table()

    return run


_EMPTY = pa.schema(
    [("doc", pa.int64()), ("n_shingles", pa.int64()), ("row", pa.bool_()), ("n", pa.int64()), ("shared", pa.int64()), ("bits", pa.list_(pa.int64())), ("same", pa.string()), ("prefix", pa.list_(pa.int64())), ("segments", pa.list_(pa.list_(pa.int64())))]
)


def _lists(values: np.ndarray, lens: np.ndarray, mask: np.ndarray) -> pa.Array:
    """One list for each row where ``mask`` holds, null elsewhere."""
    full = np.zeros(len(mask), np.int64)
    full[mask] = lens
    bounds = pa.array(np.concatenate([[0], np.cumsum(full)]).astype(np.int32), mask=np.append(~mask, False))
    return pa.ListArray.from_arrays(bounds, values if isinstance(values, pa.Array) else pa.array(values))


def _rows(ids: pa.Array, size: np.ndarray, row: bool, vals: np.ndarray, at: np.ndarray, own: np.ndarray, known: Known, percent: int, n_parts: int) -> pa.Table:
    """``SETS`` of documents with sorted sets; those that are not ``own`` have their size only."""
    hit, rarity = known(short_keys(vals, n_parts))
    total = np.concatenate([[0], np.cumsum(hit)])
    have = total[at[1:]] - total[at[:-1]]
    live = own & (size > 0) & (100 * have >= percent * size)
    pick = np.repeat(live, size) & hit
    hs, rs = vals[pick], rarity[pick]
    have, n = have[live], size[live]
    docs = int(live.sum())
    first = np.concatenate([[0], np.cumsum(have)])
    who = np.repeat(np.arange(docs), have)
    bits = np.zeros((docs, WORDS), U)
    place = ((hs >> U(40)) % U(64 * WORDS)).astype(np.int64)
    np.bitwise_or.at(bits, (who, place >> 6), U(1) << (place & 63).astype(U))
    # the prefix: unshared n-grams come first, then the rarest shared ones
    need = n + percent * n // -100 + 1 - (n - have)
    by = np.lexsort((hs, rs, who))
    prefix = take_ranges(hs[by], first[:-1], need)
    same: list[str | None] = [None] * len(size)
    for d, a, b, whole in zip(np.flatnonzero(live).tolist(), first[:-1].tolist(), first[1:].tolist(), (have == n).tolist(), strict=True):
        if whole:
            same[d] = hashlib.blake2b(hs[a:b].tobytes(), digest_size=16).hexdigest()
    per = np.bincount(who * VERTICAL + (hs >> U(61)).astype(np.int64), minlength=docs * VERTICAL)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(hs.view(np.int64)))
    full_n, full_have = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    full_n[live], full_have[live] = n, have
    cols = [
        ids, pa.array(size.astype(np.int64)), pa.array(np.full(len(size), row)), pa.array(full_n, mask=~live), pa.array(full_have, mask=~live),
        _lists(bits.ravel().view(np.int64), np.full(docs, WORDS), live), pa.array(same, pa.string()), _lists(prefix.view(np.int64), need, live), _lists(inner, np.full(docs, VERTICAL), live),
    ]
    return pa.Table.from_arrays(cols, names=_EMPTY.names)


def document_sets(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SETS`` of all texts, stored."""
    t = texts(docs, id_col, text_col)
    n_parts = fragments(t)
    t = dealt(t, prime(n_parts))
    known = t.groupBy("bucket").applyInArrow(_counts(k, n_parts), CELLS).groupBy("part").applyInArrow(_fragment, KNOWN)
    return stored(t.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_sets(k, percent, n_parts), SETS), "ngram-sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the threshold: overlaps counted by fragment, summed by pair."""
    s = sets.select("doc", F.posexplode("segments").alias("part", "seg")).where(F.size("seg") > 0)
    left = s.select(F.col("doc").alias("a"), "part", F.col("seg").alias("sa"))
    right = s.select(F.col("doc").alias("b"), "part", F.col("seg").alias("sb"))
    overlap = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o"))
    total = overlap.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _possible(na, sa, nb, sb, percent: int):
    """Whether sets of these sizes, of which so many n-grams are shared with any document, could link."""
    need = percent * (na + nb)
    return ((100 + percent) * sa >= need) & ((100 + percent) * sb >= need)


def links(sets: DataFrame, percent: int = PERCENT) -> list[DataFrame]:
    """Of ``document_sets``: stored tables of links (a, b) that connect all that is linked: between class
    representatives by stars, by the rest, and of each class's members with its representative."""
    sets = sets.where("n is not null")
    # a class may hold a third of all rows: its least id meets its members in SALT places
    whole = sets.where("same is not null").select("doc", "same", F.pmod(F.xxhash64("doc"), F.lit(SALT)).cast("int").alias("salt"))
    least = whole.groupBy("same").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1")
    least = least.select("same", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    classes = stored(whole.join(least, ["same", "salt"]).where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b")), "ngram-classes")
    postings = sets.select("doc", "n", "shared", "prefix").join(classes.select(F.col("b").alias("doc")), "doc", "left_anti")
    postings = stored(postings.select("doc", "n", "shared", F.explode("prefix").alias("gram")), "ngram-postings")
    # the hub of a posting: the document with the fewest n-grams of its own, as an original has among its copies
    hubs = postings.groupBy("gram").agg(F.min(F.struct((F.col("n") - F.col("shared")).alias("own"), "doc", "n", "shared")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    hubs = hubs.select("gram", F.col("hub.doc").alias("a"), F.col("hub.n").alias("na"), F.col("hub.shared").alias("sa"))
    stars = postings.join(hubs, "gram").where("doc <> a").where(_possible(F.col("na"), F.col("sa"), F.col("n"), F.col("shared"), percent))
    stars = stored(stars.select("a", F.col("doc").alias("b"), "na", F.col("n").alias("nb")).distinct(), "ngram-stars")
    found = stored(_linked(stars, sets, percent), "ngram-links")
    met = components(found).select(F.col("node").alias("doc"), "component")
    tagged = postings.join(met, "doc", "left").select("doc", "n", "shared", "gram", F.coalesce("component", "doc").alias("c"))
    rest = _across(tagged, sets.select("doc", "bits"), percent).join(stars.select("a", "b").union(stars.select("b", "a")), ["a", "b"], "left_anti")
    rest = stored(rest, "ngram-rest")
    more = stored(_linked(rest, sets, percent), "ngram-links")
    discard(postings, stars, rest)
    return [found, more, classes]


def groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``document_sets``, (doc, component) of the documents that have a link; all others are alone)."""
    sets = document_sets(docs, k, percent, id_col, text_col)
    found = links(sets, percent)
    of_rep = components(found[0].union(found[1]).union(found[2]))
    discard(*found)
    return sets, of_rep.select(F.col("node").alias("doc"), "component")


def _missing(x: str, y: str):
    """A lower bound of the n-grams of one bitmap that the other lacks."""
    total = F.lit(0)
    for k in range(WORDS):
        total = total + F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}{k}"))))
    return total


def _across(tagged: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): pairs of one posting and two components that could link.

    Members leave that could link with no member of another component: a posting's components and its
    two smallest sizes with different components bound what any partner can be. The rest is dealt to
    blocks of about ``BLOCK`` members; of the pairs in two blocks, bitmaps of the shared n-grams bound the
    overlap; only what passes leaves the join.
    """
    least = tagged.groupBy("gram", "c").agg(F.min("n").alias("n"), F.max("shared").alias("s"), F.count(F.lit(1)).alias("m"))
    one = least.groupBy("gram").agg(F.min(F.struct("n", "c")).alias("lo"), F.max(F.struct("s", "c")).alias("hi"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.sum("m").alias("m")).where("c0 <> c1")
    # for members of the component that holds the extreme itself, the next one counts
    two = least.select("gram", "c", "n", "s").join(one.select("gram", "lo", "hi", "m"), "gram").groupBy("gram").agg(
        F.min(F.when(F.col("c") != F.col("lo.c"), F.col("n"))).alias("n2"), F.max(F.when(F.col("c") != F.col("hi.c"), F.col("s"))).alias("s2"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("m").alias("m")
    )
    x = tagged.join(two, "gram")
    n = F.when(F.col("c") == F.col("lo.c"), F.col("n2")).otherwise(F.col("lo.n"))
    s = F.when(F.col("c") == F.col("hi.c"), F.col("s2")).otherwise(F.col("hi.s"))
    x = x.where(_possible(F.col("n"), F.col("shared"), n, s, percent)).select("doc", "n", "shared", "gram", "c", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("blocks"))
    x = x.join(bits, "doc").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left, right = x.withColumns({"i": F.col("block"), "j": every}), x.withColumns({"j": F.col("block"), "i": every})
    left, right = (
        y.select("gram", "i", "j", F.col("doc").alias(e), F.col("n").alias("n" + e), F.col("shared").alias("s" + e), F.col("c").alias("x" + e), *[F.col("bits")[k].alias(f"{e}{k}") for k in range(WORDS)])
        for e, y in (("a", left), ("b", right))
    )
    pairs = left.join(right, ["gram", "i", "j"]).where("xa <> xb and a < b")
    pairs = pairs.where(_possible(F.col("na"), F.col("sa") - _missing("a", "b"), F.col("nb"), F.col("sb") - _missing("b", "a"), percent))
    return pairs.select("a", "b", "na", "nb").distinct()


def jaccard_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    sets, g = groups(docs, k, percent, id_col, text_col)
    rows = sets.where("row").select(F.col("doc").alias("doc_id"), "n_shingles")
    return rows.join(g, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its group, with all their columns.
    Rows without an id stay."""
    sets, g = groups(docs, k, percent, id_col, text_col)
    discard(sets)
    gone = g.where("doc <> component").select(F.col("doc").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
