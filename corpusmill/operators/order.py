"""Global positions without a global sort in one task: blocks, their sums, and positions within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Rows of a block of a file, about.
BLOCK = 65_536
#: Blocks that integer keys are cut into, at most.
BLOCKS = 2_048


def prefix_sum(df: DataFrame, blocks: list[Column], inner: list[Column], value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before a row, in the order (blocks, inner).

    Within a block the sum is a window partitioned by block; the blocks' own offsets are a window over
    one row per block, a small fraction of the rows.
    """
    names = [f"__b{k}" for k in range(len(blocks))]
    # descending block keys stay descending: the order is taken from the caller's columns
    plain = [b[0] if isinstance(b, tuple) else b for b in blocks]
    order = [F.col(n).desc() if isinstance(b, tuple) and b[1] == "desc" else F.col(n).asc() for n, b in zip(names, blocks, strict=True)]
    d = df.withColumns({n: p for n, p in zip(names, plain, strict=True)}).withColumn("__v", value.cast("long"))
    return _placed(df, d, _block_sums(d, names, order), names, inner, out)


def _block_sums(d: DataFrame, names: list[str], order: list[Column]) -> DataFrame:
    """(block, __o): the sum of all blocks before."""
    sums = d.groupBy(*names).agg(F.sum("__v").alias("__s"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")


def _placed(df: DataFrame, d: DataFrame, sums: DataFrame, names: list[str], inner: list[Column], out: str) -> DataFrame:
    w = Window.partitionBy(*names).orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__r", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    on = None
    for n in names:
        c = d[n].eqNullSafe(sums[n])
        on = c if on is None else on & c
    d = d.join(sums, on)
    return d.withColumn(out, F.col("__o") + F.col("__r")).select(*df.columns, out)


def _literal(numbers: list, kind: str) -> Column:
    """A constant array from one literal, however long it is."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")


def key_bounds(df: DataFrame, key: Column, blocks: int = BLOCKS) -> list[int]:
    """Where blocks of about as many rows each begin, by quantiles of an integer key: at most ``blocks`` numbers
    come to the driver, however keys are spread."""
    shares = _literal([k / blocks for k in range(1, blocks)], "double")
    found = df.agg(F.percentile_approx(key.cast("long"), shares, 8 * blocks)).first()[0]
    return sorted(set(found or []))


def block_of(key: Column, bounds: list[int], fan: int = 64) -> Column:
    """The number of the block that a key is in: a search in two steps over a literal array."""
    if not bounds:
        return F.lit(0)
    k = key.cast("long")

    def reached(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= k))

    part = reached(_literal(bounds[::fan], "bigint"))
    inner = F.slice(_literal(bounds, "bigint"), F.greatest(part - 1, F.lit(0)) * fan + 1, F.lit(fan))
    return F.when(part == 0, 0).otherwise((part - 1) * fan + reached(inner))


def ordered_sum(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows with a smaller integer key. Bounds and sums of blocks come from
    keys and values alone, which are written once; the rows themselves are shuffled once."""
    c = F.col(key)
    narrow = staged(df.select(c, value.cast("long").alias("__value")), "keys")
    block = block_of(c, key_bounds(narrow, c))
    sums = _block_sums(narrow.withColumns({"__b0": block, "__v": F.col("__value")}), ["__b0"], [F.col("__b0").asc()])
    d = df.withColumns({"__b0": block, "__v": value.cast("long")})
    return _placed(df, d, F.broadcast(sums), ["__b0"], [c], out)  # sums has a row for each of BLOCKS blocks


def dense_index(df: DataFrame, key: str, out: str = "doc") -> DataFrame:
    """``out``: 0, 1, 2 ... in the order of an integer key."""
    return ordered_sum(df, key, F.lit(1), out)


def dense_index_of_files(df: DataFrame, out: str = "doc", block: int = BLOCK) -> DataFrame:
    """``out``: 0, 1, 2 ... over (file name, row in the file); call it on a scan, null rows already dropped."""
    d = df.withColumns({"__f": F.col("_metadata.file_name"), "__i": F.col("_metadata.row_index")})
    d = prefix_sum(d, [F.col("__f"), F.floor(F.col("__i") / F.lit(block))], [F.col("__i")], F.lit(1), out)
    return d.drop("__f", "__i")


def frequency_rank(df: DataFrame, count: str, key: str, out: str = "id") -> DataFrame:
    """``out``: 0 for the largest count, ties by key. A block is one count and three first characters."""
    return prefix_sum(df, [(F.col(count), "desc"), F.substring(key, 1, 3)], [F.col(key)], F.lit(1), out)
