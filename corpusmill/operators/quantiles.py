"""Exact quantiles of groups of any size.

``percentile`` keeps a group's distinct values in one task, which is right for most groups and wrong for a hot one.
Groups above ``LIGHT`` rows are selected by ranges instead: bounds of about equally many rows come from a sketch, rows are
counted by range, and only the ranges that hold a wanted rank are looked at value by value, with equal values counted
before they are shuffled. Both ways interpolate alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import sized

#: Rows of a group up to which its values may meet in one task.
LIGHT = 1_000_000
#: Ranges that a larger group is cut into, about.
RANGES = 128


def _range_of(value: Column, bounds: Column) -> Column:
    """How many bounds are below a value: range k holds values above bound k - 1 and up to bound k."""
    return F.size(F.filter(bounds, lambda b: b < value))


def selected(t: DataFrame, group: str, value: str, ps: list[float], ranges: int = RANGES, weight: str | None = None) -> DataFrame:
    """(group, q): the quantiles ``ps`` of all groups, by ranges. ``weight``: how often a row counts, where not once."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    t = t.where(F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v"), w.alias("__w"))
    cuts = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    bounds = sized(t.groupBy("__g").agg(F.sum("__w").alias("__n"), F.percentile_approx("__v", cuts, 8 * ranges).alias("__bounds")))
    ranged = t.join(bounds, "__g").select("__g", "__v", "__w", "__n", _range_of(F.col("__v"), F.col("__bounds")).alias("__k"))
    counts = ranged.groupBy("__g", "__n", "__k").agg(F.sum("__w").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("__g").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = [F.lit(float(p)) * (F.col("__n") - 1) for p in ps]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    counts = counts.withColumn("__before", before).withColumn("__ranks", F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c"))))
    wanted = sized(counts.where(F.size("__ranks") > 0).select("__g", "__k", "__before", "__ranks"))
    values = ranged.join(wanted, ["__g", "__k"]).groupBy("__g", "__k", "__n", "__before", "__ranks", "__v").agg(F.sum("__w").alias("__c"))
    inner = F.coalesce(F.sum("__c").over(Window.partitionBy("__g", "__k").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("__at", F.col("__before") + inner)
    hit = F.filter("__ranks", lambda r: (r >= F.col("__at")) & (r < F.col("__at") + F.col("__c")))
    found = values.select("__g", "__n", "__v", F.explode(hit).alias("__r"))
    found = found.groupBy("__g", "__n").agg(F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__of"))

    def at(x: Column) -> Column:
        low, high = F.floor(x).cast("long"), F.ceil(x).cast("long")
        a, b = F.element_at("__of", low), F.element_at("__of", high)
        return F.when((low == high) | (a == b), a).otherwise((high - x) * a + (x - low) * b)

    return found.select(F.col("__g").alias(group), F.array(*[at(x) for x in place]).alias("q"))


def quantiles(t: DataFrame, counts: DataFrame, group: str, value: str, ps: list[float], light: int = LIGHT, weight: str | None = None) -> DataFrame:
    """(group, q) of rows that can be read twice; ``counts`` (group, num) tells which groups are large. ``weight`` as in ``selected``."""
    hot = sized(counts.where(F.col("num") > light).select(group))
    often = F.lit(1) if weight is None else F.col(weight)
    few = t.join(hot, group, "left_anti").groupBy(group).agg(F.percentile(value, F.array(*map(F.lit, ps)), often).alias("q"))
    return few.union(selected(t.join(hot, group, "left_semi"), group, value, ps, weight=weight)) if hot.head(1) else few
