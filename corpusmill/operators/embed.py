"""Distance of embeddings from the centroid of a reference set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flagged(rows: DataFrame, reference: DataFrame, key: str = "token_id") -> DataFrame:
    """``reference``: whether the key is in the reference set."""
    r = reference.select(F.col(key)).distinct().withColumn("__r", F.lit(True))
    return rows.join(r, key, "left").withColumn("reference", F.coalesce("__r", F.lit(False))).drop("__r")


def centroid(rows: DataFrame, embedding: str = "embedding", reference: Column | None = None) -> DataFrame:
    """(vec): the mean of the reference rows by dimension, in order; null where there is none."""
    rows = rows.where(F.col("reference") if reference is None else reference)
    means = rows.select(F.posexplode(embedding).alias("idx", "val")).groupBy("idx").agg(F.avg("val").alias("m"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("idx", "m"))), lambda x: x["m"].cast("float"))
    return means.agg(vec.alias("v")).select(F.when(F.size("v") > 0, F.col("v")).alias("vec"))


def euclidean(a: Column, b: Column) -> Column:
    """Arrays of unequal length are an error."""
    d = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    total = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == F.size(b), total).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("dimensions differ")).cast("double"))


def distances(rows: DataFrame, key: str = "token_id", embedding: str = "embedding", reference: Column | None = None) -> DataFrame:
    """(key, distance) of every row. The centroid is one row of one array: it is broadcast."""
    c = centroid(rows, embedding, reference)
    return rows.crossJoin(F.broadcast(c)).select(key, euclidean(F.col(embedding), F.col("vec")).alias("distance"))


def with_reference(dist: DataFrame, rows: DataFrame, key: str = "token_id") -> DataFrame:
    """Distances with the flag, by key: what the plot draws."""
    return dist.join(rows.select(key, "reference"), key).orderBy(key)
