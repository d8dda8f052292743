"""Exact quantiles of groups of any size: by places in a distributed order, without a buffer of a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.workspace import cut, written

#: Rows of (group, range) offsets and of group totals that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Distinct (group, value) rows up to which one task may hold a group's values.
FEW = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _same(keys: list[str]) -> Column:
    """Equal keys on both sides of a join, nulls too; the other side's keys have two underlines in front."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], keys: list[str] | None = None, few: int = FEW) -> DataFrame:
    """(keys, a column a probability): linear interpolation between the two nearest values; groups without values have no row.

    Equal values of a group are counted together, then sorted over ranges of (keys, value): each range knows how many values
    of a group lie in the ranges before it, so every distinct value knows its places in the group's order. The values at the
    places asked for are picked by a sum, which combines on the map side. Up to ``few`` counted values in all groups
    together, Spark's own percentile of the counts gives the same.
    """
    keys = keys or []
    named = [f"k{i}" for i in range(len(keys))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = cut(counts)
    if counts.count() <= few:
        found = counts.groupBy(*named).agg(*[F.percentile("v", p, F.col("n")).alias(name) for name, p in probabilities.items()])
        return found.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], *probabilities)
    d = written(counts.repartitionByRange(*named, "v").withColumn("pid", F.spark_partition_id()), "quantiles")
    sums = d.groupBy(*named, "pid").agg(F.sum("n").alias("held"))
    by = Window.partitionBy(*(named or [F.lit(0)]))  # a row a range
    ahead = sums.select(*[F.col(k).alias(f"__{k}") for k in named], F.col("pid").alias("__pid"), (F.sum("held").over(by.orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("ahead"), F.sum("held").over(by).alias("total"))
    ahead = _small(ahead)
    inside = Window.partitionBy(*named, "pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = d.withColumn("__end", F.sum("n").over(inside)).join(ahead, _same(named) & (F.col("pid") == F.col("__pid")))
    end = F.col("ahead") + F.col("__end")
    start = end - F.col("n")

    def picked(p: float) -> Column:
        at = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        here = lambda place: (start <= place) & (place < end)
        whole = F.when(low == high, F.when(here(low), F.col("v")))
        part = F.when(here(low), (high - at) * F.col("v")).otherwise(0.0) + F.when(here(high), (at - low) * F.col("v")).otherwise(0.0)
        return F.sum(F.when(low == high, whole).when(here(low) | here(high), part))

    out = placed.groupBy(*named).agg(*[picked(p).alias(name) for name, p in probabilities.items()])
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], *probabilities)


def with_quantiles(rest: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rest`` with the quantile columns of their group; null where it has no values."""
    if not keys:
        return rest.join(F.broadcast(found), how="left")
    renamed = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
    return rest.join(renamed, _same(keys), "left").drop(*[f"__{k}" for k in keys])
