"""Mixing sources to target weights: hash-random keys, ranges within each source, distributed prefix sums, an exact cut.

Every row gets a key from a hash of its id and a seed, and keys fall into equal ranges. Sums per (source, range) and per
run of ranges give each range its place, so no task ever sees a whole source. A source's budget is met exactly: whole
epochs first, then rows in key order up to the cut. The cut lies in one range of a source; only the keys and sizes of
that range's rows are sorted. What comes out is one row a source, so the rows themselves are never shuffled.

Null sources form one source (last in order). A row with a null id gets its key from all of its columns. Rows that agree
in key and size (repeated ids) share what is left at the cut evenly, rounded down. Sources without words get target 0.
An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import cut, parts_for, small

#: Fixed values of the mixing contract.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
RANGE_ROWS = 2_000
RUN_RANGES = 1_000


def with_sizes(df: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``(source, source_size)`` -> ``(source, source_size, target)``: one row a source.

    Shares by weight, none above ``most`` times its source; what is cut off goes to the others by weight. This level is
    found in one pass: in order of cap per weight, the first source that stays under its cap fixes the level for all
    after it. The windows run over one row a source.
    """
    everything = Window.partitionBy()
    n = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", pick).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    t = t.withColumn("place", F.row_number().over(order))
    t = t.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")), F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("place"))).over(everything))
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _cuts(sums: DataFrame, rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Where each source's last epoch ends: (source, cut_key, cut_size, cut_share), the last for each row at the cut.

    ``sums(source, range, words)``, ``rows(source, range, key, size)``, ``goals(source, rest)``. The range is found in
    runs of ``RUN_RANGES`` ranges first, so every window is over a bounded number of rows.
    """

    def found(parts: DataFrame, by: list[str], order: list[str], goals: DataFrame) -> DataFrame:
        """The one part of each source in which the running sum passes ``rest``; ``rest`` is then what is left inside."""
        before = F.sum("words").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
        g = goals.withColumnRenamed("source", "__s")
        met = parts.join(g, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        met = met.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        return cut(met.withColumn("rest", F.col("rest") - F.col("before")).drop("before"))

    def inside(table: DataFrame, met: DataFrame, key: str) -> DataFrame:
        m = small(met.select(F.col("source").alias("__s"), F.col(key).alias("__k")))
        return table.join(m, F.col("source").eqNullSafe(F.col("__s")) & (F.col(key) == F.col("__k"))).drop("__s", "__k")

    sums = sums.withColumn("run", F.floor(F.col("range") / RUN_RANGES))
    run = found(sums.groupBy("source", "run").agg(F.sum("words").alias("words")), ["source"], ["run"], small(goals))
    goals = small(run.select("source", "rest"))
    one = found(inside(sums, run, "run"), ["source"], ["range"], goals)
    equal = inside(rows, one, "range").groupBy("source", "key", "size").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    at = found(equal, ["source"], ["key", "size"], small(one.select("source", "rest")))
    return at.select("source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.floor(F.col("rest") / F.col("n")).alias("cut_share"))


def mix(df: DataFrame, rows: int, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """``df`` has ``source``, ``size`` and ``id_col``; ``rows`` is its number of rows (for the number of ranges).

    Adds source_size, target and taken (words the mix takes of this row, repeats counted). All other columns stay
    (columns of these three names are replaced).
    """
    ranges = parts_for(rows, RANGE_ROWS)
    df = df.drop("source_size", "target", "taken")
    unnamed = F.concat(F.lit("null:"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]).cast("string"))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), unnamed), F.lit(f":{seed}")))
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * ranges / 2**32).cast("long")
    slim = cut(df.select("source", key.alias("key"), "size").withColumn("range", place))
    sums = cut(slim.groupBy("source", "range").agg(F.sum("size").alias("words")))
    t = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = cut(t.withColumn("epochs", epochs).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")))
    c = _cuts(sums, slim, t.select("source", "rest")).withColumnRenamed("source", "__s")
    plan = t.join(small(c), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s", "rest").withColumnRenamed("source", "__source")
    out = df.withColumn("__key", key).join(small(cut(plan)), F.col("source").eqNullSafe(F.col("__source")))
    at, own = F.struct(F.col("cut_key"), F.col("cut_size")), F.struct(F.col("__key"), F.col("size"))
    more = F.when(F.col("cut_key").isNull(), 0).when(own < at, F.col("size")).when(own == at, F.col("cut_share")).otherwise(0)
    taken = (F.col("epochs") * F.col("size") + more).cast("long")
    return out.withColumn("taken", taken).drop("__source", "__key", "epochs", "cut_key", "cut_size", "cut_share")
