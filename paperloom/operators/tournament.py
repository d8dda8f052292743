"""Pairwise comparisons: head-to-head counts, Elo, multi-trial Elo, strengths, overall ranks.

``matches(seq, metric, item_a, item_b, winner, rationale_a, rationale_b)``; winner is A, B or tie.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import workspace
from paperloom.functions import text as tx
from paperloom.operators.folds import ordered_fold
from paperloom.operators.quantiles import quantiles, with_quantiles

ELO_ROW = "item string, rating double, wins long, losses long, ties long"


def _mirrored(matches: DataFrame) -> DataFrame:
    """Each match from both sides: (metric, item, other, won) with won 1, 0.5 or 0."""
    a = F.when(F.col("winner") == "A", 1.0).when(F.col("winner") == "B", 0.0).otherwise(0.5)
    return matches.select("metric", F.col("item_a").alias("item"), F.col("item_b").alias("other"), a.alias("won")).unionByName(matches.select("metric", F.col("item_b").alias("item"), F.col("item_a").alias("other"), (1 - a).alias("won")))


def head_to_head(matches: DataFrame) -> DataFrame:
    """(metric, item, other, wins, ties, losses) for all ordered pairs of a metric's items, zeros included."""
    m = _mirrored(matches)
    items = m.select("metric", "item").distinct()
    grid = items.join(items.withColumnRenamed("item", "other"), "metric").where("item <> other")
    c = m.groupBy("metric", "item", "other").agg(F.count_if(F.col("won") == 1).alias("wins"), F.count_if(F.col("won") == 0.5).alias("ties"), F.count_if(F.col("won") == 0).alias("losses"))
    out = grid.join(c, ["metric", "item", "other"], "left")
    return out.select("metric", "item", "other", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("wins", "ties", "losses")])


def elo_step(ratings: dict, a, b, winner: str, k: float, base: float, div: float) -> None:
    """One match; ``ratings`` maps an item to [rating, wins, losses, ties]."""
    x, y = ratings.setdefault(a, [base, 0, 0, 0]), ratings.setdefault(b, [base, 0, 0, 0])
    expected = 1 / (1 + 10 ** ((y[0] - x[0]) / div))
    got = {"A": 1.0, "B": 0.0}.get(winner, 0.5)
    x[0], y[0] = x[0] + k * (got - expected), y[0] + k * (expected - got)
    for side, s in ((x, got), (y, 1 - got)):
        side[{1.0: 1, 0.0: 2}.get(s, 3)] += 1


def _replay(matches: DataFrame, keys: list[str], k: float, base: float, div: float) -> DataFrame:
    """Ordered replay of each key's matches: parallel over keys, and of a key only the items' ratings are held."""

    def step(ratings: dict, rows: pd.DataFrame) -> None:
        for a, b, w in rows[["item_a", "item_b", "winner"]].itertuples(index=False):
            elo_step(ratings, a, b, w, k, base, div)

    def end(ratings: dict) -> pd.DataFrame:
        return pd.DataFrame([(item, *r) for item, r in ratings.items()], columns=["item", "rating", "wins", "losses", "ties"])

    return ordered_fold(matches, keys, ["__order"], dict, step, end, ELO_ROW)


def ranked(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("rating"), "item")))


def elo(matches: DataFrame, k: float = 32, base: float = 1200, div: float = 400) -> DataFrame:
    m = matches.select("metric", "item_a", "item_b", "winner", F.col("seq").alias("__order"))
    return ranked(_replay(m, ["metric"], k, base, div))


def melo(matches: DataFrame, trials: int = 10, seed: int = 0, k: float = 32, base: float = 1200, div: float = 400) -> DataFrame:
    """Mean rating over shuffled replays; truncated means of wins, losses and ties."""
    m = matches.select("metric", "item_a", "item_b", "winner", "seq").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    m = m.withColumn("__order", F.struct(F.xxhash64("seq", "trial", F.lit(seed)).alias("h"), "seq")).withColumn("__order", F.concat(F.hex("__order.h"), F.lpad(F.col("seq").cast("string"), 20, "0"))).drop("seq")
    r = _replay(m, ["metric", "trial"], k, base, div)
    return ranked(r.groupBy("metric", "item").agg(F.avg("rating").alias("rating"), *[F.floor(F.avg(c)).alias(c) for c in ("wins", "losses", "ties")]))


def bradley_terry(matches: DataFrame, most: int = 100, close: float = 1e-6, compress: bool = True) -> DataFrame:
    """(metric, item, strength, rank), fitted once from 1.0 for all metrics together; the driver sees one number a round.

    A round: strength * wins / expected wins; * 0.2 without a win. A range wider than 1:10 is compressed (a tenth of the
    largest plus the root), then strengths are scaled to sum to the number of items. The round in which nothing moves by
    ``close`` is not applied.
    """
    from pyspark import StorageLevel

    m = _mirrored(matches)
    pairs = m.groupBy("metric", "item", "other").agg(F.count("*").alias("played"), F.sum("won").alias("won")).persist(StorageLevel.MEMORY_AND_DISK)
    wins = pairs.groupBy("metric", "item").agg(F.sum("won").alias("wins"))
    s = wins.select("metric", "item", "wins", F.lit(1.0).alias("s"))
    done: DataFrame | None = None
    w = Window.partitionBy("metric")
    for _ in range(most):
        o = s.select("metric", F.col("item").alias("other"), F.greatest("s", F.lit(1e-10)).alias("so"))
        x = pairs.join(s.select("metric", "item", F.greatest("s", F.lit(1e-10)).alias("si")), ["metric", "item"]).join(o, ["metric", "other"])
        expected = x.groupBy("metric", "item").agg(F.sum(F.col("played") * F.col("si") / (F.col("si") + F.col("so"))).alias("expected"))
        n = s.join(expected, ["metric", "item"])
        new = F.when(F.col("expected") < 1e-10, F.col("s")).when(F.col("wins") > 0, F.col("s") * F.col("wins") / F.col("expected")).otherwise(F.col("s") * 0.2)
        n = n.withColumn("new", new).withColumn("move", F.max(F.abs(F.col("new") - F.col("s"))).over(w))
        if compress:
            wide = (F.min("new").over(w) < 0.1 * F.max("new").over(w)) & (F.max("new").over(w) > 0)
            n = n.withColumn("new", F.when(wide, 0.1 * F.max("new").over(w) + F.sqrt("new")).otherwise(F.col("new")))
        n = n.withColumn("new", F.when(F.sum("new").over(w) > 0, F.col("new") * F.count("*").over(w) / F.sum("new").over(w)).otherwise(F.col("new")))
        # a metric that has come to rest keeps what it had
        s = n.select("metric", "item", "wins", F.when(F.col("move") < close, F.col("s")).otherwise(F.col("new")).alias("s"), "move")
        s = workspace.cut(s)
        done = s
        if (s.agg(F.max("move")).first()[0] or 0.0) < close:
            break
        s = s.drop("move")
    pairs.unpersist()
    return (done if done is not None else s).select("metric", "item", F.col("s").alias("strength")).withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("strength"), "item")))


def overall_ranks(rankings: DataFrame) -> DataFrame:
    """``(metric, item, rank)``: mean, median, best, worst rank and a map by metric, by mean."""
    r = rankings.groupBy("item").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.median("rank").alias("median_rank"), F.min("rank").alias("best"), F.max("rank").alias("worst"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "rank")))).alias("by_metric"))
    return r.orderBy("mean_rank", "item")


def rationale_token_stats(matches: DataFrame) -> DataFrame:
    """(item, n, mean, median, stdev, min, max) of rationale lengths over both sides."""
    both = matches.select(F.col("item_a").alias("item"), tx.count_tokens(F.col("rationale_a")).alias("n")).unionByName(matches.select(F.col("item_b").alias("item"), tx.count_tokens(F.col("rationale_b")).alias("n")))
    rest = both.groupBy("item").agg(F.count("*").alias("count"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("stdev"), F.min("n").alias("min"), F.max("n").alias("max"))
    return with_quantiles(rest, quantiles(both, "n", {"median": 0.5}, ["item"]), ["item"]).select("item", "count", "mean", "median", "stdev", "min", "max")
