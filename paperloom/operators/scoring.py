"""Novelty scores, ensembles and rationale choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions.ratings import clamp, novelty_probability, score_to_rating
from paperloom.operators.encode import hashing_encoder
from paperloom.operators.sampling import draw
from paperloom.workspace import written

#: Rows of a parameter grid.
GRID = 10_000
#: Characters of a group of rationales that one task works on whole, of the groups of one task, and what a row counts beyond its text.
GROUP_CHARS = 1_000_000
PART_CHARS = 2_000_000
ROW_CHARS = 50
#: Names of large groups are broadcast up to so many; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def nova_score(acus: DataFrame, matches: DataFrame, t: float = 0.6, alpha: float = -0.5, beta: float = 1.0, gamma: float = 0.3) -> DataFrame:
    """``acus(paper_id, acu_id, salient)``, ``matches(acu_id, score)``: (paper_id, n, score, rating).

    An ACU is novel if no match reaches ``t``; its weight is 1 if salient, else min(1, alpha (ratio - beta)^3 + gamma) with
    the share of salient ones as ratio.
    """
    return nova_grid_scores(acus, matches, acus.sparkSession.createDataFrame([(t, alpha, beta, gamma)], "t double, alpha double, beta double, gamma double")).select("paper_id", "n", "score", "rating")


def nova_grid_scores(acus: DataFrame, matches: DataFrame, grid: DataFrame) -> DataFrame:
    """The same for every row of a parameter grid (t, alpha, beta, gamma) of at most ``GRID`` rows, in one job.

    Every ACU meets every row of the grid, so a larger one is an error.
    """
    if grid.limit(GRID + 1).count() > GRID:
        raise ValueError(f"a grid of more than {GRID} rows")
    best = matches.groupBy("acu_id").agg(F.max("score").alias("best"))
    a = acus.join(best, "acu_id", "left")
    share = a.groupBy("paper_id").agg((F.count_if("salient") / F.count("*")).alias("ratio"))
    g = a.join(share, "paper_id").join(F.broadcast(grid))
    weight = F.when(F.col("salient"), 1.0).otherwise(F.least(F.lit(1.0), F.col("alpha") * F.pow(F.col("ratio") - F.col("beta"), 3) + F.col("gamma")))
    novel = F.when(F.coalesce(F.col("best") >= F.col("t"), F.lit(False)), 0.0).otherwise(1.0)
    s = g.groupBy("paper_id", "t", "alpha", "beta", "gamma").agg(F.count("*").alias("n"), F.round(F.sum(novel * weight) / F.count("*"), 6).alias("score"))
    return s.withColumn("rating", score_to_rating(F.col("score")))


def nova_grid(acus: DataFrame, matches: DataFrame, labels: DataFrame, grid: DataFrame) -> DataFrame:
    """Accuracy against ``labels(paper_id, label)`` by parameter combination, best first."""
    s = nova_grid_scores(acus, matches, grid).join(labels, "paper_id")
    keys = ["t", "alpha", "beta", "gamma"]
    return s.groupBy(*keys).agg(F.round(F.avg((F.col("rating") == F.col("label")).cast("double")), 6).alias("accuracy")).orderBy(F.desc("accuracy"), *keys)


def nova_index(papers: DataFrame, acus: str, n_papers: int, n_sentences: int, seed: int = 0, encoder: Callable[[DataFrame, str], DataFrame] = hashing_encoder) -> DataFrame:
    """(paper_id, sentence_id, sentence, embedding): drawn sentences of drawn papers, encoded."""
    p = papers.orderBy(draw("paper_id", seed), "paper_id").limit(n_papers)
    s = p.select("paper_id", F.posexplode(acus).alias("pos", "sentence")).withColumn("sentence_id", F.concat_ws("-", "paper_id", "pos"))
    drawn = s.orderBy(draw("sentence_id", seed), "sentence_id").limit(n_sentences).select("paper_id", "sentence_id", "sentence")
    return encoder(drawn, "sentence")


def ensemble(evals: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, label, confidence, n): half-even rounded median; max(0, 1 - stdev / 2), 1 for a single vote."""
    sd = F.coalesce(F.stddev_samp("label"), F.lit(0.0))
    return evals.groupBy(key).agg(F.bround(F.median("label")).cast("int").alias("label"), F.round(F.greatest(F.lit(0.0), 1 - sd / 2), 6).alias("confidence"), F.count("*").alias("n"))


def _with_grams(e: DataFrame) -> DataFrame:
    """Add ``grams``: 1- and 2-grams of the text ``__t`` without English stop words, repeats included."""
    from pyspark.ml.feature import StopWordsRemover

    stop = StopWordsRemover.loadDefaultStopWords("english")
    e = e.withColumn("w", F.filter(F.split(F.lower("__t"), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 1) & ~w.isin(stop)))
    two = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return e.withColumn("grams", F.concat("w", two))


def _weight() -> Column:
    return F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)


def _scores_in_place(e: DataFrame, key: str, order_by: str, features: int, parts: int) -> DataFrame:
    """(key, order_by, words, score): rows meet once by key, and all else goes on where they lie. Score is null without grams."""
    by_key = Window.partitionBy(key)
    e = e.repartition(parts, key).withColumn("n", F.count("*").over(by_key)).withColumn("row", F.row_number().over(by_key.orderBy(order_by)))
    e = _with_grams(e).select(key, order_by, "row", "n", tx.word_count(F.col("__t")).alias("words"), "grams")  # counted here, not once a gram
    x = e.select("*", F.explode_outer("grams").alias("g")).groupBy(key, "row", order_by, "n", "words", "g").agg(F.count("*").alias("tf"))
    by_gram, by_row = Window.partitionBy(key, "g"), Window.partitionBy(key, "row")
    x = x.withColumn("df", F.count("*").over(by_gram)).withColumn("all", F.sum("tf").over(by_gram))
    x = x.withColumn("r", F.dense_rank().over(by_key.orderBy(F.col("g").isNull(), F.desc("all"), "g"))).where((F.col("r") <= features) | F.col("g").isNull())
    x = x.withColumn("x", F.when(F.col("g").isNotNull(), _weight()))
    x = x.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(by_row))).withColumn("sum", F.sum("x").over(by_gram))
    return x.groupBy(key, "row", order_by, "words").agg(F.round(F.sum(F.col("x") * F.col("sum")), 9).alias("score")).drop("row")


def _scores_dealt_out(e: DataFrame, key: str, order_by: str, features: int) -> DataFrame:
    """The same for groups of any size, by shuffles of grams. Keys are wrapped, so that the null key joins too."""
    e = written(e.select(F.struct(key).alias("k"), order_by, "__t", F.monotonically_increasing_id().alias("row")), "rationales")
    tf = _with_grams(e).select("k", "row", F.explode("grams").alias("g")).groupBy("k", "row", "g").agg(F.count("*").alias("tf"))
    n = e.groupBy("k").agg(F.count("*").alias("n"))
    df = tf.groupBy("k", "g").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("all"), "g"))).where(F.col("r") <= features)
    x = tf.join(df, ["k", "g"]).join(n, "k").withColumn("x", _weight())
    norm = x.groupBy("k", "row").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    x = x.join(norm, ["k", "row"]).withColumn("x", F.col("x") / F.col("norm"))
    total = x.groupBy("k", "g").agg(F.sum("x").alias("sum"))
    score = x.join(total, ["k", "g"]).groupBy("k", "row").agg(F.round(F.sum(F.col("x") * F.col("sum")), 9).alias("score"))
    rows = e.select("k", "row", order_by, tx.word_count(F.col("__t")).alias("words")).join(score, ["k", "row"], "left")
    return rows.select(F.col("k")[key].alias(key), order_by, "words", "score")


def best_rationale(evals: DataFrame, key: str, text: str, order_by: str, features: int = 1000, method: str = "tfidf") -> DataFrame:
    """(key, order_by, score): the text nearest to all others of its group.

    TF-IDF over 1- and 2-grams without English stop words, smooth idf, the ``features`` most frequent grams, unit rows;
    the score is the row sum of the cosine matrix, i.e. the product with the sum of all rows. Groups without any gram
    choose the text with the most words. Ties go to the first.

    Groups of up to ``GROUP_CHARS`` characters are worked on whole, about ``PART_CHARS`` characters a task, so only texts
    are shuffled, once; larger ones are dealt out by gram.
    """
    e = evals.select(key, order_by, F.coalesce(text, F.lit("")).alias("__t"))
    sizes = e.groupBy(key).agg(F.sum(F.length("__t") + ROW_CHARS).alias("chars"))
    chars, large = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.count_if(F.col("chars") > GROUP_CHARS)).first()
    parts = max(evals.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS))
    if large:
        names = sizes.where(F.col("chars") > GROUP_CHARS).select(F.col(key).alias("__large"))
        names = F.broadcast(names) if large <= BROADCAST_ROWS else names
        same = F.col(key).eqNullSafe(F.col("__large"))
        scores = _scores_in_place(e.join(names, same, "left_anti"), key, order_by, features, parts).unionByName(_scores_dealt_out(e.join(names, same, "left_semi"), key, order_by, features))
    else:
        scores = _scores_in_place(e, key, order_by, features, parts)
    has = F.max(F.col("score").isNotNull()).over(Window.partitionBy(key))
    scores = scores.withColumn("has", has).withColumn("by", F.when(F.col("has"), F.coalesce("score", F.lit(-1.0))).otherwise(F.col("words").cast("double")))
    w = Window.partitionBy(key).orderBy(F.desc("by"), order_by)
    return scores.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, order_by, F.coalesce("score", F.lit(0.0)).alias("score"))


def best_of_n(ratings: DataFrame, key: str = "paper_id") -> DataFrame:
    """``(key, label, rating)``: mean of clamped 1-4 ratings over 4, else 0 or 1 by label; then bounded by label."""
    r = ratings.groupBy(key, "label").agg(F.count("rating").alias("n"), F.sum(clamp(F.col("rating"), 1, 4)).alias("s"))
    p = F.when(F.col("n") > 0, F.col("s") / (4.0 * F.col("n")))
    return r.select(key, "label", F.round(novelty_probability(F.col("label"), p), 6).alias("probability"))
