"""Evaluation metrics over columns of true and predicted labels. Undefined values are null, ratios 0/0 are 0 where stated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.fuzzy import lcs_length
from paperloom.functions.stem import stem_words
from paperloom.operators.aggregate import correlation, describe, rating_stats  # noqa: F401
from paperloom.operators.quantiles import quantiles, with_quantiles

#: Words or n-grams that a task compares at a time.
PIECE = 200_000

ratio0 = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, labels: list[int], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Long table (y_true, y_pred, n) over all label pairs; both label lists are small literals."""
    grid = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("y_true")).select("y_true", F.explode(F.array(*map(F.lit, labels))).alias("y_pred"))
    n = df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))
    return grid.join(n, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def accuracy(t: Column, p: Column) -> Column:
    return F.avg((t == p).cast("double"))


def accuracy_within(t: Column, p: Column, k: int) -> Column:
    return F.coalesce(F.avg((F.abs(t - p) <= k).cast("double")), F.lit(0.0))


def mae(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p).cast("double"))


def mse(t: Column, p: Column) -> Column:
    return F.avg((t - p).cast("double") * (t - p))


def average_ranks(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """(keys, value, out): mean rank of each distinct value, by a running count over distinct values."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn(out, F.sum("__n").over(w) - (F.col("__n") - 1) / 2.0).drop("__n")


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    pairs = df.groupBy(*keys, x, y).agg(F.count("*").alias("w"))
    rx, ry = average_ranks(df, x, keys, "rx"), average_ranks(df, y, keys, "ry")
    j = pairs.join(rx, [*keys, x]).join(ry, [*keys, y])
    n, sx, sy = F.sum("w"), F.sum(F.col("w") * F.col("rx")), F.sum(F.col("w") * F.col("ry"))
    sxx, syy, sxy = (F.sum(F.col("w") * F.col(a) * F.col(b)) for a, b in (("rx", "rx"), ("ry", "ry"), ("rx", "ry")))
    value = F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(n * sxy - sx * sy, F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy)))
    return j.groupBy(*keys).agg(value.alias("spearman"))


def class_counts(df: DataFrame, keys: list[str], t: str, p: str) -> DataFrame:
    """(keys, label, tp, fp, fn) for each label seen on either side."""
    rows = df.select(*keys, F.explode(F.array_distinct(F.array(t, p))).alias("label"), F.col(t).alias("__t"), F.col(p).alias("__p"))
    hit = lambda c: F.count_if(c)
    return rows.groupBy(*keys, "label").agg(hit((F.col("__t") == F.col("label")) & (F.col("__p") == F.col("label"))).alias("tp"), hit((F.col("__t") != F.col("label")) & (F.col("__p") == F.col("label"))).alias("fp"), hit((F.col("__t") == F.col("label")) & (F.col("__p") != F.col("label"))).alias("fn"))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return ratio0(tp, tp + fp), ratio0(tp, tp + fn), ratio0(2 * tp, 2 * tp + fp + fn)


def precision_recall_f1(df: DataFrame, average: str, keys: list[str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred", positive=1) -> DataFrame:
    """binary (one class), macro (mean over labels seen on either side) or micro."""
    keys = keys or []
    c = class_counts(df, keys, y_true, y_pred)
    if average == "macro":
        p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
        return c.select(*keys, p.alias("p"), r.alias("r"), f.alias("f")).groupBy(*keys).agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))
    if average == "binary":
        c = c.where(F.col("label") == positive)
    s = c.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select(*keys, p.alias("precision"), r.alias("recall"), f.alias("f1"))


def metrics(df: DataFrame, keys: list[str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred", confidence: str | None = None, check_empty: bool = True) -> DataFrame:
    """All rating metrics a group, one row each; an empty input is an error."""
    keys = keys or []
    if check_empty and df.isEmpty():
        raise ValueError("metrics of no predictions")
    t, p = F.col(y_true), F.col(y_pred)
    sure = F.coalesce(F.avg(confidence), F.lit(1.0)) if confidence else F.max(F.lit(1.0))
    base = df.groupBy(*keys).agg(F.count("*").alias("n"), accuracy(t, p).alias("accuracy"), accuracy_within(t, p, 1).alias("accuracy_1"), mae(t, p).alias("mae"), mse(t, p).alias("mse"), F.sqrt(mse(t, p)).alias("rmse"), correlation(t.cast("double"), p.cast("double")).alias("pearson"), sure.alias("confidence"))
    macro = precision_recall_f1(df, "macro", keys, y_true, y_pred)
    rho = spearman(df, y_true, y_pred, keys)
    out = base.join(macro, keys).join(rho, keys) if keys else base.join(macro).join(rho)
    return out.select(*keys, "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_1", "mae", "mse", "rmse", "pearson", "spearman", "precision", "recall", "f1", "confidence")])


def macro_from_confusion(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Macro precision, recall, F1 over all classes of a long confusion table, and accuracy."""
    row, col = Window.partitionBy(*keys, "y_true"), Window.partitionBy(*keys, "y_pred")
    c = conf.withColumn("row", F.sum("n").over(row)).withColumn("col", F.sum("n").over(col))
    d = c.groupBy(*keys).agg(F.sum("n").alias("total"), *[F.round(F.avg(F.when(F.col("y_true") == F.col("y_pred"), e)), 6).alias(n) for n, e in (("precision", ratio0(F.col("n"), F.col("col"))), ("recall", ratio0(F.col("n"), F.col("row"))), ("f1", ratio0(2 * F.col("n"), F.col("row") + F.col("col"))))], F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hits"))
    return d.select(*keys, "precision", "recall", "f1", F.round(ratio0(F.col("hits"), F.col("total")), 6).alias("accuracy"))


def binary_report(df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Counts and positive, negative and macro precision, recall, F1; null on 0/0."""
    t, p = F.col(y_true), F.col(y_pred)
    c = df.groupBy(*keys).agg(F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 1) & (p == 0)).alias("fn"))
    q = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = {"pos_precision": q(tp, tp + fp), "pos_recall": q(tp, tp + fn), "neg_precision": q(tn, tn + fn), "neg_recall": q(tn, tn + fp)}
    for side in ("pos", "neg"):
        a, b = out[f"{side}_precision"], out[f"{side}_recall"]
        out[f"{side}_f1"] = F.try_divide(2 * a * b, a + b)
    for m in ("precision", "recall", "f1"):
        out[f"macro_{m}"] = (out[f"pos_{m}"] + out[f"neg_{m}"]) / 2
    return c.select(*keys, "tp", "fp", "tn", "fn", *[F.round(v, 6).alias(k) for k, v in out.items()])


def review_metrics(papers: DataFrame, reviews: str, keys: list[str]) -> DataFrame:
    """Metrics over exploded reviews ``struct<rating, prediction>`` that have a prediction."""
    r = papers.select(*keys, F.explode(reviews).alias("r")).select(*keys, F.col("r.rating").alias("y_true"), F.col("r.prediction").alias("y_pred")).where("y_pred is not null")
    return metrics(r, keys)


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*keys, "x.*")


def judge_aggregate(evals: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return unpivot(evals, [key], columns).groupBy(key, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("stdev"))


def run_aggregate(runs: DataFrame, columns: list[str], ok: str, cost: str) -> DataFrame:
    """Over successful runs, a row a metric: mean, median, stdev (null for one value), min, max; total cost of all runs."""
    total = runs.agg(F.round(F.sum(cost), 4).alias("total_cost"))
    values = unpivot(runs.where(F.col(ok)), [], columns)
    m = values.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("stdev"), F.min("value").alias("min"), F.max("value").alias("max"))
    m = with_quantiles(m, quantiles(values, "value", {"median": 0.5}, ["metric"]), ["metric"]).withColumn("median", F.round("median", 6))
    return m.select("metric", "n", "mean", "median", "stdev", "min", "max").join(total)


def run_values(runs: DataFrame, name: str, columns: list[str], ok: str) -> DataFrame:
    """The values that ``run_aggregate`` sums up: (name, metric, value) of successful runs, nulls left out."""
    return unpivot(runs.where(F.col(ok)), [name], columns).where("value is not null")


def experiment_rollup(log: DataFrame, since: str, until: str, day: str, kind: str, cost: str) -> DataFrame:
    """Count and cost by day and by type, with totals: (by, value, n, cost); value is null in the total rows."""
    d = log.withColumn("__day", F.to_date(day)).where(F.col("__day").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    part = lambda name, c: d.rollup(c.alias("value")).agg(F.count("*").alias("n"), F.round(F.sum(cost), 4).alias("cost")).select(F.lit(name).alias("by"), F.col("value").cast("string").alias("value"), "n", "cost")
    return part("day", F.col("__day").cast("string")).unionByName(part("type", F.col(kind)))


def experiment_table(runs: DataFrame, name: str, pattern: str, sort_by: str, desc: bool = True) -> DataFrame:
    return runs.where(F.col(name).contains(pattern)).orderBy(F.desc_nulls_last(sort_by) if desc else F.asc_nulls_last(sort_by), name)


def unlogged_runs(runs: DataFrame, name: str, dataset: str, log: DataFrame, logged: str) -> DataFrame:
    """Runs none of whose name variants is in the log."""
    bare = F.regexp_replace(name, "^ablation_", "")
    base = F.array_distinct(F.array(F.col(name), bare, F.regexp_replace(name, "_graph", ""), F.regexp_replace(bare, "_graph", "")))
    v = runs.select(name, F.explode(F.concat(base, F.transform(base, lambda x: F.concat(x, F.lit("_"), F.col(dataset))))).alias("__v"))
    found = v.join(log.select(F.col(logged).alias("__v")), "__v", "left_semi").select(name).distinct()
    return runs.join(found, name, "left_anti")


def sentence_labels(sentences: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """``sentences(key, sentence, gold)`` against ``predicted(key, background, target)``: (y_true, y_pred) of each sentence.

    A sentence belongs to the predicted block that contains it, ignoring case; in both or in none it counts as right. Equal
    sentences of one label and key are one.
    """
    j = sentences.select(key, "sentence", "gold").distinct().join(predicted, key)
    inside = lambda c: F.contains(F.lower(c), F.lower("sentence"))
    b, t = inside(F.col("background")), inside(F.col("target"))
    j = j.withColumn("pred", F.when(b & ~t, "background").when(t & ~b, "target").otherwise(F.col("gold")))
    return j.select(F.col("gold").alias("y_true"), F.col("pred").alias("y_pred"))


def sentence_agreement(sentences: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """One row of the figures over ``sentence_labels``: true and false positives and false negatives, precision, recall and
    F1 of both classes, macro and micro F1, accuracy and the number of sentences; ratios of nothing are 0."""
    hit = lambda t, p: F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p))
    kinds = {"bg": ("background", "target"), "tgt": ("target", "background")}
    sums = {f"{n}_{k}": x for k, (a, b) in kinds.items() for n, x in (("tp", hit(a, a)), ("fp", hit(b, a)), ("fn", hit(a, b)))}
    c = sentence_labels(sentences, predicted, key).agg(F.count("*").alias("n"), *[x.alias(name) for name, x in sums.items()])
    col = {x: F.col(x) for x in c.columns}
    f1, out = {}, {}
    for k in kinds:
        p, r, f1[k] = _prf(col[f"tp_{k}"], col[f"fp_{k}"], col[f"fn_{k}"])
        out |= {f"precision_{k}": p, f"recall_{k}": r, f"f1_{k}": f1[k]}
    total = {x: col[f"{x}_bg"] + col[f"{x}_tgt"] for x in ("tp", "fp", "fn")}
    out |= {"macro_f1": (f1["bg"] + f1["tgt"]) / 2, "micro_f1": _prf(**total)[2], "accuracy": ratio0(total["tp"], col["n"])}
    return c.select("n", *sums, *[F.round(v, 6).alias(name) for name, v in out.items()])


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _compared_words(df: DataFrame, pred: str, ref: str, stem: bool) -> tuple[Column, Column]:
    both = _words(F.col(pred)), _words(F.col(ref))
    return tuple(stem_words(w, least=4) for w in both) if stem else both


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries both have in common from the start."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _pieces(a: pa.ListArray, b: pa.ListArray, most: int = PIECE) -> Iterator[tuple[pa.ListArray, pa.ListArray]]:
    """The rows of a batch in pieces of up to ``most`` entries of both sides, or of one row."""
    ends = np.cumsum(_sizes(a) + _sizes(b))
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield a.slice(at, to - at), b.slice(at, to - at)
        at = to


def rouge_n(df: DataFrame, key: str, pred: str, ref: str, n: int, stem: bool = False) -> DataFrame:
    """(key, f1) of n-gram overlaps of lower-cased words, counted as multisets within each row, no shuffle.

    With ``stem`` words of over three letters are stemmed. N-grams become 64-bit hashes on the JVM side; the overlaps of
    a bounded number of them are counted together.
    """

    def keys(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all rows, each mixed with its row, and the rows' sizes."""
        sizes = _sizes(lists)
        row = np.repeat(np.arange(len(lists), dtype=np.uint64), sizes)
        with np.errstate(over="ignore"):
            return lists.flatten().to_numpy().view(np.uint64) ^ ((row + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), sizes

    def some(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
        (ka, na), (kb, nb) = keys(a), keys(b)
        ua, first, ca = np.unique(ka, return_index=True, return_counts=True)
        ub, cb = np.unique(kb, return_counts=True)
        _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
        row = np.searchsorted(np.cumsum(na), first[ia], side="right")
        shared = np.bincount(row, weights=np.minimum(ca[ia], cb[ib]), minlength=len(a))
        return np.divide(2.0 * shared, na + nb, out=np.zeros(len(a)), where=na + nb > 0)

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0), *[some(x, y) for x, y in _pieces(a, b)]]))

    def grams(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        made = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n)))
        return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<bigint>"))

    a, b = _compared_words(df, pred, ref, stem)
    words = df.select(key, a.alias("__a"), b.alias("__b"))
    return words.select(key, score(grams(F.col("__a")), grams(F.col("__b"))).alias("f1"))


def rouge_l(df: DataFrame, key: str, pred: str, ref: str, stem: bool = False) -> DataFrame:
    """(key, f1) of the longest common word subsequence; Arrow batches, one integer a column of the table.

    Words are numbers before they are Python objects, a bounded number of them at a time.
    """

    def some(a: pa.ListArray, b: pa.ListArray) -> Iterator[float]:
        numbers = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode().indices.to_numpy()
        ends = np.cumsum(np.concatenate([_sizes(a), _sizes(b)]))
        rows = np.split(numbers, ends[:-1])
        for p, r in zip(rows[: len(a)], rows[len(a) :], strict=True):
            total = len(p) + len(r)
            # what both begin or end with is in a longest common subsequence
            head = _agreeing(p, r)
            tail = _agreeing(p[head:][::-1], r[head:][::-1])
            p, r = sorted((p[head : len(p) - tail].tolist(), r[head : len(r) - tail].tolist()), key=len)
            yield 2.0 * (head + tail + lcs_length(p, r)) / total if total else 0.0

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([f1 for x, y in _pieces(a, b) for f1 in some(x, y)], pa.float64())

    return df.select(key, score(*_compared_words(df, pred, ref, stem)).alias("f1"))


def rouge(df: DataFrame, key: str, pred: str, ref: str, stem: bool = True) -> DataFrame:
    """(key, rouge_1, rouge_2, rouge_l) of each row; their means are the usual report."""
    parts = [rouge_n(df, key, pred, ref, n, stem).withColumnRenamed("f1", f"rouge_{n}") for n in (1, 2)]
    parts.append(rouge_l(df, key, pred, ref, stem).withColumnRenamed("f1", "rouge_l"))
    return parts[0].join(parts[1], key).join(parts[2], key)
