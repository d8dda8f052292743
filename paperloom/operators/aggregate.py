"""Exact batch aggregations. Rules such as "first wins" take the order column explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators.quantiles import quantiles, with_quantiles
from paperloom.functions.ratings import final_rating


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def describe(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """count, mean, std (0 for one row), min, quartiles (interpolated), max."""
    keys, v = keys or [], F.col(value)
    rest = df.groupBy(*keys).agg(F.count(v).alias("count"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))
    q = quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, keys)
    return with_quantiles(rest, q, keys).select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def rating_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    keys, v = keys or [], F.col(value)
    rest = df.groupBy(*keys).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.when(F.count(v) > 2, F.stddev_samp(v)).otherwise(0.0), 6).alias("stdev"))
    return with_quantiles(rest, quantiles(df, value, {"median": 0.5}, keys), keys).select(*keys, "mean", "median", "stdev")


def group_lists(df: DataFrame, key: str, value: str, order_by: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.col(order_by).alias("o"), F.col(value).alias("v"))))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.transform(rows, lambda x: x["v"]).alias("items"))


def aggregate_mentions(refs: DataFrame, mentions: DataFrame, most: int = 256) -> DataFrame:
    """``refs(paper_id, refs array<struct<title,authors,year>>)`` and ``mentions(paper_id, ref_index, context)``.

    Mentions meet their reference by index, those out of range go; one row by (paper, title, sorted authors, year) with
    the sorted set of trimmed contexts of at most ``most`` characters.
    """
    r = refs.select("paper_id", F.posexplode("refs").alias("ref_index", "ref"))
    met = r.join(mentions, ["paper_id", "ref_index"])
    return met.groupBy("paper_id", F.col("ref.title").alias("title"), F.array_sort("ref.authors").alias("authors"), F.col("ref.year").alias("year")).agg(F.array_sort(F.collect_set(F.left(tx.strip(F.col("context")), F.lit(most)))).alias("contexts"))


def merge_sections(df: DataFrame, key: str, sections: str) -> DataFrame:
    """Sections of one leading number become one: its first heading and the joined ``heading\\ntext`` parts."""
    s = df.select(key, F.posexplode(sections).alias("pos", "s")).withColumn("n", tx.section_number(F.col("s.heading"))).where("n is not null")
    part = F.concat("s.heading", F.lit("\n"), "s.text", F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct("pos", part.alias("t"))))
    return s.groupBy(key, "n").agg(F.min_by("s.heading", "pos").alias("heading"), F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("text"))


def main_review(reviews: DataFrame, key: str = "paper_id", ord_: str = "ord") -> DataFrame:
    """One review a paper: among those with the upper median rating the most confident, or the smallest rationale."""
    by = Window.partitionBy(key)
    r = reviews.withColumn("__i", F.row_number().over(by.orderBy("rating", ord_)) - 1).withColumn("__n", F.count("*").over(by))
    r = r.withColumn("__median", F.max(F.when(F.col("__i") == F.floor(F.col("__n") / 2), F.col("rating"))).over(by)).where("rating = __median")
    r = r.withColumn("__sure", F.max("confidence").over(by))
    order = [F.desc_nulls_last("confidence"), F.when(F.col("__sure").isNull(), F.col("rationale")), F.col(ord_)]
    return first_by(r, [key], *order).drop("__i", "__n", "__median", "__sure")


def final_ratings(reviews: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, rating) of the main review, with its scaled recommendation if it has one."""
    return main_review(reviews, key).select(key, final_rating(F.col("recommendation"), F.col("rating")).alias("rating"))


def dedup_earliest(df: DataFrame, title: str, year: str, order_by: str) -> DataFrame:
    return first_by(df, [title], F.asc_nulls_last(year), F.col(order_by))


def unique_references(papers: DataFrame, refs: str, key: str) -> DataFrame:
    """First reference by clean title over all papers."""
    r = papers.select(key, F.posexplode(refs).alias("pos", "ref")).select(key, "pos", "ref.*").withColumn("clean", tx.clean_title(F.col("title")))
    return first_by(r, ["clean"], key, "pos")


def _first_record(df: DataFrame, key: str, order_by: str, but: list[str]) -> Column:
    """Aggregate: all fields of a group's first row but those that are gathered."""
    return F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (key, *but)]), order_by).alias("__first")


def merge_areas(results: DataFrame, order_by: str) -> DataFrame:
    """``(paper_id, title, abstract, area, ...)``: one row a paper, all fields of its first row, sorted set of areas."""
    r = results.where(F.coalesce("abstract", F.lit("")) != "")
    return r.groupBy("paper_id").agg(_first_record(r, "paper_id", order_by, ["area"]), F.array_sort(F.collect_set("area")).alias("areas")).select("paper_id", "__first.*", "areas")


def merge_recommendations(recs: DataFrame, order_by: str) -> DataFrame:
    """``(paper_id, source_peer, source_s2, ...)``: all fields of a paper's first row and both sorted sets of sources.

    Null sources are skipped.
    """
    sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("source_peer", "sources_peer"), ("source_s2", "sources_s2"))]
    merged = recs.groupBy("paper_id").agg(_first_record(recs, "paper_id", order_by, ["source_peer", "source_s2"]), *sets)
    return merged.select("paper_id", "__first.*", "sources_peer", "sources_s2")


def reference_polarity(contexts: DataFrame, keys: list[str], polarity: str) -> DataFrame:
    """negative if more than half of the contexts are, else positive."""
    neg = F.count_if(F.col(polarity) == "negative")
    return contexts.groupBy(*keys).agg(F.when(neg * 2 > F.count("*"), "negative").otherwise("positive").alias("polarity"))


def context_stats(contexts: DataFrame) -> DataFrame:
    """``(paper_id, ref_id, gold, prediction)``: one row of totals, counts and shares, and references with several contexts."""
    per_ref = contexts.groupBy("paper_id", "ref_id").agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == p).alias(f"{c}_{p}") for c in ("gold", "prediction") for p in ("positive", "negative")])
    cols = [f"{c}_{p}" for c in ("gold", "prediction") for p in ("positive", "negative")]
    t = per_ref.agg(F.sum("n").alias("contexts"), *[F.sum(c).alias(c) for c in cols], F.count_if(F.col("n") > 1).alias("multi_refs"))
    return t.select("*", *[F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("contexts")), F.lit(0.0)), 4).alias(f"{c}_pct") for c in cols])


def distinct_venues(df: DataFrame, venue: str) -> DataFrame:
    v = tx.casefold(F.regexp_replace(F.col(venue), "\n", " "))
    return df.select(v.alias("venue")).where("venue is not null and venue <> ''").distinct()


def title_index(df: DataFrame, title: str, file: str, order_by: str) -> DataFrame:
    return df.groupBy(title).agg(F.max_by(file, order_by).alias(file))


def mention_stats(contexts: DataFrame, paper: str, context: str) -> DataFrame:
    """Distinct contexts overall, their mean number a paper, their words and the words times 1.5."""
    d = contexts.select(paper, context).distinct()
    per = d.groupBy(paper).agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_per_paper"))
    whole = d.select(context).distinct().agg(F.count("*").alias("contexts"), F.sum(tx.count_tokens(F.col(context))).alias("words"))
    return whole.join(per).withColumn("tokens", F.round(F.col("words") * 1.5, 1))


def rating_key_counts(reviews: DataFrame, ratings: str, ignored: list[str]) -> DataFrame:
    k = reviews.select(F.explode(F.map_keys(ratings)).alias("key")).where(~F.col("key").isin(ignored))
    return k.groupBy("key").agg(F.count("*").alias("n"))


def at_least_keys(reviews: DataFrame, ratings: str, ignored: list[str]) -> DataFrame:
    """(k, n): rows with at least k rating keys, for each k that occurs."""
    n = reviews.select(F.size(F.filter(F.map_keys(ratings), lambda k: ~k.isin(ignored))).alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # one row a count
    return n.select("k", F.sum("c").over(up).alias("n"))


def list_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, total, mean, stdev) of list lengths."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.size(c).alias("n")) for c in columns])).alias("x")
    return df.select(kinds).select("x.*").groupBy("kind").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("stdev"))


def noise_share(noise: DataFrame, column: str, limits: list[float]) -> DataFrame:
    """(limit, n, share): how many rows of ``rating_noise`` are at most each limit, and their share of all; one pass."""
    counts = noise.agg(F.count(column).alias("all"), *[F.count_if(F.col(column) <= t).alias(f"n{i}") for i, t in enumerate(limits)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("limit"), F.col(f"n{i}").alias("n")) for i, t in enumerate(limits)]))
    return counts.select("all", rows.alias("x")).select("x.limit", "x.n", F.round(F.coalesce(F.try_divide("x.n", "all"), F.lit(0.0)), 6).alias("share"))


def rating_noise(reviews: DataFrame, key: str, rating: str) -> DataFrame:
    """(key, variance, spread) of a paper's ratings."""
    return reviews.groupBy(key).agg(F.round(F.var_pop(rating), 6).alias("variance"), (F.max(rating) - F.min(rating)).alias("spread"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n, pct, cumulative_pct); the last bin includes its upper end."""
    b = F.least(F.lit(bins), F.width_bucket(F.col(value).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).cast("int"))
    n = df.select(b.alias("bin")).where("bin between 1 and " + str(bins)).groupBy("bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row a bin
    return n.select("bin", "n", F.round(100.0 * F.col("n") / F.sum("n").over(w), 4).alias("pct"), F.round(100.0 * F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w), 4).alias("cumulative_pct"))


def degrees(related: DataFrame) -> DataFrame:
    """(type, direction, node, degree): in and out for citations, undirected for semantic edges."""
    out = related.select("type", F.lit("out").alias("direction"), F.col("source").alias("node"))
    in_ = related.select("type", F.lit("in").alias("direction"), F.col("target").alias("node"))
    d = out.unionByName(in_).withColumn("direction", F.when(F.col("type") == "semantic", "both").otherwise(F.col("direction")))
    return d.groupBy("type", "direction", "node").agg(F.count("*").alias("degree"))


def degree_stats(related: DataFrame, top: int = 5) -> DataFrame:
    d = degrees(related)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "node"))), 1, top)
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("type", "direction").orderBy(F.desc("degree"), "node")))
    tops = ranked.where(F.col("r") <= top).groupBy("type", "direction").agg(F.array_join(F.transform(best, lambda x: x["node"].cast("string")), ",").alias("top"))
    stats = d.groupBy("type", "direction").agg(F.round(F.avg("degree"), 6).alias("mean"), F.min("degree").alias("min"), F.max("degree").alias("max"), F.round(F.coalesce(F.stddev_samp("degree"), F.lit(0.0)), 6).alias("stdev"))
    return stats.join(tops, ["type", "direction"])


def entity_counts(entities: DataFrame, relationships: DataFrame, types: list[str], key: str = "paper_id") -> DataFrame:
    """One row a graph: nodes, edges and one column a type, zeros included."""
    e = entities.groupBy(key).agg(F.count("*").alias("nodes"), *[F.count_if(F.col("type") == t).alias(t) for t in types])
    r = relationships.groupBy(key).agg(F.count("*").alias("edges"))
    return e.join(r, key, "left").withColumn("edges", F.coalesce("edges", F.lit(0)).cast("long"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson from sums; null where a side has no variance. A rounding remainder of the size of the sums counts as none."""
    n, sx, sy = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)), F.sum(x), F.sum(y)
    vx, vy = n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(n * F.sum(x * y) - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


def field_label_stats(df: DataFrame, fields: list[str], label: str) -> DataFrame:
    """(field, pearson, min, q1, median, q3, max) of each count column against the label."""
    f = df.select(F.col(label).cast("double").alias("label"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in fields])).alias("x")).select("label", "x.*")
    rest = f.groupBy("field").agg(F.round(correlation(F.col("v"), F.col("label")), 6).alias("pearson"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(f, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["field"])
    return with_quantiles(rest, q, ["field"]).select("field", "pearson", "min", "q1", "median", "q3", "max")


def filled_distribution(df: DataFrame, column: str, labels: list) -> DataFrame:
    """(label, n, pct) for a fixed label list, zeros included."""
    names = df.sparkSession.createDataFrame([(x,) for x in labels], f"label {dict(df.dtypes)[column]}")
    n = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    out = names.join(n, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("pct", F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)), 4))


def avg_publication_year(related: DataFrame, key: str) -> DataFrame:
    return related.groupBy(key).agg(F.bround(F.avg("year")).cast("int").alias("avg_year"))
