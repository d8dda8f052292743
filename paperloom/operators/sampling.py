"""Search, sampling, splitting and limiting. Draws go by a hash of the key and a seed, so they are the same every time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators.aggregate import first_by
from paperloom.workspace import cut

#: Cut keys of up to so many groups are broadcast.
BROADCAST_ROWS = 1_000_000


def draw(key: str | Column, seed: int) -> Column:
    """A reproducible random order."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def combine_results(primary: DataFrame, secondary: DataFrame, n: int, title: str) -> DataFrame:
    """``(id, title, abstract, ord)``: valid rows, primary first, distinct ids, at most ``n``, without rows of the same title."""
    rows = primary.withColumn("__p", F.lit(0)).unionByName(secondary.withColumn("__p", F.lit(1)))
    rows = rows.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("abstract", F.lit("")) != ""))
    once = first_by(rows, ["id"], "__p", "ord")
    return once.orderBy("__p", "ord", "id").limit(n).where(tx.clean_title(F.col("title")) != tx.clean_title(F.lit(title))).drop("__p")


def fulltext_search(papers: DataFrame, query: str, n: int, weights=(1.0, 0.4)) -> DataFrame:
    """``papers(id, title, abstract, citation_count)``: all words occur; by weighted count, then citations, then id."""
    terms = sorted(set(query.lower().split()))
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w.isin(terms))
    p = papers.select("id", "citation_count", words("title").alias("t"), words("abstract").alias("a"))
    p = p.where(F.size(F.array_distinct(F.concat("t", "a"))) == len(terms))
    return p.select("id", "citation_count", F.round(F.size("t") * weights[0] + F.size("a") * weights[1], 6).alias("score")).orderBy(F.desc("score"), F.desc("citation_count"), "id").limit(n)


def substring_search(papers: DataFrame, query: str) -> DataFrame:
    """(id, score): 10 a hit in the title, 5 in the authors, 1 in the abstract; a blank query finds all with score 0."""
    q = query.strip().lower()
    if not q:
        return papers.select("id", F.lit(0).cast("long").alias("score"))
    hits = lambda c: (F.length(F.coalesce(c, F.lit(""))) - F.length(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(q), F.lit("")))) / len(q)
    s = papers.select("id", F.round(10 * hits("title") + 5 * hits("authors") + hits("abstract")).cast("long").alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "id")


def sample(df: DataFrame, k: int | None, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(key, seed), key).limit(k) if k else df


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(key, seed), key)


def split(df: DataFrame, key: str, train: float, dev: float, seed: int = 0) -> DataFrame:
    """Adds ``split``: train, dev or test. Numbers below 1 are shares, others counts; the rest is test.

    The cut keys are the n-th smallest draws; they are found by counting draws by their first digits (see ``_nth``).
    """
    n = df.count()
    a, b = (int(n * x) if x < 1 else int(x) for x in (train, dev))
    d = df.withColumn("__d", F.concat(draw(key, seed), F.col(key).cast("string")))
    ends = _nth(d.select(F.lit(0).alias("g"), "__d"), d.sparkSession.createDataFrame([(0, i, min(n, m)) for i, m in enumerate((a, a + b)) if m], "g int, i int, n long"))
    at = {r["i"]: r["d"] for r in ends.collect()}  # two rows at most
    le = lambda i: F.lit(False) if i not in at else F.col("__d") <= at[i]
    return d.withColumn("split", F.when(le(0), "train").when(le(1), "dev").otherwise("test")).drop("__d")


def _nth(draws: DataFrame, wanted: DataFrame, digits: int = 4) -> DataFrame:
    """(g, i, d): for each row of ``wanted(g, i, n)`` the ``n``-th smallest (or last) of ``draws(g, __d)``.

    Draws are counted by their first digits first; only those that share the right digits with the n-th one are sorted,
    so no task sees a whole group.
    """
    part = F.left("__d", F.lit(digits))
    counts = draws.groupBy("g", part.alias("part")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("part"))
    counts = counts.withColumn("upto", upto).withColumn("all", F.sum("c").over(Window.partitionBy("g")))
    n = F.least("n", "all")
    right = counts.join(wanted, "g").where((F.col("upto") >= n) & (F.col("upto") - F.col("c") < n)).select("g", "part", "i", (n - F.col("upto") + F.col("c")).alias("n"))
    near = draws.withColumn("part", part).join(right, ["g", "part"])
    place = F.row_number().over(Window.partitionBy("g", "i").orderBy("__d"))
    return near.withColumn("place", place).where("place = n").select("g", "i", F.col("__d").alias("d"))


def capped(df: DataFrame, group: str, key: str, most: Mapping | int, seed: int = 0) -> DataFrame:
    """At most so many drawn rows of a group: a number, or one by group (few groups; those without a number get none).

    Null is a group. Rows of equal key are drawn together, so the last key drawn may bring more than one row.
    """
    d = df.withColumn("__d", F.concat(draw(key, seed), F.col(key).cast("string")))
    own = F.struct(F.col(group)).alias("g")  # structs of nulls are equal
    sizes = d.groupBy(group).agg(F.count("*").alias("all"))
    if isinstance(most, Mapping):
        sizes = sizes.withColumn("n", F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col(group)] if most else F.lit(0))
    else:
        sizes = sizes.withColumn("n", F.lit(most))
    wanted = sizes.where("n > 0").select(own, F.lit(0).alias("i"), F.col("n").cast("long"))
    ends = cut(_nth(d.select(own, "__d"), wanted).select(F.col("g").alias("__g"), F.col("d").alias("__end")))
    if ends.count() <= BROADCAST_ROWS:  # one row a group: else all rows of a group would go to one task
        ends = F.broadcast(ends)
    return d.withColumn("__g", own).join(ends, "__g").where(F.col("__d") <= F.col("__end")).select(df.columns)


def balance(df: DataFrame, group: str, main, key: str, seed: int = 0) -> DataFrame:
    """No class larger than the main class."""
    return capped(df, group, key, df.where(F.col(group) == main).count(), seed)


def downsample(df: DataFrame, group: str, ratios: str, key: str, count: int | None = None, seed: int = 0) -> DataFrame:
    """Classes (sorted) in the given percentages: the most rows that allows, or ``count`` (rounding rest to the largest class)."""
    shares = [int(x) for x in ratios.split("/")]
    sizes = sorted((r[group], r["count"]) for r in df.groupBy(group).count().collect())  # one row a class
    if sum(shares) != 100 or len(shares) != len(sizes):
        raise ValueError("ratios must sum to 100, one for each class")
    total = count or min(n * 100 // s for s, (_, n) in zip(shares, sizes, strict=True) if s)
    want = [total * s // 100 for s in shares]
    if count:
        want[max(range(len(want)), key=lambda i: want[i])] += count - sum(want)
    if any(w > n for w, (_, n) in zip(want, sizes, strict=True)):
        raise ValueError("a class has too few rows")
    return capped(df, group, key, {name: w for w, (name, _) in zip(want, sizes, strict=True)}, seed)


def sample_contexts(papers: DataFrame, contexts: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` contexts over all papers, back in their lists in order; papers without any go."""
    e = papers.select(key, F.posexplode(contexts).alias("pos", "context"))
    s = e.orderBy(draw(F.concat_ws("-", key, "pos"), seed), key, "pos").limit(n)
    return s.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "context"))), lambda x: x["context"]).alias(contexts))


def stratified(df: DataFrame, group: str, n: int, classes: int, key: str, seed: int = 0) -> DataFrame:
    """n / classes drawn rows of each class."""
    return capped(df, group, key, n // classes, seed)


def evidence_quota(evidence: DataFrame, key: str, order_by: str) -> DataFrame:
    """Up to 3 semantic and 2 citation items, filled to 5 from the source with more left (ties: citations), in order."""
    w = Window.partitionBy(key)
    sem, cit = (F.count_if(F.col("source") == s).over(w) for s in ("semantic", "citation"))
    e = evidence.withColumn("__s", sem).withColumn("__c", cit)
    s0, c0 = F.least("__s", F.lit(3)), F.least("__c", F.lit(2))
    need, more = 5 - s0 - c0, (F.col("__s") - s0) > (F.col("__c") - c0)
    ns = s0 + F.when(more, F.least(F.col("__s") - s0, need)).otherwise(0)
    nc = c0 + F.when(~more, F.least(F.col("__c") - c0, need)).otherwise(0)
    r = F.row_number().over(Window.partitionBy(key, "source").orderBy(order_by))
    return e.withColumn("__r", r).where(F.col("__r") <= F.when(F.col("source") == "semantic", ns).otherwise(nc)).drop("__s", "__c", "__r")


def sample_by_prediction(df: DataFrame, n: int, pred: str, order_by: str) -> DataFrame:
    """The first ``n`` rows predicted at most 2, and at least 3."""
    low = F.when(F.col(pred) <= 2, "low").when(F.col(pred) >= 3, "high")
    d = df.withColumn("side", low).where("side is not null")
    return d.withColumn("__r", F.row_number().over(Window.partitionBy("side").orderBy(order_by))).where(F.col("__r") <= n).drop("__r")
