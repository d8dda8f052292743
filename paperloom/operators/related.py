"""Semantic and citation neighbours, and the related-paper query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators.filters import non_blank
from paperloom.workspace import cut, new_path

#: Queries to a pass over the nodes: so many vectors are broadcast at once, whatever their number is.
QUERIES = 8_192
#: Nodes to a matrix product.
BLOCK = 2_048
#: Papers whose vectors a task of the citation scores holds, and parts that the cited titles are dealt to.
PAPERS = 65_536
TITLE_PARTS = 16


#: A node without ``since`` comes after every query with ``until``; a query without ``until`` sees every node.
_NEVER = np.iinfo(np.int64).max


def _passes(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bounded parts (ids, vectors, until) of the queries that have a vector, by a hash of the id."""
    until = F.coalesce(F.col("until").cast("long"), F.lit(_NEVER)) if "until" in queries.columns else F.lit(_NEVER)
    queries = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", until.alias("until"))
    passes = max(1, -(-queries.count() // QUERIES))
    for p in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).collect()
        if rows:
            yield np.array([r["query_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["until"] for r in rows], dtype=np.int64)


def _scored(queries: DataFrame, nodes: DataFrame, group: list[str], reduce: Callable[[list], Iterator[tuple]], keep: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(query_id, group, node_id, score): what ``keep`` takes from each block of scores (queries by nodes).

    The queries are a stated set that meets all nodes. A bounded part of them is broadcast at a time, and the nodes are
    scored where they lie, so no vector is shuffled and no key gathers nodes; each task brings what ``reduce`` leaves of
    its blocks. With several parts each one's rows are written before the next is read. If the queries have a column
    ``until`` and the nodes one ``since``, a query meets only nodes with ``since`` at most its ``until``.
    """
    spark, kinds = nodes.sparkSession, dict(nodes.dtypes)
    schema = ", ".join([f"query_id {dict(queries.dtypes)['query_id']}", *[f"{g} {kinds[g]}" for g in group], f"node_id {kinds['node_id']}", "score double"])
    dated = "until" in queries.columns and "since" in nodes.columns
    since = F.coalesce(F.col("since").cast("long"), F.lit(_NEVER)) if dated else F.lit(0).cast("long")
    nodes = nodes.where(F.col("embedding").isNotNull()).select("node_id", "embedding", since.alias("since"), *group)

    def scored(ids: np.ndarray, a: np.ndarray, until: np.ndarray) -> DataFrame:
        held = spark.sparkContext.broadcast((ids, a / (np.sqrt((a * a).sum(1))[:, None] + 1e-300), np.sqrt((a * a).sum(1)), until))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, unit, norms, until = held.value
            best: dict[tuple, list] = {}
            for batch in batches:
                for values, part in [((), batch)] if not group else batch.groupby(group, sort=False, dropna=False):
                    for at in range(0, len(part), BLOCK):
                        some = part.iloc[at : at + BLOCK]
                        b = np.array(some["embedding"].tolist(), dtype=np.float64)
                        own = np.sqrt((b * b).sum(1))
                        s = np.clip((unit @ b.T) * norms[:, None] / (norms[:, None] * own[None, :] + 1e-8), 0.0, 1.0)
                        if dated:
                            s[some["since"].to_numpy()[None, :] > until[:, None]] = -1.0
                        i, j = keep(s)
                        best.setdefault(values, []).append((i, some["node_id"].to_numpy()[j], s[i, j]))
                        if len(best[values]) > 8:
                            best[values] = [reduce(best[values])]
            for values, found in best.items():
                i, node, s = reduce(found)
                named = {g: pd.Series([None if pd.isna(v) else v] * len(i), dtype="object") for g, v in zip(group, values, strict=True)}
                yield pd.DataFrame({"query_id": ids[i], **named, "node_id": node, "score": s})

        return nodes.mapInPandas(run, schema)

    parts = _passes(queries)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return scored(*first)
    path = new_path(spark, "vector-scores")
    for part in (first, second, *parts):
        scored(*part).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _joined(found: list) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def semantic_topk(queries: DataFrame, nodes: DataFrame, k: int, group: list[str] | None = None, legacy: bool = False, apart: bool = False) -> DataFrame:
    """``queries(query_id, embedding)``, ``nodes(node_id, embedding[, group])``: (query_id, group, node_id, score, r).

    Exact cosine clipped to [0, 1], best ``k`` a query (and group), ties by node id. A task gives at most ``k`` nodes a
    query and group, so what is shuffled is queries x tasks x k rows. With ``apart`` no query is its own answer.
    """
    group = group or []
    most = k + 1 if apart else k

    def keep(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of a block, and all that equal its last (ties go by node id)."""
        if s.shape[1] <= most:
            return np.repeat(np.arange(len(s)), s.shape[1]), np.tile(np.arange(s.shape[1]), len(s))
        return np.nonzero(s >= np.partition(s, -most, axis=1)[:, -most][:, None])

    out = _scored(queries, nodes, group, lambda found: _best(found, most), keep).where("score >= 0")
    out = out.where("node_id <> query_id") if apart else out
    out = out.withColumn("r", F.row_number().over(Window.partitionBy("query_id", *group).orderBy(F.desc("score"), "node_id"))).where(F.col("r") <= k)
    # the angular distance d of unit vectors gives the old score 1 - d / 2
    return out.withColumn("legacy_score", 1 - F.sqrt(2 - 2 * F.col("score")) / 2) if legacy else out


def semantic_above(queries: DataFrame, nodes: DataFrame, threshold: float, group: list[str] | None = None) -> DataFrame:
    """(query_id, group, node_id, score) of all nodes with at least this score."""
    return _scored(queries, nodes, group or [], _joined, lambda s: np.nonzero(s >= threshold))


def vector_search(queries: DataFrame, sentences: DataFrame, k: int = 5, threshold: float = 0.6, apart: bool = False) -> DataFrame:
    return semantic_topk(queries, sentences, k, apart=apart).where(F.col("score") >= threshold)


def signature_index(nodes: DataFrame, tables: int = 16, bits: int = 8, seed: int = 1) -> DataFrame:
    """The index of the approximate search: (t, bucket, node_id), a row a node and table; write it once and keep it.

    A bucket is the side of ``bits`` random planes that a vector lies on, so vectors at a small angle often share one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = _signatures(np.array(batch["embedding"].tolist(), dtype=np.float64), tables, bits, seed)
                yield pd.DataFrame({"t": np.tile(np.arange(tables, dtype=np.int32), len(batch)), "bucket": keys.ravel(), "node_id": np.repeat(batch["node_id"].to_numpy(), tables)})

    return nodes.where(F.col("embedding").isNotNull()).select("node_id", "embedding").mapInPandas(run, f"t int, bucket long, node_id {dict(nodes.dtypes)['node_id']}")


def _signatures(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))
    return (x @ planes > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def approximate_search(queries: DataFrame, nodes: DataFrame, k: int = 5, threshold: float = 0.6, tables: int = 16, bits: int = 8, index: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """``vector_search`` over the nodes that share a bucket with the query: (query_id, node_id, score, r).

    Scores are exact; nodes in no common bucket are missed, so the result is approximate. Nodes get their signatures and
    are scored where they lie, bucket by bucket, against a bounded part of the queries at a time: no vector and no pair is
    shuffled, a task brings ``k`` nodes a query at most. For a few queries ``index``, a kept ``signature_index`` with the
    same tables and bits, spares the scan's products: their pairs are joined instead.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    if index is None:
        return _bucketed(queries, nodes, k, threshold, tables, bits, apart).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    asked = signature_index(queries.select(F.col("query_id").alias("node_id"), "embedding"), tables, bits).withColumnRenamed("node_id", "query_id")
    pairs = asked.join(index, ["t", "bucket"]).select("query_id", "node_id").distinct()
    pairs = pairs.where("query_id <> node_id") if apart else pairs

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_cosines(np.stack(a.to_list()), np.stack(b.to_list())) if len(a) else [], dtype="float64")

    q, n = queries.select("query_id", F.col("embedding").alias("a")), nodes.select("node_id", F.col("embedding").alias("b"))
    scored = pairs.join(q, "query_id").join(n, "node_id").select("query_id", "node_id", cosine("a", "b").alias("score")).where(F.col("score") >= threshold)
    return scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)


def _bucketed(queries: DataFrame, nodes: DataFrame, k: int, threshold: float, tables: int, bits: int, apart: bool) -> DataFrame:
    """(query_id, node_id, score): each task's best ``k`` of the pairs that share a bucket and reach the threshold."""
    spark = nodes.sparkSession
    schema = f"query_id {dict(queries.dtypes)['query_id']}, node_id {dict(nodes.dtypes)['node_id']}, score double"
    nodes = nodes.where(F.col("embedding").isNotNull()).select("node_id", "embedding")

    def scored(ids: np.ndarray, a: np.ndarray, _: np.ndarray) -> DataFrame:
        held = spark.sparkContext.broadcast((ids, a, _signatures(a, tables, bits, 1)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, a, keys = held.value
            unit, found = _unit(a), []
            order = np.argsort(keys, axis=0, kind="stable")
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    some = batch.iloc[at : at + BLOCK]
                    b, node = np.array(some["embedding"].tolist(), dtype=np.float64), some["node_id"].to_numpy()
                    own, sides, codes = _signatures(b, tables, bits, 1), _unit(b), []
                    for t in range(tables):
                        mine, lies = keys[order[:, t], t], np.argsort(own[:, t], kind="stable")
                        theirs = own[lies, t]
                        both = np.intersect1d(mine, theirs)
                        ends = [np.searchsorted(x, both, side=side) for x in (mine, theirs) for side in ("left", "right")]
                        for q0, q1, n0, n1 in zip(*ends, strict=True):
                            i, j = order[q0:q1, t], lies[n0:n1]
                            # a little below the threshold: the cosines below are rounded in another order
                            x, y = np.nonzero(np.maximum(unit[i] @ sides[j].T, 0.0) >= threshold - 1e-6)
                            codes.append(i[x] * len(b) + j[y])
                    i, j = np.divmod(np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64), len(b))
                    if apart:
                        other = ids[i] != node[j]
                        i, j = i[other], j[other]
                    s = np.concatenate([_cosines(a[i[c : c + QUERIES]], b[j[c : c + QUERIES]]) for c in range(0, len(i), QUERIES)]) if len(i) else np.zeros(0)
                    inside = s >= threshold
                    found.append((i[inside], node[j[inside]], s[inside]))
                    found = [_best(found, k)]
            if found:
                i, node, s = found[0]
                yield pd.DataFrame({"query_id": ids[i], "node_id": node, "score": s})

        return nodes.mapInPandas(run, schema)

    parts = _passes(queries)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return scored(*first)
    path = new_path(spark, "vector-scores")
    for part in (first, second, *parts):
        scored(*part).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _unit(a: np.ndarray) -> np.ndarray:
    return a / (np.sqrt((a * a).sum(1))[:, None] + 1e-300)


def _best(found: list, most: int) -> tuple[np.ndarray, ...]:
    """The best ``most`` a query of (query, node, score), ties by node."""
    i, node, s = _joined(found)
    order = np.lexsort((node, -s, i))
    i, node, s = i[order], node[order], s[order]
    inside = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[inside], node[inside], s[inside]


def search_recall(queries: DataFrame, nodes: DataFrame, k: int = 5, threshold: float = 0.6, tables: int = 16, bits: int = 8, sample: int = 200, apart: bool = False) -> float:
    """Share of the exact answers of a sample of queries (by hash) that the approximate search finds; 1 if there are none."""
    some = cut(queries.orderBy(F.xxhash64("query_id")).limit(sample))
    truth = cut(vector_search(some, nodes, k, threshold, apart).select("query_id", "node_id"))
    found = approximate_search(some, nodes, k, threshold, tables, bits, apart=apart).select("query_id", "node_id")
    total = truth.count()
    return truth.join(found, ["query_id", "node_id"], "left_semi").count() / total if total else 1.0


def audited_search(queries: DataFrame, nodes: DataFrame, k: int = 5, threshold: float = 0.6, recall: float = 0.9, bits: int = 8, most: int = 128, apart: bool = False) -> DataFrame:
    """``approximate_search`` with as many tables as the recall of a sample asks for: doubled until it is reached.

    Adds the column ``recall`` (of the sample). If ``most`` tables don't reach it the search is exact.
    """
    tables = 8
    while tables <= most:
        got = search_recall(queries, nodes, k, threshold, tables, bits, apart=apart)
        if got >= recall:
            return approximate_search(queries, nodes, k, threshold, tables, bits, apart=apart).withColumn("recall", F.lit(got))
        tables *= 2
    return vector_search(queries, nodes, k, threshold, apart).withColumn("recall", F.lit(1.0))


def find_best(queries: DataFrame, sentences: DataFrame, threshold: float = 0.6, apart: bool = False) -> DataFrame:
    """One row a query; node and score are null if nothing reaches the threshold."""
    return queries.select("query_id").join(vector_search(queries, sentences, 1, threshold, apart).drop("r"), "query_id", "left")


def topk_per_group(df: DataFrame, group: list[str], score: str, k: int, tie: str) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie))).where(F.col("r") <= k)


def citation_scores(papers: DataFrame, refs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``papers(paper_id, title)``, ``refs(paper_id, cited_title, polarity)``, ``vectors(title, embedding)``: scored, ranked edges.

    Titles are cleaned to letters. Edges are dealt once, without vectors, by a block of papers and a part of the titles. A
    paper's vector goes to each part, a title's to each block, and a task holds its block's papers (``PAPERS`` or so) while
    titles and their edges pass by in order, so vectors are copied by blocks and not by edges.
    """
    spark, t = refs.sparkSession, tx.clean_title_alpha(F.col("title"))
    v = vectors.where("embedding is not null").select(t.alias("t"), "embedding").where("t is not null").dropDuplicates(["t"])
    p = papers.where("paper_id is not null").select("paper_id", t.alias("t"))
    blocks = max(8, -(-p.count() // PAPERS))
    parts = min(TITLE_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block, part = F.pmod(F.xxhash64("paper_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda c, like: F.lit(None).cast(like.schema[c].dataType).alias(c)
    own = p.join(v, "t").select(block.alias("b"), every(parts).alias("s"), F.lit(0).alias("side"), none("t", v), "paper_id", none("polarity", refs), none("cited_title", refs), "embedding")
    titles = v.select(every(blocks).alias("b"), part.alias("s"), F.lit(1).alias("side"), "t", none("paper_id", papers), none("polarity", refs), none("cited_title", refs), "embedding")
    edges = refs.where("paper_id is not null").withColumn("t", tx.clean_title_alpha(F.col("cited_title"))).where("t is not null")
    edges = edges.select(block.alias("b"), part.alias("s"), F.lit(2).alias("side"), "t", "paper_id", "polarity", "cited_title", none("embedding", v))
    dealt = edges.unionByName(titles).unionByName(own).repartitionById(blocks * parts, F.col("b") * parts + F.col("s")).drop("b", "s").sortWithinPartitions("t", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, found = [], [], None  # of the papers
        name, vector = pa.scalar(None, pa.string()), None  # of the last title
        for batch in batches:
            side, emb = batch["side"].to_numpy(), batch["embedding"].drop_null()
            x = emb.flatten().to_numpy(zero_copy_only=False).reshape(len(emb), -1) if len(emb) else np.zeros((0, 0))
            n = int((side == 0).sum())
            if n:
                ids.append(batch["paper_id"].slice(0, n).to_pandas())
                held.append(x[:n])
            names = pa.concat_arrays([pa.array([name.as_py()], batch["t"].type), batch["t"].filter(pa.array(side == 1))])
            y = x[n:] if vector is None else np.concatenate([vector, x[n:]]) if len(emb) else vector
            at = np.cumsum(side == 1)[side == 2]
            if len(at) and ids:
                if found is None:
                    code, unique = pd.factorize(pd.concat(ids, ignore_index=True))
                    order = np.argsort(code, kind="stable")
                    found = pd.Index(unique), np.bincount(code, minlength=len(unique)), np.searchsorted(code[order], np.arange(len(unique))), np.concatenate(held)[order]
                index, count, first, own = found
                e = batch.filter(pa.array(side == 2))
                who = index.get_indexer(e["paper_id"].to_pandas())
                keep = np.flatnonzero((who >= 0) & pc.fill_null(pc.equal(e["t"], names.take(pa.array(at))), False).to_numpy(zero_copy_only=False))
                # a paper with several titles has an edge from each
                times = count[who[keep]]
                row = np.repeat(keep, times)
                mine = np.repeat(first[who[keep]], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                score = _cosines(own[mine], y[at[row] - (vector is None)]) if len(row) else np.zeros(0)
                e = e.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([e["paper_id"], e["polarity"], e["cited_title"], pa.array(score, pa.float64(), from_pandas=True)], ["paper_id", "polarity", "cited_title", "score"])
            if (side == 1).any():
                name, vector = names[-1], y[-1:]

    kinds = dict(dealt.dtypes)
    s = dealt.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in ("paper_id", "polarity", "cited_title")] + ["score double"]))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("paper_id", "polarity").orderBy(F.desc("score"), "cited_title")))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, clipped to [0, 1]."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
    return np.clip(np.einsum("ij,ij->i", x, y) / (norms + 1e-8), 0.0, 1.0)


def top_reference_titles(scores: DataFrame, k: int | None) -> DataFrame:
    return (scores.where(F.col("r") <= k) if k else scores).select(F.col("cited_title").alias("title")).distinct()


def two_sided_topk(scored: DataFrame, k: int) -> DataFrame:
    """``scored(query_id, kind, paper_id, score)``, kind background or target: 2k each, papers in both go, k each stay."""
    two = topk_per_group(scored, ["query_id", "kind"], "score", 2 * k, "paper_id").drop("r")
    both = two.groupBy("query_id", "paper_id").agg(F.count_distinct("kind").alias("n")).where("n > 1").select("query_id", "paper_id")
    return topk_per_group(two.join(both, ["query_id", "paper_id"], "left_anti"), ["query_id", "kind"], "score", k, "paper_id")


#: Sources and polarities in order of priority.
PRIORITY = [("citation", "positive"), ("citation", "negative"), ("semantic", "negative"), ("semantic", "positive")]


def dedup_by_priority(related: DataFrame) -> DataFrame:
    """One row a (query, paper): citations before semantic, semantic negative before positive, then by rank."""
    order = F.lit(len(PRIORITY))
    for i, (s, p) in enumerate(PRIORITY):
        order = F.when((F.col("source") == s) & (F.col("polarity") == p), i).otherwise(order)
    w = Window.partitionBy("query_id", "paper_id").orderBy(order, "r")
    return related.withColumn("__p", F.row_number().over(w)).where("__p = 1").drop("__p")


def related_papers(citations: DataFrame, semantic: DataFrame, k: int | None = 3, threshold: float | None = None) -> DataFrame:
    """``citations(query_id, paper_id, polarity, score)``, ``semantic(query_id, paper_id, kind, score)``: the related papers of
    all queries, by count or by threshold: (query_id, source, polarity, paper_id, score, r).

    Background neighbours speak for the paper (positive), target neighbours compete with it (negative).
    """
    if threshold is None:
        c = topk_per_group(citations, ["query_id", "polarity"], "score", k, "paper_id")
        s = two_sided_topk(semantic, k)
    else:
        c = topk_per_group(citations.where(F.col("score") >= threshold), ["query_id", "polarity"], "score", 2**31 - 1, "paper_id")
        s = topk_per_group(semantic.where(F.col("score") >= threshold), ["query_id", "kind"], "score", 2**31 - 1, "paper_id")
    c = c.withColumn("source", F.lit("citation"))
    s = s.withColumn("source", F.lit("semantic")).withColumn("polarity", F.when(F.col("kind") == "background", "positive").otherwise("negative")).drop("kind")
    return dedup_by_priority(c.unionByName(s.select(c.columns)))


def month_number(year: Column, month: Column, missing: int) -> Column:
    """A number that orders months; ``missing`` stands for the month where there is none."""
    return (year * 100 + F.coalesce(month, F.lit(missing))).cast("long")


def single_paper_related(queries: DataFrame, pool: DataFrame, citations: DataFrame, k: int, filter_by_date: bool = True) -> DataFrame:
    """Related papers of papers that are not in the pool: (query_id, source, polarity, paper_id, score, r).

    ``queries(query_id, kind, embedding, year, month)`` and ``pool(paper_id, kind, embedding, abstract, year, published)``,
    kind background or target; ``citations(query_id, paper_id, polarity, score, abstract)``. Papers with a blank abstract
    are left out. Each side's best ``k`` count, background as negative, target as positive; citations by polarity; one row
    a paper stays. With ``filter_by_date`` a query meets only papers published not after it: earlier years, and of its own
    year the months up to its own if both are known (a query without a year meets all). The dates are compared before the
    best are taken, so every query gets ``k`` if there are as many.
    """
    q = queries.withColumn("until", month_number(F.col("year"), F.col("month"), 0))
    n = pool.where(non_blank(F.col("abstract"))).withColumn("since", month_number(F.col("year"), F.when(F.year("published") == F.col("year"), F.month("published")), 99)).withColumnRenamed("paper_id", "node_id")
    n = n if filter_by_date else n.drop("since")
    sides = []
    for kind, polarity in (("background", "negative"), ("target", "positive")):
        best = semantic_topk(q.where(F.col("kind") == kind), n.where(F.col("kind") == kind), k)
        sides.append(best.select("query_id", F.col("node_id").alias("paper_id"), "score", "r", F.lit("semantic").alias("source"), F.lit(polarity).alias("polarity")))
    cited = citations.where(non_blank(F.col("abstract"))).select("query_id", "paper_id", "polarity", "score")
    cited = topk_per_group(cited, ["query_id", "polarity"], "score", k, "paper_id").withColumn("source", F.lit("citation"))
    return dedup_by_priority(cited.unionByName(sides[0]).unionByName(sides[1])).select("query_id", "source", "polarity", "paper_id", "score", "r")


def kg_neighbours(terms: DataFrame, relations: DataFrame) -> DataFrame:
    """``terms(paper_id, term)``, ``relations(head, tail)``: all tails of exactly matching normalised heads."""
    h = relations.select(tx.alpha_ascii(F.col("head")).alias("t"), "tail")
    j = terms.select("paper_id", "term", tx.alpha_ascii(F.col("term")).alias("t")).where("t <> ''").join(h, "t")
    return j.groupBy("paper_id", "term").agg(F.array_sort(F.collect_set("tail")).alias("tails"))


def base_input_match(sentences: DataFrame, nodes: DataFrame, apart: bool = False) -> DataFrame:
    """``sentences(paper_id, relation_id, query_id, embedding)`` (two templates a relation) -> the best node over both.

    With ``apart`` queries are nodes too, and none is its own answer.
    """
    best = semantic_topk(sentences.select("query_id", "embedding"), nodes.select("node_id", "embedding"), 1, apart=apart)
    j = sentences.select("paper_id", "relation_id", "query_id").join(best, "query_id")
    return j.groupBy("paper_id", "relation_id").agg(F.max_by("node_id", F.struct("score", -F.col("node_id"))).alias("node_id"), F.max("score").alias("score"))


def scimon_terms(citations: DataFrame, kg: DataFrame | None, semantic: DataFrame) -> DataFrame:
    """(paper_id, citation_titles, kg_terms, semantic_terms): sorted distinct lists; semantic terms without those of the graph."""
    c = citations.groupBy("paper_id").agg(F.array_sort(F.collect_set("title")).alias("citation_titles"))
    s = semantic
    if kg is not None:
        k = kg.groupBy("paper_id").agg(F.array_sort(F.collect_set("term")).alias("kg_terms"))
        s = s.join(kg.select("paper_id", "term").distinct(), ["paper_id", "term"], "left_anti")
    s = s.groupBy("paper_id").agg(F.array_sort(F.collect_set("term")).alias("semantic_terms"))
    out = c.join(s, "paper_id", "full_outer")
    out = out.join(k, "paper_id", "full_outer") if kg is not None else out.withColumn("kg_terms", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return out.select("paper_id", *[F.coalesce(x, none).alias(x) for x in ("citation_titles", "kg_terms", "semantic_terms")])
