"""Embedding near-duplicates by NN-descent.

Equal vectors are one node. A neighbour graph starts from several sorted random-hyperplane signatures (nodes next to each
other in one of the orders are compared) and is refined by neighbours-of-neighbours joins: each node gathers its
neighbours and reverse neighbours and all of these are compared with each other by one small matrix product. Rounds end
when the number of links stops growing. Pairs with cosine >= 0.9 in double precision are links, all others are dropped.

A node whose list holds links only is saturated: it may have more. A link falls out of both lists only if both ends are
saturated, so the components with saturated nodes are compared with each other: each is a ball around one of its members
(the pivot), the pivots get neighbour lists by a descent of their own, balls within reach are multiplied chunk by chunk, and
components with a link between them become one. Lists are then enlarged to the whole component. There the angle to one pivot settles most pairs (two nodes within half the limit of the
pivot are linked); only nodes outside that half are compared, chunk by chunk, with the component's members, and counts
instead of pairs come out.

The audit compares a sample of nodes with all vectors (in blocks, nothing else is collected). Its links count as found if
they are in the result: listed, or inside one enlarged component. They do not go into the result. Each turn draws other
nodes. While fewer than
``RECALL`` are found, lists and signature orders are doubled and the rounds go on; beyond lists of ``MOST`` all nodes are
compared with all, in blocks.

Vectors that are null or zero or hold null or non-finite components have no links. Vectors of different length are
compared as if filled up with zeros. Repeated rows count as links of each other. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import components, cut, new_path, parts_for, written

SIMILAR = 0.9
LIST = 10
MOST = 40
TABLES = 8
SPAN = 24
SAMPLE = 400
RECALL = 0.98
CHUNK = 512
BLOCK = 2048
SEED = 20240101


def _nodes(rows: DataFrame, dim: int) -> DataFrame:
    """Classes of equal vectors with their unit vectors: nid, h1, h2, copies, least, u32, u64."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), dim))
            for i, v in enumerate(batch["v"]):
                x[i, : len(v)] = v
            x /= np.maximum(np.abs(x).max(1), 5e-324)[:, None] if len(x) else 1.0
            x /= np.sqrt((x * x).sum(1))[:, None]
            out = batch.drop(columns=["v"])
            out["u32"] = [r.tobytes() for r in x.astype(np.float32)]
            out["u64"] = [r.tobytes() for r in x]
            yield out[["h1", "h2", "copies", "least", "u32", "u64"]]

    classes = rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("v").alias("v"))
    made = classes.select("h1", "h2", "copies", F.col("least").cast("string").alias("least"), "v").mapInPandas(run, "h1 long, h2 long, copies long, least string, u32 binary, u64 binary")
    return written(made.withColumn("nid", F.monotonically_increasing_id()), "nn-nodes")


def _mat(blobs, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=dtype).reshape(len(blobs), -1)


LISTS = "nid long, near array<struct<s:float,o:long>>"


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each row of ``sims`` its ``k`` best columns; nodes are never their own neighbours."""
    k = min(k, sims.shape[1])
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(sims, best, 1)
    return [[(float(s), int(ids[j])) for s, j in zip(ss, jj, strict=True) if s > -1.5] for ss, jj in zip(got, best, strict=True)]


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all lists of a node."""
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))), lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), 1, k)
    # sums in float32 differ a little by order, so the same neighbour may come twice; it only takes a place in the list
    return lists.groupBy("nid").agg(best.alias("near"))


def _start(nodes: DataFrame, n: int, dim: int, k: int, turn: int = 0) -> DataFrame:
    """Lists from signature orders: other ones each turn, and twice as many as in the turn before."""
    tables = TABLES << turn
    bits = max(4, min(60, round(math.log2(max(n, 2) / 8))))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(SEED + turn).standard_normal((dim, tables * bits)).astype(np.float32)
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if len(batch) == 0:
                continue
            on = (_mat(batch["u32"], np.float32) @ planes > 0).reshape(len(batch), tables, bits)
            keys = on.astype(np.int64) @ weights
            for t in range(tables):
                yield pd.DataFrame({"t": t, "key": keys[:, t], "nid": batch["nid"], "u32": batch["u32"]})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("t", sort=False):
                ids, x = part["nid"].to_numpy(), _mat(list(part["u32"]), np.float32)
                for a in range(0, len(ids), SPAN):
                    lo, hi = max(0, a - SPAN), min(len(ids), a + 2 * SPAN)
                    own = np.arange(a, min(len(ids), a + SPAN))
                    sims = x[own] @ x[lo:hi].T
                    sims[np.arange(len(own)), own - lo] = -2.0
                    yield pd.DataFrame({"nid": ids[own], "near": _top(sims, ids[lo:hi], k)})

    parts = max(8, n * tables // 40_000)
    keyed = nodes.select("nid", "u32").mapInPandas(sign, "t int, key long, nid long, u32 binary")
    ordered = keyed.repartitionByRange(parts, "t", "key", "nid").sortWithinPartitions("t", "key", "nid")
    return _merged(ordered.mapInPandas(near, LISTS), k)


def _refine(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round: all members of each node's neighbourhood (lists in both directions) are compared with each other."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out_ids, out = [], []
            for members in batch["members"]:
                ids = np.array([m["nid"] for m in members])
                x = _mat([m["u32"] for m in members], np.float32)
                sims = x @ x.T
                sims[ids[:, None] == ids[None, :]] = -2.0
                out_ids.append(ids)
                out += _top(sims, ids, k)
            if out:
                yield pd.DataFrame({"nid": np.concatenate(out_ids), "near": out})

    e = graph.select("nid", F.explode("near").alias("x")).select("nid", F.col("x.o").alias("o"), F.col("x.s").alias("s"))
    back = e.select(F.col("o").alias("c"), F.col("nid").alias("m"), F.row_number().over(Window.partitionBy("o").orderBy(F.desc("s"), "nid")).alias("r")).where(F.col("r") <= k).drop("r")
    pairs = e.select(F.col("nid").alias("c"), F.col("o").alias("m")).unionByName(back).unionByName(graph.select(F.col("nid").alias("c"), F.col("nid").alias("m")))
    full = pairs.join(nodes.select(F.col("nid").alias("m"), "u32"), "m")
    groups = full.groupBy("c").agg(F.collect_set(F.struct(F.col("m").alias("nid"), "u32")).alias("members"))
    return _merged(groups.select("members").mapInPandas(local, LISTS).unionByName(graph), k)


def _links(graph: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Verified links (a, b), a < b, in double precision."""
    near = graph.select("nid", F.explode("near").alias("x")).where(F.col("x.s") >= similar - 1e-3)
    pairs = near.select(F.least("nid", "x.o").alias("a"), F.greatest("nid", "x.o").alias("b")).distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ok = np.einsum("ij,ij->i", _mat(batch["ua"], np.float64), _mat(batch["ub"], np.float64)) >= similar
                yield batch.loc[ok, ["a", "b"]]

    one = nodes.select(F.col("nid").alias("a"), F.col("u64").alias("ua"))
    two = nodes.select(F.col("nid").alias("b"), F.col("u64").alias("ub"))
    return pairs.join(one, "a").join(two, "b").mapInPandas(check, "a long, b long")


def audit(nodes: DataFrame, similar: float, turn: int = 0, sample: int = SAMPLE) -> DataFrame:
    """All links (a, b) of a bounded sample of nodes (by hash), found by comparing it with every vector."""
    chosen = nodes.orderBy(F.xxhash64("nid", F.lit(SEED + turn))).limit(sample).select("nid", "u64").collect()
    held = nodes.sparkSession.sparkContext.broadcast((np.array([r["nid"] for r in chosen]), _mat([r["u64"] for r in chosen], np.float64) if chosen else np.zeros((0, 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = held.value
        for batch in batches:
            if len(batch) and len(ids):
                own = batch["nid"].to_numpy()
                i, j = np.nonzero(_mat(batch["u64"], np.float64) @ q.T >= similar)
                a, b = own[i], ids[j]
                ok = a != b
                yield pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok]})

    return nodes.select("nid", "u64").mapInPandas(run, "a long, b long").distinct()


def descend(nodes: DataFrame, n: int, dim: int, similar: float = SIMILAR, k: int = LIST, turn: int = 0, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph, links): lists of ``k``, started anew and from the lists of the turn before, refined until links stop growing."""
    graph = _start(nodes, n, dim, k, turn)
    graph = cut(graph if known is None else _merged(graph.unionByName(known), k))
    before = -1
    while True:
        now = graph.agg(F.coalesce(F.sum(F.size(F.filter("near", lambda x: x["s"] >= similar))), F.lit(0)).alias("n")).first()["n"]
        if now <= before * 1.005 and before >= 0:
            return graph, cut(_links(graph, nodes, similar))
        before = now
        graph = cut(_refine(graph, nodes, k))


def _saturated(graph: DataFrame, k: int, similar: float) -> DataFrame:
    return graph.where((F.size("near") >= k) & (F.element_at("near", -1)["s"] >= similar - 1e-3)).select("nid")


def chunk_pairs(sized: DataFrame) -> DataFrame:
    """(a, c1, b, c2): every chunk of ``a`` with every chunk of ``b``, from ``sized(a, na, b, nb)``; rows of numbers only.

    They are dealt by chunk before they are many, so one large component's pairs are made and compared by many tasks.
    """
    first = sized.select("a", "b", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("c1")).repartition("a", "b", "c1")
    return first.select("a", "c1", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("c2"))


def dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their angle to the pivot (the component's root) and their chunk; and (root, chunks, wide)."""

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                c = np.einsum("ij,ij->i", _mat(batch["u64"], np.float64), _mat(batch["pivot"], np.float64))
                yield batch.drop(columns=["pivot"]).assign(angle=np.arccos(np.clip(c, -1.0, 1.0)))

    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    pivots = members.where("nid = root").select("root", F.col("u64").alias("pivot"))
    m = members.select("root", "nid", "copies", "u64").join(pivots, "root").mapInPandas(angles, "root long, nid long, copies long, u64 binary, angle double")
    m = written(m.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("nid"), "chunks").cast("int")), "nn-members")
    return m, cut(m.groupBy("root").agg(F.max("chunks").alias("chunks"), F.max("angle").alias("wide")))


def across(members: DataFrame, nodes: DataFrame, dim: int, similar: float, k: int, turn: int) -> DataFrame | None:
    """Pairs (a, b) of the roots of ``members(root, nid, u64, ..)`` that have a link between their members; None: one root.

    Each component is one ball (its pivot and widest angle). Neighbour lists of the pivots come from a descent of their
    own, and pairs of balls within reach of each other are compared chunk by chunk.
    """
    limit = math.acos(similar) + 1e-6

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [bool((_mat(x, np.float64) @ _mat(y, np.float64).T >= similar).any()) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[np.array(ok, dtype=bool), ["a", "b"]]

    m, balls = dealt(members)
    n = balls.count()
    if n < 2:
        return None
    pivots = written(balls.select(F.col("root").alias("nid")).join(nodes, "nid"), "nn-pivots")
    graph, _ = descend(pivots, n, dim, similar, 2 * k, turn)
    near = graph.select("nid", F.explode("near").alias("x")).select(F.least("nid", "x.o").alias("a"), F.greatest("nid", "x.o").alias("b"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x.s").cast("double")))).alias("angle"))
    ends = [balls.select(F.col("root").alias(e), F.col("wide").alias(f"w{e}"), F.col("chunks").alias(f"n{e}")) for e in ("a", "b")]
    near = near.join(ends[0], "a").join(ends[1], "b").where(F.col("angle") <= limit + 1e-3 + F.col("wa") + F.col("wb")).select("a", "na", "b", "nb").distinct()
    packed = m.groupBy("root", "chunk").agg(F.collect_list("u64").alias("us"))
    one, two = (packed.select(F.col("root").alias(r), F.col("chunk").alias(c), F.col("us").alias(u)) for r, c, u in (("a", "c1", "x"), ("b", "c2", "y")))
    return cut(chunk_pairs(near).join(one, ["a", "c1"]).join(two, ["b", "c2"]).mapInPandas(linked, "a long, b long").distinct())


def _mates(on: np.ndarray, ia: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest row's id that each row and each column of a link matrix is joined with."""
    last = np.iinfo(np.int64).max
    la = ia
    while True:
        lb = np.where(on, la[:, None], last).min(0)
        new = np.where(on, lb[None, :], last).min(1)
        if (new == la).all():
            return la, lb
        la = new


def every(nodes: DataFrame, n: int, similar: float) -> tuple[DataFrame, DataFrame]:
    """All nodes with all, a bounded block after the other: (nid, root) and (nid, others) of nodes with links."""
    spark = nodes.sparkSession
    blocks = parts_for(n, BLOCK)
    path = new_path(spark, "nn-every")
    for at in range(blocks):
        chosen = nodes.where(F.pmod(F.xxhash64("nid"), F.lit(blocks)) == at).select("nid", "copies", "u64").collect()
        if not chosen:
            continue
        held = spark.sparkContext.broadcast((np.array([r["nid"] for r in chosen]), np.array([r["copies"] for r in chosen]), _mat([r["u64"] for r in chosen], np.float64)))

        def compare(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, copies, q = held.value
            for batch in batches:
                for lo in range(0, len(batch), CHUNK):
                    own, x = batch["nid"].to_numpy()[lo : lo + CHUNK], _mat(list(batch["u64"][lo : lo + CHUNK]), np.float64)
                    on = (x @ q.T >= similar) & (own[:, None] != ids[None, :])
                    i, j = np.flatnonzero(on.any(1)), np.flatnonzero(on.any(0))
                    if len(i):
                        la, lb = _mates(on[np.ix_(i, j)], own[i])
                        yield pd.DataFrame({"nid": np.concatenate([own[i], ids[j]]), "others": np.concatenate([on[i] @ copies, 0 * lb]), "mate": np.concatenate([la, lb])})

        nodes.select("nid", "u64").mapInPandas(compare, "nid long, others long, mate long").write.mode("append").parquet(path)
        held.unpersist()
    found = spark.read.parquet(path)
    roots = components(found.select(F.col("nid").alias("a"), F.col("mate").alias("b"))).withColumnRenamed("node", "nid")
    return cut(roots), cut(found.groupBy("nid").agg(F.sum("others").alias("others")))


def settled(graph: DataFrame, links: DataFrame, nodes: DataFrame, dim: int, k: int, turn: int, similar: float) -> tuple[DataFrame, DataFrame]:
    """(nid, root) of nodes in components, and (root, nid, copies, u64) of the components that hold saturated nodes."""
    roots = cut(components(links).withColumnRenamed("node", "nid"))
    own = F.coalesce("root", "nid").alias("root")
    full = _saturated(graph, k, similar).join(roots, "nid", "left").select(own).distinct()
    members = nodes.select("nid", "copies", "u64").join(roots, "nid", "left").select(own, "nid", "copies", "u64").join(full, "root", "left_semi")
    members = written(members, "nn-full")
    over = across(members, nodes, dim, similar, k, turn)
    if over is None or over.isEmpty():
        return roots, members
    moved = cut(components(over).select(F.col("node").alias("root"), F.col("root").alias("to")))
    members = members.join(moved, "root", "left").select(F.coalesce("to", "root").alias("root"), "nid", "copies", "u64")
    inside = members.select("nid", "root")
    return cut(inside.unionByName(roots.join(inside, "nid", "left_anti").select("nid", "root"))), members


def lost(truth: DataFrame, links: DataFrame, members: DataFrame) -> int:
    """How many of the audit's links the result does not count: neither listed nor inside one enlarged component."""
    ends = [members.select(F.col("nid").alias(e), F.col("root").alias(f"r{e}")) for e in ("a", "b")]
    out = truth.join(links, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
    return out.where("coalesce(ra <> rb, true)").count()


def enlarged(members: DataFrame, similar: float) -> DataFrame:
    """Exact number of linked rows inside each component: ``members(root, nid, copies, u64)`` -> (nid, others)."""
    half = math.acos(similar) / 2 - 1e-6

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for outer, other in zip(batch["outer"], batch["other"], strict=True):
                a, b = _mat([x["u64"] for x in outer], np.float64), _mat([x["u64"] for x in other], np.float64)
                ia, ib = np.array([x["nid"] for x in outer]), np.array([x["nid"] for x in other])
                na, nb = np.array([x["copies"] for x in outer]), np.array([x["copies"] for x in other])
                inner = np.array([x["inner"] for x in other])
                on = (a @ b.T >= similar) & (ia[:, None] != ib[None, :])
                yield pd.DataFrame({"nid": np.concatenate([ia, ib[inner]]), "others": np.concatenate([on @ nb, na @ on[:, inner]])})

    m, balls = dealt(members)
    m = m.withColumn("inner", F.col("angle") <= half)
    inside = m.where("inner").groupBy("root").agg(F.sum("copies").alias("all_inner"))
    base = m.where("inner").join(inside, "root").select("nid", (F.col("all_inner") - F.col("copies")).alias("others"))
    packed = lambda d, root, chunk, name: d.groupBy(F.col("root").alias(root), F.col("chunk").alias(chunk)).agg(F.collect_list(F.struct("nid", "copies", "inner", "u64")).alias(name))
    sized = balls.select(F.col("root").alias("a"), F.col("chunks").alias("na"), F.col("root").alias("b"), F.col("chunks").alias("nb"))
    pairs = chunk_pairs(sized).join(packed(m.where("not inner"), "a", "c1", "outer"), ["a", "c1"]).join(packed(m, "b", "c2", "other"), ["b", "c2"])
    rest = pairs.select("outer", "other").mapInPandas(compare, "nid long, others long")
    return base.unionByName(rest).groupBy("nid").agg(F.sum("others").alias("others"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", similar: float = SIMILAR) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    kind = dict(df.dtypes)[id_col]
    v = F.col(vector).cast("array<double>")
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(SEED), "v"))
    good = rows.where("fine")
    dim = good.agg(F.max(F.size("v")).alias("d")).first()["d"]
    alone = rows.where("not fine").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if dim is None:
        return alone
    nodes = _nodes(good, dim)
    n = nodes.count()
    k, turn, graph, links = LIST, 0, None, nodes.select(F.col("nid").alias("a"), F.col("nid").alias("b")).where("false")
    while True:
        if k > MOST:
            roots, more = every(nodes, n, similar)
            break
        graph, links = descend(nodes, n, dim, similar, k, turn, graph)
        roots, members = settled(graph, links, nodes, dim, k, turn, similar)
        truth = cut(audit(nodes, similar, turn))
        if lost(truth, links, members) <= (1 - RECALL) * truth.count():
            more = enlarged(members, similar)
            break
        k, turn = 2 * k, turn + 1
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    plain = both.join(nodes.select(F.col("nid").alias("b"), "copies"), "b").groupBy(F.col("a").alias("nid")).agg(F.sum("copies").alias("listed"))
    named = nodes.drop("u32", "u64").join(roots, "nid", "left").join(plain, "nid", "left").join(more, "nid", "left")
    named = named.withColumn("root", F.coalesce("root", "nid")).withColumn("least", F.col("least").cast(kind))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "root").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", "listed", F.lit(0))).alias("n_links"), "component_id"))
    out = good.select("id", "h1", "h2").join(named, ["h1", "h2"])
    return out.select(F.col("id").alias(id_col), "n_links", F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")).unionByName(alone)
