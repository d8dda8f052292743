"""Centroid clustering (Lloyd's rounds) in which heaps of bounds say which vectors must be looked at again.

Components are whole numbers, ``floor(256 * x)``, so distances, sums and centroids are exact.

Vectors live in blocks of a table, each with its state: the vector's centroid, and a key. When a vector is compared with
all centroids, the gap between its distance to the second nearest (lower bound) and to its own (upper bound) is known.
Each later round takes at most (move of the own centroid + largest move of another) off that gap. These amounts are added
up for each centroid; the key is the gap plus the sum so far, so it need not be changed while centroids move. Within a
block the keys of each centroid's vectors are a heap (kept as an ascending array, which is one): vectors are popped while
their key is at most the sum now, are compared exactly with all centroids, and are put into the heap of their new centroid.
All others keep their centroid, without being compared.

A round is one pass over the blocks. Each block brings the change of the sums and counts of its popped vectors; the driver
gets one row a centroid. Each round's blocks are a table in the shared folder, and the table before goes.

Cases: vectors of another length, null ones, and ones with null or non-finite components are left out. Repeated rows are
vectors of their own. With fewer vectors than centroids there are as many centroids as vectors. Vectors without an id come
last among the first centroids (equal ones by components). Centroids without vectors stay. An empty table gives an empty
result. Components beyond ``MOST`` are an error, since squared distances would not fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import clean_up, last_path, mark, parts_for, written

CLUSTERS = 40
ROUNDS = 5
DIM = 64
#: Vectors to a block (of DIM 64-bit numbers each).
BLOCK = 8_192
#: Largest component: 64 squared differences of twice this size stay below 2**63.
MOST = 1 << 27
#: Bounds are doubles; keys this much above the sum of moves (relative to the distances) still count as expired.
SLACK = 1e-9

STATE = "ids array<string>, x binary, own binary, key binary, clusters binary, counts binary, sums binary, popped long"


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column a centroid."""
    out = np.empty((len(x), len(centroids)), dtype=np.int64)
    for c, centre in enumerate(centroids):
        d = x - centre
        out[:, c] = np.einsum("ij,ij->i", d, d)
    return out


def compared(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, ties to the smaller number; gap to the second nearest; scale of the rounding error)."""
    d = _distances(x, centroids)
    own = d.argmin(1)
    at = np.arange(len(x))
    upper = np.sqrt(d[at, own].astype(np.float64))
    d[at, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(np.float64)) if len(centroids) > 1 else np.full(len(x), np.inf)
    return own, lower - upper, np.where(np.isfinite(lower), lower, 0.0)


class Heaps:
    """The heaps of one block: for each centroid an ascending array of keys and the places of their vectors."""

    def __init__(self, own: np.ndarray, key: np.ndarray, k: int):
        self.own, self.key, self.k = own, key, k
        order = np.lexsort((key, own))
        ends = np.searchsorted(own[order], np.arange(k + 1))
        self.places = [order[ends[c] : ends[c + 1]] for c in range(k)]

    def pop_expired(self, moved: np.ndarray) -> np.ndarray:
        """Pop every vector whose key is at most the sum of moves of its centroid."""
        out = []
        for c in range(self.k):
            n = int(np.searchsorted(self.key[self.places[c]], moved[c], side="right"))
            out.append(self.places[c][:n])
            self.places[c] = self.places[c][n:]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def push(self, places: np.ndarray, own: np.ndarray, key: np.ndarray) -> None:
        self.own[places], self.key[places] = own, key
        for c in np.unique(own):
            both = np.concatenate([self.places[c], places[own == c]])
            self.places[c] = both[np.argsort(self.key[both], kind="stable")]


def _changes(k: int, *moves: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, change of their counts, change of their sums) of (centroids, vectors, 1 or -1)."""
    dim = moves[0][1].shape[1]
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
    for own, x, sign in moves:
        np.add.at(counts, own, sign)
        np.add.at(sums, own, sign * x)
    used = np.flatnonzero((counts != 0) | (sums != 0).any(1))
    return used, counts[used], sums[used]


def _row(ids, x, own, key, changes, popped) -> pd.DataFrame:
    blobs = [a.astype(np.int64).tobytes() for a in changes]
    return pd.DataFrame({"ids": [ids], "x": [x.tobytes()], "own": [own.astype(np.int32).tobytes()], "key": [key.tobytes()], "clusters": [blobs[0]], "counts": [blobs[1]], "sums": [blobs[2]], "popped": [popped]})


def _read_row(r, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r.x, dtype=np.int64).reshape(-1, dim), np.frombuffer(r.own, dtype=np.int32).copy(), np.frombuffer(r.key, dtype=np.float64).copy()


def _added(state: DataFrame, dim: int) -> list:
    """The changes of all blocks added up: one row a centroid (these come to the driver)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                sums = np.frombuffer(r.sums, dtype=np.int64).reshape(-1, dim)
                yield pd.DataFrame({"c": np.frombuffer(r.clusters, dtype=np.int64), "n": np.frombuffer(r.counts, dtype=np.int64)} | {f"s{i}": sums[:, i] for i in range(dim)})

    parts = state.select("clusters", "counts", "sums").mapInPandas(unpack, "c long, n long, " + ", ".join(f"s{i} long" for i in range(dim)))
    return parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dim)]).collect()


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, block: int = BLOCK, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, rescanned) of every kept vector.

    ``rescanned`` says how many vectors were popped and compared in all rounds after the first.
    """
    kind = dict(df.dtypes)[id_col]
    v = F.col(vector).cast("array<double>")
    fine = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.select(F.col(id_col).cast("string").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & fine)
    kept = kept.select("id", F.transform("v", lambda x: F.floor(F.lit(256.0) * F.greatest(F.least(x, F.lit(4.0 * MOST)), F.lit(-4.0 * MOST))).cast("long")).alias("x"))
    first = kept.orderBy(F.sha2(F.concat(F.lit("2:"), "id"), 256).asc_nulls_last(), "x").limit(clusters).collect()
    out = f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, rescanned long"
    if not first:
        return df.sparkSession.createDataFrame([], out)
    centroids = np.array([r["x"] for r in first], dtype=np.int64)
    k = len(centroids)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                x = np.array(part["x"].tolist(), dtype=np.int64).reshape(len(part), dim)
                if (np.abs(x) > MOST).any():
                    raise OverflowError(f"components beyond {MOST} after scaling: squared distances do not fit 64 bits")
                own, gap, scale = compared(x, centroids)
                yield _row(list(part["id"]), x, own, gap - SLACK * scale, _changes(k, (own, x, 1)), 0)

    count = kept.count()
    spark = df.sparkSession
    before = mark()
    state = written(kept.repartition(parts_for(count, block)).mapInPandas(start, STATE), "heap-blocks")
    sums, counts = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=object)
    moved, rescanned = np.zeros(k), 0
    for _ in range(rounds):
        for r in _added(state, dim):
            counts[r["c"]] += r["n"]
            sums[r["c"]] += np.array([r[f"s{i}"] for i in range(dim)], dtype=object)
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(k)], dtype=np.int64)
        steps = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(1))
        others = np.array([np.delete(steps, c).max() if k > 1 else 0.0 for c in range(k)])
        moved, centroids = moved + (steps + others) * (1 + SLACK), new

        def again(batches: Iterator[pd.DataFrame], centroids=centroids, moved=moved) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    x, own, key = _read_row(r, dim)
                    heaps = Heaps(own, key, k)
                    popped = heaps.pop_expired(moved)
                    was, found = own[popped].copy(), x[popped]
                    now, gap, scale = compared(found, centroids)
                    heaps.push(popped, now, gap - SLACK * scale + moved[now])
                    other = now != was
                    changes = _changes(k, (was[other], found[other], -1), (now[other], found[other], 1))
                    yield _row(r.ids, x, heaps.own, heaps.key, changes, len(popped))

        state = written(state.mapInPandas(again, STATE), "heap-blocks")
        clean_up(spark, before, keep=(last_path(),))
        rescanned += state.agg(F.sum("popped").alias("n")).first()["n"]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x, own, _ = _read_row(r, dim)
                d = x - centroids[own]
                yield pd.DataFrame({"id": pd.Series(list(r.ids), dtype="object"), "cluster": own, "distance": np.einsum("ij,ij->i", d, d)})

    found = state.select("ids", "x", "own", "key").mapInPandas(measured, "id string, cluster int, distance long")
    sizes = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    facts = spark.createDataFrame([(c, n, sum(sizes.values()), names[c]) for c, n in sizes.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster").withColumn("rescanned", F.lit(rescanned).cast("long"))
    return out.select(F.col("id").cast(kind).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "rescanned")
