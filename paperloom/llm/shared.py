"""What several operators share: block sizing and connected components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.workspace import batches_of, clean_up, cut, forget, last_path, mark, new_path, shared_dir, written

__all__ = ["TEXT_ROWS", "batches_of", "clean_up", "components", "cut", "forget", "last_path", "mark", "new_path", "parts_for", "release", "shared_dir", "small", "text_bytes", "written"]


#: Checkpoints of up to so many rows (of a few numbers or a short text each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of whole texts in an Arrow batch.
TEXT_ROWS = 1000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a checkpoint: it is counted), marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def release() -> None:
    """Hand memory that a task has freed back to the machine: Python workers live on and share an executor's memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0)).alias("n")).first()["n"])


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of at most about ``each`` units hold ``total`` units."""
    return max(least, math.ceil(total / each))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star steps.

    Returns ``(node, root)``: root is the smallest node of the component. Nodes without edges do not appear; nulls and
    loops are dropped, repeated edges count once. Each round is a min-aggregation and a join, with a checkpoint, and
    the driver sees only a count and a sum. The number of rounds grows with the logarithm of the longest path; if they
    are not enough it is an error, never a partial result.
    """
    e = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = (now["n"], now["s"])
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
