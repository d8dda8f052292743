"""A stored layout for point and neighbour reads: folders by kind, rows sorted by key, Bloom filters on the key.

A read of one key opens one folder, and within it only the row groups whose range and Bloom filter may hold the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.joins import neighbours

#: Bytes of a row group: the smallest part of a file that a read can skip.
ROW_GROUP = 16 << 20


def write_layout(df: DataFrame, path: str, key: str, kind: str | None = None, files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Write ``df`` sorted by ``key`` over ranges of it, so a frequent key is at most a few files, in folders of ``kind``."""
    order = [*([kind] if kind else []), key]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", row_group)
    (writer.partitionBy(kind) if kind else writer).parquet(path)


def find(spark: SparkSession, path: str, key: str, value, kind: tuple[str, str] | None = None) -> DataFrame:
    """The rows of one key (of one kind: column and value)."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col(kind[0]) == kind[1]) if kind else rows
    return rows.where(F.col(key) == value)


def write_edges(related: DataFrame, path: str, files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """``related(source, target, type, similarity)`` for neighbour reads: every edge under both of its ends (column ``node``)."""
    ends = related.withColumn("node", F.explode(F.array_distinct(F.array("source", "target"))))
    write_layout(ends, path, "node", "type", files, row_group)


def stored_neighbours(spark: SparkSession, path: str, paper, kind: str, limit: int | None = None) -> DataFrame:
    """``neighbours`` of one paper from stored edges: (paper, neighbour, similarity, r)."""
    edges = find(spark, path, "node", paper, ("type", kind)).drop("node").distinct()
    one = spark.range(1).select(F.lit(paper).alias("paper"))
    return neighbours(edges, F.broadcast(one), kind, limit)


def neighbours_of_many(spark: SparkSession, path: str, papers: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """The same for many papers: their ids meet the stored ends, each edge once from either end."""
    edges = spark.read.parquet(path).where(F.col("type") == kind)
    own = edges.join(papers.select(F.col("paper").alias("node")), "node", "left_semi")
    return neighbours(own.drop("node").distinct(), papers, kind, limit)
