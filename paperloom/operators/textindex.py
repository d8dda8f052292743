"""An inverted index as a table, and full-text search that reads only the terms of the query.

The table has a row for each term, paper and field: (bucket, term, id, field, tf, citation_count). It is partitioned by
``bucket`` (a hash of the term) and sorted by term within files, with Bloom filters on the term: a query's buckets are the
only folders that are read, and within them only the row groups that may hold its terms. Frequent terms are dealt over
several files by the papers' ids, so no task writes or reads all rows of a term.

    write_index(papers, path)
    search_index(read_index(spark, path), "graph of papers", 20)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.stem import stem, stem_words

#: Buckets of terms: folders of the table.
BUCKETS = 64
#: Fields of papers whose words are counted together.
ROWS = 500
#: Weights of the fields.
WEIGHTS = {"title": 1.0, "abstract": 0.4}


def terms_of(c: Column, stemmed: bool = False) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return stem_words(words) if stemmed else words


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(papers: DataFrame, stemmed: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the index for ``papers(id, title, abstract, citation_count)``.

    All words of a row are together, so they are counted where the row lies and only the counts are dealt.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), terms_of(F.col(f), stemmed).alias("terms")) for f in WEIGHTS])
    words = papers.select("id", "citation_count", F.explode(fields).alias("x")).select("id", "citation_count", "x.field", "x.terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                terms = some["terms"].flatten().dictionary_encode()
                if len(terms) == 0:
                    continue
                width, row = len(terms.dictionary), np.repeat(np.arange(len(some)), some["terms"].value_lengths().to_numpy())
                key, tf = np.unique(row * width + terms.indices.to_numpy(), return_counts=True)
                own = some.select(["id", "field", "citation_count"]).take(pa.array(key // width))
                yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(key % width)), own["id"], own["field"], own["citation_count"], pa.array(tf.astype(np.int32))], ["term", "id", "field", "citation_count", "tf"])

    kinds = dict(words.dtypes)
    counted = words.mapInArrow(run, f"term string, id {kinds['id']}, field string, citation_count {kinds['citation_count']}, tf int")
    return counted.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", "id", "field", "tf", "citation_count")


def write_index(papers: DataFrame, path: str, stemmed: bool = False, buckets: int = BUCKETS, files: int | None = None) -> None:
    """Write the index once; ``files`` is how many ranges of (bucket, term, id) are written (shuffle partitions if null)."""
    rows = postings(papers, stemmed, buckets)
    order = ("bucket", "term", "id")
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).write.partitionBy("bucket").mode("overwrite")
    writer.option("parquet.bloom.filter.enabled#term", "true").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _query_terms(query: str, stemmed: bool) -> list[str]:
    words = "".join(c.lower() if c.isalnum() else " " for c in query).split()
    return sorted({stem(w) if stemmed and len(w) > 2 else w for w in words})


def _score() -> Column:
    weight = F.element_at(F.create_map(*[x for f, w in WEIGHTS.items() for x in (F.lit(f), F.lit(w))]), F.col("field"))
    return F.round(F.sum(weight * F.col("tf")), 6)


def search_index(index: DataFrame, query: str, n: int, stemmed: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(id, citation_count, score): papers that hold all terms, by weighted count, then citations, then id.

    A query without terms finds nothing.
    """
    spark, terms = index.sparkSession, _query_terms(query, stemmed)
    named = spark.createDataFrame([(t,) for t in terms], "term string").select("term", _bucket(F.col("term"), buckets).alias("bucket"))
    held = sorted({r["bucket"] for r in named.collect()})  # a few terms: the query's own
    some = index.where(F.col("bucket").isin(held) & F.col("term").isin(terms))
    found = some.groupBy("id", "citation_count").agg(F.count_distinct("term").alias("held"), _score().alias("score"))
    return found.where(F.col("held") == len(terms)).select("id", "citation_count", "score").orderBy(F.desc("score"), F.desc("citation_count"), "id").limit(n)


def search_many(index: DataFrame, queries: DataFrame, n: int, stemmed: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``queries(query_id, query)`` -> (query_id, id, citation_count, score, r): the ``n`` best papers of each query.

    Terms meet the index on (bucket, term), so Spark prunes the buckets that no query asks for.
    """
    asked = queries.select("query_id", F.array_distinct(terms_of(F.col("query"), stemmed)).alias("terms"))
    asked = asked.select("query_id", F.size("terms").alias("all"), F.explode("terms").alias("term")).withColumn("bucket", _bucket(F.col("term"), buckets))
    found = index.join(asked, ["bucket", "term"]).groupBy("query_id", "all", "id", "citation_count").agg(F.count_distinct("term").alias("held"), _score().alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("citation_count"), "id")
    return found.where(F.col("held") == F.col("all")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= n).select("query_id", "id", "citation_count", "score", "r")
