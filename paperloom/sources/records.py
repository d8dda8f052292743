"""Readers and writers of record sets, and keyed table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import extract_spans, format_authors
from paperloom.operators.filters import non_blank

BAD = "_corrupt_record"


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array of records; a record that does not fit the schema is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines (plain, gz or zst): bad and blank lines are skipped; an error if there are bad lines only."""
    made = spark.createDataFrame([], schema).schema
    kind = T.StructType([*made.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    raw = lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
    good = raw.where(F.col(BAD).isNull()).drop(BAD)
    if good.isEmpty() and not lines.isEmpty():
        raise ValueError(f"no valid line in {path}")
    return good


def append_records(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("append").format(kind).save(path)


def write_records(df: DataFrame, path: str, kind: str = "parquet", compression: str | None = None) -> None:
    w = df.write.mode("overwrite").format(kind)
    (w.option("compression", compression) if compression else w).save(path)


#: Suffixes of compressed text and Spark's names of their codecs.
CODECS = {".gz": "gzip", ".bz2": "bzip2", ".deflate": "deflate", ".snappy": "snappy", ".lz4": "lz4"}


def codec_of(path: str) -> str | None:
    """The codec that a path's last suffix names, in any case; null for plain text.

    ``.zst`` is read, but Spark writes it only with Hadoop's native library: asking for it is an error here.
    """
    suffix = "." + path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if suffix == ".zst":
        raise ValueError(f"{path}: .zst can be read, not written")
    return CODECS.get(suffix)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, compressed as the path's suffix says (``rows.jsonl.gz``); ``mode`` may be append."""
    codec = codec_of(path)
    w = df.write.mode(mode)
    (w.option("compression", codec) if codec else w).json(path)


def scan_tree(spark: SparkSession, root: str, segment: str, schema: T.StructType | str, pattern: str = "*.json") -> DataFrame:
    """All JSON files below ``root``; conference: the folder two above ``segment``'s files, id: file name to its first dot."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True).json(root)
    df = df.withColumn("__path", F.col("_metadata.file_path"))
    conference = F.regexp_extract("__path", rf"([^/]+)/[^/]+/{segment}/[^/]+$", 1)
    return df.withColumn("conference", F.when(conference == "", "unknown").otherwise(F.url_decode(conference))).withColumn("id", F.regexp_extract("__path", r"([^/.]+)[^/]*$", 1)).drop("__path")


FULLTEXT = "content struct<text:string,annotations:struct<abstract:string,title:string,venue:string>>"


def fulltext(df: DataFrame) -> DataFrame:
    """Rows of full text with all three annotations: abstract, title, venue, text."""
    a = F.col("content.annotations")
    full = df.where(F.col("content.text").isNotNull() & a["abstract"].isNotNull() & a["title"].isNotNull() & a["venue"].isNotNull())
    return full.select(*[extract_spans(F.col("content.text"), a[n]).alias(n) for n in ("abstract", "title", "venue")], F.col("content.text").alias("text"))


def scan_fulltext(spark: SparkSession, path: str) -> DataFrame:
    return fulltext(spark.read.schema(FULLTEXT).json(path))


def review_table(results: DataFrame, entity_types: list[str], blank: bool = False) -> DataFrame:
    """Flat rows of reviewed papers with a graph and both rationales; graph labels as bullet columns.

    Rationales that are empty or white space alone count as missing; with ``blank`` only null ones do.
    """
    has = lambda c: c.isNotNull() if blank else non_blank(c)
    df = results.where((F.size("entities") > 0) & has(F.col("rationale")) & has(F.col("rationale_pred")))
    bullets = lambda t: F.array_join(F.transform(F.filter("entities", lambda e: e["type"] == t), lambda e: F.concat(F.lit("• "), e["label"])), "\n")
    return df.select("paper_id", "title", format_authors(F.col("authors")).alias("authors"), "rationale", "rationale_pred", *[bullets(t).alias(t) for t in entity_types])


def export_review_csv(results: DataFrame, path: str, entity_types: list[str]) -> None:
    review_table(results, entity_types).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def missing_rows(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What an insert that ignores conflicts would add: new keys once (the smallest row of a key)."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest]) if rest else new.distinct()
    return one.join(table.select(keys), keys, "left_anti").select(new.columns)


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(missing_rows(table, new, keys))


def delete_with_cascade(papers: DataFrame, related: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers without ``ids(id)``, and edges that touch none of them."""
    edges = related.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return papers.join(ids, "id", "left_anti"), edges.select(related.columns)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)
