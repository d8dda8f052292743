"""Corpus pipeline: five stages from raw documents to a mix.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``documents``.
Rows are told apart by id and text, so repeated or missing ids do no harm; rows that agree in both are copies.

* quality: documents that the language model rejects go. Null and empty texts, null languages and languages without trusted
  rows stay; with an empty ``labels`` table all stay.
* near_duplicates: of each group of similar documents the one with the smallest id stays (rows without an id come last).
  Null and empty texts stay.
* decontaminate: documents that hold a benchmark item, or nearly, go. Null and empty texts stay, and with an empty
  ``benchmark`` table all stay.
* personal_data: spans are replaced by their kind in brackets; ``n_chars`` follows the text. Null and empty texts stay as
  they are.
* mix: rows the mix takes, with size, source_size, target and taken (words taken, repeats counted). Null and empty texts
  have no words, so the mix takes none of them.

Extra columns of the input tables are ignored. An empty ``documents`` table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate as leaks
from paperloom.llm import mixing, ngram_join, pii, quality
from paperloom.llm.shared import TEXT_ROWS, batches_of, clean_up, cut, last_path, mark, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys of rejected rows are broadcast up to so many rows (of about 60 bytes); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
RID = "__rid"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    """Add a text key that sorts as doc_id does (nulls last) and tells texts apart."""
    number = F.lpad((F.col("doc_id").cast("decimal(38,0)") + F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("string"), 20, "0")
    return docs.withColumn(RID, F.concat_ws(":", F.coalesce(number, F.lit("none")), F.hex(F.xxhash64(F.coalesce("text", F.lit("")))), F.coalesce("lang", F.lit("-"))))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    rejected = cut(rejected.select(RID).distinct())
    if rejected.count() <= BROADCAST_ROWS:
        rejected = F.broadcast(rejected)
    return docs.join(rejected, RID, "left_anti").select(COLUMNS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    trusted = keyed.select("doc_id", RID).join(_read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    judged = quality.judge(keyed.select(RID, "text", "lang"), trusted.select(RID), id_col=RID)
    return _without(keyed, judged.where("not keep"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    groups = cut(ngram_join.join_similar(keyed.select(RID, "text"), id_col=RID).where("n_shingles > 0"))
    kept = _without(keyed, groups.where(F.col(RID) != F.col("component_id")))
    repeated = groups.where(F.col(RID) == F.col("component_id")).groupBy(RID).agg(F.count("*").alias("n")).where("n > 1").select(RID)
    if repeated.isEmpty():
        return kept
    kept, repeated = _keyed(kept), cut(repeated)
    once = kept.join(repeated, RID, "left_semi").dropDuplicates([RID])
    return kept.join(repeated, RID, "left_anti").unionByName(once).select(COLUMNS)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    with batches_of(spark, TEXT_ROWS):
        return _without(keyed, leaks.find_leaks(keyed.select(RID, "text"), _read(spark, sf_dir, "benchmark"), id_col=RID))


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(pii.find_personal_data(docs.select(COLUMNS), out="__pii"), pii="__pii")
    return out.withColumn("n_chars", F.when(F.size("__pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = mixing.with_sizes(docs.select(COLUMNS))
    return mixing.mix(sized, docs.count()).where("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("personal_data", stage_personal_data),
    ("mix", stage_mix),
]
#: SQL cannot express the language model and the edit matching; tests hold the stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    What a stage has left in the shared folder, its input included, goes when its rows are written.
    """
    docs = _read(spark, sf_dir, "documents").select(COLUMNS)
    since = None
    for k, (name, stage) in enumerate(STAGES):
        own = mark()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            clean_up(spark, own if since is None else since, keep=(last_path(),))
            since = mark() - 1
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
