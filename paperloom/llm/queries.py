"""The registered queries of this subpackage: ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.llm import decontaminate, heap_kmeans, language, mixing, ngram_join, nn_descent, pii, quality, ranked_search, suffix_dedup, tokens, url_filter, warc
from paperloom.llm.oracles import ORACLE
from paperloom.llm.shared import cut, written

QUERIES = {}
__all__ = ["ORACLE", "QUERIES"]


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op3_personal_data(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_personal_data(docs))


QUERIES["op3_personal_data"] = op3_personal_data


def op6_mixing(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = cut(mixing.with_sizes(docs).select("doc_id", "source", "size"))
    return mixing.mix(sized, sized.count()).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op6_mixing"] = op6_mixing


def op7_warc(spark, sf_dir):
    got = warc.round_trip(_read(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op7_warc"] = op7_warc


def op10_url_filter(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES["op10_url_filter"] = op10_url_filter


def op1_decontaminate(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, _read(spark, sf_dir, "benchmark"))


QUERIES["op1_decontaminate"] = op1_decontaminate


def op2_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.train(docs))


QUERIES["op2_language"] = op2_language


def op4_token_counts(spark, sf_dir):
    """Trees of all documents are kept as a table; the edits that redact personal data are applied to what it holds."""
    stored = written(tokens.build_trees(_read(spark, sf_dir, "documents").select("doc_id", "text")), "token-trees")
    found = pii.find_personal_data(stored)
    edits = F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("replacement")))
    edited = tokens.edit_trees(found.withColumn("edits", edits).drop("pii"), "edits")
    return edited.select("doc_id", "n_tokens", "n_tokens_edited", "n_leaves", "chars_again", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))


QUERIES["op4_token_counts"] = op4_token_counts


def op9_quality(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trusted = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(docs, trusted).select("doc_id", "lang", "perplexity", "excess", "threshold", "keep")


QUERIES["op9_quality"] = op9_quality


def op8_ngram_join(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join_similar(docs).drop("key")


QUERIES["op8_ngram_join"] = op8_ngram_join


def op5_nn_descent(spark, sf_dir):
    return nn_descent.near_duplicates(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES["op5_nn_descent"] = op5_nn_descent


def op12_heap_clustering(spark, sf_dir):
    return heap_kmeans.cluster(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("rescanned")


QUERIES["op12_heap_clustering"] = op12_heap_clustering


def op11_ranked_search(spark, sf_dir):
    return ranked_search.search(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))


QUERIES["op11_ranked_search"] = op11_ranked_search


def op13_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


QUERIES["op13_suffix_dedup"] = op13_suffix_dedup
