"""Joins, matching, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import workspace
from paperloom.functions import text as tx
from paperloom.operators import joins as jn
from paperloom.plans.aggregates import EDGES, EDGES_SQL
from paperloom.plans.base import ORACLE, add
from paperloom.plans.texts import SQL_TITLE, TITLE
from paperloom.sources import layout

C = F.col
add("f1_join_reviews_metadata", lambda t: jn.join_reviews_metadata(t.documents.select(C("source").alias("conference"), C("doc_id").alias("id"), "n_chars"), t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(C("source").alias("conference"), C("doc_id").alias("id"), "quality")), "SELECT d.source AS conference, d.doc_id AS id, n_chars, quality FROM documents d JOIN labels USING (doc_id)")
add("f2_only_known", lambda t: jn.only_known(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"]), "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
_refs = lambda t: t.orders.groupBy(C("o_custkey").alias("paper_id")).agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit(" Customer#"), F.lpad((k % 3000).cast("string"), 9, "0"))).alias("refs"))
add("f3_enrich_references", lambda t: jn.enrich_references(_refs(t), t.customer.select(C("c_name").alias("title"), "c_custkey"), "c_custkey", 2).select("paper_id", F.array_join(F.transform("references", lambda x: x["c_custkey"].cast("string")), ",").alias("ids")),
    "SELECT o_custkey AS paper_id, string_agg(c_custkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders JOIN customer ON c_custkey = o_orderkey % 3000 GROUP BY 1 HAVING count(*) >= 2")
add("f4_filter_recommended", lambda t: jn.filter_recommended(t.nation.select(C("n_name").alias("title")), t.customer.select(C("c_custkey").alias("rec_id"), F.array(F.concat(F.lit("NATION_"), (C("c_custkey") % 40).cast("string")), C("c_name")).alias("sources"))).select("rec_id"), "SELECT c_custkey AS rec_id FROM customer WHERE 'NATION_' || (c_custkey % 40) IN (SELECT n_name FROM nation)")
_content = lambda t: jn.attach_content(t.documents.select("source", "doc_id"), t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("source", "doc_id", C("quality").alias("content")), ["source", "doc_id"], "content")
add("f5_attach_content", lambda t: _content(t)[1], "SELECT source, count(quality) AS matched, count(*) - count(quality) AS unmatched FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
add("f6_remaining", lambda t: jn.remaining(t.documents.select("doc_id"), t.labels, "doc_id")[1], "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("f7_test_set", lambda t: jn.restrict_to_test_set(t.customer.select(C("c_nationkey").alias("k"), "c_custkey"), t.nation.select((C("n_nationkey") + 10).alias("k")), "k")[0], "SELECT c_nationkey AS k, c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey + 10 FROM nation)")
add("f7_missing_titles", lambda t: jn.restrict_to_test_set(t.customer.select(C("c_nationkey").alias("k"), "c_custkey"), t.nation.select((C("n_nationkey") + 10).alias("k")), "k")[1], "SELECT DISTINCT n_nationkey + 10 AS k FROM nation WHERE n_nationkey + 10 NOT IN (SELECT c_nationkey FROM customer)")


def _asked_titles(t):
    """Titles of the benchmark and of every hundredth document, as they are and misspelt: one letter left out, or in capitals."""
    titles = t.benchmark.select(TITLE().alias("query")).unionByName(t.documents.where("doc_id % 100 = 0").select(TITLE().alias("query")))
    spelt = [F.translate("query", x, "") for x in "adeilnorst"]
    return titles.select(F.explode(F.array("query", F.upper("query"), *spelt)).alias("query")).where("query <> ''")


_titles = lambda t: t.documents.select(TITLE().alias("title"))
add("f8_fuzzy_title_join", lambda t: jn.fuzzy_title_join(_asked_titles(t), _titles(t)))
add("f8_minhash_title_join", lambda t: jn.minhash_title_join(_asked_titles(t), _titles(t)))
add("f8_levenshtein_join", lambda t: jn.levenshtein_title_join(t.nation.select(C("n_name").alias("query")), t.nation.select(F.concat("n_name", F.lit("x")).alias("title")).unionByName(t.customer.select(C("c_mktsegment").alias("title"))), 2),
    "WITH c AS (SELECT DISTINCT title FROM (SELECT n_name || 'x' AS title FROM nation UNION ALL SELECT c_mktsegment FROM customer)), j AS (SELECT n_name AS query, title, levenshtein(lower(n_name), lower(title))::INTEGER AS distance FROM nation, c) SELECT * FROM j WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, title) <= 5")
add("f9_validate_title_match", lambda t: jn.validate_title_match(t.documents.select("doc_id", TITLE().alias("a"), F.when(C("doc_id") % 2 > 0, F.concat(F.lit("On "), TITLE())).otherwise(F.lit("Unrelated subject matter 123")).alias("b")), "a", "b").select("doc_id"))
add("f10_containment_match", lambda t: jn.containment_match(t.nation.select(C("n_name").alias("a_title"), "n_nationkey"), t.customer.select(F.concat(F.lit("the nation_"), (C("c_custkey") % 30).cast("string")).alias("b_title")), "n_nationkey"),
    "WITH b AS (SELECT DISTINCT 'the nation_' || (c_custkey % 30) AS b_title FROM customer) SELECT n_name AS a_title, n_nationkey, b_title FROM nation JOIN b ON contains(b_title, lower(n_name)) OR contains(lower(n_name), b_title) QUALIFY row_number() OVER (PARTITION BY b_title ORDER BY n_nationkey) = 1")
PAPER = lambda: F.concat(F.lit("paper "), F.floor(C("doc_id") / 20).cast("string"))  # noqa: E731  # of at most 20 documents
add("f16_match_aspects", lambda t: jn.match_aspects(t.documents.groupBy(PAPER().alias("title")).agg(F.min("doc_id").alias("paper_id"), F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.col("text").alias("x")))), lambda x: x["x"]).alias("reviews")), t.documents.groupBy(F.upper(PAPER()).alias("title")).agg(F.min_by("text", "doc_id").alias("review")).withColumn("labels", F.array(F.lit("novelty")))).select("paper_id", "ord", F.array_join("labels", ",").alias("labels")))
_cat = lambda t, lo, hi, name: t.part.where((C("p_partkey") % 10).between(lo, hi)).select("p_partkey", F.when(C("p_partkey") % 3 > 0, C("p_name")).alias("p_name"), F.array(F.lit(name)).alias("tags"), F.struct(F.when(F.lit(name) == "b", C("p_brand")).alias("brand"), C("p_type").alias("kind")).alias("more"))
add("f17_merge_catalogues", lambda t: jn.merge_catalogues(_cat(t, 0, 6, "a"), _cat(t, 4, 9, "b").withColumn("extra", F.lit(1)), "p_partkey").select("p_partkey", "p_name", F.array_join("tags", ",").alias("tags"), "more.brand", "more.kind", "extra"),
    "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 10 < 4 THEN 'a' WHEN p_partkey % 10 > 6 THEN 'b' ELSE 'a,b' END AS tags, CASE WHEN p_partkey % 10 >= 4 THEN p_brand END AS brand, p_type AS kind, CASE WHEN p_partkey % 10 >= 4 THEN 1 END AS extra FROM part")
add("f18_common_ids", lambda t: jn.common_ids([t.orders.select(C("o_custkey").alias("k")), t.customer.where("c_acctbal > 0").select(C("c_custkey").alias("k")), t.supplier.select((C("s_suppkey") * 2).alias("k"))], "k"), "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_suppkey * 2 FROM supplier")
add("f19_all_pairings", lambda t: jn.all_pairings(t.region.select("r_name"), "r_name", [t.nation.select("n_name"), t.events.select("event_type").distinct()]), "SELECT a.r_name AS item_a, b.r_name AS item_b, n_name, event_type FROM region a, region b, nation, (SELECT DISTINCT event_type FROM events) WHERE a.r_name <> b.r_name")
_two = lambda t, s: t.customer.where(C("c_custkey") % 7 != s).select("c_custkey", F.when(C("c_custkey") % 3 == s, F.lit(0.0)).otherwise(C("c_acctbal")).alias("bal"), F.array(C("c_mktsegment"), F.lit("x")).alias("tags") if s else F.array(F.lit("x"), C("c_mktsegment")).alias("tags"))
add("f20_diff_rows", lambda t: jn.diff_rows(_two(t, 0), _two(t, 1), "c_custkey", ["bal", "tags"]).select("c_custkey", F.array_join("fields", ",").alias("fields")), "SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 1) THEN 'bal,tags' ELSE 'bal' END AS fields FROM customer WHERE c_custkey % 7 IN (0, 1) OR (c_custkey % 3 IN (0, 1) AND c_acctbal <> 0)")
_papers = lambda t: t.embeddings.select(F.floor(C("vec_id") / 2).alias("paper")).distinct()
_dedup = lambda t: EDGES(t).groupBy("source", "target", "type").agg(F.max("similarity").alias("similarity"))
_dedup_sql = f"e AS (SELECT source, target, type, max(similarity) AS similarity FROM {EDGES_SQL} x GROUP BY ALL)"
add("f21_neighbours", lambda t: jn.neighbours(_dedup(t), _papers(t), "semantic", 10), f"WITH {_dedup_sql}, p AS (SELECT DISTINCT vec_id // 2 AS paper FROM embeddings), n AS (SELECT source AS paper, target AS neighbour, similarity FROM e WHERE type = 'semantic' UNION ALL SELECT target, source, similarity FROM e WHERE type = 'semantic') SELECT paper, neighbour, similarity, row_number() OVER (PARTITION BY paper ORDER BY similarity DESC, neighbour)::INTEGER AS r FROM n WHERE paper IN (SELECT paper FROM p) QUALIFY r <= 10".replace("SELECT paper, neighbour, similarity, row_number", "SELECT paper, neighbour, similarity, row_number"))
add("f21_citations", lambda t: jn.neighbours(_dedup(t), _papers(t), "citation", 10).select("paper", "neighbour", "similarity"), f"WITH {_dedup_sql}, p AS (SELECT DISTINCT vec_id // 2 AS paper FROM embeddings) SELECT source AS paper, target AS neighbour, similarity FROM e WHERE type = 'citation' AND source IN (SELECT paper FROM p) QUALIFY row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) <= 10")


def _stored_edges(t):
    path = workspace.new_path(t.spark, "edges-by-node")
    layout.write_edges(_dedup(t), path)
    return path


add("f21_stored_neighbours", lambda t: layout.neighbours_of_many(t.spark, _stored_edges(t), _papers(t), "semantic", 10), ORACLE["f21_neighbours"])
add("f21_stored_citations", lambda t: layout.neighbours_of_many(t.spark, _stored_edges(t), _papers(t), "citation", 10).select("paper", "neighbour", "similarity"), ORACLE["f21_citations"])
add("f22_related_edges", lambda t: jn.related_edges(EDGES(t), F.lit(7)), f"SELECT source, target, type, similarity FROM {EDGES_SQL} e WHERE source = 7 OR target = 7")
_filled = lambda t: jn.backfill(t.orders.select("o_orderkey", F.when(C("o_orderkey") % 3 > 0, C("o_orderstatus")).alias("s"), "o_custkey"), t.customer.where("c_acctbal > 0").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("s")), "o_custkey", "s")
add("f23_backfill", lambda t: _filled(t)[0].select("o_orderkey", "s"), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus WHEN c_acctbal > 0 THEN c_mktsegment END AS s FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
add("f23_backfill_report", lambda t: _filled(t)[1], "WITH o AS (SELECT coalesce(c_acctbal > 0, false) AS hit FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0) SELECT count(*) FILTER (hit) AS filled, count(*) FILTER (NOT hit) AS missing, round(100.0 * count(*) FILTER (hit) / count(*), 4) AS rate FROM o")
add("f24_contexts_by_reference", lambda t: jn.contexts_by_reference(t.part.select((C("p_partkey") % 100).alias("paper_id"), C("p_partkey").alias("key"), C("p_name").alias("title"), F.array("p_brand").alias("authors")), t.lineitem.select((C("l_partkey") % 100).alias("paper_id"), (C("l_partkey") + F.when(C("l_linenumber") == 7, 100_000).otherwise(0)).alias("key"), F.concat("l_returnflag", "l_linestatus").alias("sentence"))).select("paper_id", "key", "title", F.array_join("authors", ",").alias("authors"), F.array_join("contexts", "|").alias("contexts")),
    "WITH c AS (SELECT l_partkey % 100 AS paper_id, l_partkey + CASE WHEN l_linenumber = 7 THEN 100000 ELSE 0 END AS key, string_agg(DISTINCT l_returnflag || l_linestatus, '|' ORDER BY l_returnflag || l_linestatus) AS contexts FROM lineitem GROUP BY 1, 2) SELECT paper_id, key, coalesce(p_name, 'Unknown Reference') AS title, coalesce(p_brand, '') AS authors, contexts FROM c LEFT JOIN part ON p_partkey = key AND p_partkey % 100 = paper_id")
add("i1_concat", lambda t: jn.concat_all([t.customer.select(C("c_name").alias("name"), C("c_acctbal").alias("bal")), t.supplier.select(C("s_name").alias("name")), t.nation.select(C("n_name").alias("name"))]), "SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, NULL FROM supplier UNION ALL SELECT n_name, NULL FROM nation")
add("i2_intersection", lambda t: t.orders.select("o_custkey").intersect(t.customer.where("c_acctbal > 5000").select("c_custkey")), "SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
add("i3_difference", lambda t: t.customer.select("c_custkey").subtract(t.orders.select("o_custkey")), "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
_alpha_sql = rf"regexp_replace(regexp_replace(replace(lower(regexp_replace(x, '[^\p{{L}}\s]', '', 'g')), 'ß', 'ss'), '\s+', ' ', 'g'), '^ | $', '', 'g')"
add(
    "i4_title_union",
    lambda t: t.documents.select(tx.clean_title_alpha(C("text")).alias("title")).union(t.benchmark.select(tx.clean_title_alpha(C("text")))).distinct(),
    f"SELECT DISTINCT {_alpha_sql} AS title FROM (SELECT text AS x FROM documents UNION ALL SELECT text FROM benchmark)",
)
