"""Batch aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import aggregate as ag
from paperloom.operators import filters as fl  # noqa: F401
from paperloom.plans.base import add
from paperloom.plans.rows import ENT_SQL, REL_SQL, hierarchy
from paperloom.plans.texts import SQL_TITLE, TITLE

C = F.col
joined = lambda c: F.array_join(c, "|")
add("d1_group_lists", lambda t: ag.group_lists(t.documents.withColumn("g", F.when(C("doc_id") % 9 > 0, F.floor(C("doc_id") / 20))), "g", "lang", "doc_id").select("g", joined("items").alias("items")), "SELECT doc_id // 20 AS g, string_agg(lang, '|' ORDER BY doc_id) AS items FROM documents WHERE doc_id % 9 > 0 GROUP BY 1")
_refs = lambda t: t.orders.groupBy((C("o_custkey")).alias("paper_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))), lambda x: F.struct(x["o_orderpriority"].alias("title"), F.array(x["o_orderstatus"], F.lit("B")).alias("authors"), F.lit(2000).alias("year"))).alias("refs"))
_mentions = lambda t: t.lineitem.select((C("l_suppkey")).alias("paper_id"), (C("l_linenumber") - 1).alias("ref_index"), F.concat(F.lit("  "), C("l_returnflag"), F.lit("-"), C("l_linestatus"), F.lit(" ")).alias("context"))
add("d2_aggregate_mentions", lambda t: ag.aggregate_mentions(_refs(t), _mentions(t)).select("paper_id", "title", joined("authors").alias("authors"), "year", joined("contexts").alias("contexts")),
    "WITH r AS (SELECT o_custkey AS paper_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderpriority AS title, CASE WHEN o_orderstatus < 'B' THEN o_orderstatus || '|B' ELSE 'B|' || o_orderstatus END AS authors FROM orders) SELECT r.paper_id, title, authors, 2000 AS year, string_agg(DISTINCT l_returnflag || '-' || l_linestatus, '|' ORDER BY l_returnflag || '-' || l_linestatus) AS contexts FROM r JOIN lineitem l ON l.l_suppkey = r.paper_id AND l.l_linenumber - 1 = r.i GROUP BY ALL")
_sections = lambda t: t.documents.groupBy(F.floor(C("doc_id") / 20).alias("paper_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: F.struct(F.when(x["doc_id"] % 5 == 4, F.lit("A Appendix")).otherwise(F.concat((x["doc_id"] % 5 + 1).cast("string"), F.lit(". Part "), x["doc_id"].cast("string"))).alias("heading"), x["text"].alias("text"))).alias("sections"))
add("d3_merge_sections", lambda t: ag.merge_sections(_sections(t), "paper_id", "sections"),
    "WITH d AS (SELECT doc_id // 20 AS paper_id, doc_id, (doc_id % 5 + 1)::INTEGER AS n, (doc_id % 5 + 1) || '. Part ' || doc_id AS h, text FROM documents WHERE doc_id % 5 <> 4) SELECT paper_id, n, arg_min(h, doc_id) AS heading, string_agg(h || chr(10) || text || chr(10), chr(10) ORDER BY doc_id) AS text FROM d GROUP BY paper_id, n")
REVIEWS = lambda t: t.lineitem.select((C("l_orderkey") % 4000).alias("paper_id"), F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("h"), (C("l_linenumber").cast("long") * 1_000_000_000 + C("l_orderkey") * 10_000 + C("l_partkey")).alias("ord"), (C("l_quantity") % 5 + 1).cast("int").alias("rating"), F.when(C("l_orderkey") % 3 > 0, (C("l_suppkey") % 5).cast("int")).alias("confidence"), F.concat("l_returnflag", C("l_partkey").cast("string")).alias("rationale"), F.when(C("l_tax") > 0.04, (C("l_partkey") % 9 + 1).cast("int")).alias("recommendation"))
REVIEWS_SQL = "(SELECT l_orderkey % 4000 AS paper_id, l_linenumber::BIGINT * 1000000000 + l_orderkey * 10000 + l_partkey AS ord, (l_quantity % 5 + 1)::INTEGER AS rating, CASE WHEN l_orderkey % 3 > 0 THEN (l_suppkey % 5)::INTEGER END AS confidence, l_returnflag || l_partkey AS rationale, CASE WHEN l_tax > 0.04 THEN (l_partkey % 9 + 1)::INTEGER END AS recommendation FROM lineitem)"
_main_sql = f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rating, ord) - 1 AS i, count(*) OVER (PARTITION BY paper_id) AS n FROM {REVIEWS_SQL} x), m AS (SELECT *, max(CASE WHEN i = n // 2 THEN rating END) OVER (PARTITION BY paper_id) AS med FROM r), k AS (SELECT *, max(confidence) OVER (PARTITION BY paper_id) AS sure FROM m WHERE rating = med), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC NULLS LAST, CASE WHEN sure IS NULL THEN rationale END NULLS FIRST, ord) = 1)"
add("d4_main_review", lambda t: ag.main_review(REVIEWS(t)).select("paper_id", "rating", "confidence", "rationale"), f"{_main_sql} SELECT paper_id, rating, confidence, rationale FROM f")
add("c2_final_rating", lambda t: ag.final_ratings(REVIEWS(t)), f"{_main_sql} SELECT paper_id, coalesce(CASE WHEN recommendation <= 1 THEN 1 WHEN recommendation <= 5 THEN 2 WHEN recommendation <= 7 THEN 3 WHEN recommendation IS NOT NULL THEN 4 END, rating, 0) AS rating FROM f")
add("d5_dedup_earliest", lambda t: ag.dedup_earliest(t.documents.select("doc_id", TITLE().alias("title"), F.when(C("doc_id") % 4 > 0, C("n_chars") % 20 + 2000).alias("year")), "title", "year", "doc_id"), f"WITH d AS (SELECT doc_id, {SQL_TITLE} AS title, CASE WHEN doc_id % 4 > 0 THEN n_chars % 20 + 2000 END AS year FROM documents) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY title ORDER BY year NULLS LAST, doc_id) = 1")
add("d6_dedup_first", lambda t: ag.first_by(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey"), "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
add("d7_unique_references", lambda t: ag.unique_references(t.orders.groupBy(C("o_custkey").alias("paper_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey"))), lambda x: F.struct(F.concat(F.lit(" REF  "), (x["o_orderkey"] % 700).cast("string")).alias("title"), x["o_orderkey"].alias("k"))).alias("refs")), "refs", "paper_id").select("clean", "paper_id", "k"), "SELECT 'ref ' || (o_orderkey % 700) AS clean, o_custkey AS paper_id, o_orderkey AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 700 ORDER BY o_custkey, o_orderkey) = 1")
_areas = lambda t: t.documents.select((C("n_chars") % 300).alias("paper_id"), TITLE().alias("title"), F.when(C("doc_id") % 5 > 0, C("text")).otherwise("").alias("abstract"), C("source").alias("area"), C("doc_id").alias("ord"))
add("d8_merge_areas", lambda t: ag.merge_areas(_areas(t), "ord").select("paper_id", "title", F.length("abstract").alias("n_abstract"), C("ord").alias("first_id"), joined("areas").alias("areas")), f"WITH d AS (SELECT *, {SQL_TITLE} AS title FROM documents WHERE doc_id % 5 > 0 AND text <> '') SELECT n_chars % 300 AS paper_id, arg_min(title, doc_id) AS title, arg_min(length(text), doc_id) AS n_abstract, min(doc_id) AS first_id, string_agg(DISTINCT source, '|' ORDER BY source) AS areas FROM d GROUP BY 1")
add("d9_merge_recommendations", lambda t: ag.merge_recommendations(t.documents.select((C("n_chars") % 300).alias("paper_id"), TITLE().alias("title"), C("source").alias("source_peer"), F.when(C("doc_id") % 3 > 0, C("lang")).alias("source_s2"), "doc_id"), "doc_id").select("paper_id", "title", C("doc_id").alias("first_id"), joined("sources_peer").alias("sources_peer"), joined("sources_s2").alias("sources_s2")), f"WITH d AS (SELECT *, {SQL_TITLE} AS title, CASE WHEN doc_id % 3 > 0 THEN lang END AS s2 FROM documents) SELECT n_chars % 300 AS paper_id, arg_min(title, doc_id) AS title, min(doc_id) AS first_id, string_agg(DISTINCT source, '|' ORDER BY source) AS sources_peer, coalesce(string_agg(DISTINCT s2, '|' ORDER BY s2), '') AS sources_s2 FROM d GROUP BY 1")
_ctx = lambda t: t.lineitem.select((C("l_orderkey") % 500).alias("paper_id"), (C("l_partkey") % 10).alias("ref_id"), F.when(C("l_returnflag") == "R", "negative").when(C("l_returnflag") == "A", "positive").alias("gold"), F.when(C("l_linestatus") == "F", "negative").otherwise("positive").alias("prediction"))
add("d10_reference_polarity", lambda t: ag.reference_polarity(_ctx(t), ["paper_id", "ref_id"], "prediction"), "SELECT l_orderkey % 500 AS paper_id, l_partkey % 10 AS ref_id, CASE WHEN 2 * count(*) FILTER (l_linestatus = 'F') > count(*) THEN 'negative' ELSE 'positive' END AS polarity FROM lineitem GROUP BY 1, 2")
_cs = {"gold_positive": "l_returnflag = 'A'", "gold_negative": "l_returnflag = 'R'", "prediction_positive": "l_linestatus <> 'F'", "prediction_negative": "l_linestatus = 'F'"}
add("d11_context_stats", lambda t: ag.context_stats(_ctx(t)), "SELECT count(*) AS contexts, " + ", ".join(f"count(*) FILTER ({c}) AS {n}, round(100.0 * count(*) FILTER ({c}) / count(*), 4) AS {n}_pct" for n, c in _cs.items()) + ", (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey % 500, l_partkey % 10 HAVING count(*) > 1)) AS multi_refs FROM lineitem")
add("d12_distinct_venues", lambda t: ag.distinct_venues(t.documents.select(F.concat(F.upper("source"), F.lit("\n"), "lang").alias("v")), "v"), "SELECT DISTINCT lower(source) || ' ' || lang AS venue FROM documents")
add("d13_title_index", lambda t: ag.title_index(t.documents.select(TITLE().alias("title"), C("source").alias("file"), "doc_id"), "title", "file", "doc_id"), f"SELECT {SQL_TITLE} AS title, arg_max(source, doc_id) AS file FROM documents GROUP BY 1")
add("d14_mention_stats", lambda t: ag.mention_stats(t.documents.select("source", TITLE().alias("c")), "source", "c"), rf"WITH d AS (SELECT DISTINCT source, {SQL_TITLE} AS c FROM documents), w AS (SELECT sum(len(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '')))::BIGINT AS words, count(*) AS contexts FROM (SELECT DISTINCT c FROM d)) SELECT contexts, words, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM d GROUP BY source)) AS mean_per_paper, round(words * 1.5, 1)::DOUBLE AS tokens FROM w")
_map = lambda: F.map_from_arrays(F.slice(F.array(F.lit("clarity"), F.lit("impact"), F.lit("rating"), F.lit("soundness")), F.lit(1), (C("doc_id") % 5).cast("int")), F.slice(F.array(*[F.lit(1)] * 4), F.lit(1), (C("doc_id") % 5).cast("int")))
add("d15_rating_keys", lambda t: ag.rating_key_counts(t.documents.select(_map().alias("m")), "m", ["rating"]), "SELECT key, count(*) AS n FROM documents, (VALUES ('clarity', 1), ('impact', 2), ('soundness', 4)) k(key, i) WHERE doc_id % 5 >= i GROUP BY key")
add("d15_at_least_keys", lambda t: ag.at_least_keys(t.documents.select(_map().alias("m")), "m", ["rating"]), "WITH d AS (SELECT CASE WHEN doc_id % 5 >= 3 THEN doc_id % 5 - 1 ELSE doc_id % 5 END AS k FROM documents) SELECT k::INTEGER AS k, (SELECT count(*) FROM d e WHERE e.k >= g.k) AS n FROM (SELECT DISTINCT k FROM d) g")
_n = lambda m: F.slice(F.split("text", " "), F.lit(1), (C("doc_id") % m).cast("int"))
_len = lambda m: f"least(doc_id % {m}, len(string_split(text, ' ')))"
add("d16_term_stats", lambda t: ag.list_stats(t.documents.select(_n(4).alias("tasks"), _n(7).alias("methods")), ["tasks", "methods"]), f"SELECT kind, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, round(coalesce(stddev_samp(n), 0), 6) AS stdev FROM (SELECT 'tasks' AS kind, {_len(4)} AS n FROM documents UNION ALL SELECT 'methods', {_len(7)} FROM documents) GROUP BY kind")
add("d17_rating_noise", lambda t: ag.rating_noise(REVIEWS(t), "paper_id", "rating"), f"SELECT paper_id, round(var_pop(rating), 6) AS variance, max(rating) - min(rating) AS spread FROM {REVIEWS_SQL} r GROUP BY paper_id")
add("d17_histogram", lambda t: ag.histogram(t.lineitem, "l_quantity", 0, 50, 10), "WITH b AS (SELECT least(10, floor(l_quantity / 5)::INTEGER + 1) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1) SELECT bin, n, round(100.0 * n / sum(n) OVER (), 4) AS pct, round(100.0 * sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 4) AS cumulative_pct FROM b")
EDGES = lambda t: t.lineitem.select((C("l_orderkey") % 250).alias("source"), (C("l_partkey") % 250).alias("target"), F.when(C("l_returnflag") == "R", "semantic").otherwise("citation").alias("type"), F.round(1 - C("l_discount"), 6).alias("similarity"))
EDGES_SQL = "(SELECT l_orderkey % 250 AS source, l_partkey % 250 AS target, CASE WHEN l_returnflag = 'R' THEN 'semantic' ELSE 'citation' END AS type, round(1 - l_discount, 6) AS similarity FROM lineitem)"
_deg_sql = f"WITH d AS (SELECT type, CASE WHEN type = 'semantic' THEN 'both' ELSE dir END AS direction, node, count(*) AS degree FROM (SELECT type, 'out' AS dir, source AS node FROM {EDGES_SQL} a UNION ALL SELECT type, 'in', target FROM {EDGES_SQL} b) GROUP BY ALL)"
add("d18_degree_stats", lambda t: ag.degree_stats(EDGES(t)), f"{_deg_sql}, r AS (SELECT *, row_number() OVER (PARTITION BY type, direction ORDER BY degree DESC, node) AS r FROM d) SELECT type, direction, round(avg(degree), 6) AS mean, min(degree) AS min, max(degree) AS max, round(coalesce(stddev_samp(degree), 0), 6) AS stdev, string_agg(node::VARCHAR, ',' ORDER BY r) FILTER (r <= 5) AS top FROM r GROUP BY type, direction")
_types = ["title", "primary_area", "keyword", "tldr", "claim", "method", "experiment"]
add("d19_entity_counts", lambda t: ag.entity_counts(*hierarchy(t), _types), f"WITH {ENT_SQL}, {REL_SQL}, r AS (SELECT paper_id, count(*) AS edges FROM rel GROUP BY 1) SELECT ent.paper_id, count(*) AS nodes, " + ", ".join(f"count(*) FILTER (type = '{x}') AS {x}" for x in _types) + ", coalesce(any_value(r.edges), 0)::BIGINT AS edges FROM ent LEFT JOIN r USING (paper_id) GROUP BY ent.paper_id")
add("d20_describe", lambda t: ag.describe(t.documents, "n_chars", ["source"]), "SELECT source, count(*) AS count, round(avg(n_chars), 6) AS mean, round(coalesce(stddev_samp(n_chars), 0), 6) AS std, min(n_chars)::DOUBLE AS min, quantile_cont(n_chars, 0.25)::DOUBLE AS p25, quantile_cont(n_chars, 0.5)::DOUBLE AS p50, quantile_cont(n_chars, 0.75)::DOUBLE AS p75, max(n_chars)::DOUBLE AS max FROM documents GROUP BY source")
add("d21_rating_stats", lambda t: ag.rating_stats(REVIEWS(t), "rating", ["paper_id"]), f"SELECT paper_id, round(avg(rating), 6) AS mean, median(rating)::DOUBLE AS median, round(CASE WHEN count(*) > 2 THEN stddev_samp(rating) ELSE 0 END, 6) AS stdev FROM {REVIEWS_SQL} r GROUP BY paper_id")
add("d22_field_label_stats", lambda t: ag.field_label_stats(t.lineitem.select("l_quantity", "l_tax", F.lit(1.0).alias("one"), (C("l_linenumber") % 5).alias("label")), ["l_quantity", "l_tax", "one"], "label"), "WITH f AS (SELECT 'l_quantity' AS field, l_quantity AS v, l_linenumber % 5 AS label FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_linenumber % 5 FROM lineitem UNION ALL SELECT 'one', 1.0, l_linenumber % 5 FROM lineitem) SELECT field, CASE WHEN min(v) < max(v) AND min(label) < max(label) THEN round(corr(v, label), 6) END AS pearson, min(v) AS min, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS max FROM f GROUP BY field")
add("d23_filled_distribution", lambda t: ag.filled_distribution(t.documents.select((C("doc_id") % 4 + 1).cast("int").alias("y")), "y", [1, 2, 3, 4, 5]), "SELECT l::INTEGER AS label, count(doc_id) AS n, round(100.0 * count(doc_id) / (SELECT count(*) FROM documents), 4) AS pct FROM range(1, 6) g(l) LEFT JOIN documents ON doc_id % 4 + 1 = l GROUP BY l")
add("d24_avg_year", lambda t: ag.avg_publication_year(t.documents.select("source", F.when(C("doc_id") % 3 > 0, C("n_chars") % 30 + 1990).alias("year")), "source"), "SELECT source, round_even(avg(CASE WHEN doc_id % 3 > 0 THEN n_chars % 30 + 1990 END), 0)::INTEGER AS avg_year FROM documents GROUP BY source")
_limits = [0.0, 0.5, 1.0, 2.0, 4.0]
add(
    "d17_noise_share",
    lambda t: ag.noise_share(ag.rating_noise(REVIEWS(t), "paper_id", "rating"), "spread", _limits),
    f"WITH p AS (SELECT max(rating) - min(rating) AS spread FROM {REVIEWS_SQL} r GROUP BY paper_id) SELECT l::DOUBLE AS \"limit\", count(*) FILTER (spread <= l) AS n, round(count(*) FILTER (spread <= l) / count(*), 6) AS share FROM p, (SELECT unnest([{', '.join(map(str, _limits))}]) AS l) GROUP BY l",
)
