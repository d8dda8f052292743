"""Vector neighbours, related papers, search, sampling and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom import workspace
from paperloom.functions import text as tx
from paperloom.operators import related as rl
from paperloom.operators import sampling as sa
from paperloom.operators import textindex as ti
from paperloom.operators.joins import concat_all  # noqa: F401
from paperloom.plans.base import ORACLE, add
from paperloom.plans.texts import SQL_TITLE, TITLE

C = F.col
# roles: paper = vec_id div 2; even ids are its background, odd ids its target. Ids divisible by 100 ask (vectors, or
# papers with both of their vectors), and every vector but the asking one answers.
NODES = lambda t: t.embeddings.select(C("vec_id").alias("node_id"), F.when(C("vec_id") % 2 == 0, "background").otherwise("target").alias("kind"), "embedding")
ASK = lambda t: t.embeddings.where("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), "embedding")
ASK_PAPERS = lambda t: t.embeddings.where("vec_id div 2 % 100 = 0").select(C("vec_id").alias("query_id"), "embedding")
COS = "greatest(0, least(1, list_dot_product(q.v, n.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(n.v, n.v)) + 1e-8)))"
E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id, CASE WHEN n.vec_id % 2 = 0 THEN 'background' ELSE 'target' END AS kind, " + COS + " AS score FROM e q, e n WHERE {who} % 100 = 0 AND n.vec_id <> q.vec_id)"
E, E_PAPERS = E.replace("{who}", "q.vec_id"), E.replace("{who}", "(q.vec_id // 2)")
add("f11_semantic_topk", lambda t: rl.semantic_topk(ASK(t), NODES(t), 5, ["kind"], apart=True).select("query_id", "kind", "node_id", F.round("score", 4).alias("score"), "r"),
    f"WITH {E} SELECT query_id, kind, node_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, node_id)::INTEGER AS r FROM s QUALIFY r <= 5")
add("f12_vector_search", lambda t: rl.vector_search(ASK(t), NODES(t), 5, 0.3, apart=True).select("query_id", "node_id", F.round("score", 4).alias("score")),
    f"WITH {E} SELECT query_id, node_id, round(score, 4) AS score FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 5) WHERE score >= 0.3")
add("f12_find_best", lambda t: rl.find_best(ASK(t), NODES(t), 0.35, apart=True).select("query_id", "node_id", F.round("score", 4).alias("score")),
    f"WITH {E}, b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) = 1) SELECT query_id, CASE WHEN score >= 0.35 THEN node_id END AS node_id, CASE WHEN score >= 0.35 THEN round(score, 4) END AS score FROM b")
# asked with distorted vectors: the buckets find their near copies (tests measure the recall), and the twin is the exact answer
_bent = lambda t: ASK(t).withColumn("embedding", F.transform("embedding", lambda x, i: (x * (1 + 0.1 * (i % 3 - 1))).cast("float")))
add("f12_approximate_search", lambda t: rl.audited_search(_bent(t), NODES(t).drop("kind"), 5, 0.9, recall=0.99, bits=6).select("query_id", "node_id", F.round("score", 4).alias("score"), "r"),
    f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT vec_id, list_transform(v, lambda x, i: (x * (1 + 0.1 * ((i - 1) % 3 - 1)))::FLOAT::DOUBLE) AS v FROM e WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id, {COS} AS score FROM b q, e n) SELECT query_id, node_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INTEGER AS r FROM s WHERE score >= 0.9 QUALIFY r <= 5")
_name = lambda c: F.concat(F.lit("title "), F.translate(c.cast("string"), "0123456789", "abcdefghij"))
#: Ids are dealt over the whole table: one more than the largest.
_size = lambda t: F.lit(t.embeddings.agg(F.max("vec_id")).first()[0] + 1)
_cited = lambda t: t.lineitem.select((C("l_orderkey") % _size(t)).alias("paper_id"), ((C("l_partkey") * 7919 + C("l_linenumber")) % _size(t)).alias("cited"), F.when(C("l_returnflag") == "R", "negative").otherwise("positive").alias("polarity")).distinct().select("paper_id", _name(C("cited")).alias("cited_title"), "polarity")
_scores = lambda t: rl.citation_scores(t.embeddings.select(C("vec_id").alias("paper_id"), _name(C("vec_id")).alias("title")), _cited(t), t.embeddings.select(_name(C("vec_id")).alias("title"), "embedding"))
_cite_sql = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT DISTINCT l_orderkey % n AS paper_id, (l_partkey * 7919 + l_linenumber) % n AS cited, CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END AS polarity FROM lineitem, (SELECT max(vec_id) + 1 AS n FROM embeddings)), c AS (SELECT paper_id, polarity, 'title ' || translate(cited::VARCHAR, '0123456789', 'abcdefghij') AS cited_title, " + COS + " AS score FROM x JOIN e q ON q.vec_id = paper_id JOIN e n ON n.vec_id = cited)"
add("f13_citation_scores", lambda t: _scores(t).where("r <= 5").select("paper_id", "polarity", "cited_title", F.round("score", 4).alias("score")), f"WITH {_cite_sql} SELECT paper_id, polarity, cited_title, round(score, 4) AS score FROM c QUALIFY row_number() OVER (PARTITION BY paper_id, polarity ORDER BY score DESC, cited_title) <= 5")
add("f25_top_reference_titles", lambda t: rl.top_reference_titles(_scores(t), 1), f"WITH {_cite_sql} SELECT DISTINCT cited_title AS title FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY paper_id, polarity ORDER BY score DESC, cited_title) = 1)")
add("f14_base_input_match", lambda t: rl.base_input_match(t.embeddings.where("vec_id % 100 = 0").select(F.floor(C("vec_id") / 200).alias("paper_id"), F.floor(C("vec_id") / 200).alias("relation_id"), C("vec_id").alias("query_id"), "embedding"), t.embeddings.select(C("vec_id").alias("node_id"), "embedding"), apart=True).select("paper_id", "relation_id", "node_id", F.round("score", 4).alias("score")),
    f"WITH {E} SELECT query_id // 200 AS paper_id, query_id // 200 AS relation_id, node_id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id // 200 ORDER BY score DESC, node_id) = 1")
add("f15_kg_neighbours", lambda t: rl.kg_neighbours(t.part.select((C("p_partkey") % 20).alias("paper_id"), C("p_name").alias("term")).distinct(), t.part.select(F.upper("p_name").alias("head"), C("p_type").alias("tail"))).select("paper_id", "term", F.array_join("tails", ",").alias("tails")),
    "SELECT DISTINCT p_partkey % 20 AS paper_id, p_name AS term, tails FROM part JOIN (SELECT p_name AS h, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS tails FROM part GROUP BY 1) ON h = p_name")

# H
add("h1_topk_per_group", lambda t: rl.topk_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 3, "o_orderkey"), "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS r FROM orders QUALIFY r <= 3")
SEM = lambda t: rl.semantic_topk(ASK_PAPERS(t), NODES(t), 60, ["kind"], apart=True).select(F.floor(C("query_id") / 2).alias("q"), "query_id", "kind", F.floor(C("node_id") / 2).alias("paper_id"), "score")
# a query's background text asks the background nodes, its target text the target nodes
SIDES = lambda t: SEM(t).where((C("query_id") % 2 == 0) == (C("kind") == "background")).select(C("q").alias("query_id"), "kind", "paper_id", "score")
SIDES_SQL = f"{E_PAPERS}, sem AS (SELECT query_id // 2 AS query_id, kind, node_id // 2 AS paper_id, score FROM s WHERE (query_id % 2 = 0) = (kind = 'background'))"
TWO = "two AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, paper_id) AS r0 FROM sem QUALIFY r0 <= 2 * {k}), both_ AS (SELECT query_id, paper_id FROM two GROUP BY ALL HAVING count(DISTINCT kind) > 1), side AS (SELECT query_id, kind, paper_id, score, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, paper_id) AS r FROM two ANTI JOIN both_ USING (query_id, paper_id) QUALIFY r <= {k})"
add("h2_two_sided_topk", lambda t: rl.two_sided_topk(SIDES(t), 20).select("query_id", "kind", "paper_id", F.round("score", 4).alias("score"), "r"), f"WITH {SIDES_SQL}, {TWO.format(k=20)} SELECT query_id, kind, paper_id, round(score, 4) AS score, r::INTEGER AS r FROM side")
#: Papers are pairs of vectors; every one may be cited, and each hundredth asks.
_papers = lambda t: F.floor((_size(t) + 1) / 2)
CITES = lambda t: t.lineitem.select((C("l_orderkey") % F.ceil(_papers(t) / 100) * 100).alias("query_id"), ((C("l_partkey") * 7919 + C("l_linenumber")) % _papers(t)).alias("paper_id"), F.when(C("l_returnflag") == "R", "negative").otherwise("positive").alias("polarity"), F.round(1 - C("l_discount"), 6).alias("score")).groupBy("query_id", "paper_id").agg(F.max("score").alias("score"), F.min("polarity").alias("polarity"))
CITES_SQL = "cit AS (SELECT l_orderkey % (n // 200 + CASE WHEN n % 200 > 0 THEN 1 ELSE 0 END) * 100 AS query_id, (l_partkey * 7919 + l_linenumber) % ((n + 1) // 2) AS paper_id, max(round(1 - l_discount, 6)) AS score, min(CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END) AS polarity FROM lineitem, (SELECT max(vec_id) + 1 AS n FROM embeddings) GROUP BY 1, 2)"
_union = "u AS (SELECT query_id, paper_id, 'citation' AS source, polarity, score, r FROM c UNION ALL SELECT query_id, paper_id, 'semantic', CASE WHEN kind = 'background' THEN 'positive' ELSE 'negative' END, score, r FROM side) SELECT query_id, paper_id, source, polarity, round(score, 4) AS score FROM u QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY CASE WHEN source = 'citation' AND polarity = 'positive' THEN 0 WHEN source = 'citation' THEN 1 WHEN polarity = 'negative' THEN 2 ELSE 3 END, r) = 1"
_c_sql = "c AS (SELECT *, row_number() OVER (PARTITION BY query_id, polarity ORDER BY score DESC, paper_id) AS r FROM cit QUALIFY r <= {k})"
_shown = lambda d: d.select("query_id", "paper_id", "source", "polarity", F.round("score", 4).alias("score"))
add("h4_related_papers", lambda t: _shown(rl.related_papers(CITES(t), SIDES(t), 20)), f"WITH {SIDES_SQL}, {TWO.format(k=20)}, {CITES_SQL}, {_c_sql.format(k=20)}, {_union}")
add("h4_related_papers_threshold", lambda t: _shown(rl.related_papers(CITES(t), SEM_ALL(t), threshold=0.25)), f"WITH {SIDES_SQL}, side AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, paper_id) AS r FROM sem WHERE score >= 0.25), {CITES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, polarity ORDER BY score DESC, paper_id) AS r FROM cit WHERE score >= 0.25), {_union}")


# a paper's year and month from its number; every fourth paper has no day of publication
_paper = lambda: F.floor(C("vec_id") / 2)
_year = lambda: (2000 + _paper() % 10).cast("int")
_month = lambda: F.when(_paper() % 4 > 0, _paper() % 12 + 1).cast("int")
_kind = lambda: F.when(C("vec_id") % 2 == 0, "background").otherwise("target")
_asking = lambda t: t.embeddings.where("vec_id div 2 % 100 = 0").select(_paper().alias("query_id"), _kind().alias("kind"), "embedding", _year().alias("year"), F.when(_paper() % 300 > 0, F.lit(6)).alias("month"))
_pool = lambda t: t.embeddings.where("vec_id div 2 % 100 > 0").select(_paper().alias("paper_id"), _kind().alias("kind"), "embedding", F.when(_paper() % 7 > 0, "an abstract").otherwise(" ").alias("abstract"), _year().alias("year"), F.make_date(_year(), _month(), F.lit(1)).alias("published"))
_cited_by = lambda t: CITES(t).withColumn("abstract", F.when(C("paper_id") % 7 > 0, "an abstract"))
_single_sql = """e AS (SELECT vec_id, vec_id // 2 AS p, CASE WHEN vec_id % 2 = 0 THEN 'background' ELSE 'target' END AS kind, embedding::DOUBLE[] AS v, 2000 + vec_id // 2 % 10 AS y, CASE WHEN vec_id // 2 % 4 > 0 THEN vec_id // 2 % 12 + 1 END AS m FROM embeddings),
side AS (SELECT q.p AS query_id, n.p AS paper_id, q.kind, {cos} AS score, row_number() OVER (PARTITION BY q.p, q.kind ORDER BY {cos} DESC, n.p) AS r FROM e q JOIN e n ON n.kind = q.kind AND n.p % 100 > 0 AND n.p % 7 > 0 AND {allowed} WHERE q.p % 100 = 0 QUALIFY r <= 10), {cites}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, polarity ORDER BY score DESC, paper_id) AS r FROM cit WHERE paper_id % 7 > 0 QUALIFY r <= 10),
u AS (SELECT query_id, paper_id, 'citation' AS source, polarity, score, r FROM c UNION ALL SELECT query_id, paper_id, 'semantic', CASE WHEN kind = 'background' THEN 'negative' ELSE 'positive' END, score, r FROM side) SELECT query_id, paper_id, source, polarity, round(score, 4) AS score FROM u QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY CASE WHEN source = 'citation' AND polarity = 'positive' THEN 0 WHEN source = 'citation' THEN 1 WHEN polarity = 'negative' THEN 2 ELSE 3 END, r) = 1"""
_allowed = "(n.y < q.y OR (n.y = q.y AND q.p % 300 > 0 AND n.m <= 6))"
for _name_, _dated in (("h4_single_paper_dated", True), ("h4_single_paper", False)):
    add(_name_, lambda t, d=_dated: _shown(rl.single_paper_related(_asking(t), _pool(t), _cited_by(t), 10, d)), "WITH " + _single_sql.format(cos=COS, allowed=_allowed if _dated else "true", cites=CITES_SQL))


def SEM_ALL(t):
    """All scores of the asking papers that reach the threshold: for the threshold mode, where no top-k cuts the lists."""
    near = rl.semantic_above(ASK_PAPERS(t), NODES(t), 0.25, ["kind"]).where("node_id <> query_id")
    near = near.where((C("query_id") % 2 == 0) == (C("kind") == "background"))
    return near.select(F.floor(C("query_id") / 2).alias("query_id"), "kind", F.floor(C("node_id") / 2).alias("paper_id"), "score")


_rel = lambda t: t.lineitem.select((C("l_orderkey") % 50).alias("query_id"), (C("l_partkey") % 50).alias("paper_id"), F.when(C("l_linestatus") == "F", "citation").otherwise("semantic").alias("source"), F.when(C("l_returnflag") == "R", "negative").otherwise("positive").alias("polarity"), "l_extendedprice").groupBy("query_id", "paper_id", "source", "polarity").agg(F.max("l_extendedprice").alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source", "polarity").orderBy(F.desc("score"), "paper_id")))
add("h3_dedup_by_priority", lambda t: rl.dedup_by_priority(_rel(t)).select("query_id", "paper_id", "source", "polarity"), "WITH u AS (SELECT DISTINCT l_orderkey % 50 AS query_id, l_partkey % 50 AS paper_id, CASE WHEN l_linestatus = 'F' THEN 'citation' ELSE 'semantic' END AS source, CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END AS polarity FROM lineitem) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY CASE WHEN source = 'citation' AND polarity = 'positive' THEN 0 WHEN source = 'citation' THEN 1 WHEN polarity = 'negative' THEN 2 ELSE 3 END) = 1")
_terms = lambda t, m, n: t.lineitem.where(C("l_linenumber") == n).select((C("l_orderkey") % 500).alias("paper_id"), F.concat(F.lit("t"), (C("l_partkey") % m).cast("string")).alias("term"))
add("h5_scimon_terms", lambda t: rl.scimon_terms(_terms(t, 90, 1).withColumnRenamed("term", "title"), _terms(t, 50, 2), _terms(t, 70, 3)).select("paper_id", *[F.array_join(c, ",").alias(c) for c in ("citation_titles", "kg_terms", "semantic_terms")]),
    "WITH x AS (SELECT DISTINCT l_orderkey % 500 AS p, 't' || (l_partkey % 90) AS t FROM lineitem WHERE l_linenumber = 1), k AS (SELECT DISTINCT l_orderkey % 500 AS p, 't' || (l_partkey % 50) AS t FROM lineitem WHERE l_linenumber = 2), s AS (SELECT DISTINCT l_orderkey % 500 AS p, 't' || (l_partkey % 70) AS t FROM lineitem WHERE l_linenumber = 3 EXCEPT SELECT p, t FROM k), ids AS (SELECT p FROM x UNION SELECT p FROM k UNION SELECT p FROM s) SELECT p AS paper_id, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM x WHERE x.p = ids.p), '') AS citation_titles, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM k WHERE k.p = ids.p), '') AS kg_terms, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM s WHERE s.p = ids.p), '') AS semantic_terms FROM ids")
_hit = lambda t, where: t.documents.where(where).select(C("doc_id").alias("id"), TITLE().alias("title"), F.when(C("doc_id") % 7 > 0, C("text")).otherwise("").alias("abstract"), C("n_chars").alias("ord"))
add("h6_combine_results", lambda t: sa.combine_results(_hit(t, "lang = 'en'"), _hit(t, "true"), 50, "That it").select("id", "title"),
    rf"WITH r AS (SELECT doc_id AS id, {SQL_TITLE} AS title, n_chars AS ord, 0 AS p FROM documents WHERE lang = 'en' AND doc_id % 7 > 0 AND text <> '' UNION ALL SELECT doc_id, {SQL_TITLE}, n_chars, 1 FROM documents WHERE doc_id % 7 > 0 AND text <> ''), o AS (SELECT * FROM r WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, ord) = 1), l AS (SELECT * FROM o ORDER BY p, ord, id LIMIT 50) SELECT id, title FROM l WHERE regexp_replace(lower(title), '\s+', ' ', 'g') <> 'that it'")
_cnt = lambda c, w: rf"len(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x IN ({w})))"
add("h7_fulltext_search", lambda t: sa.fulltext_search(t.documents.select(C("doc_id").alias("id"), TITLE().alias("title"), C("text").alias("abstract"), C("n_chars").alias("citation_count")), "The of", 100),
    f"WITH d AS (SELECT doc_id AS id, n_chars AS citation_count, {_cnt(SQL_TITLE, chr(39) + 'the' + chr(39))} + {_cnt(SQL_TITLE, chr(39) + 'of' + chr(39))} AS t, {_cnt('text', chr(39) + 'the' + chr(39))} AS a1, {_cnt('text', chr(39) + 'of' + chr(39))} AS a2, {_cnt(SQL_TITLE, chr(39) + 'the' + chr(39))} AS t1, {_cnt(SQL_TITLE, chr(39) + 'of' + chr(39))} AS t2 FROM documents) SELECT id, citation_count, round(t + (a1 + a2) * 0.4, 6)::DOUBLE AS score FROM d WHERE a1 + t1 > 0 AND a2 + t2 > 0 ORDER BY score DESC, citation_count DESC, id LIMIT 100")
_papers_of = lambda t: t.documents.select(C("doc_id").alias("id"), TITLE().alias("title"), C("text").alias("abstract"), C("n_chars").alias("citation_count"))


def _index(t):
    """The index of all documents, written to the shared folder and read again."""
    path = workspace.new_path(t.spark, "text-index")
    ti.write_index(_papers_of(t), path)
    return ti.read_index(t.spark, path)


add("h7_index_search", lambda t: ti.search_index(_index(t), "The of", 100), ORACLE["h7_fulltext_search"])
_terms_sql = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
add(
    "h7_index_queries",
    lambda t: ti.search_many(_index(t), t.benchmark.select(C("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query")), 10),
    f"""WITH q AS (SELECT item_id, list_distinct({_terms_sql.format(c="array_to_string(string_split(text, ' ')[1:3], ' ')")}) AS ts FROM benchmark), qt AS (SELECT item_id, len(ts) AS n, unnest(ts) AS term FROM q),
p AS (SELECT doc_id, n_chars, w, term, count(*) AS tf FROM (SELECT doc_id, n_chars, 1.0 AS w, unnest({_terms_sql.format(c=SQL_TITLE)}) AS term FROM documents UNION ALL SELECT doc_id, n_chars, 0.4, unnest({_terms_sql.format(c='text')}) FROM documents) GROUP BY ALL)
SELECT item_id AS query_id, doc_id AS id, n_chars AS citation_count, round(sum(w * tf), 6)::DOUBLE AS score, (row_number() OVER (PARTITION BY item_id ORDER BY sum(w * tf) DESC, n_chars DESC, doc_id))::INTEGER AS r FROM qt JOIN p USING (term) GROUP BY item_id, n, doc_id, n_chars HAVING count(DISTINCT term) = n QUALIFY r <= 10""",
)
_n = lambda c: f"(length({c}) - length(replace(lower({c}), 'an', ''))) // 2"
add("h8_substring_search", lambda t: sa.substring_search(t.documents.select(C("doc_id").alias("id"), TITLE().alias("title"), C("source").alias("authors"), C("text").alias("abstract")), " AN "), f"SELECT * FROM (SELECT doc_id AS id, (10 * ({_n(SQL_TITLE)}) + 5 * ({_n('source')}) + ({_n('text')}))::BIGINT AS score FROM documents) WHERE score > 0")
_draw = lambda c, s=0: f"md5('{s}:' || {c})"
add("h9_sample", lambda t: sa.sample(t.orders.select("o_orderkey", "o_custkey"), 100, "o_orderkey", 7), f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {_draw('o_orderkey', 7)} LIMIT 100")
add("h10_split", lambda t: sa.split(t.orders.select("o_orderkey"), "o_orderkey", 0.8, 0.1), f"WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_draw('o_orderkey')}) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM o")
add("h11_balance", lambda t: sa.balance(t.events.select("event_id", "event_type"), "event_type", "error", "event_id"), f"SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_draw('event_id')}) <= (SELECT count(*) FROM events WHERE event_type = 'error')")
add("h12_downsample", lambda t: sa.downsample(t.lineitem.select("l_linestatus", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("k")), "l_linestatus", "40/60", "k").groupBy("l_linestatus").agg(F.count("*").alias("n")), "WITH c AS (SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT min(n * 100 // CASE WHEN l_linestatus = 'F' THEN 40 ELSE 60 END) AS t FROM c) SELECT l_linestatus, (t * CASE WHEN l_linestatus = 'F' THEN 40 ELSE 60 END // 100)::BIGINT AS n FROM c, t")
add("h13_sample_contexts", lambda t: sa.sample_contexts(t.documents.select("doc_id", F.split("text", "\n").alias("c")), "c", 200, "doc_id").select("doc_id", F.array_join("c", "|").alias("c")), f"WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents), s AS (SELECT * FROM e ORDER BY {_draw('doc_id || chr(45) || i')}, doc_id, i LIMIT 200) SELECT doc_id, string_agg(x, '|' ORDER BY i) AS c FROM s GROUP BY doc_id")
add("h14_stratified", lambda t: sa.stratified(t.documents.select("doc_id", (C("n_chars") % 5).alias("g")), "g", 50, 5, "doc_id"), f"SELECT doc_id, n_chars % 5 AS g FROM documents QUALIFY row_number() OVER (PARTITION BY n_chars % 5 ORDER BY {_draw('doc_id')}) <= 10")
_ev = lambda t: t.lineitem.select((C("l_orderkey") % 3000).alias("paper_id"), F.when(C("l_linestatus") == "F", "semantic").otherwise("citation").alias("source"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("ord")).distinct()
add("h15_evidence_quota", lambda t: sa.evidence_quota(_ev(t), "paper_id", "ord").groupBy("paper_id", "source").agg(F.count("*").alias("n")), "WITH e AS (SELECT DISTINCT l_orderkey % 3000 AS p, l_linestatus = 'F' AS sem, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) FROM lineitem), c AS (SELECT p, count(*) FILTER (sem) AS s, count(*) FILTER (NOT sem) AS c FROM e GROUP BY p), q AS (SELECT *, least(s, 3) AS s0, least(c, 2) AS c0 FROM c), f AS (SELECT p, s0 + CASE WHEN s - s0 > c - c0 THEN least(s - s0, 5 - s0 - c0) ELSE 0 END AS ns, c0 + CASE WHEN s - s0 > c - c0 THEN 0 ELSE least(c - c0, 5 - s0 - c0) END AS nc FROM q) SELECT p AS paper_id, 'semantic' AS source, ns AS n FROM f WHERE ns > 0 UNION ALL SELECT p, 'citation', nc FROM f WHERE nc > 0")
add("h16_sample_by_prediction", lambda t: sa.sample_by_prediction(t.documents.select("doc_id", (C("n_chars") % 5 + 1).alias("y")), 25, "y", "doc_id"), "SELECT doc_id, n_chars % 5 + 1 AS y, CASE WHEN n_chars % 5 + 1 <= 2 THEN 'low' ELSE 'high' END AS side FROM documents QUALIFY row_number() OVER (PARTITION BY side ORDER BY doc_id) <= 25")
