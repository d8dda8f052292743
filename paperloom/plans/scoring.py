"""Novelty scores, ensembles, tournaments and claim graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import graphs as gr
from paperloom.operators import scoring as sc
from paperloom.operators import tournament as to
from paperloom.plans.base import add
from paperloom.plans.rows import ENT_SQL, REL_SQL, hierarchy

C = F.col
# ACUs: sentences (lines) of documents; a match score from the line's length
_acus = lambda t: t.documents.select(C("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("i", "x")).select("paper_id", (C("paper_id") * 100000 + C("i")).alias("acu_id"), (F.length("x") % 3 == 0).alias("salient"), F.length("x").alias("n"))
_match = lambda t: _acus(t).where("n % 4 > 0").select("acu_id", (C("n") % 100 / 100.0).alias("score"))
_acu_sql = "l AS (SELECT doc_id AS paper_id, length(unnest(string_split(text, chr(10)))) AS n FROM documents), a AS (SELECT paper_id, n % 3 = 0 AS salient, CASE WHEN n % 4 > 0 THEN (n % 100) / 100.0 END AS best FROM l), w AS (SELECT *, avg(salient::INT) OVER (PARTITION BY paper_id) AS ratio FROM a)"
_score = lambda t, al, be, ga: f"round(sum(CASE WHEN best >= {t} THEN 0.0 ELSE CASE WHEN salient THEN 1.0 ELSE least(1.0, {al} * pow(ratio - {be}, 3) + {ga}) END END::DOUBLE) / count(*), 6)"
_rating = "CASE WHEN score < 0.2 THEN 1 WHEN score < 0.4 THEN 2 WHEN score < 0.6 THEN 3 WHEN score < 0.8 THEN 4 ELSE 5 END"
add("j1_nova_score", lambda t: sc.nova_score(_acus(t), _match(t)), f"WITH {_acu_sql}, s AS (SELECT paper_id, count(*) AS n, {_score(0.6, -0.5, 1.0, 0.3)} AS score FROM w GROUP BY paper_id) SELECT paper_id, n, score, {_rating} AS rating FROM s")
_grid = [(0.5, -0.5, 1.0, 0.3), (0.6, -0.5, 1.0, 0.3), (0.7, -1.0, 0.5, 0.2)]
_grid_sql = " UNION ALL ".join(f"SELECT paper_id, {t} AS t, {a} AS alpha, {b} AS beta, {g} AS gamma, {_score(t, a, b, g)} AS score FROM w GROUP BY paper_id" for t, a, b, g in _grid)
add("j2_nova_grid", lambda t: sc.nova_grid(_acus(t), _match(t), t.documents.select(C("doc_id").alias("paper_id"), (C("n_chars") % 5 + 1).alias("label")), t.spark.createDataFrame(_grid, "t double, alpha double, beta double, gamma double")), f"WITH {_acu_sql}, s AS ({_grid_sql}) SELECT t::DOUBLE AS t, alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, gamma::DOUBLE AS gamma, round(avg(({_rating} = n_chars % 5 + 1)::INT), 6) AS accuracy FROM s JOIN documents ON doc_id = paper_id GROUP BY ALL")
add("j3_nova_index", lambda t: sc.nova_index(t.documents.select(C("doc_id").alias("paper_id"), F.split("text", "\n").alias("acus")), "acus", 100, 300).select("paper_id", "sentence_id", "sentence", F.exists("embedding", lambda x: x != 0).alias("encoded")), "WITH p AS (SELECT * FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 100), s AS (SELECT doc_id AS paper_id, doc_id || '-' || unnest(range(0, len(string_split(text, chr(10))))) AS sentence_id, unnest(string_split(text, chr(10))) AS sentence FROM p) SELECT paper_id, sentence_id, sentence, regexp_matches(sentence, '[^\\s]') AS encoded FROM s ORDER BY md5('0:' || sentence_id), sentence_id LIMIT 300")
_evals = lambda t: t.lineitem.select((C("l_orderkey") % 5000).alias("paper_id"), (C("l_quantity") % 5 + 1).cast("int").alias("label"))
add("j4_ensemble", lambda t: sc.ensemble(_evals(t)), "WITH e AS (SELECT l_orderkey % 5000 AS paper_id, (l_quantity % 5 + 1)::INTEGER AS label FROM lineitem) SELECT paper_id, round_even(median(label), 0)::INTEGER AS label, round(greatest(0, 1 - coalesce(stddev_samp(label), 0) / 2), 6) AS confidence, count(*) AS n FROM e GROUP BY paper_id")
add("j5_best_rationale", lambda t: sc.best_rationale(t.conversations, "conv_id", "text", "turn").select("conv_id", "turn", F.round("score", 6).alias("score")))
add("j6_best_of_n", lambda t: sc.best_of_n(_evals(t).groupBy("paper_id").agg(F.max("label").alias("label"), F.collect_list("label").alias("r")).select("paper_id", "label", F.explode_outer(F.filter("r", lambda x: x != 3)).alias("rating"))),
    "WITH e AS (SELECT l_orderkey % 5000 AS paper_id, (l_quantity % 5 + 1)::INTEGER AS r FROM lineitem), g AS (SELECT paper_id, max(r) AS label, avg(least(4, r)) FILTER (r <> 3) / 4 AS p FROM e GROUP BY 1) SELECT paper_id, label, round(CASE WHEN p IS NULL THEN (CASE WHEN label >= 4 THEN 1 ELSE 0 END)::DOUBLE WHEN label < 4 THEN least(p, 0.4::DOUBLE) ELSE greatest(p, 0.6::DOUBLE) END, 6) AS probability FROM g")
# a match: consecutive players; metric = event type
MATCHES = lambda t: t.events.select(C("event_id").alias("seq"), C("event_type").alias("metric"), F.concat(F.lit("u"), (C("user_id") % 12).cast("string")).alias("item_a"), F.concat(F.lit("u"), ((C("user_id") % 12 + 1 + C("event_id") % 11) % 12).cast("string")).alias("item_b"), F.when(C("value") < 5, "A").when(C("value") < 12, "B").otherwise("tie").alias("winner"), C("props").alias("rationale_a"), F.concat_ws(" ", "event_type", "props").alias("rationale_b"))
M = "m AS (SELECT event_id AS seq, event_type AS metric, 'u' || (user_id % 12) AS item_a, 'u' || ((user_id % 12 + 1 + event_id % 11) % 12) AS item_b, CASE WHEN value < 5 THEN 1.0 WHEN value < 12 THEN 0.0 ELSE 0.5 END AS w FROM events), s AS (SELECT metric, item_a AS item, item_b AS other, w FROM m UNION ALL SELECT metric, item_b, item_a, 1 - w FROM m)"
add("j7_head_to_head", lambda t: to.head_to_head(MATCHES(t)), f"WITH {M}, i AS (SELECT DISTINCT metric, item FROM s) SELECT a.metric, a.item, b.item AS other, count(*) FILTER (w = 1) AS wins, count(*) FILTER (w = 0.5) AS ties, count(*) FILTER (w = 0) AS losses FROM i a JOIN i b ON a.metric = b.metric AND a.item <> b.item LEFT JOIN s ON s.metric = a.metric AND s.item = a.item AND s.other = b.item GROUP BY ALL")
_r = lambda d, c: d.withColumn(c, F.round(c, 4))
# the twin folds each metric's matches, in order, into a map of ratings
_old = lambda x: f"coalesce(acc.r[x.{x}], 1200.0)"
_gain = f"32 * (x.w - 1 / (1 + pow(10.0, ({_old('b')} - {_old('a')}) / 400)))"
_fold_sql = f"""SELECT metric, list_reduce(list({{'r': MAP {{}}::MAP(VARCHAR, DOUBLE), 'a': item_a, 'b': item_b, 'w': w::DOUBLE}} ORDER BY seq), lambda acc, x: {{'r': map_concat(acc.r, MAP {{x.a: {_old('a')} + {_gain}, x.b: {_old('b')} - {_gain}}}), 'a': '', 'b': '', 'w': 0.0}}, {{'r': MAP {{}}::MAP(VARCHAR, DOUBLE), 'a': '', 'b': '', 'w': 0.0::DOUBLE}}).r AS r FROM m GROUP BY metric"""
add("j8_elo", lambda t: _r(to.elo(MATCHES(t)), "rating"),
    f"WITH {M}, f AS ({_fold_sql}), e AS (SELECT metric, unnest(map_entries(r), recursive := true) FROM f), n AS (SELECT metric, item, count(*) FILTER (w = 1) AS wins, count(*) FILTER (w = 0) AS losses, count(*) FILTER (w = 0.5) AS ties FROM s GROUP BY ALL) SELECT metric, item, round(value, 4) AS rating, wins, losses, ties, (row_number() OVER (PARTITION BY metric ORDER BY value DESC, item))::INTEGER AS rank FROM e JOIN n USING (metric) WHERE n.item = e.key")
add("j9_melo", lambda t: _r(to.melo(MATCHES(t)), "rating"))
add("j10_bradley_terry", lambda t: _r(to.bradley_terry(MATCHES(t)), "strength"))
_ranks = lambda t: t.events.groupBy(C("event_type").alias("metric"), (C("user_id") % 12).alias("item")).agg(F.count("*").alias("n"))
add("j11_overall_ranks", lambda t: to.overall_ranks(_ranks(t).withColumn("rank", F.row_number().over(to.Window.partitionBy("metric").orderBy(F.desc("n"), "item")))).select("item", "mean_rank", "median_rank", "best", "worst", F.array_join(F.transform(F.map_entries("by_metric"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_metric")), "WITH c AS (SELECT event_type AS metric, user_id % 12 AS item, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY n DESC, item)::INTEGER AS rank FROM c) SELECT item, round(avg(rank), 6) AS mean_rank, median(rank)::DOUBLE AS median_rank, min(rank) AS best, max(rank) AS worst, string_agg(metric || '=' || rank, ',' ORDER BY metric) AS by_metric FROM r GROUP BY item")
add("j12_rationale_tokens", lambda t: to.rationale_token_stats(MATCHES(t)), r"WITH m AS (SELECT 'u' || (user_id % 12) AS a, 'u' || ((user_id % 12 + 1 + event_id % 11) % 12) AS b, len(list_filter(regexp_split_to_array(props, '\s+'), lambda x: x <> '')) AS n FROM events), x AS (SELECT a AS item, n FROM m UNION ALL SELECT b, n + 1 FROM m) SELECT item, count(*) AS count, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, round(coalesce(stddev_samp(n), 0), 6) AS stdev, min(n)::BIGINT AS min, max(n)::BIGINT AS max FROM x GROUP BY item")
_papers = lambda t: t.customer.select(C("c_custkey").alias("paper_id"))
# hierarchy(): labels are unique, so the rules reduce to the injected faults
_rules = f"""WITH {ENT_SQL}, {REL_SQL}, o AS (SELECT o_custkey AS p, o_orderkey AS k FROM orders JOIN customer ON c_custkey = o_custkey),
v AS (SELECT paper_id, 0 AS rule, 'Found edge with unknown target node: ''' || target || '''' AS message FROM rel WHERE paper_id % 7 = 0 AND target LIKE 'A%'
UNION ALL SELECT c_custkey, 1, 'Found 0 ''primary_area'' nodes. Should be exactly 1.' FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT c_custkey, 3, 'Found 0 incoming edges to node type ''tldr''. Should be exactly 1. Node: ''S' || c_custkey || '''' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT p, 4, 'Found 1 outgoing edges from node type ''experiment''. Should be 0.' FROM o WHERE k % 97 = 0
UNION ALL SELECT p, 5, 'Found illegal incoming edge from ''experiment'' to ''claim''' FROM o WHERE k % 97 = 0
UNION ALL SELECT p, 6, 'Node type ''method'' has no incoming edges from ''claim''. Should be at least 1.' FROM o WHERE k % 11 = 0
UNION ALL SELECT p, 7, 'Node type ''claim'' has no outgoing edges to ''method''. Should be at least 1.' FROM o WHERE k % 11 = 0
UNION ALL SELECT c_custkey, 7, 'Node type ''tldr'' has no outgoing edges to ''claim''. Should be at least 1.' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT p, 8, 'Graph has cycles' FROM o WHERE k % 97 = 0 AND k % 11 > 0)
SELECT paper_id, rule, message FROM v UNION ALL SELECT c_custkey, -1, 'Valid' FROM customer WHERE c_custkey NOT IN (SELECT paper_id FROM v)"""
add("j13_validate_graphs", lambda t: gr.validate_graphs(*hierarchy(t), _papers(t)), _rules)
# every node begins a path, so the longest path to a node is its level; none is as long as 30 unless it runs in a circle
add(
    "j14_levels",
    lambda t: gr.topological_levels(hierarchy(t)[1]),
    f"WITH RECURSIVE {REL_SQL}, e AS (SELECT DISTINCT paper_id, source, target FROM rel), n AS (SELECT paper_id, source AS label FROM e UNION SELECT paper_id, target FROM e), "
    "p AS (SELECT paper_id, label, 0 AS l FROM n UNION SELECT e.paper_id, e.target, l + 1 FROM p JOIN e ON e.paper_id = p.paper_id AND e.source = p.label WHERE l < 30) "
    "SELECT paper_id, label, CASE WHEN max(l) < 30 THEN max(l)::INTEGER END AS level FROM p GROUP BY ALL",
)
add("j14_has_cycle", lambda t: gr.has_cycle(hierarchy(t)[1]), f"WITH {REL_SQL}, c AS (SELECT DISTINCT o_custkey AS p FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 11 > 0) SELECT DISTINCT paper_id, paper_id IN (SELECT p FROM c) AS has_cycle FROM rel")
add("j15_graph_to_text", lambda t: gr.graph_to_text(*hierarchy(t)))
add("j16_fluent_text", lambda t: gr.fluent_text(*hierarchy(t)))
_ctx = lambda t: t.documents.select(F.floor(C("doc_id") / 20).alias("paper_id"), C("doc_id").cast("string").alias("related_id"), F.col("source").alias("title"), C("text").alias("summary"), C("n_chars").cast("double").alias("score"), F.when(C("doc_id") % 2 == 0, "citation").otherwise("semantic").alias("source"), F.when(C("doc_id") % 3 == 0, "positive").otherwise("negative").alias("polarity"))
_slices = [(s, p) for s in ("citation", "semantic") for p in ("positive", "negative")]
add("j17_related_context", lambda t: gr.related_context(_ctx(t), "paper_id"), "SELECT doc_id // 20 AS paper_id, " + ", ".join(f"coalesce(string_agg('Title: ' || source || chr(10) || 'Summary: ' || text || chr(10), chr(10) || chr(10) ORDER BY n_chars DESC, doc_id::VARCHAR) FILTER (doc_id % 2 {'=' if s == 'citation' else '<>'} 0 AND doc_id % 3 {'=' if p == 'positive' else '<>'} 0), '[No related papers available]') AS {s}_{p}" for s, p in _slices) + " FROM documents GROUP BY 1")


def _nested(t):
    """One nested response a customer, from its orders."""
    o = t.orders.groupBy(C("o_custkey").alias("paper_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    name = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    return o.select(
        "paper_id", F.lit("Same").alias("title"), F.lit("Area").alias("primary_area"), F.array(F.lit("Same")).alias("keywords"), F.lit("Sum").alias("tldr"),
        F.transform("k", lambda k, i: F.struct(name("C", k).alias("text"), F.lit("d").alias("detail"), F.array(i, i + 1).alias("method_indices"))).alias("claims"),
        F.transform("k", lambda k, i: F.struct(name("M", k).alias("text"), F.lit("d").alias("detail"), F.array(F.lit(-1)).alias("experiment_indices"))).alias("methods"),
        F.transform("k", lambda k: F.struct(name("E", k).alias("text"), F.lit("d").alias("detail"))).alias("experiments"),
    )


add("j18_graph_entities", lambda t: gr.graph_tables(_nested(t))[0].select("paper_id", "label", "type"), "WITH p AS (SELECT DISTINCT o_custkey AS paper_id FROM orders) SELECT paper_id, x.label, x.type FROM p, (VALUES ('Same', 'title'), ('Area', 'primary_area'), ('Same [keyword]', 'keyword'), ('Sum', 'tldr')) x(label, type) UNION ALL SELECT o_custkey, k || o_orderkey, y.type FROM orders, (VALUES ('C', 'claim'), ('M', 'method'), ('E', 'experiment')) y(k, type)")
add("j18_graph_relationships", lambda t: gr.graph_tables(_nested(t))[1].select("paper_id", "source", "target"), "WITH p AS (SELECT DISTINCT o_custkey AS paper_id FROM orders), o AS (SELECT o_custkey AS paper_id, o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx, max(o_orderkey) OVER (PARTITION BY o_custkey) AS mx FROM orders) SELECT paper_id, x.s AS source, x.t AS target FROM p, (VALUES ('Same', 'Area'), ('Same', 'Same [keyword]'), ('Same', 'Sum')) x(s, t) UNION ALL SELECT paper_id, 'Sum', 'C' || k FROM o UNION ALL SELECT paper_id, 'C' || k, 'M' || k FROM o UNION ALL SELECT paper_id, 'C' || k, 'M' || nx FROM o WHERE nx IS NOT NULL UNION ALL SELECT paper_id, 'M' || k, 'E' || mx FROM o")
