"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import metrics as me
from paperloom.plans.base import add

C = F.col
PRED = lambda t: t.lineitem.select((C("l_orderkey") % 20).alias("g"), (C("l_quantity") % 5 + 1).cast("int").alias("y_true"), ((C("l_quantity") + C("l_linenumber") % 3) % 5 + 1).cast("int").alias("y_pred"), C("l_discount").alias("confidence"))
P = "p AS (SELECT l_orderkey % 20 AS g, (l_quantity % 5 + 1)::INTEGER AS y_true, ((l_quantity + l_linenumber % 3) % 5 + 1)::INTEGER AS y_pred, l_discount AS confidence FROM lineitem)"
BIN = lambda t: PRED(t).select("g", (C("y_true") >= 3).cast("int").alias("y_true"), (C("y_pred") >= 3).cast("int").alias("y_pred"))
B = f"{P}, b AS (SELECT g, (y_true >= 3)::INTEGER AS y_true, (y_pred >= 3)::INTEGER AS y_pred FROM p)"
one = lambda name, col, sql: add(name, lambda t: PRED(t).groupBy("g").agg(*[F.round(c, 6).alias(n) for n, c in col().items()]), f"WITH {P} SELECT g, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in sql.items()) + " FROM p GROUP BY g")
t_, p_ = (lambda: C("y_true")), (lambda: C("y_pred"))

add("e1_confusion", lambda t: me.confusion(PRED(t), [1, 2, 3, 4, 5]), f"WITH {P} SELECT a::INTEGER AS y_true, b::INTEGER AS y_pred, count(p.g) AS n FROM range(1, 6) x(a) CROSS JOIN range(1, 6) y(b) LEFT JOIN p ON y_true = a AND y_pred = b GROUP BY a, b")
one("e2_accuracy", lambda: {"v": me.accuracy(t_(), p_())}, {"v": "avg((y_true = y_pred)::INT)"})
one("e3_accuracy_within", lambda: {"v": me.accuracy_within(t_(), p_(), 1)}, {"v": "avg((abs(y_true - y_pred) <= 1)::INT)"})
one("e4_errors", lambda: {"mae": me.mae(t_(), p_()), "mse": me.mse(t_(), p_()), "rmse": F.sqrt(me.mse(t_(), p_()))}, {"mae": "avg(abs(y_true - y_pred))", "mse": "avg((y_true - y_pred) ** 2)", "rmse": "sqrt(avg((y_true - y_pred) ** 2))"})
one("e5_pearson", lambda: {"v": me.correlation(t_().cast("double"), p_().cast("double")), "none": me.correlation(t_().cast("double"), F.lit(1.0))}, {"v": "corr(y_true, y_pred)", "none": "NULL::DOUBLE"})
RANKS = "r AS (SELECT g, y_true, y_pred, rank() OVER (PARTITION BY g ORDER BY y_true) + (count(*) OVER (PARTITION BY g, y_true) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y_pred) + (count(*) OVER (PARTITION BY g, y_pred) - 1) / 2.0 AS ry FROM p)"
add("e6_spearman", lambda t: me.spearman(PRED(t), "y_true", "y_pred", ["g"]).select("g", F.round("spearman", 6).alias("v")), f"WITH {P}, {RANKS} SELECT g, round(corr(rx, ry), 6) AS v FROM r GROUP BY g")
_cls = "c AS (SELECT g, l AS label, count(*) FILTER (y_true = l AND y_pred = l) AS tp, count(*) FILTER (y_true <> l AND y_pred = l) AS fp, count(*) FILTER (y_true = l AND y_pred <> l) AS fn FROM p, range(1, 6) q(l) GROUP BY g, l HAVING count(*) FILTER (y_true = l OR y_pred = l) > 0)"
_pr = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END", "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END", "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END"
_rounded = lambda d, keys: d.select(*keys, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
add("e7_prf_macro", lambda t: _rounded(me.precision_recall_f1(PRED(t), "macro", ["g"]), ["g"]), f"WITH {P}, {_cls} SELECT g, round(avg({_pr[0]}), 6) AS precision, round(avg({_pr[1]}), 6) AS recall, round(avg({_pr[2]}), 6) AS f1 FROM c GROUP BY g")
add("e7_prf_micro", lambda t: _rounded(me.precision_recall_f1(PRED(t), "micro", ["g"]), ["g"]), f"WITH {P} SELECT g, round(avg((y_true = y_pred)::INT), 6) AS precision, round(avg((y_true = y_pred)::INT), 6) AS recall, round(avg((y_true = y_pred)::INT), 6) AS f1 FROM p GROUP BY g")
add("e7_prf_binary", lambda t: _rounded(me.precision_recall_f1(BIN(t), "binary", ["g"]), ["g"]), f"WITH {B}, c AS (SELECT g, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM b GROUP BY g) SELECT g, round({_pr[0]}, 6) AS precision, round({_pr[1]}, 6) AS recall, round({_pr[2]}, 6) AS f1 FROM c")
ALL = f"{P}, {RANKS}, {_cls}, m AS (SELECT g, avg({_pr[0]}) AS precision, avg({_pr[1]}) AS recall, avg({_pr[2]}) AS f1 FROM c GROUP BY g), s AS (SELECT g, corr(rx, ry) AS spearman FROM r GROUP BY g), a AS (SELECT g, count(*) AS n, avg((y_true = y_pred)::INT) AS accuracy, avg((abs(y_true - y_pred) <= 1)::INT) AS accuracy_1, avg(abs(y_true - y_pred)) AS mae, avg((y_true - y_pred) ** 2) AS mse, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, corr(y_true, y_pred) AS pearson, avg(confidence) AS confidence FROM p GROUP BY g)"
_names = ("accuracy", "accuracy_1", "mae", "mse", "rmse", "pearson", "spearman", "precision", "recall", "f1")
add("e8_metrics", lambda t: me.metrics(PRED(t), ["g"], confidence="confidence"), f"WITH {ALL} SELECT g, n, {', '.join(f'round({c}, 6) AS {c}' for c in (*_names, 'confidence'))} FROM a JOIN m USING (g) JOIN s USING (g)")
add("e9_macro_from_confusion", lambda t: me.macro_from_confusion(PRED(t).groupBy("g", "y_true", "y_pred").agg(F.count("*").alias("n")), ["g"]), f"WITH {P}, {_cls}, d AS (SELECT g, avg((y_true = y_pred)::INT) AS accuracy FROM p GROUP BY g) SELECT g, round(avg({_pr[0]}), 6) AS precision, round(avg({_pr[1]}), 6) AS recall, round(avg({_pr[2]}), 6) AS f1, round(any_value(accuracy), 6) AS accuracy FROM c JOIN d USING (g) GROUP BY g")
add("e10_binary_report", lambda t: me.binary_report(BIN(t), ["g"]), f"WITH {B}, c AS (SELECT g, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM b GROUP BY g), q AS (SELECT *, tp / nullif(tp + fp, 0) AS pp, tp / nullif(tp + fn, 0) AS pr, tn / nullif(tn + fn, 0) AS np, tn / nullif(tn + fp, 0) AS nr FROM c), f AS (SELECT *, 2 * pp * pr / nullif(pp + pr, 0) AS pf, 2 * np * nr / nullif(np + nr, 0) AS nf FROM q) SELECT g, tp, fp, tn, fn, round(pp, 6) AS pos_precision, round(pr, 6) AS pos_recall, round(np, 6) AS neg_precision, round(nr, 6) AS neg_recall, round(pf, 6) AS pos_f1, round(nf, 6) AS neg_f1, round((pp + np) / 2, 6) AS macro_precision, round((pr + nr) / 2, 6) AS macro_recall, round((pf + nf) / 2, 6) AS macro_f1 FROM f")
add("e11_review_metrics", lambda t: me.review_metrics(PRED(t).groupBy("g").agg(F.collect_list(F.struct(C("y_true").alias("rating"), F.when(C("y_true") + C("y_pred") < 9, C("y_pred")).alias("prediction"))).alias("reviews")), "reviews", ["g"]), f"WITH {ALL.replace('FROM lineitem)', 'FROM lineitem WHERE (l_quantity % 5 + 1)::INTEGER + ((l_quantity + l_linenumber % 3) % 5 + 1)::INTEGER < 9)')} SELECT g, n, {', '.join(f'round({c}, 6) AS {c}' for c in _names)}, 1.0::DOUBLE AS confidence FROM a JOIN m USING (g) JOIN s USING (g)")
_un = lambda key, cols, extra="": f"u AS (" + " UNION ALL ".join(f"SELECT {key}, '{n}' AS metric, ({e})::DOUBLE AS value FROM lineitem {extra}" for n, e in cols.items()) + ")"  # noqa: E731, F541
add("e12_judge_aggregate", lambda t: me.judge_aggregate(t.lineitem.select("l_returnflag", C("l_quantity").alias("clarity"), C("l_tax").alias("depth")), "l_returnflag", ["clarity", "depth"]), f"WITH {_un('l_returnflag', {'clarity': 'l_quantity', 'depth': 'l_tax'})} SELECT l_returnflag, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev FROM u GROUP BY ALL")
add("e13_run_aggregate", lambda t: me.run_aggregate(t.lineitem.select((C("l_linestatus") == "F").alias("ok"), C("l_quantity").alias("f1"), F.when(C("l_tax") > 0.02, C("l_tax")).alias("mae"), "l_extendedprice"), ["f1", "mae"], "ok", "l_extendedprice"), f"WITH {_un('l_linestatus', {'f1': 'l_quantity', 'mae': 'CASE WHEN l_tax > 0.02 THEN l_tax END'}, chr(39).join(['WHERE l_linestatus = ', 'F', '']))} SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS stdev, min(value) AS min, max(value) AS max, (SELECT round(sum(l_extendedprice), 4) FROM lineitem) AS total_cost FROM u GROUP BY metric")
add("e14_experiment_rollup", lambda t: me.experiment_rollup(t.events, "2024-01-05", "2024-01-20", "ts", "event_type", "value"), "WITH d AS (SELECT ts::DATE AS day, event_type, value FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') SELECT 'day' AS \"by\", strftime(day, '%Y-%m-%d') AS value, count(*) AS n, round(sum(value), 4) AS cost FROM d GROUP BY ROLLUP (day) UNION ALL SELECT 'type', event_type, count(*), round(sum(value), 4) FROM d GROUP BY ROLLUP (event_type)")
add("e15_experiment_table", lambda t: me.experiment_table(t.part.select("p_partkey", "p_name", "p_retailprice"), "p_name", "ring", "p_retailprice"), "SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(p_name, 'ring')")
add("e16_unlogged_runs", lambda t: me.unlogged_runs(t.orders.select(F.concat(F.when(C("o_orderkey") % 2 > 0, F.lit("ablation_")).otherwise(F.lit("")), F.lit("r"), C("o_orderkey").cast("string"), F.lit("_graph")).alias("run"), C("o_orderstatus").alias("dataset")), "run", "dataset", t.lineitem.select(F.concat(F.lit("r"), C("l_orderkey").cast("string"), F.when(C("l_linenumber") > 3, F.lit("_F")).otherwise(F.lit(""))).alias("name")), "name"),
    "SELECT CASE WHEN o_orderkey % 2 > 0 THEN 'ablation_' ELSE '' END || 'r' || o_orderkey || '_graph' AS run, o_orderstatus AS dataset FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_linenumber <= 3 OR o_orderstatus = 'F'))")
_sent = lambda t: t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "sentence")).withColumn("gold", F.when(C("i") % 2 == 0, "background").otherwise("target"))
_blocks = lambda t: t.documents.select("doc_id", F.array_join(F.filter(F.split("text", "\n"), lambda x, i: i % 3 != 1), " ").alias("background"), F.array_join(F.filter(F.split("text", "\n"), lambda x, i: i % 3 == 1), " ").alias("target"))
_labels_sql = "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), b AS (SELECT doc_id, a, lower(array_to_string(list_filter(a, lambda x, i: (i - 1) % 3 <> 1), ' ')) AS bg, lower(array_to_string(list_filter(a, lambda x, i: (i - 1) % 3 = 1), ' ')) AS tg FROM d), s AS (SELECT DISTINCT doc_id, bg, tg, s, CASE WHEN i % 2 = 0 THEN 'background' ELSE 'target' END AS y_true FROM (SELECT doc_id, bg, tg, unnest(a) AS s, unnest(range(0, len(a))) AS i FROM b)), p AS (SELECT y_true, contains(bg, lower(s)) AS ib, contains(tg, lower(s)) AS it FROM s), l AS (SELECT y_true, CASE WHEN ib AND NOT it THEN 'background' WHEN it AND NOT ib THEN 'target' ELSE y_true END AS y_pred FROM p)"
_count = lambda t, p: f"count(*) FILTER (y_true = '{t}' AND y_pred = '{p}')"
_zero = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"
_f1 = lambda k: _zero(f"2 * tp_{k}", f"2 * tp_{k} + fp_{k} + fn_{k}")
_report = {
    **{f"{m}_{k}": e for k in ("bg", "tgt") for m, e in (("precision", _zero(f"tp_{k}", f"tp_{k} + fp_{k}")), ("recall", _zero(f"tp_{k}", f"tp_{k} + fn_{k}")), ("f1", _f1(k)))},
    "macro_f1": f"({_f1('bg')} + {_f1('tgt')}) / 2",
    "micro_f1": _zero("2 * (tp_bg + tp_tgt)", "2 * (tp_bg + tp_tgt) + fp_bg + fp_tgt + fn_bg + fn_tgt"),
    "accuracy": _zero("tp_bg + tp_tgt", "n"),
}
_sides = {"bg": ("background", "target"), "tgt": ("target", "background")}
_c = ", ".join(f"{_count(*x)} AS {n}_{k}" for k, (a, b) in _sides.items() for n, x in (("tp", (a, a)), ("fp", (b, a)), ("fn", (a, b))))
add(
    "e17_sentence_agreement",
    lambda t: me.sentence_agreement(_sent(t), _blocks(t), "doc_id"),
    f"{_labels_sql}, c AS (SELECT count(*) AS n, {_c} FROM l) SELECT *, {', '.join(f'round({e}, 6)::DOUBLE AS {n}' for n, e in _report.items())} FROM c",
)
add("e17_sentence_labels", lambda t: me.sentence_labels(_sent(t), _blocks(t), "doc_id").groupBy("y_true", "y_pred").agg(F.count("*").alias("n")), f"{_labels_sql} SELECT y_true, y_pred, count(*) AS n FROM l GROUP BY ALL")
add(
    "e13_run_values",
    lambda t: me.run_values(t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("run"), (C("l_linestatus") == "F").alias("ok"), C("l_quantity").alias("f1"), F.when(C("l_tax") > 0.02, C("l_tax")).alias("mae")), "run", ["f1", "mae"], "ok"),
    "SELECT l_orderkey || '-' || l_linenumber AS run, 'f1' AS metric, l_quantity::DOUBLE AS value FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'mae', l_tax::DOUBLE FROM lineitem WHERE l_linestatus = 'F' AND l_tax > 0.02",
)
_w = lambda c: rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_ref = "concat_ws(' ', source, text)"
_rouge_sql = lambda n: f"WITH w AS (SELECT doc_id, {_w('text')} AS p, {_w(_ref)} AS r FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(p) - {n - 2}), lambda i: array_to_string(p[i:i+{n - 1}], ' ')) AS p, list_transform(range(1, len(r) - {n - 2}), lambda i: array_to_string(r[i:i+{n - 1}], ' ')) AS r FROM w), a AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(p) AS g FROM g) GROUP BY ALL), b AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(r) AS g FROM g) GROUP BY ALL), o AS (SELECT a.doc_id, sum(least(a.c, b.c)) AS o FROM a JOIN b USING (doc_id, g) GROUP BY 1) SELECT doc_id, round(CASE WHEN len(p) + len(r) = 0 THEN 0 ELSE 2 * coalesce(o, 0) / (len(p) + len(r)) END, 6)::DOUBLE AS f1 FROM g LEFT JOIN o USING (doc_id)"
_rouge_in = lambda t: t.documents.select("doc_id", "text", F.concat_ws(" ", "source", "text").alias("ref"))
for _n in (1, 2):
    add(f"e18_rouge_{_n}", lambda t, n=_n: me.rouge_n(_rouge_in(t), "doc_id", "text", "ref", n).select("doc_id", F.round("f1", 6).alias("f1")), _rouge_sql(_n))
# the text is a subsequence of the reference, which has the words of the source in front
add(
    "e18_rouge_l",
    lambda t: me.rouge_l(_rouge_in(t), "doc_id", "text", "ref").select("doc_id", F.round("f1", 6).alias("f1")),
    f"WITH w AS (SELECT doc_id, len({_w('text')}) AS n, len({_w(_ref)}) AS m FROM documents) SELECT doc_id, round(2 * n / (n + m), 6)::DOUBLE AS f1 FROM w",
)
