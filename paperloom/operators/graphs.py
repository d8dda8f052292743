"""Hierarchical claim graphs as two tables.

``entities(paper_id, ord, label, type, detail)`` and ``relationships(paper_id, ord, source, target)``. All graphs are
handled together.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.workspace import cut, new_path, written

#: Node types, the chain of levels, and the types that stand alone, below the title, and without children.
TYPES = ["title", "primary_area", "keyword", "tldr", "claim", "method", "experiment"]
CHAIN = ["tldr", "claim", "method", "experiment"]
SINGLE = ["title", "primary_area", "tldr"]
SECOND = ["tldr", "primary_area", "keyword"]
LEAVES = ["primary_area", "keyword", "experiment"]


#: Rows of a graph that a task peels by itself.
GRAPH = 100_000
#: The messages of the rules.
MESSAGES = {
    "empty": "Empty graph",
    "valid": "Valid",
    "twice": "Entities with non-unique names: {names}",
    "source": "Found edge with unknown source node: '{label}'",
    "target": "Found edge with unknown target node: '{label}'",
    "single": "Found {n} '{type}' nodes. Should be exactly 1.",
    "title_in": "Title node should not have any incoming edges.",
    "second_in": "Found {n} incoming edges to node type '{type}'. Should be exactly 1. Node: '{label}'",
    "second_from": "Incoming edge to '{type}' is not Title, but '{other}'.",
    "leaf_out": "Found {n} outgoing edges from node type '{type}'. Should be 0.",
    "illegal_out": "Found illegal outgoing edge from '{type}' to '{other}'",
    "illegal_in": "Found illegal incoming edge from '{other}' to '{type}'",
    "no_in": "Node type '{type}' has no incoming edges from '{other}'. Should be at least 1.",
    "no_out": "Node type '{type}' has no outgoing edges to '{other}'. Should be at least 1.",
    "cycle": "Graph has cycles",
}


def say(message: str, **values: Column) -> Column:
    """A message of the table with its places filled."""
    return tx.render_template(MESSAGES[message], values)


def _typed(ent: DataFrame, rel: DataFrame) -> DataFrame:
    """Edges with the types of both ends (null for unknown ends). Of equal labels the last entity counts.

    ``source_n`` and ``target_n`` are the numbers of entities of each type of the chain that carry the label.
    """
    n = F.struct(*[F.count_if(F.col("type") == t).alias(t) for t in CHAIN])
    last = ent.groupBy("paper_id", "label").agg(F.max_by("type", "ord").alias("type"), n.alias("n"))
    for end in ("source", "target"):
        rel = rel.join(last.select("paper_id", F.col("label").alias(end), F.col("type").alias(f"{end}_type"), F.col("n").alias(f"{end}_n")), ["paper_id", end], "left")
    return rel


def validate_graphs(ent: DataFrame, rel: DataFrame, papers: DataFrame, cycles: bool = True) -> DataFrame:
    """(paper_id, rule, message): one row a violation; "Empty graph" or "Valid" for the others. Rules 0 to 8.

    The typed edges and the violations are written once; edges, nodes and papers are each read once for all their rules.
    """
    e = written(_typed(ent, rel), "graph-edges")
    unknown_s, unknown_t = F.col("source_type").isNull(), F.col("target_type").isNull()
    known = e.where(~unknown_s & ~unknown_t)
    none = F.array().cast("array<struct<rule:int,message:string>>")
    times = lambda n, rule, text: F.array_repeat(F.struct(F.lit(rule).alias("rule"), text.alias("message")), n.cast("int"))
    rule = lambda when, rule, text: F.when(when, times(F.lit(1), rule, text)).otherwise(none)
    told = lambda df, rules: df.select("paper_id", F.explode(F.concat(*rules)).alias("x")).select("paper_id", "x.rule", "x.message")
    pair = list(zip(CHAIN[:-1], CHAIN[1:], strict=True))

    twice = ent.groupBy("paper_id", "label").agg(F.count("*").alias("n"), F.min("ord").alias("o")).where("n > 1")
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "o", "label", "n"))), lambda x: F.concat(x["label"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    twice = twice.groupBy("paper_id").agg(say("twice", names=F.array_join(names, ", ")).alias("message")).select("paper_id", F.lit(0).alias("rule"), "message")

    rules = [rule(unknown_s, 0, say("source", label=F.col("source"))), rule(unknown_t, 0, say("target", label=F.col("target")))]
    for x, y in pair:  # an edge is judged once for each entity that carries its label
        rules.append(F.when(~unknown_s & (F.col("target_type") != y), times(F.col("source_n")[x], 5, say("illegal_out", type=F.lit(x), other=F.col("target_type")))).otherwise(none))
        rules.append(F.when(~unknown_t & (F.col("source_type") != x), times(F.col("target_n")[y], 5, say("illegal_in", other=F.col("source_type"), type=F.lit(y)))).otherwise(none))
    of_edges = told(e, rules)

    per = ent.groupBy("paper_id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in SINGLE])
    filled = papers.select("paper_id").distinct().join(per, "paper_id")
    of_papers = told(filled, [rule(F.col(t) != 1, 1, say("single", n=F.col(t), type=F.lit(t))) for t in SINGLE])

    among = lambda c: F.collect_set(F.when(F.col(c).isin(CHAIN), F.col(c)))
    incoming = known.groupBy("paper_id", F.col("target").alias("label")).agg(F.count("*").alias("n_in"), F.min_by("source_type", "ord").alias("first_in"), among("source_type").alias("above"))
    outgoing = known.groupBy("paper_id", F.col("source").alias("label")).agg(F.count("*").alias("n_out"), among("target_type").alias("below"))
    nodes = ent.join(incoming, ["paper_id", "label"], "left").join(outgoing, ["paper_id", "label"], "left")
    nodes = nodes.withColumns({"n_in": F.coalesce("n_in", F.lit(0)), "n_out": F.coalesce("n_out", F.lit(0))})
    kind = F.col("type")
    rules = [
        rule((kind == "title") & (F.col("n_in") > 0), 2, say("title_in")),
        rule(kind.isin(SECOND) & (F.col("n_in") != 1), 3, say("second_in", n=F.col("n_in"), type=kind, label=F.col("label"))),
        rule(kind.isin(SECOND) & (F.col("n_in") > 0) & (F.col("first_in") != "title"), 3, say("second_from", type=kind, other=F.col("first_in"))),
        rule(kind.isin(LEAVES) & (F.col("n_out") > 0), 4, say("leaf_out", n=F.col("n_out"), type=kind)),
    ]
    for x, y in pair:
        rules.append(rule((kind == y) & ~F.coalesce(F.array_contains("above", x), F.lit(False)), 6, say("no_in", type=F.lit(y), other=F.lit(x))))
        rules.append(rule((kind == x) & ~F.coalesce(F.array_contains("below", y), F.lit(False)), 7, say("no_out", type=F.lit(x), other=F.lit(y))))
    one_title = filled.where("title = 1").select("paper_id", F.lit(True).alias("one"))
    of_nodes = told(nodes, rules).join(one_title, "paper_id", "left").where((F.col("rule") != 2) | F.col("one")).drop("one")

    errors = twice.unionByName(of_edges).unionByName(of_papers).unionByName(of_nodes)
    if cycles:
        circular = topological_levels(rel).where("level is null").select("paper_id").distinct().join(filled, "paper_id", "left_semi")
        errors = errors.unionByName(circular.select("paper_id", F.lit(8).alias("rule"), say("cycle").alias("message")))
    errors = written(errors, "graph-errors")
    wrong = errors.select("paper_id").distinct().withColumn("wrong", F.lit(True))
    state = papers.select("paper_id").distinct().join(per.select("paper_id", F.lit(True).alias("filled")), "paper_id", "left").join(wrong, "paper_id", "left")
    fine = state.where("filled is null or wrong is null").select("paper_id", F.lit(-1).alias("rule"), F.when(F.col("filled").isNull(), say("empty")).otherwise(say("valid")).alias("message"))
    return errors.unionByName(fine)


def topological_levels(rel: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(paper_id, label, level): rounds of peeling nodes without remaining incoming edges; null for nodes on or behind cycles.

    Graphs of at most ``GRAPH`` rows are dealt by paper once and peeled inside the tasks, many at a time. Larger ones are
    peeled together by rounds of joins.
    """
    # an end without a label is no node; a row without target is a node alone
    e = rel.select("paper_id", F.coalesce("source", "target").alias("source"), F.when(F.col("source").isNotNull(), F.col("target")).alias("target"))
    if nodes is not None:
        e = e.unionByName(nodes.select("paper_id", F.col("label").alias("source"), F.lit(None).cast("string").alias("target")))
    e = e.where("source is not null")
    large = cut(e.groupBy("paper_id").agg(F.count("*").alias("n")).where(F.col("n") > GRAPH).select("paper_id"))
    if large.isEmpty():
        return _peeled(e)
    by_rounds = _levels_by_rounds(e.join(large, "paper_id", "left_semi"))
    return _peeled(e.join(large, "paper_id", "left_anti")).unionByName(by_rounds)


def _peeled(e: DataFrame) -> DataFrame:
    """Levels of graphs that fit into a task; tasks hold the rows of some papers at a time."""

    def levels(t: pa.Table) -> pa.RecordBatch:
        paper = t["paper_id"].combine_chunks().dictionary_encode("encode")
        label = pa.concat_arrays([*t["source"].chunks, *t["target"].chunks]).dictionary_encode()
        own = paper.indices.to_numpy().astype(np.int64)
        code = label.indices.fill_null(-1).to_numpy().astype(np.int64).reshape(2, -1)
        width = len(label.dictionary)
        edge = code[1] >= 0
        key, at = np.unique(np.concatenate([own * width + code[0], (own * width + code[1])[edge]]), return_inverse=True)
        source, target = at[: len(own)][edge], at[len(own) :]
        order = np.argsort(source, kind="stable")
        target, first, out = target[order], np.searchsorted(source[order], np.arange(len(key))), np.bincount(source, minlength=len(key))
        into, level = np.bincount(target, minlength=len(key)), np.full(len(key), -1, np.int32)
        free = np.flatnonzero(into == 0)
        for n in itertools.count():
            if not len(free):
                break
            level[free] = n
            times = out[free]
            reached, gone = np.unique(target[np.repeat(first[free] - np.cumsum(times) + times, times) + np.arange(times.sum())], return_counts=True)
            into[reached] -= gone
            free = reached[into[reached] == 0]
        columns = [paper.dictionary.take(pa.array(key // width)), label.dictionary.take(pa.array(key % width)), pa.array(level, mask=level < 0)]
        return pa.RecordBatch.from_arrays(columns, ["paper_id", "label", "level"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < GRAPH:
                continue
            t = pa.Table.from_batches(held)
            paper = t["paper_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            whole = int(np.searchsorted(paper, paper[-1]))  # the last paper may go on
            if whole:
                yield levels(t.slice(0, whole))
            held = t.slice(whole).to_batches()
        if held:
            yield levels(pa.Table.from_batches(held))

    # by number: Spark drops a repartition by columns above a join on them, and may then turn the join into a broadcast
    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = e.repartitionById(n, F.pmod(F.xxhash64("paper_id"), F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("paper_id").mapInArrow(run, f"paper_id {dict(e.dtypes)['paper_id']}, label string, level int")


def _levels_by_rounds(e: DataFrame) -> DataFrame:
    """Levels of graphs of any size.

    Each round is a few joins over the remaining edges with a checkpoint, and adds its nodes to one table; the driver sees
    whether there were any. There are as many rounds as the deepest graph has levels.
    """
    spark, ends = e.sparkSession, e.select("paper_id", F.col("source").alias("label")).unionByName(e.where("target is not null").select("paper_id", F.col("target").alias("label")))
    e = cut(e.where("target is not null").distinct())
    left = cut(ends.distinct())
    path = new_path(spark, "graph-levels")
    for level in itertools.count():
        targets = e.select("paper_id", F.col("target").alias("label"))
        free = cut(left.join(targets, ["paper_id", "label"], "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        free.write.mode("append").parquet(path)
        gone = free.select("paper_id", "label")
        left = cut(left.join(gone, ["paper_id", "label"], "left_anti"))
        e = cut(e.join(gone.withColumnRenamed("label", "source"), ["paper_id", "source"], "left_anti"))
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return spark.read.schema(free.schema).parquet(path).unionByName(rest) if level else rest


def has_cycle(rel: DataFrame) -> DataFrame:
    return topological_levels(rel).groupBy("paper_id").agg(F.max(F.col("level").isNull()).alias("has_cycle"))


def graph_to_text(ent: DataFrame, rel: DataFrame) -> DataFrame:
    """(paper_id, text): entities by level and order, ``type: label`` and detail below; a trailing ``[..]`` goes."""
    lv = topological_levels(rel, ent)
    j = ent.join(lv, ["paper_id", "label"], "left")
    label = F.regexp_replace("label", r"\s*\[[^\]]*\]$", "")
    line = F.concat("type", F.lit(": "), label, F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit("\n "), "detail")).otherwise(F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(2**30)).alias("l"), "ord", line.alias("t"))))
    return j.groupBy("paper_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("text"))


def _sentence(label: Column, detail: Column) -> Column:
    s = F.concat(F.regexp_replace(label, "[.:,?!]+$", ""), F.lit(": "), detail)
    s = F.when(s.rlike(r"[.!?;]$"), s).otherwise(F.concat(s, F.lit(".")))
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))


def fluent_text(ent: DataFrame, rel: DataFrame) -> DataFrame:
    """(paper_id, text): title and area, then numbered claims with their methods and experiments.

    Claims without children and methods without children are left out; children count in the order of the edges.
    """
    one = lambda t: ent.where(F.col("type") == t).groupBy("paper_id").agg(F.min_by("label", "ord").alias(t))
    head = one("title").join(one("primary_area"), "paper_id")
    node = ent.groupBy("paper_id", "label").agg(F.max_by("type", "ord").alias("type"), F.max_by("detail", "ord").alias("detail"))
    child = rel.select("paper_id", "source", F.col("target").alias("label"), F.row_number().over(Window.partitionBy("paper_id", "source").orderBy("ord")).alias("nr"))
    sen = _sentence(F.col("label"), F.col("detail"))
    joined = lambda nr, t, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(nr, t.alias("t")))), lambda x: x["t"]), sep)
    exps = child.join(node.where("type = 'experiment'"), ["paper_id", "label"]).withColumn("nr", F.row_number().over(Window.partitionBy("paper_id", "source").orderBy("nr")))
    exps = exps.groupBy("paper_id", "source").agg(F.sort_array(F.collect_list(F.struct("nr", sen.alias("t")))).alias("exps")).withColumnRenamed("source", "label")
    parents = rel.select("paper_id", F.col("source").alias("label")).distinct()
    claims = ent.where("type = 'claim'").withColumn("c", F.row_number().over(Window.partitionBy("paper_id").orderBy("ord"))).join(parents, ["paper_id", "label"], "left_semi")
    claims = claims.select("paper_id", "c", F.col("label").alias("claim"), F.col("detail").alias("claim_detail"))
    m = child.join(node.where("type = 'method'"), ["paper_id", "label"]).join(parents, ["paper_id", "label"], "left_semi").join(exps, ["paper_id", "label"], "left")
    m = m.select("paper_id", F.col("source").alias("claim"), "nr", "label", "detail", "exps").join(claims.select("paper_id", "claim", "c"), ["paper_id", "claim"])
    line = lambda x: F.concat(F.lit("    "), F.col("c").cast("string"), F.lit("."), F.col("nr").cast("string"), F.lit("."), x["nr"].cast("string"), F.lit(". "), x["t"])
    bullets = F.coalesce(F.array_join(F.transform("exps", line), "\n"), F.lit(""))
    m = m.withColumn("t", F.concat(sen, F.lit(" This method is validated by these experiments:\n"), bullets)).withColumn("k", F.row_number().over(Window.partitionBy("paper_id", "claim", "c").orderBy("nr")))
    m = m.withColumn("t", F.concat(F.lit("  "), F.col("c").cast("string"), F.lit("."), F.col("k").cast("string"), F.lit(". "), "t"))
    m = m.groupBy("paper_id", "claim", "c").agg(joined("k", F.col("t"), "\n").alias("methods"))
    cl = claims.join(m, ["paper_id", "claim", "c"], "left").withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("c")))
    cl = cl.withColumn("t", F.concat(F.col("n").cast("string"), F.lit(". "), _sentence(F.col("claim"), F.col("claim_detail")), F.lit(" This is done with:\n"), F.coalesce("methods", F.lit(""))))
    cl = cl.groupBy("paper_id").agg(joined("n", F.col("t"), "\n\n").alias("claims"))
    out = head.join(cl, "paper_id", "left")
    first = F.concat(F.lit("This paper is titled '"), "title", F.lit("'. It's about "), tx.remove_parenthetical(F.col("primary_area")), F.lit(". The key contributions are:"))
    return out.select("paper_id", tx.fix_spaces_before_punctuation(F.concat_ws("\n\n", first, "claims")).alias("text"))


def concise_edges(ent: DataFrame, rel: DataFrame, keep: list[str]) -> DataFrame:
    """(paper_id, source, target): edges between kept types; the title takes over the kept children of its removed ones.

    If nothing hangs on the title then, it gets all claims.
    """
    e = _typed(ent, rel).where("source_type is not null and target_type is not null")
    kept = e.where(F.col("source_type").isin(keep) & F.col("target_type").isin(keep)).select("paper_id", "source", "target")
    through = e.where((F.col("source_type") == "title") & ~F.col("target_type").isin(keep)).select("paper_id", F.col("source").alias("top"), F.col("target").alias("source"))
    bridged = through.join(e.where(F.col("target_type").isin(keep)).select("paper_id", "source", "target"), ["paper_id", "source"]).select("paper_id", F.col("top").alias("source"), "target")
    out = kept.unionByName(bridged).distinct()
    titles = ent.where("type = 'title'").select("paper_id", F.col("label").alias("source")).distinct()
    bare = titles.join(out.select("paper_id", "source").distinct(), ["paper_id", "source"], "left_anti")
    claims = ent.where("type = 'claim'").select("paper_id", F.col("label").alias("target")).distinct()
    return out.unionByName(bare.join(claims, "paper_id").select("paper_id", "source", "target"))


def graph_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested responses to (entities, relationships).

    ``(paper_id, title, primary_area, keywords array, tldr, claims array<struct<text, detail, method_indices>>,
    methods array<struct<text, detail, experiment_indices>>, experiments array<struct<text, detail>>)``. A label that
    occurs before gets its type in brackets; edges name the last label given to (text, type); indices outside their list
    are dropped, negative ones count from the end.
    """
    kind = "array<struct<type:string,label:string,detail:string>>"
    plain = lambda t, c: F.transform(c, lambda x: F.struct(F.lit(t).alias("type"), x.alias("label"), F.lit(None).cast("string").alias("detail")))
    rich = lambda t, c: F.transform(c, lambda x: F.struct(F.lit(t).alias("type"), x["text"].alias("label"), x["detail"].alias("detail")))
    none = F.array().cast(kind)
    parts = [plain("title", F.array("title")), plain("primary_area", F.array("primary_area")), plain("keyword", F.col("keywords")), plain("tldr", F.array("tldr")), rich("claim", F.col("claims")), rich("method", F.col("methods")), rich("experiment", F.col("experiments"))]
    e = df.select("paper_id", F.posexplode(F.concat(*[F.coalesce(p.cast(kind), none) for p in parts])).alias("ord", "e")).select("paper_id", "ord", F.col("e.type").alias("type"), F.col("e.label").alias("base"), F.col("e.detail").alias("detail"))
    nth = F.row_number().over(Window.partitionBy("paper_id", "base").orderBy("ord"))
    e = e.withColumn("label", F.when(nth > 1, F.concat("base", F.lit(" ["), "type", F.lit("]"))).otherwise(F.col("base")))
    names = e.groupBy("paper_id", "type", "base").agg(F.max_by("label", "ord").alias("label"))
    edge = lambda st, s, tt, t: F.struct(F.lit(st).alias("st"), s.alias("s"), F.lit(tt).alias("tt"), t.alias("t"))
    pick = lambda arr, i: F.try_element_at(arr, F.when(i >= 0, i + 1).otherwise(i))["text"]
    raw = F.concat(
        F.array(edge("title", F.col("title"), "primary_area", F.col("primary_area"))),
        F.transform("keywords", lambda k: edge("title", F.col("title"), "keyword", k)),
        F.array(edge("title", F.col("title"), "tldr", F.col("tldr"))),
        F.transform("claims", lambda c: edge("tldr", F.col("tldr"), "claim", c["text"])),
        F.flatten(F.transform("claims", lambda c: F.transform(c["method_indices"], lambda i: edge("claim", c["text"], "method", pick(F.col("methods"), i))))),
        F.flatten(F.transform("methods", lambda m: F.transform(m["experiment_indices"], lambda i: edge("method", m["text"], "experiment", pick(F.col("experiments"), i))))),
    )
    r = df.select("paper_id", F.posexplode(raw).alias("ord", "x")).select("paper_id", "ord", "x.*").where("t is not null and s is not null")
    side = lambda t, b, out: names.select("paper_id", F.col("type").alias(t), F.col("base").alias(b), F.col("label").alias(out))
    r = r.join(side("st", "s", "source"), ["paper_id", "st", "s"]).join(side("tt", "t", "target"), ["paper_id", "tt", "t"])
    return e.select("paper_id", "ord", "label", "type", "detail"), r.select("paper_id", "ord", "source", "target")


def related_context(related: DataFrame, key: str = "paper_id") -> DataFrame:
    """One prompt column for each (source, polarity): related papers by score, or a placeholder."""
    from paperloom.operators.prompts import NO_RELATED

    slices = [f"{s}_{p}" for s in ("citation", "semantic") for p in ("positive", "negative")]
    line = F.concat(F.lit("Title: "), "title", F.lit("\nSummary: "), "summary", F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("k"), "related_id", line.alias("t"))))
    out = related.withColumn("__s", F.concat_ws("_", "source", "polarity")).groupBy(key).pivot("__s", slices).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n"))
    return out.select(key, *[F.coalesce(F.nullif(F.col(s), F.lit("")), F.lit(NO_RELATED)).alias(s) for s in slices])
