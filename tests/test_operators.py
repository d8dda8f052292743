"""Metrics, tournaments, graphs, sources and streams on small rows."""

import json
import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import encode, graphs, joins, metrics, sampling, scoring, tournament
from paperloom.sources import records
from paperloom.streaming import operators as st


def plain_metrics(true, pred):
    """The same numbers by sets and sums; a class counts if it is true or predicted somewhere."""
    classes = sorted(set(true) | set(pred))
    hits = {c: sum(t == p == c for t, p in zip(true, pred, strict=True)) for c in classes}
    precision = [hits[c] / pred.count(c) if pred.count(c) else 0.0 for c in classes]
    recall = [hits[c] / true.count(c) if true.count(c) else 0.0 for c in classes]
    f1 = [2 * p * r / (p + r) if p + r else 0.0 for p, r in zip(precision, recall, strict=True)]
    off = [abs(t - p) for t, p in zip(true, pred, strict=True)]
    rank = lambda v: [sum(x < y for x in v) + (v.count(y) + 1) / 2 for y in v]

    def correlation(a, b):
        ma, mb = (sum(v) / len(v) for v in (a, b))
        va, vb = sum((x - ma) ** 2 for x in a), sum((y - mb) ** 2 for y in b)
        return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / (va * vb) ** 0.5 if va and vb else None

    n = len(classes)
    mean = lambda v: sum(v) / n
    return mean(precision), mean(recall), mean(f1), sum(hits.values()) / len(true), sum(off) / len(off), (sum(x * x for x in off) / len(off)) ** 0.5, correlation(true, pred), correlation(rank(true), rank(pred))


@pytest.mark.parametrize("seed", range(5))
def test_metrics(spark, seed):
    rng = random.Random(seed)
    true = [rng.randint(1, 4) for _ in range(17)]
    pred = [2] * 17 if seed == 4 else [min(5, max(1, t + rng.choice([-2, -1, 0, 0, 1]))) for t in true]
    r = metrics.metrics(spark.createDataFrame(list(zip(true, pred, strict=True)), "y_true int, y_pred int")).first()
    for name, e in zip(("precision", "recall", "f1", "accuracy", "mae", "rmse", "pearson", "spearman"), plain_metrics(true, pred), strict=True):
        assert r[name] == (None if e is None else pytest.approx(e, abs=1e-5)), name


def test_metrics_of_nothing(spark):
    with pytest.raises(ValueError):
        metrics.metrics(spark.createDataFrame([], "y_true int, y_pred int"))


def match_log(spark):
    rows, seq = [], 0
    for metric in ("clarity", "factuality"):
        for a, b, w in (("a", "b", "A"), ("b", "c", "tie"), ("a", "c", "B")):
            rows.append((seq, metric, a, b, w, "one two", "three"))
            seq += 1
    return spark.createDataFrame(rows, "seq long, metric string, item_a string, item_b string, winner string, rationale_a string, rationale_b string")


def test_tournament(spark):
    m = match_log(spark)
    h = {(r.metric, r.item, r.other): r for r in tournament.head_to_head(m).collect()}
    assert len(h) == 12
    for (k, a, b), r in h.items():
        o = h[(k, b, a)]
        assert (r.wins, r.ties, r.losses) == (o.losses, o.ties, o.wins)
    e = tournament.elo(m).collect()
    assert sorted(r["rank"] for r in e if r.metric == "clarity") == [1, 2, 3]
    assert sum(r.rating for r in e) == pytest.approx(1200 * 6)
    one, two = (sorted(map(tuple, tournament.melo(m, 3, seed=1).collect())) for _ in range(2))
    assert one == two


def test_strengths(spark):
    games = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("D", "B"), ("C", "A")]
    m = spark.createDataFrame([(i, "m", a, b, "A", "", "") for i, (a, b) in enumerate(games)], "seq long, metric string, item_a string, item_b string, winner string, rationale_a string, rationale_b string")
    r = tournament.bradley_terry(m, most=15).collect()
    s = [x.strength for x in r]
    assert len({round(x, 6) for x in s}) > 2 and min(s) > 0.1 and sum(s) == pytest.approx(5)


ENT = "paper_id long, ord long, label string, type string, detail string"
REL = "paper_id long, ord long, source string, target string"


def test_validation_never_raises(spark):
    ent = spark.createDataFrame([(1, 0, "x", "tldr", "d"), (3, 0, "t", "title", None)], ENT)
    rel = spark.createDataFrame([(1, 0, "ghost", "spirit")], REL)
    papers = spark.createDataFrame([(1,), (2,), (3,)], "paper_id long")
    got = {(r.paper_id, r.message) for r in graphs.validate_graphs(ent, rel, papers).collect()}
    assert (2, "Empty graph") in got
    assert (1, "Found 0 'title' nodes. Should be exactly 1.") in got
    assert (1, "Found edge with unknown source node: 'ghost'") in got and (1, "Found edge with unknown target node: 'spirit'") in got
    assert any(p == 1 and m.startswith("Found 0 incoming edges to node type 'tldr'") for p, m in got)


def test_cycles_and_levels(spark):
    rel = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "b", "c"), (2, 0, "a", "b"), (2, 1, "b", "a"), (2, 2, "x", "y")], REL)
    assert {r.paper_id: r.has_cycle for r in graphs.has_cycle(rel).collect()} == {1: False, 2: True}
    assert {r.label: r.level for r in graphs.topological_levels(rel).where("paper_id = 1").collect()} == {"a": 0, "b": 1, "c": 2}


def test_fluent_text(spark):
    ent = spark.createDataFrame([(1, 0, "T", "title", None), (1, 1, "Area (x)", "primary_area", None), (1, 2, "c1", "claim", "why"), (1, 3, "c2", "claim", "why"), (1, 4, "m1", "method", "how"), (1, 5, "e1", "experiment", "seen!")], ENT)
    rel = spark.createDataFrame([(1, 0, "c1", "m1"), (1, 1, "m1", "e1")], REL)
    want = "This paper is titled 'T'. It's about Area. The key contributions are:\n\n1. C1: why. This is done with:\n  1.1. M1: how. This method is validated by these experiments:\n    1.1.1. E1: seen!"
    assert graphs.fluent_text(ent, rel).first()["text"] == want


def test_jsonl(spark, tmp_path):
    good, bad, mixed = (tmp_path / n for n in ("good", "bad", "mixed"))
    for d in (good, bad, mixed):
        d.mkdir()
    (good / "a.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    (mixed / "a.json").write_text('{"a": 1}\nnot json\n')
    (bad / "a.json").write_text("not json\n")
    assert records.read_jsonl(spark, str(good), "a int").count() == 2
    assert records.read_jsonl(spark, str(mixed), "a int").count() == 1
    with pytest.raises(ValueError):
        records.read_jsonl(spark, str(bad), "a int")
    df = spark.createDataFrame([(3,)], "a int")
    records.write_records(df, str(tmp_path / "p"))
    records.append_records(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_read_records_and_tree(spark, tmp_path):
    d = tmp_path / "iclr" / "train" / "reviews"
    d.mkdir(parents=True)
    (d / "104.pdf.json").write_text(json.dumps({"a": 1}))
    r = records.scan_tree(spark, str(tmp_path), "reviews", "a int").first()
    assert (r["conference"], r["id"], r["a"]) == ("iclr", "104", 1)
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    assert records.read_records(spark, str(tmp_path / "list.json"), "a int").count() == 2
    (tmp_path / "wrong.json").write_text('[{"a": "text"}]')
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "wrong.json"), "a int").collect()


def test_review_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", ["a"], "r", "p", [("claim", "c")])], "paper_id int, title string, authors array<string>, rationale string, rationale_pred string, entities array<struct<type:string,label:string>>")
    records.export_review_csv(df, str(tmp_path / "csv"), ["claim"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["claim"] == "• c"


def test_rate_rules():
    assert st.parse_rule("10/minute") == (10, 60)
    for rule in ("x/minute", "0/day", "3/fortnight", "3"):
        with pytest.raises(ValueError):
            st.parse_rule(rule)
    assert st.decide([0, 1, 2, 3], [], 2, 3)[0] == [True, True, False, True]


def events(spark):
    rows = [(i, f"k{i % 2}", f"2024-01-01 00:00:{i:02d}", 1) for i in range(20)]
    return spark.createDataFrame(rows, "event_id long, key string, ts string, tokens int").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_of(spark, df, tmp_path):
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run_stream(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_rate_limit_stream(spark, tmp_path):
    e = events(spark)
    batch = {tuple(r) for r in st.rate_limit_decisions(e, "2/minute").collect()}
    run_stream(st.rate_limit_stream(stream_of(spark, e, tmp_path), "2/minute"), "append", "limited")
    assert {tuple(r) for r in spark.table("limited").collect()} == batch
    assert sum(r[2] for r in batch) == 4


def test_usage_stream(spark, tmp_path):
    run_stream(st.usage_stream(stream_of(spark, events(spark), tmp_path), "10 seconds", "10 seconds", late="0 seconds"), "append", "usage")
    assert {r.requests for r in spark.table("usage").collect()} == {5}


def test_incremental(spark, tmp_path):
    out, e = str(tmp_path / "out"), events(spark)
    w = st.incremental_annotate(stream_of(spark, e, tmp_path), lambda d: d.withColumn("done", F.lit(True)), out, "event_id", str(tmp_path / "cp"))
    for _ in range(2):
        w.trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(out).count() == 20


def test_online_elo(spark, tmp_path):
    m = match_log(spark)
    run_stream(st.online_elo(stream_of(spark, m, tmp_path)), "update", "elo")
    got = {(r.metric, r.item): round(r.rating, 6) for r in spark.table("elo").collect()}
    assert got == {(r.metric, r.item): round(r.rating, 6) for r in tournament.elo(m).collect()}


def test_splits(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    n = {r["split"]: r["count"] for r in sampling.split(df, "k", 0.5, 20).groupBy("split").count().collect()}
    assert n == {"train": 100, "dev": 20, "test": 80}
    with pytest.raises(ValueError):
        sampling.downsample(df.withColumn("c", F.col("k") % 2), "c", "50/60", "k")
    assert sampling.downsample(df.withColumn("c", (F.col("k") < 50).cast("int")), "c", "50/50", "k").count() == 100


def test_ensemble_and_rationale(spark):
    e = spark.createDataFrame([(1, 1, 3, "graph neural novelty"), (1, 2, 4, "graph neural method novelty"), (1, 3, 5, "cooking pasta"), (2, 1, 2, "the"), (2, 2, 2, "the and of")], "paper_id int, ord int, label int, text string")
    r = {x.paper_id: x for x in scoring.ensemble(e).collect()}
    assert r[1].label == 4 and r[1].confidence == 0.5 and r[2].confidence == 1.0
    best = {x.paper_id: x.ord for x in scoring.best_rationale(e, "paper_id", "text", "ord").collect()}
    assert best[1] in (1, 2) and best[2] == 2


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, t string")
    out = encode.respond_with(df.where("t is not null"), "t", lambda p: (p * 2, 1.0)).collect()
    assert [r.response for r in out] == ["aa", "aa"]


def test_containment(spark):
    a = spark.createDataFrame([("Cat", 1), ("concatenation of lists", 2)], "a_title string, o int")
    b = spark.createDataFrame([("concatenate",), ("lists",), ("dog",)], "b_title string")
    assert {(r.b_title, r.a_title) for r in joins.containment_match(a, b, "o").collect()} == {("concatenate", "Cat"), ("lists", "concatenation of lists")}


def test_containment_at_every_offset(spark):
    """Titles of one to seven letters inside a longer one at every place, in both directions, against plain Python."""
    long_one = "Graphs of Novel work"
    parts = {long_one[i : i + n] for n in (1, 2, 3, 4, 7) for i in range(len(long_one) - n + 1)} | {"zq", "x", "", "novel works", long_one.upper()}
    small = spark.createDataFrame([(t, i) for i, t in enumerate(sorted(parts))], "a_title string, o int")
    large = spark.createDataFrame([(long_one,), ("Novel",), ("work of",)], "b_title string")
    rows = sorted((o, t) for o, t in enumerate(sorted(parts)))
    for a, b, given, asked in ((small, large, rows, [long_one, "Novel", "work of"]),):
        want = {}
        for y in asked:
            hit = next(((o, t) for o, t in given if t and (t.lower() in y.lower() or y.lower() in t.lower())), None)
            if hit:
                want[y] = hit[1]
        assert {r.b_title: r.a_title for r in joins.containment_match(a, b, "o").collect()} == want
    one = spark.createDataFrame([(long_one, 1)], "a_title string, o int")
    every = small.select(F.col("a_title").alias("b_title"))
    want = {t for t in parts if t and (t.lower() in long_one.lower() or long_one.lower() in t.lower())}
    assert {r.b_title for r in joins.containment_match(one, every, "o").collect()} == want


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_base_input_match_asks_all_vectors(spark, tmp_path):
    """Every hundredth vector asks, all others answer, askers too."""
    from paperloom.plans import registry

    unit = lambda *at: [1.0 if i in at else 0.0 for i in range(6)]
    rows = [(i, unit(5)) for i in (1, 25, 50)] + [(0, unit(0)), (100, unit(0, 1)), (200, unit(2)), (300, unit(3)), (325, unit(2, 3))]
    table(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>")
    got = registry.QUERIES["f14_base_input_match"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, 0.7071), (1, 1, 325, 0.7071)]


def document_rows(texts):
    return [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_match_aspects_takes_bounded_papers(spark, tmp_path):
    """Documents of one source are many papers, each of at most 20 documents with an aspect of its own."""
    from paperloom.plans import registry

    table(spark, tmp_path, "documents", document_rows([f"{i} " * 30 for i in range(45)]), DOCUMENTS)
    got = registry.QUERIES["f16_match_aspects"](spark, str(tmp_path)).collect()
    assert sorted((r.paper_id, r.ord) for r in got) == sorted((i // 20 * 20, i % 20) for i in range(45))
    assert [(r.paper_id, r.labels) for r in sorted(got) if r.ord == 0] == [(0, "novelty"), (20, "novelty"), (40, "novelty")]


def test_titles_are_compared_whole(spark, tmp_path):
    """Titles and texts that differ only far behind: matches and scores are those of the whole."""
    from paperloom.functions.fuzzy import indel_ratio, partial
    from paperloom.plans import registry

    head = "signal graph paper method result under river stone light sound "
    texts = [head + tail * 9 + ". More of it." for tail in ("alpha beta ", "zygote quux ")] + ["short one. x", head * 4 + "q" * 400, head * 4 + "z" * 400]
    table(spark, tmp_path, "documents", document_rows(texts), DOCUMENTS)
    table(spark, tmp_path, "benchmark", [(0, texts[0])], "item_id long, text string")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    titles = [t.split(".")[0] if "." in t else t[:100] for t in texts]
    found = {(r["query"], r.title): r.score for r in run("f8_fuzzy_title_join")}
    assert found[titles[0], titles[0]] == 100 and (titles[0], titles[1]) not in found
    assert found[titles[0].replace("e", ""), titles[0]] == round(indel_ratio(titles[0].replace("e", ""), titles[0]))
    assert {r.doc_id: r.v for r in run("g29_fuzzy_partial_ratio")} == {i: round(partial(t, "web" + t[::-1])) for i, t in enumerate(titles)}
    assert [r.labels for r in sorted(run("f16_match_aspects"))] == ["novelty", "", "", "", ""]
    assert {1, 3} <= {r.doc_id for r in run("f9_validate_title_match")}
    # windows that are passed over are never the best
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 25))) for _ in range(2))
        a, b = sorted((a, b), key=len)
        want = 100.0 if a in b else max(indel_ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))
        assert partial(a, b) == want


def test_partial_ratio_of_long_texts(spark):
    """All windows of long texts in one pass; one text whole in the middle of the other but for one letter."""
    from paperloom.functions.fuzzy import fuzzy_partial_ratio, partials

    rng = random.Random(5)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(6_000))
    start = time.monotonic()
    got = partials([long_, long_[2_000:4_000] + "x" + long_[4_000:5_000], "", "", "ab"], ["x" + long_[::-1], long_, "", "a", "xaby"])
    assert got[1:] == [pytest.approx(200 * 3_000 / 6_002), 100.0, 0.0, 100.0] and 40 < got[0] < 100
    assert time.monotonic() - start < 20
    rows_ = spark.createDataFrame([(0, "ab", None), (1, None, None), (2, "abc", "xabd"), (3, "", "")], "i int, a string, b string")
    assert [r.v for r in rows_.select("i", fuzzy_partial_ratio("a", "b").alias("v")).orderBy("i").collect()] == [None, None, 67, 100]


@pytest.mark.parametrize("block", [1_024, 3])
def test_fuzzy_title_join_of_one_length(spark, monkeypatch, block):
    """All titles in one band of length, dealt over many pairs of blocks, against comparing all pairs; MinHash finds most."""
    from paperloom.functions.fuzzy import indel_ratio

    monkeypatch.setattr(joins, "TITLE_BLOCK", block)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(40)).strip() for _ in range(12)]

    def edited(t):
        at = rng.randrange(len(t))
        return t[:at] + rng.choice(["", "x", "yz"]) + t[at + rng.randrange(6) :]

    titles = sorted({edited(edited(rng.choice(base))) for _ in range(80)})
    asked = sorted({edited(t) for t in base} | {"", "qqqq"})
    q, c = (spark.createDataFrame([(t,) for t in side], f"{n} string") for n, side in (("query", asked), ("title", titles)))
    clean = {r.t: r.c for r in spark.createDataFrame([(t,) for t in asked + titles], "t string").select("t", tx.match_title(F.col("t")).alias("c")).collect()}
    for least in (70, 80, 95):
        want = set()
        for a in asked:
            scored = sorted(((round(indel_ratio(clean[a], clean[b])), b) for b in titles), reverse=True)
            want |= {(a, b, s) for s, b in [x for x in scored if x[0] >= least][:5]}
        got = joins.fuzzy_title_join(q, c, least)
        assert {tuple(r) for r in got.collect()} == want and (want or least > 80)
    near = joins.minhash_title_join(q, c, 80)
    assert {tuple(r) for r in near.collect()} <= {tuple(r) for r in joins.fuzzy_title_join(q, c, 80, k=100).collect()}
    assert joins.title_join_recall(q, c, 80) >= 0.9


def test_strengths_and_trials_take_the_defaults(spark, monkeypatch):
    """No fewer rounds or shuffles than the operators' own."""
    from paperloom.plans import registry, scoring

    asked = []
    made = lambda *a, **b: asked.append((a[1:], b)) or spark.range(1).selectExpr("1.23456 AS strength", "1.23456 AS rating")
    monkeypatch.setattr(scoring, "MATCHES", lambda t: None)
    for name in ("bradley_terry", "melo"):
        monkeypatch.setattr(tournament, name, made)
    for name in ("j10_bradley_terry", "j9_melo"):
        registry.QUERIES[name](spark, "")
    assert asked == [((), {}), ((), {})]


def test_titles_of_the_same_letters():
    """Titles that no count of letters tells apart are aligned side by side; scores are those of single pairs."""
    from paperloom.functions.fuzzy import indel_ratio

    rng = random.Random(4)
    titles = ["".join(rng.sample("abcdefghij klmnopqrst" * 5, 105)) for _ in range(500)]
    asked = [t[:50] + t[55:] for t in titles]
    start = time.monotonic()
    got = {(i, j): s for i, j, s in joins.close_pairs(asked, titles, 50)}
    assert time.monotonic() - start < 10
    assert all(got[i, i] == 98 for i in range(500))
    for i, j in [(rng.randrange(500), rng.randrange(500)) for _ in range(500)]:
        assert got.get((i, j), 0) == (s if (s := round(indel_ratio(asked[i], titles[j]))) >= 50 else 0)


def test_minhash_titles_of_one_vocabulary(spark):
    """Titles that nearly all agree in some band: pairs never become rows, and none is missed."""
    titles = [f"the common beginning of all these long titles number {n} {n * 7919 % 1000}" for n in range(300)]
    q, c = (spark.createDataFrame([(t,) for t in titles], f"{n} string") for n in ("query", "title"))
    near = joins.minhash_title_join(q, c, 90)
    assert sorted(near.collect()) == sorted(joins.fuzzy_title_join(q, c, 90).collect())
    assert "explode(keys" not in near._jdf.queryExecution().toString()


def _some_graphs(spark):
    """Random graphs with labels that several entities carry, unknown ends, circles, and one long chain."""
    import random

    rng, ent, rel = random.Random(5), [], []
    for p in range(60):
        n = rng.randint(1, 9)
        ent += [(p, i, f"n{rng.randint(0, n)}", rng.choice([*graphs.TYPES, None, "other"]), "d") for i in range(n)]
        rel += [(p, i, f"n{rng.randint(0, n + 1)}", f"n{rng.randint(0, n + 1)}") for i in range(rng.randint(0, 9))]
    rel += [(99, i, f"c{i}", f"c{i + 1}") for i in range(40)] + [(98, 0, None, "x"), (98, 1, "y", None)]
    return spark.createDataFrame(ent, ENT), spark.createDataFrame(rel, REL)


def test_levels_take_no_round_of_joins_a_level(spark, monkeypatch):
    ent, rel = _some_graphs(spark)
    cuts, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: cuts.append(1) or cut(df))
    got = sorted(graphs.topological_levels(rel, ent).collect(), key=repr)
    assert len(cuts) == 1
    want = {}
    edges, nodes = {}, {(r.paper_id, r.label) for r in ent.collect()}
    for r in rel.collect():
        nodes |= {(r.paper_id, x) for x in (r.source, r.target) if x is not None}
        if None not in (r.source, r.target):
            edges.setdefault((r.paper_id, r.target), set()).add((r.paper_id, r.source))
    for level in range(60):
        free = [v for v in nodes if v not in want and all(want.get(s, level) < level for s in edges.get(v, ()))]
        want |= dict.fromkeys(free, level)
    assert {(r.paper_id, r.label): r.level for r in got} == {v: want.get(v) for v in nodes} and len(got) == len(nodes)
    monkeypatch.setattr(graphs, "GRAPH", 8)  # the larger graphs by rounds, the others several to a chunk
    rel = rel.where("paper_id < 90 or ord < 3")
    small = graphs.topological_levels(rel.where("paper_id < 20"), ent.where("paper_id < 20")).collect()
    assert {(r.paper_id, r.label): r.level for r in small} == {v: want.get(v) for v in nodes if v[0] < 20} and len(cuts) > 3


def test_validation_reads_edges_and_nodes_once(spark, monkeypatch):
    """Every rule is told in one pass over the typed edges or the nodes; labels that several entities carry count each."""
    ent, rel = _some_graphs(spark)
    ent = ent.unionByName(spark.createDataFrame([(70, i, x, t, "d") for i, (x, t) in enumerate([("a", "claim"), ("a", "claim"), ("b", "experiment"), ("t", "title")])], ENT))
    rel = rel.unionByName(spark.createDataFrame([(70, 0, "a", "b")], REL))
    typed, tables = graphs._typed, []
    monkeypatch.setattr(graphs, "written", lambda df, what, written=graphs.written: tables.append(what) or written(df, what))
    monkeypatch.setattr(graphs, "_typed", lambda e, r: typed(e, r))
    got = graphs.validate_graphs(ent, rel, ent.select("paper_id")).collect()
    assert tables == ["graph-edges", "graph-errors"]
    assert sorted(r.message for r in got if r.paper_id == 70 and r.rule == 5) == ["Found illegal incoming edge from 'claim' to 'experiment'"] + ["Found illegal outgoing edge from 'claim' to 'experiment'"] * 2


def _brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_rouge_holds_pieces_of_a_batch(spark, monkeypatch):
    """Pieces of a few words give what brute force gives, also for one row beyond a piece, nulls and empty texts."""
    rng = random.Random(3)
    draw = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    data = [(i, draw(rng.randint(0, 9)), draw(rng.randint(0, 9))) for i in range(60)] + [(60, None, "a"), (61, "", ""), (62, draw(80), draw(90)), (63, "x a b", "a b"), (64, "a b", "a b x")]
    df = spark.createDataFrame(data, "k long, p string, r string").repartition(2)
    pieces = metrics._pieces
    monkeypatch.setattr(metrics, "_pieces", lambda a, b: pieces(a, b, 12))
    lists = [pa.array([[1] * n for n in sizes], pa.list_(pa.int64())) for sizes in ([3, 0, 20, 5, 5], [3, 0, 0, 1, 1])]
    seen = [(len(x), len(x.flatten()) + len(y.flatten())) for x, y in metrics._pieces(*lists)]
    assert seen == [(2, 6), (1, 20), (2, 12)]
    got = {r.k: r.f1 for r in metrics.rouge_l(df, "k", "p", "r").collect()}
    two = {r.k: r.f1 for r in metrics.rouge_n(df, "k", "p", "r", 2).collect()}
    for k, p, r in data:
        p, r = (p or "").split(), (r or "").split()
        assert got[k] == pytest.approx(2 * _brute_lcs(p, r) / (len(p) + len(r)) if p or r else 0.0)
        a, b = (Counter(zip(x, x[1:])) for x in (p, r))
        n = sum(a.values()) + sum(b.values())
        assert two[k] == pytest.approx(2 * sum((a & b).values()) / n if n else 0.0)


def test_responses_hold_pieces_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(encode, "ASKED", 4)
    data = [(i, None if i == 7 else "x" * i, float(i)) for i in range(10)]
    df = spark.createDataFrame(data, "k long, p string, v double")
    out = encode.respond_with(df, "p", lambda p: (f"<{len(p)}>", 1)).collect()
    assert {tuple(r) for r in out} == {(k, p, v, "<error>" if p is None else f"<{len(p)}>", 0.0 if p is None else 1.0) for k, p, v in data}
    held = []
    batch = pa.RecordBatch.from_pydict({"p": [str(i) for i in range(10)]})
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, kind: held.extend(x.num_rows for x in run(iter([batch]))))
    encode.respond_with(df.select("p"), "p", lambda p: (p, 0))
    assert held == [4, 4, 2]
