"""Text and vector search against brute force; what an index spares."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import stem
from paperloom.operators import related, textindex

# -- text


def rank(papers, query, n, stemmed=False):
    cut = lambda t: [stem.stem(w) if stemmed and len(w) > 2 else w for w in re.findall(r"[^\W_]+", (t or "").lower())]
    terms = set(cut(query))
    out = []
    for i, title, abstract, cites in papers:
        t, a = Counter(cut(title)), Counter(cut(abstract))
        if terms and all(t[w] + a[w] for w in terms):
            out.append((-round(sum(t[w] + 0.4 * a[w] for w in terms), 6), -cites, i))
    return [(i, -s) for s, _, i in sorted(out)[:n]]


@pytest.fixture(scope="module")
def papers():
    rng = random.Random(3)
    words = ["graph", "graphs", "novel", "Novelty", "running", "runs", "ß", "x2", "the"] + [f"w{i}" for i in range(30)]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(n))
    return [(i, say(4), say(rng.choice([0, 5, 30])), rng.randrange(5)) for i in range(200)] + [(900, None, None, 0), (901, "the the", "", 1), (902, "", "graph", 2)]


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_finds_what_a_scan_finds(spark, papers, tmp_path, stemmed):
    df = spark.createDataFrame(papers, "id long, title string, abstract string, citation_count long").withColumn("term", F.lit("clash"))
    path = str(tmp_path / "index")
    textindex.write_index(df, path, stemmed, buckets=8, files=5)
    index = textindex.read_index(spark, path)
    asked = ["the graph", "Novelty", "running graphs", "nothing", "", "w1 w2", "!!"]
    for q in asked:
        got = [(r.id, r.score) for r in textindex.search_index(index, q, 10, stemmed, buckets=8).collect()]
        assert got == rank(papers, q, 10, stemmed), q
    many = textindex.search_many(index, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), 10, stemmed, buckets=8).collect()
    for k, q in enumerate(asked):
        assert [(r.id, r.score) for r in sorted((r for r in many if r.query_id == k), key=lambda r: r.r)] == rank(papers, q, 10, stemmed), q


def test_a_query_reads_its_terms_only(spark, papers, tmp_path):
    df = spark.createDataFrame(papers, "id long, title string, abstract string, citation_count long")
    path = str(tmp_path / "index")
    textindex.write_index(df, path, buckets=16, files=6)
    found = textindex.search_index(textindex.read_index(spark, path), "the graph", 10, buckets=16)
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*In\(term", plan)
    files = textindex.read_index(spark, path).select(F.input_file_name().alias("f"), "bucket", "term").distinct().collect()
    assert len({r.f for r in files if r.term in ("the", "graph")}) < len({r.f for r in files}) / 2


def test_a_frequent_term_is_dealt_over_files(spark, tmp_path):
    df = spark.range(20_000).select("id", F.lit("same").alias("title"), F.lit("").alias("abstract"), F.lit(0).cast("long").alias("citation_count"))
    path = str(tmp_path / "index")
    textindex.write_index(df, path, files=8)
    assert textindex.read_index(spark, path).select(F.input_file_name()).distinct().count() > 4


# -- vectors


def vectors(rng, n, dim=16):
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + 0.05 * rng.normal(size=(n - n // 2, dim))
    return x.astype(np.float32)


def frames(spark, x, every=7):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    nodes = spark.createDataFrame([*rows, (9_000, None)], "node_id long, embedding array<float>").withColumn("kind", F.when(F.col("node_id") % 3 == 0, "a").when(F.col("node_id") % 3 == 1, "b"))
    return spark.createDataFrame([*rows[::every], (9_001, None)], "query_id long, embedding array<float>"), nodes


def exact(x, every, k, apart):
    y = x.astype(np.float64)
    s = np.clip((y @ y.T) / (np.outer(np.sqrt((y * y).sum(1)), np.sqrt((y * y).sum(1))) + 1e-8), 0, 1)
    return {q: [j for j in sorted(range(len(x)), key=lambda j: (-round(s[q, j], 9), j)) if not (apart and j == q)][:k] for q in range(0, len(x), every)}, s


@pytest.mark.parametrize("queries,block", [(8_192, 2_048), (5, 16)])
def test_topk_in_parts_and_blocks(spark, monkeypatch, queries, block):
    """Several parts of queries and many small blocks give what one product gives, repeated vectors and all."""
    monkeypatch.setattr(related, "QUERIES", queries)
    monkeypatch.setattr(related, "BLOCK", block)
    x = vectors(np.random.default_rng(1), 150)
    x[20:40] = x[0]
    q, n = frames(spark, x)
    want, s = exact(x, 7, 6, True)
    got = related.semantic_topk(q, n.drop("kind"), 6, apart=True).collect()
    for a, nodes in want.items():
        found = sorted((r.r, r.node_id, r.score) for r in got if r.query_id == a)
        assert [round(v, 7) for _, _, v in found] == [round(s[a, j], 7) for j in nodes]
    by = related.semantic_topk(q, n, 2, ["kind"]).collect()
    assert all(sum(r.query_id == a and r.kind == kind for r in by) == 2 for a in want for kind in ("a", "b", None))
    above = related.semantic_above(q, n.drop("kind"), 0.9).collect()
    assert {(r.query_id, r.node_id) for r in above} == {(a, j) for a in want for j in range(150) if s[a, j] >= 0.9}


def test_approximate_search_is_exact_in_scores_and_audited(spark):
    x = vectors(np.random.default_rng(2), 600)
    q, n = frames(spark, x, every=3)
    n = n.drop("kind")
    truth = {(r.query_id, r.node_id): r.score for r in related.vector_search(q, n, 5, 0.9, apart=True).collect()}
    got = {(r.query_id, r.node_id): r.score for r in related.approximate_search(q, n, 5, 0.9, tables=16, bits=6, apart=True).collect()}
    assert set(got) <= set(truth) and len(got) >= 0.9 * len(truth) and len(truth) > 150
    assert all(got[p] == pytest.approx(truth[p], abs=1e-9) for p in got)
    assert related.search_recall(q, n, 5, 0.9, tables=16, bits=6, apart=True) >= 0.9
    assert related.search_recall(q, n, 5, 0.9, tables=1, bits=30, apart=True) < 0.9
    kept = related.signature_index(n, 16, 6)
    again = {(r.query_id, r.node_id) for r in related.approximate_search(q, n, 5, 0.9, 16, 6, index=kept, apart=True).collect()}
    assert again == set(got)


def test_approximate_search_shuffles_no_pairs_and_keeps_with_several_passes(spark, monkeypatch):
    x = vectors(np.random.default_rng(5), 300)
    q, n = frames(spark, x, every=3)
    kept = related.signature_index(n, 8, 6)
    want = {(r.query_id, r.node_id, r.r): r.score for r in related.approximate_search(q, n, 5, 0.0, 8, 6, index=kept).collect()}
    once = related.approximate_search(q, n, 5, 0.0, 8, 6)
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.node_id, r.r): r.score for r in once.collect()} == want and len(want) > 300
    monkeypatch.setattr(related, "QUERIES", 30)
    assert {(r.query_id, r.node_id, r.r): r.score for r in related.approximate_search(q, n, 5, 0.0, 8, 6).collect()} == want


def test_audited_search_falls_back_to_the_exact_way(spark):
    x = np.random.default_rng(3).normal(size=(120, 16)).astype(np.float32)
    q, n = frames(spark, x, every=5)
    n = n.drop("kind")
    got = related.audited_search(q, n, 3, 0.0, recall=1.0, bits=40, most=8, apart=True).collect()
    truth = related.vector_search(q, n, 3, 0.0, apart=True).collect()
    assert {(r.query_id, r.node_id, r.r) for r in got} == {(r.query_id, r.node_id, r.r) for r in truth} and got[0].recall == 1.0


def allowed(main, cand):
    """The rule of dates, case by case."""
    (y, m), (cy, cm) = main, cand
    if y is None:
        return True
    if cy is None or cy > y:
        return False
    return cy < y or (m is not None and cm is not None and cm <= m)


def test_single_papers_by_date(spark):
    """The best of each side among the papers that are old enough, however many newer ones are nearer."""
    rng = random.Random(5)
    x = vectors(np.random.default_rng(6), 240)
    mains = [(1000 + i, [2020, 2020, 2019, None][i % 4], [6, None, 1, 3][i % 4]) for i in range(8)]
    q = [(i, kind, x[2 * k + s].tolist(), y, m) for k, (i, y, m) in enumerate(mains) for s, kind in enumerate(("background", "target"))]
    pool, when = [], {}
    for p in range(100):
        y, m = rng.choice([2018, 2019, 2020, 2021, None]), rng.choice([1, 6, 7, None])
        day = f"{y}-{m:02d}-03" if y and m else rng.choice([None, "1999-01-01"])
        when[p] = (y, m if y and m else None)
        abstract = rng.choice(["text", "text", " ", None])
        pool += [(p, kind, x[16 + 2 * p + s].tolist(), abstract, y, day) for s, kind in enumerate(("background", "target"))]
    nodes = spark.createDataFrame(pool, "paper_id long, kind string, embedding array<float>, abstract string, year int, d string").withColumn("published", F.to_date("d"))
    queries = spark.createDataFrame(q, "query_id long, kind string, embedding array<float>, year int, month int")
    cites = spark.createDataFrame([(1000, 1, "positive", 0.9, "a"), (1000, 2, "negative", 0.8, " "), (1001, 3, "negative", 0.7, "a")], "query_id long, paper_id long, polarity string, score double, abstract string")
    for dated in (True, False):
        got = related.single_paper_related(queries, nodes, cites, 4, dated).collect()
        assert {(r.query_id, r.paper_id) for r in got if r.source == "citation"} == {(1000, 1), (1001, 3)}
        for k, (i, y, m) in enumerate(mains):
            best = {}
            for s, kind in enumerate(("background", "target")):
                a = x[2 * k + s].astype(float)
                scored = []
                for p in range(100):
                    if (pool[2 * p][3] or "").strip() and (not dated or allowed((y, m), when[p])):
                        b = x[16 + 2 * p + s].astype(float)
                        scored.append((-max(0.0, min(1.0, a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b) + 1e-8))), p))
                for score, p in sorted(scored)[:4]:
                    best.setdefault(p, ("negative" if kind == "background" else "positive", -score))
            cited = {r.paper_id for r in got if r.query_id == i and r.source == "citation"}
            found = {r.paper_id: (r.polarity, round(r.score, 6)) for r in got if r.query_id == i and r.source == "semantic"}
            assert found == {p: (polarity, round(score, 6)) for p, (polarity, score) in best.items() if p not in cited}, (dated, i)


def test_encoders_must_agree(spark):
    from paperloom.operators import encode

    df = encode.encode_with(spark.createDataFrame([("a",)], "t string"), "t", lambda texts: texts.map(lambda s: [float(len(s))]), "lengths")
    assert encode.encoder_of(df) == "lengths" and encode.require_encoder(df, "lengths") is df
    with pytest.raises(ValueError, match="incompatible"):
        encode.require_encoder(df, "other")
    with pytest.raises(ValueError, match="incompatible"):
        encode.require_encoder(spark.createDataFrame([([1.0],)], "embedding array<double>"), "lengths")


def test_text_files_by_suffix(spark, tmp_path):
    import zstandard

    from paperloom.sources import records

    df = spark.createDataFrame([(1, "é"), (2, "b")], "i long, t string")
    for name, files in (("rows.jsonl.gz", ".json.gz"), ("rows.JSONL.BZ2", ".json.bz2"), ("rows.jsonl", ".json")):
        path = tmp_path / name
        records.write_jsonl(df, str(path))
        records.write_jsonl(df, str(path), "append")
        assert all(p.name.endswith(files) for p in path.iterdir() if p.name.startswith("part-"))
        assert sorted(records.read_jsonl(spark, str(path), "i long, t string").collect()) == [(1, "é"), (1, "é"), (2, "b"), (2, "b")]
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.compress('{"i": 7, "t": "ü"}\n{bad\n\n'.encode()))
    assert records.read_jsonl(spark, str(tmp_path / "x.jsonl.zst"), "i long, t string").collect() == [(7, "ü")]
    with pytest.raises(ValueError, match="zst"):
        records.write_jsonl(df, str(tmp_path / "y.jsonl.zst"))


def test_a_chain_of_levels_is_one_table(spark):
    from paperloom.operators import graphs

    rel = spark.createDataFrame([("p", f"n{i}", f"n{i + 1}") for i in range(12)] + [("q", "a", "b"), ("q", "b", "a")], "paper_id string, source string, target string")
    got = graphs.topological_levels(rel)
    assert {(r.paper_id, r.label): r.level for r in got.collect()} == {("p", f"n{i}"): i for i in range(13)} | {("q", "a"): None, ("q", "b"): None}
    assert got._jdf.queryExecution().toString().count("Union") < 8
    assert graphs.topological_levels(rel.limit(0)).count() == 0


def test_citation_scores_join_no_vectors_to_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.random((40, 6)).astype("float32")
    name = lambda i: "title " + "".join("abcdefghij"[int(c)] for c in str(i))
    vectors = spark.createDataFrame([(name(i), x[i].tolist()) for i in range(40)], "title string, embedding array<float>")
    # paper 5 has two titles, papers 35 to 39 none that is known, and titles 40 to 44 have no vector
    own = [(i, name(i if i < 35 else i + 100)) for i in range(40)] + [(5, name(6))]
    edges = [(p, name(c), "positive" if (p + c) % 3 else "negative") for p in range(40) for c in range(45)] + [(None, name(1), "positive"), (1, None, "negative")]
    got = related.citation_scores(spark.createDataFrame(own, "paper_id long, title string"), spark.createDataFrame(edges, "paper_id long, cited_title string, polarity string"), vectors)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()) == 1, "only papers meet vectors in a join"
    cos = lambda a, b: float(a.astype(float) @ b.astype(float) / (np.linalg.norm(a.astype(float)) * np.linalg.norm(b.astype(float)) + 1e-8))
    want = sorted((p, pol, c, round(cos(x[v], x[i]), 9)) for p, v in [(i, i) for i in range(35)] + [(5, 6)] for i in range(40) for q, c, pol in edges if q == p and c == name(i))
    rows = got.collect()
    assert sorted((r.paper_id, r.polarity, r.cited_title, round(r.score, 9)) for r in rows) == want
    assert all(r.r == 1 + sum((-o.score, o.cited_title) < (-r.score, r.cited_title) for o in rows if (o.paper_id, o.polarity) == (r.paper_id, r.polarity)) for r in rows if r.paper_id < 2)


def test_postings_are_counted_where_the_papers_lie(spark, monkeypatch):
    monkeypatch.setattr(textindex, "ROWS", 3)
    df = spark.createDataFrame([(1, "A b", "b, b c", 5), (2, None, "", 1), (3, "x", None, None), (4, "B", "c c c", 2)], "id long, title string, abstract string, citation_count long")
    got = textindex.postings(df)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {("a", 1, "title", 1, 5), ("b", 1, "title", 1, 5), ("b", 1, "abstract", 2, 5), ("c", 1, "abstract", 1, 5), ("x", 3, "title", 1, None), ("b", 4, "title", 1, 2), ("c", 4, "abstract", 3, 2)}
    rows = [tuple(r)[1:] for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
