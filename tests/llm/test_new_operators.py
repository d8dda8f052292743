"""Ranked search, centroid clustering and repeated-string removal against brute force on small, messy rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import heap_kmeans, ranked_search, suffix_dedup

# -- 12


def lloyd(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(x) for _, x in named[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for c, xs in groups.items():
            centroids[c] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    found = [(i, *nearest(x)) for i, x in kept]
    sums = Counter()
    for _, d, c in found:
        sums[c] += d
    return sorted([(i is None, i or 0, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found])


@pytest.mark.parametrize("k,block", [(7, 8192), (7, 13), (1, 50), (500, 64)])
def test_clustering(spark, k, block):
    rng = np.random.default_rng(k + block)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 3 * (i % 3)]) for i in range(150)]
    rows += [(200 + i, [1.0, 0.5, -0.25, 0.0]) for i in range(9)]  # ties and repeated vectors
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, [0.0] * 4), (400, None), (401, []), (402, [1.0] * 3), (403, [1.0, None, 0.0, 0.0]), (404, [float("nan")] * 4), (405, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("id", F.lit(0))
    got = heap_kmeans.cluster(df, clusters=k, rounds=5, dim=4, block=block).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == lloyd(rows, k, 5, 4)


def test_clustering_skips_settled_vectors(spark):
    """Well separated groups: bounds spare nearly all vectors from a second look."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(scale=0.01, size=4) + 100 * (i % 3)]) for i in range(600)]
    got = heap_kmeans.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), clusters=3, rounds=5, dim=4).collect()
    first = {r.cluster for r in got}
    assert len(first) <= 3 and got[0].rescanned < 5 * 600
    assert heap_kmeans.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        heap_kmeans.cluster(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<float>"), dim=4).count()


# -- 11


def ranked(docs, items, top):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = [cut(t) for _, t in docs]
    n_all, l_all = sum(bool(w) for w in words), sum(map(len, words))
    tfs = [Counter(w) for w in words]
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for (i, _), w, tf in zip(docs, words, tfs, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * (50 + 50 * len(w) * n_all // l_all))) for t in set(cut(text)) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaf,top", [(1, 5), (64, 50), (3, 1)])
def test_best_first(leaf, top):
    """Intervals split at the largest impact find what scoring everything finds."""
    rng = np.random.default_rng(leaf)
    n_docs, n_terms = 300, 40
    has = rng.random((n_terms, n_docs)) < rng.random(n_terms)[:, None] ** 2
    term, doc = np.nonzero(has)
    impact = rng.integers(0, 6, len(term)) * 10**9
    questions = [np.flatnonzero(rng.random(n_terms) < 0.3) for _ in range(20)] + [np.zeros(0, dtype=np.int64)]
    rank = rng.permutation(n_docs)
    dense = np.zeros((n_terms, n_docs), dtype=np.int64)
    dense[term, doc] = impact
    got = ranked_search.best_first(ranked_search.Postings(n_docs, term, doc, impact, n_terms), n_docs, questions, rank, top, leaf)
    for q, found in zip(questions, got, strict=True):
        scores = dense[q].sum(0)
        best = sorted((d for d in range(n_docs) if scores[d] > 0), key=lambda d: (-scores[d], rank[d]))[:top]
        assert found == {d: scores[d] for d in best}


def test_best_first_skips_intervals():
    """One document far above all others: most of the block is never scored."""
    n_docs = 4096
    doc = np.arange(n_docs)
    impact = np.ones(n_docs, dtype=np.int64)
    impact[1234] = 10**6
    lists = ranked_search.Postings(n_docs, np.zeros(n_docs, dtype=np.int64), doc, impact, 1)
    seen = []
    whole = lists.scores
    lists.scores = lambda *a: seen.append(a) or whole(*a)
    assert ranked_search.best_first(lists, n_docs, [np.array([0])], doc, 1) == [{1234: 10**6}]
    assert not seen


@pytest.mark.parametrize("terms,block", [(ranked_search.TERMS, ranked_search.BLOCK), (5, 256)])
def test_ranked_search(spark, terms, block):
    rng = random.Random(terms)
    vocabulary = ["alpha", "Beta", "GAMMA", "delta7", "épée", "Ärger", "日本", "x", "of", "the"] + [f"w{i}" for i in range(40)]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(rng.randrange(400), say(rng.choice([0, 1, 3, 20, 60]))) for _ in range(700)] + [(None, "alpha beta"), (None, "alpha beta"), (5, None), (6, ""), (7, "!?"), (8, say(30_000)), (9, "alpha"), (10, "alpha")]
    items = [(1, "Alpha beta, the GAMMA"), (2, "日本 ärger Ärger"), (3, None), (4, ""), (5, "nowhere"), (None, "x of"), (6, say(50)), (6, say(3)), (1, "Alpha beta, the GAMMA")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("rank", F.lit(0)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("score", F.lit(0))
    got = ranked_search.search(d, i, terms=terms, block=block).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=repr) == ranked(docs, items, 50)
    assert ranked_search.search(d.limit(0), i).count() == 0 and ranked_search.search(d, i.limit(0)).count() == 0


# -- 13


def stripped(rows, depth):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + depth] for _, b in texts for s in range(len(b) - depth + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - depth + 1):
            if seen[b[s : s + depth]] > 1:
                gone[s : s + depth] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone]) if len(b) else b""
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i is None, i or 0, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_common_columns():
    """Shared windows of pieces lined up at their anchors, against comparing all pairs."""
    rng = random.Random(3)
    depth = 12
    for _ in range(60):
        m = rng.randint(1, 30)
        at = np.array([rng.randint(0, 8) for _ in range(m)])
        pieces = [bytes(rng.choice(b"ab\x00") if rng.random() < 0.2 else 97 for _ in range(rng.randint(depth, depth + 12) + int(a))) for a in at]
        got = suffix_dedup.common_columns(pieces, at, depth)
        for i in range(m):
            want = set()
            for s in range(len(pieces[i]) - depth + 1):
                for j in range(m):
                    t = s - at[i] + at[j]
                    if j != i and t >= 0 and t + depth <= len(pieces[j]) and pieces[j][t : t + depth] == pieces[i][s : s + depth] and s <= at[i]:
                        want.add(s)
            assert {int(s) for s in got[i] if s <= at[i]} == want


@pytest.mark.parametrize("gram,most", [(8, 20_000), (8, 3), (20, 1), (24, 20_000)])
def test_remove_repeats(spark, gram, most, monkeypatch):
    depth = 24
    rng = random.Random(gram + most)
    say = lambda n: "".join(rng.choice("abcdefgh éß日") for _ in range(n))
    passages = [say(n) for n in (30, 60, 200, 20, 19)]
    rows = [(i, say(rng.randint(0, 80)) + rng.choice(passages) + say(rng.randint(0, 40)) + rng.choice(["", rng.choice(passages)])) for i in range(150)]
    near = say(400)
    for i in range(20):
        at = rng.randrange(400)
        rows.append((200 + i, near[:at] + "#" + near[at + 1 :]))
    rows += [(300, "ab" * 500), (301, "a" * 3000), (302, None), (303, ""), (304, say(23)), (305, say(24)), (306, passages[2]), (306, passages[2]), (None, passages[1]), (307, say(200) * 3), (308, "x" * 24), (308, "y" * 23), (309, "y" * 23)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash")).withColumn("id", F.lit(0)).repartition(3)
    got = suffix_dedup.remove_repeats(df, depth=depth, gram=gram, most=most).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == stripped(rows, depth)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(df.limit(0), depth=depth, gram=gram).count() == 0


def test_long_texts_are_cut_into_chunks(monkeypatch):
    """Anchors of a text made in several chunks: each window is in one piece, with its anchor inside."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    suffix_dedup._powers.cache_clear()
    data = np.frombuffer(random.Random(1).randbytes(1_000), dtype=np.uint8)
    a, lo, n, at = suffix_dedup.anchors(data, 24, 8)
    assert np.array_equal(np.concatenate([np.arange(s, s + m) for s, m in zip(lo, n, strict=True)]), np.arange(1_000 - 23))
    assert [int(suffix_dedup.gram_hashes(data[p : p + 8], 8).view(np.int64)[0]) for p in lo + at] == a.tolist()
    assert (at >= n - 1).all() and (at <= 16).all()
    suffix_dedup._powers.cache_clear()
