"""Registered queries that have no SQL twin, against brute force over the smallest tables."""

import difflib
import math
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions.fuzzy import _close, indel_ratio, partial
from paperloom.operators import tournament
from paperloom.plans import registry
from paperloom.plans.base import Tables
from paperloom.plans.rows import hierarchy
from paperloom.plans.scoring import MATCHES
from paperloom.plans.texts import TITLE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def common(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def test_ratios(spark, t):
    docs = {r.doc_id: r for r in t.documents.select("doc_id", "lang", "source", TITLE().alias("title")).collect()}
    some = sorted(docs, key=lambda i: len(docs[i].title))[:8]
    whole = {r.doc_id: r.v for r in rows(spark, "g28_fuzzy_ratio")}
    part = {r.doc_id: r.v for r in rows(spark, "g29_fuzzy_partial_ratio")}
    sequence = {r.doc_id: r.v for r in rows(spark, "g30_sequence_ratio")}
    assert set(whole) == set(part) == set(sequence) == set(docs)
    for i in some:
        d = docs[i]
        assert whole[i] == round(ratio(d.title, d.lang[::-1] + d.title))
        short, long_ = d.title, d.source + d.title[::-1]
        n = len(short)
        best = 100.0 if short in long_ else max(ratio(short, long_[max(0, k) : k + n]) for k in [*range(1 - n, 4), *range(len(long_) - n, len(long_))])
        assert part[i] >= round(best)
    for i, d in docs.items():
        assert sequence[i] == pytest.approx(difflib.SequenceMatcher(None, d.title.lower(), (d.source + d.title).lower()).ratio(), abs=1e-6)


def test_fuzzy_title_join(spark, t):
    from paperloom.plans.joining import _asked_titles

    q = {r.v: r.c for r in _asked_titles(t).select(F.col("query").alias("v")).distinct().withColumn("c", tx.match_title(F.col("v"))).collect()}
    c = {r.v: r.c for r in t.documents.select(TITLE().alias("v")).distinct().withColumn("c", tx.match_title(F.col("v"))).collect()}
    got = defaultdict(list)
    for r in rows(spark, "f8_fuzzy_title_join"):
        got[r["query"]].append((r.score, r.title))
    letters = lambda s: {x: s.count(x) for x in set(s)}
    counts = {v: letters(x) for v, x in c.items()}
    for query, clean in q.items():
        own = letters(clean)
        want = []
        for title, other in c.items():
            most = sum(min(n, counts[title].get(x, 0)) for x, n in own.items())
            if 200.0 * most >= 79.5 * (len(clean) + len(other)) and (s := round(indel_ratio(clean, other))) >= 80:
                want.append((s, title))
        assert sorted(got.get(query, []), reverse=True) == sorted(want, reverse=True)[:5]
    exact = {(q, title, s) for q, found in got.items() for s, title in found}
    near = {(r["query"], r.title, r.score) for r in rows(spark, "f8_minhash_title_join")}
    assert len(near & exact) >= 0.9 * len(exact) and len(exact) > 5


def test_rate_limit(spark, t):
    kept, want = defaultdict(list), {}
    events = t.events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()
    for r in sorted(events, key=lambda r: (r.us, r.event_id)):
        inside = [x for x in kept[r.user_id] if x > r.us - 86_400_000_000]
        want[r.event_id] = len(inside) < 3
        kept[r.user_id] = inside + [r.us] * want[r.event_id]
    got = {r.event_id: r.allowed for r in rows(spark, "k1_rate_limit")}
    assert got == want and len(set(got.values())) == 2


def test_elo(spark, t):
    ratings = defaultdict(lambda: 1200.0)
    for m in sorted(MATCHES(t).collect(), key=lambda m: m.seq):
        a, b = (m.metric, m.item_a), (m.metric, m.item_b)
        won = {"A": 1.0, "B": 0.0}.get(m.winner, 0.5)
        gain = 32 * (won - 1 / (1 + 10 ** ((ratings[b] - ratings[a]) / 400)))
        ratings[a], ratings[b] = ratings[a] + gain, ratings[b] - gain
    got = {(r.metric, r["item"]): r.rating for r in rows(spark, "j8_elo")}
    assert set(got) == set(ratings) and all(got[k] == pytest.approx(ratings[k], abs=1e-3) for k in got)


def test_validated_titles(spark, t):
    """Every title of the table against its other form."""
    clean = t.documents.select("doc_id", tx.clean_title(TITLE()).alias("a"), tx.clean_title(F.when(F.col("doc_id") % 2 > 0, F.concat(F.lit("On "), TITLE())).otherwise(F.lit("Unrelated subject matter 123"))).alias("b"))
    want = set()
    for r in clean.collect():
        best = partial(r.a, r.b)  # held against all windows in test_operators
        if round(best) >= 80:
            want.add(r.doc_id)
    assert {r.doc_id for r in rows(spark, "f9_validate_title_match")} == want and want


def test_matched_aspects(spark, t):
    """A paper's label goes to the review most like the aspect, the first of equals."""
    ratio, papers = _close(0.8), defaultdict(list)
    for r in t.documents.select("doc_id", "text").orderBy("doc_id").collect():
        papers[r.doc_id // 20].append((r.doc_id, r.text))
    got = {(r.paper_id, r.ord): r.labels for r in rows(spark, "f16_match_aspects")}
    want = {}
    for docs in papers.values():
        scores = [(-ratio(text, docs[0][1]), place) for place, (_, text) in enumerate(docs)]
        best = min(scores)
        want |= {(docs[0][0], place): "novelty" if place == best[1] and -best[0] >= 0.8 else "" for place in range(len(docs))}
    assert got == want and "novelty" in want.values()


def test_best_rationales(spark, t):
    from pyspark.ml.feature import StopWordsRemover

    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    groups = defaultdict(list)
    for r in t.conversations.select("conv_id", "turn", F.split(F.lower("text"), r"[^\p{L}\p{N}_]+").alias("w"), tx.word_count(F.col("text")).alias("n")).orderBy("turn").collect():
        words = [w for w in r.w or [] if len(w) > 1 and w not in stop]
        groups[r.conv_id].append((r.turn, Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]), r.n))
    got = {r.conv_id: (r.turn, r.score) for r in rows(spark, "j5_best_rationale")}
    assert set(got) == set(groups)
    for conv, texts in groups.items():
        total = sum((c for _, c, _ in texts), Counter())
        if len(total) > 1000:
            continue
        df = Counter(g for _, c, _ in texts for g in c)
        rows_ = []
        for _, c, _ in texts:
            v = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            rows_.append({g: x / norm for g, x in v.items()} if norm else {})
        sums = Counter()
        for v in rows_:
            sums.update(v)
        scores = [sum(x * sums[g] for g, x in v.items()) for v in rows_]
        turn, score = got[conv]
        if total:
            assert score == pytest.approx(max(scores), abs=1e-5) and scores[[x[0] for x in texts].index(turn)] == pytest.approx(max(scores), abs=1e-6)
        else:
            assert turn == max(texts, key=lambda x: (x[2] or 0, -x[0]))[0]


def test_trials(spark, t):
    """Each trial's order by its hashes, replayed one match after the other."""
    keys = [F.xxhash64("seq", F.lit(k), F.lit(0)).alias(f"h{k}") for k in range(10)]
    log = MATCHES(t).select("seq", "metric", "item_a", "item_b", "winner", *keys).collect()
    sums = defaultdict(lambda: [0.0, 0, 0, 0])
    for k in range(10):
        ratings = defaultdict(dict)
        for m in sorted(log, key=lambda m: (f"{m[f'h{k}'] & (2**64 - 1):X}" + str(m.seq).zfill(20))):
            tournament.elo_step(ratings[m.metric], m.item_a, m.item_b, m.winner, 32, 1200, 400)
        for metric, items in ratings.items():
            for item, x in items.items():
                sums[metric, item] = [a + b for a, b in zip(sums[metric, item], x, strict=True)]
    got = {(r.metric, r["item"]): r for r in rows(spark, "j9_melo")}
    assert set(got) == set(sums)
    for key, x in sums.items():
        assert got[key].rating == pytest.approx(x[0] / 10, abs=1e-3) and [got[key].wins, got[key].losses, got[key].ties] == [n // 10 for n in x[1:]]


def test_strengths(spark, t):
    """The stated rounds on dictionaries."""
    wins, played = defaultdict(lambda: defaultdict(float)), defaultdict(lambda: defaultdict(int))
    for m in MATCHES(t).collect():
        w = {"A": 1.0, "B": 0.0}.get(m.winner, 0.5)
        for a, b, x in ((m.item_a, m.item_b, w), (m.item_b, m.item_a, 1 - w)):
            wins[m.metric][a] += x
            played[m.metric][a, b] += 1
    got = {(r.metric, r["item"]): r.strength for r in tournament.bradley_terry(MATCHES(t), most=5).collect()}
    for metric, won in wins.items():
        s = dict.fromkeys(won, 1.0)
        for _ in range(5):
            expected = dict.fromkeys(won, 0.0)
            for (a, b), n in played[metric].items():
                expected[a] += n * max(s[a], 1e-10) / (max(s[a], 1e-10) + max(s[b], 1e-10))
            new = {a: s[a] if expected[a] < 1e-10 else s[a] * won[a] / expected[a] if won[a] > 0 else s[a] * 0.2 for a in s}
            move = max(abs(new[a] - s[a]) for a in s)
            if move < 1e-6:
                break
            top, low = max(new.values()), min(new.values())
            if low < 0.1 * top and top > 0:
                new = {a: 0.1 * top + math.sqrt(x) for a, x in new.items()}
            total = sum(new.values())
            s = {a: x * len(new) / total for a, x in new.items()} if total > 0 else new
        for a in s:
            assert got[metric, a] == pytest.approx(s[a], abs=2e-4)


def graphs_of(t):
    ent, rel = hierarchy(t)
    nodes, edges = defaultdict(list), defaultdict(list)
    for r in ent.orderBy("ord").collect():
        nodes[r.paper_id].append(r)
    for r in rel.orderBy("ord").collect():
        edges[r.paper_id].append((r.source, r.target))
    return nodes, edges


def levels_of(labels, edges):
    left, pairs, out, level = set(labels) | {x for e in edges for x in e}, set(edges), {}, 0
    while free := left - {b for _, b in pairs}:
        out |= dict.fromkeys(free, level)
        left, pairs, level = left - free, {e for e in pairs if e[0] not in free}, level + 1
    return out


def test_graph_texts(spark, t):
    """Entities by level, those on cycles last; details below; bracketed types gone."""
    nodes, edges = graphs_of(t)
    got = {r.paper_id: r.text for r in rows(spark, "j15_graph_to_text")}
    assert set(got) == set(nodes)
    for paper, ents in nodes.items():
        level = levels_of([e.label for e in ents], edges[paper])
        lines = [(level.get(e.label, 2**30), e.ord, f"{e.type}: {e.label}\n {e.detail}") for e in ents]
        assert got[paper] == "\n".join(x[2] for x in sorted(lines))


def test_fluent_texts(spark, t):
    """Numbered claims with their methods and these with their experiments, in the order of the edges."""
    nodes, edges = graphs_of(t)
    got = {r.paper_id: r.text for r in rows(spark, "j16_fluent_text")}
    say = lambda x: f"{x.label}: {x.detail}."
    for paper, ents in nodes.items():
        kind = {e.label: e for e in ents}
        below = defaultdict(list)
        for a, b in edges[paper]:
            below[a].append(b)
        one = lambda k: next((e.label for e in ents if e.type == k), None)
        if one("title") is None or one("primary_area") is None:
            assert paper not in got
            continue
        claims, shown = [e for e in ents if e.type == "claim"], []
        for c, claim in enumerate(claims, 1):
            if not below[claim.label]:
                continue
            methods = []
            for nr, m in enumerate(below[claim.label], 1):
                if m in kind and kind[m].type == "method" and below[m]:
                    tests = [e for e in below[m] if e in kind and kind[e].type == "experiment"]
                    bullets = "\n".join(f"    {sum(bool(below[x.label]) for x in claims[:c])}.{nr}.{k}. {say(kind[e])}" for k, e in enumerate(tests, 1))
                    methods.append((say(kind[m]), bullets))
            number = sum(bool(below[x.label]) for x in claims[:c])
            lines = [f"  {number}.{k}. {s} This method is validated by these experiments:\n{b}" for k, (s, b) in enumerate(methods, 1)]
            shown.append(f"{len(shown) + 1}. {say(claim)} This is done with:\n" + "\n".join(lines))
        head = f"This paper is titled '{one('title')}'. It's about {one('primary_area')}. The key contributions are:"
        want = "\n\n".join([head, "\n\n".join(shown)]) if shown else head
        plain = lambda text: re.sub(r"\d+\.", "#.", text)  # noqa: E731  # the numbers are tested below
        assert plain(got[paper]) == plain(re.sub(r"\s+([.!?;:,)\]}])", r"\1", want)), paper
        tops = re.findall(r"(?m)^(\d+)\. ", got[paper])
        assert tops == [str(n) for n in range(1, len(shown) + 1)]
