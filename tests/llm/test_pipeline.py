"""The pipeline on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as cp

WORDS = "the of and into signal graph paper method result under above never river stone light sound table window garden market".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    d = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, text(rng, rng.randint(40, 80)) + (f" mail me at a.b{i}@c.example now" if i % 10 == 0 else ""), "en", f"src{i % 4}") for i in range(120)]
    bench = [(i, text(rng, 30)) for i in range(3)]
    near = docs[5][1].replace(docs[5][1].split()[20], "changed", 1)
    docs += [(200, docs[5][1], "en", "src1"), (201, near, "en", "src2"), (202, "##!! %%% @@@ |||| " * 20, "en", "src0"), (203, text(rng, 20) + " " + bench[1][1] + " " + text(rng, 20), "en", "src3"), (204, text(rng, 60) + " mail me at a.b@c.example now", "en", "src3"), (205, None, None, None), (206, "", "en", "src0"), (7, docs[7][1], "en", "src0"), (None, text(rng, 50), "en", "src0")]
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").select(cp.COLUMNS)
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, corpus)
        if k + 1 < len(cp.STAGES):
            assert docs.columns == cp.COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect())
    assert 202 not in kept["quality"] and {200, 201, 203, 204, 205, 206, -1} <= set(kept["quality"])
    assert not {200, 201} & set(kept["near_duplicates"]) and 5 in kept["near_duplicates"]
    assert kept["near_duplicates"].count(7) == 1 and {205, 206, -1} <= set(kept["near_duplicates"])
    assert 203 not in kept["decontaminate"] and len(kept["decontaminate"]) == len(kept["near_duplicates"]) - 1
    private = spark.read.parquet(str(tmp_path / "personal_data"))
    assert private.count() == len(kept["decontaminate"])
    row = private.where("doc_id = 204").first()
    assert row.text.endswith("mail me at [EMAIL] now") and row.n_chars == len(row.text)
    mix = docs.collect()
    sources = {r.source: (r.source_size, r.target) for r in mix}
    for s, (_, target) in sources.items():
        assert abs(sum(r.taken for r in mix if r.source == s) - target) < 1
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * sum(n for n, _ in sources.values()))


def test_empty_corpus(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").select(cp.COLUMNS).limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0
