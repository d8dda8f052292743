"""Folds, quantiles, stored layouts and streams where one group holds most rows."""

import random
import re
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom import workspace
from paperloom.operators import aggregate, sampling, scoring, tournament
from paperloom.operators.folds import ordered_fold
from paperloom.operators.quantiles import quantiles
from paperloom.sources import layout
from paperloom.streaming import operators as st

# -- folds


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_fold_holds_its_state_only(spark, small_batches):
    """One key with 200,000 rows passes in pieces of at most a batch, in order; nulls and other keys stay apart."""
    n = 200_000
    big = spark.range(n).select(F.lit("big").alias("k"), F.lit(1).alias("j"), F.col("id").alias("o"))
    rest = spark.createDataFrame([(None, 1, 5), (None, 1, 4), ("a", None, 1), ("a", 2, 7), ("b", 2, 3)], "k string, j int, o long")

    def step(state, rows):
        assert len(rows) <= 1000
        for o in rows["o"].tolist():
            assert not state["seen"] or o >= state["last"]
            state["last"], state["seen"], state["sum"] = o, state["seen"] + 1, state["sum"] + o

    out = ordered_fold(big.unionByName(rest).repartition(7), ["k", "j"], ["o"], lambda: {"seen": 0, "last": 0, "sum": 0}, step, lambda s: pd.DataFrame({"seen": [s["seen"]], "sum": [s["sum"]]}), "seen long, sum long", parts=3)
    assert {tuple(r) for r in out.collect()} == {("big", 1, n, n * (n - 1) // 2), (None, 1, 2, 9), ("a", None, 1, 1), ("a", 2, 1, 7), ("b", 2, 1, 3)}


def test_elo_of_one_long_log(spark, small_batches):
    rng = random.Random(1)
    rows = [(i, "m", f"p{rng.randrange(5)}", f"q{rng.randrange(5)}", rng.choice(["A", "B", "tie"])) for i in range(20_000)]
    ratings = {}
    for _, _, a, b, w in rows:
        tournament.elo_step(ratings, a, b, w, 32, 1200, 400)
    rng.shuffle(rows)
    got = tournament.elo(spark.createDataFrame(rows, "seq long, metric string, item_a string, item_b string, winner string")).collect()
    assert {r["item"]: (round(r.rating, 6), r.wins, r.losses, r.ties) for r in got} == {i: (round(x[0], 6), *x[1:]) for i, x in ratings.items()}


def test_rate_limit_of_one_key(spark, small_batches):
    """Thousands of events of one key, with equal times and batches that end within a period."""
    rng = random.Random(2)
    us = sorted(rng.randrange(3_000_000_000) for _ in range(5_000))
    rows = [("k", i, t) for i, t in enumerate(us)] + [(None, 9_000, 5), ("other", 9_001, 5)]
    df = spark.createDataFrame(rows, "key string, event_id long, us long").select("key", "event_id", F.timestamp_micros("us").alias("ts"))
    want, kept = {9_000: True, 9_001: True}, []
    for i, t in enumerate(us):
        kept = [x for x in kept if x > t - 60_000_000]
        want[i] = len(kept) < 7
        kept += [t] * want[i]
    assert {r.event_id: r.allowed for r in st.rate_limit_decisions(df, "7/minute").collect()} == want
    assert st.rate_limit_decisions(df.limit(0), "7/minute").count() == 0


# -- quantiles


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_quantiles_of_a_large_group(spark, few):
    """Distinct values, ties, nulls, one-row and empty groups against NumPy; no exact percentile buffer in the plan."""
    rng = np.random.default_rng(3)
    big = rng.normal(size=60_000).round(6)
    rows = [("big", float(v)) for v in big] + [("ties", float(v)) for v in (1, 1, 1, 2, 2)] + [("one", 5.0), ("none", None), (None, 3.0), (None, 4.0), ("neg", -0.5), ("neg", None), ("neg", 1e300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    asked = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p999": 0.999, "hi": 1.0}
    found = quantiles(df, "v", asked, ["g"], few)
    assert few or "percentile(" not in found._jdf.queryExecution().toString()
    got = {r.g: r for r in found.collect()}
    assert set(got) == {"big", "ties", "one", None, "neg"}
    for g in got:
        values = [v for k, v in rows if k == g and v is not None]
        for name, p in asked.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (g, name)
    whole = quantiles(df, "v", {"mid": 0.5}, few=few).first()
    assert whole.mid == pytest.approx(statistics.median(v for _, v in rows if v is not None), rel=1e-12)
    assert quantiles(df.limit(0), "v", {"mid": 0.5}, ["g"], few).count() == 0
    d = {r.g: r for r in aggregate.describe(df, "v", ["g"]).collect()}
    assert d["none"]["count"] == 0 and d["none"].p50 is None and d[None].p50 == 3.5 and d["ties"].p25 == 1.0


# -- layouts


def scanned(df):
    """Rows that the scan of an executed frame gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    n = 60_000
    df = spark.range(n).select((F.col("id") * 7 % n).alias("k"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("kind"), F.hex(F.xxhash64("id")).alias("v"))
    path = str(tmp_path / "rows")
    layout.write_layout(df, path, "k", "kind", files=4, row_group=64 << 10)
    for key in (0, 12_345, n - 1):
        got = layout.find(spark, path, "k", key)
        assert [r.k for r in got.collect()] == [key]
        assert 0 < scanned(got) < n / 20
    assert scanned(layout.find(spark, path, "k", n + 5)) == 0
    kind = df.where("k = 12345").first()["kind"]
    assert layout.find(spark, path, "k", 12_345, ("kind", kind)).count() == 1
    assert layout.find(spark, path, "k", 12_345, ("kind", "x" if kind == "y" else "y")).count() == 0


def test_stored_neighbours(spark, tmp_path):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40), rng.choice(["citation", "semantic"])) for _ in range(300)} | {(7, 7, "semantic")}
    rows = [(s, t, k, round(rng.random(), 3)) for s, t, k in sorted(edges)]
    df = spark.createDataFrame(rows, "source long, target long, type string, similarity double")
    path = str(tmp_path / "edges")
    layout.write_edges(df, path, files=3)
    for paper in (0, 7, 39, 99):
        for kind in ("citation", "semantic"):
            near = [(t, x) for s, t, k, x in rows if k == kind and s == paper] + [(s, x) for s, t, k, x in rows if k == kind == "semantic" and t == paper]
            want = sorted(near, key=lambda p: (-p[1], p[0]))[:5]
            got = layout.stored_neighbours(spark, path, paper, kind, 5).collect()
            assert [(r.neighbour, r.similarity) for r in sorted(got, key=lambda r: r.r)] == want, (paper, kind)


# -- streams


def annotated(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kinds = "event_id long, ts timestamp"
    stream = lambda: spark.readStream.schema(kinds).parquet(source)
    start = lambda: st.incremental_annotate_by_day(stream(), lambda d: d.withColumn("done", F.lit(True)), out, "event_id", "ts", "2 days", str(tmp_path / "cp"))
    feed = lambda rows: spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    return out, start, feed


def test_annotation_by_day(spark, tmp_path):
    """Repeats within a batch, over batches and after a restart go; rows later than the watermark are dropped."""
    out, start, feed = annotated(spark, tmp_path)
    run = lambda: start().trigger(availableNow=True).start().awaitTermination(120)
    feed([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00"), (1, "2024-01-01 12:00:00")])
    run()
    feed([(2, "2024-01-02 00:00:00"), (3, "2024-01-02 10:00:00")])
    run()
    feed([(4, "2024-01-20 10:00:00")])
    run()
    feed([(5, "2024-01-01 09:00:00"), (6, "2024-01-20 11:00:00"), (4, "2024-01-20 12:00:00")])  # 5 is late
    run()
    got = spark.read.parquet(out)
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4, 6]


def test_an_interrupted_batch_writes_nothing_twice(spark, tmp_path):
    out, start, feed = annotated(spark, tmp_path)
    feed([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00")])
    # what a run had written before it was stopped, without a commit in the checkpoint
    spark.createDataFrame([(1,)], "event_id long").select("event_id", F.to_timestamp(F.lit("2024-01-01 10:00:00")).alias("ts"), F.to_date(F.lit("2024-01-01")).alias("day"), F.lit(True).alias("done")).write.partitionBy("day").parquet(out)
    start().trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_later_batches_of_a_run_do_not_read_the_sink(spark, tmp_path, monkeypatch):
    """Only a run's first batch may have been written before; what later ones read does not grow with the sink."""
    out, _, feed = annotated(spark, tmp_path)
    for n in range(3):
        feed([(n, "2024-01-01 10:00:00"), (0, "2024-01-01 11:00:00")])
    read, own = [], st.sink_days
    monkeypatch.setattr(st, "sink_days", lambda *a: read.append(1) or own(*a))
    spark.createDataFrame([(1,)], "event_id long").select("event_id", F.to_timestamp(F.lit("2024-01-01 10:00:00")).alias("ts"), F.to_date(F.lit("2024-01-01")).alias("day"), F.lit(True).alias("done")).write.partitionBy("day").parquet(out)
    stream = spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = st.incremental_annotate_by_day(stream.where("event_id <> 1 or ts is null"), lambda d: d.withColumn("done", F.lit(True)), out, "event_id", "ts", "2 days", str(tmp_path / "cp"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [0, 1, 2] and len(read) == 1


def test_a_batch_goes_through_the_state_once(spark, tmp_path):
    """Dealing a batch out to be written does not run it again: the state store counts every key once."""
    out, _, feed = annotated(spark, tmp_path)
    for n in range(3):
        feed([(3 * n + i, f"2024-01-0{i + 1} 10:00:00") for i in range(3)])
    stream = spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = st.incremental_annotate_by_day(stream, lambda d: d.withColumn("done", F.lit(True)), out, "event_id", "ts", "20 days", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"] > 0] == [3, 6, 9]
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(9))


def test_a_large_batch_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Also one of a single day; files stay few for a small one, however many partitions a shuffle has."""
    monkeypatch.setattr(st, "WRITTEN", 10)
    out, start, feed = annotated(spark, tmp_path)
    feed([(i, "2024-01-01 10:00:00") for i in range(45)])
    start().trigger(availableNow=True).start().awaitTermination(120)
    assert 3 <= spark.read.parquet(out).select(F.input_file_name()).distinct().count() <= 5
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(45))


def test_a_stream_has_no_more_partitions_than_cores(spark):
    key = "spark.sql.shuffle.partitions"
    was, cores = spark.conf.get(key), spark.sparkContext.defaultParallelism
    try:
        for given, inside in ((str(10 * cores), str(cores)), ("1", "1")):
            spark.conf.set(key, given)
            with workspace.tasks_of_cores(spark):
                assert spark.conf.get(key) == inside
            assert spark.conf.get(key) == given
    finally:
        spark.conf.set(key, was)


def test_a_batch_reads_its_days_only(spark, tmp_path):
    """The sink grows by days; the part that a batch reads of it stays the same."""
    out, sizes = str(tmp_path / "sink"), []
    for days in (3, 30):
        spark.range(days * 100).select("id", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("id") / 100).cast("int")).alias("day")).write.mode("overwrite").partitionBy("day").parquet(out)
        one = st.sink_days(spark, out, "2024-01-02", "2024-01-02")
        sizes.append(scanned(one))
        assert re.search(r"PartitionFilters: \[.*day", one._jdf.queryExecution().toString())
    assert sizes == [100, 100]


def test_cut_keys_are_broadcast(spark):
    """Rows of a drawn class stay where they lie, also where Spark takes no table for small: no task gets a whole class."""
    rows = spark.range(2_000).select("id", (F.col("id") % 2).alias("g"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sampling.capped(rows, "g", "id", {0: 600, 1: 400})
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {0: 600, 1: 400}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_rationales_of_large_groups(spark, monkeypatch):
    """Groups dealt out by gram give what groups worked on whole give; whole ones are shuffled once, as texts."""
    rng = random.Random(9)
    rows = [(k, i, " ".join(rng.choice(["graph", "novel", "method", "the", "Zug", "müde", "x1"]) for _ in range(rng.randint(0, 30)))) for k in (1, 2, None) for i in range(40)]
    rows += [(2, 5, "graph novel graph"), (3, 1, "the of"), (3, 2, "the and of"), (3, 3, None), (4, 0, ""), (5, 1, "same words"), (5, 2, "same words"), (1, 99, "")]
    e = spark.createDataFrame(rows, "k int, i int, t string")
    whole = scoring.best_rationale(e, "k", "t", "i", features=12)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    whole = sorted(map(tuple, whole.collect()), key=str)
    assert len(whole) == 6 and {(3, 2, 0.0), (4, 0, 0.0), (5, 1, 2.0)} <= set(whole) and all(s > 2 for k, _, s in whole if k in (1, 2, None))
    for chars in (0, 1500):
        monkeypatch.setattr(scoring, "GROUP_CHARS", chars)
        for names in (0, 10):
            monkeypatch.setattr(scoring, "BROADCAST_ROWS", names)
            got = sorted(map(tuple, scoring.best_rationale(e, "k", "t", "i", features=12).collect()), key=str)
            assert [r[:2] for r in got] == [r[:2] for r in whole] and [r[2] for r in got] == pytest.approx([r[2] for r in whole], abs=1e-8)
