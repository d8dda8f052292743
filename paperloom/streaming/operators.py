"""Time-window behaviour in batch and as Structured Streaming operators.

``events(key, ts, ...)`` with ``ts`` a timestamp.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.operators.folds import ordered_fold
from paperloom.operators.joins import remaining
from paperloom.operators.tournament import elo_step

#: Seconds of the periods a rule may name.
PERIODS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
#: Rows of a batch to each task that writes them to a sink.
WRITTEN = 20_000


def parse_rule(rule: str) -> tuple[int, int]:
    """``count/period`` -> (count, seconds); anything else is an error."""
    count, _, period = rule.partition("/")
    if not count.strip().isdigit() or int(count) <= 0 or period.strip() not in PERIODS:
        raise ValueError(f"not a rate rule: {rule!r}")
    return int(count), PERIODS[period.strip()]


def decide(times: list[int], kept: list[int], limit: int, span: int) -> tuple[list[bool], list[int]]:
    """Decisions for sorted times (microseconds), and the allowed ones that still count."""
    out, held = [], deque(kept)
    for t in times:
        while held and held[0] <= t - span:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, list(held)


def rate_limit_decisions(events: DataFrame, rule: str, key: str = "key", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, order, allowed): fewer than n allowed events of the key in the period before; denied ones do not count."""
    limit, seconds = parse_rule(rule)
    kinds = dict(events.dtypes)

    def step(kept: list[int], rows: pd.DataFrame) -> pd.DataFrame:
        allowed, kept[:] = decide(rows["us"].tolist(), kept, limit, seconds * 1_000_000)
        return pd.DataFrame({order: rows[order].to_numpy(), "allowed": allowed})

    e = events.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return ordered_fold(e, [key], ["us", order], list, step, lambda kept: None, f"`{order}` {kinds[order]}, allowed boolean")


class _Limiter(StatefulProcessor):
    """Allowed times of a key, cut to the period at every batch and by a timer when the key falls silent."""

    def __init__(self, limit: int, seconds: int, key: str, order: str):
        self.limit, self.seconds, self.key, self.order = limit, seconds, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", self.order])
        kept = [x[0] for x in self.kept.get()]
        allowed, kept = decide(pdf["us"].tolist(), kept, self.limit, self.seconds * 1_000_000)
        self.kept.put([(x,) for x in kept])
        if kept:
            self.handle.registerTimer(kept[-1] // 1000 + self.seconds * 1000)
        yield pd.DataFrame({self.key: pdf[self.key], self.order: pdf[self.order], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self.kept.put([(x[0],) for x in self.kept.get() if x[0] > now - self.seconds * 1_000_000])
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, rule: str, key: str = "key", ts: str = "ts", order: str = "event_id", late: str = "1 minute") -> DataFrame:
    """The same on a stream (RocksDB state store); events later than ``late`` are dropped."""
    limit, seconds = parse_rule(rule)
    kinds = dict(events.dtypes)
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).withColumn("us", F.unix_micros(ts))
    return e.groupBy(key).transformWithStateInPandas(_Limiter(limit, seconds, key, order), f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean", "append", "EventTime")


def usage_windows(events: DataFrame, seconds: int, key: str = "key", ts: str = "ts", tokens: str = "tokens", order: str = "event_id") -> DataFrame:
    """(key, order, requests, tokens) in the period up to each event, it included."""
    e = events.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    w = Window.partitionBy(key).orderBy("__us").rangeBetween(-seconds * 1_000_000, 0)
    return e.select(key, order, F.count("*").over(w).alias("requests"), F.sum(tokens).over(w).alias("tokens"))


def usage_stream(events: DataFrame, period: str, slide: str, key: str = "key", ts: str = "ts", tokens: str = "tokens", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, period, slide), key).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))


def incremental_annotate(stream: DataFrame, annotate: Callable[[DataFrame], DataFrame], out: str, key: str, checkpoint: str):
    """A stream writer: each batch annotates only keys that are not in ``out`` yet and appends them; safe to restart."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            rows = remaining(rows, spark.read.parquet(out), key)[1]
        annotate(rows).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def incremental_annotate_by_day(stream: DataFrame, annotate: Callable[[DataFrame], DataFrame], out: str, key: str, ts: str, late: str, checkpoint: str):
    """The same for rows with an event time: what a batch reads of the sink does not grow with the sink.

    Repeats of a key within ``late`` go in the state store (and its entries with the watermark); rows later than that are
    dropped as late. The sink is dealt by day. Only the first batch of a run can have been written before, by a run that was
    interrupted: it reads the days of its own rows to leave out what is there; later batches read nothing of the sink.
    A batch is held while it is written, as dealing it out reads it twice and the state store would go along each time.
    ``annotate`` must keep ``key`` and ``ts``.
    """
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    done: list[str | None] = [None]  # the run of which a batch is done

    def unwritten(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        span = batch.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if span["lo"] is None or not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return batch
        return remaining(batch, sink_days(spark, out, span["lo"], span["hi"]), key)[1]

    def step(batch: DataFrame, _: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("spark.jobGroup.id")  # of the run; where unknown, all batches look
        batch = batch.withColumn("day", F.to_date(ts)).persist()
        try:
            tasks = batch.count() // WRITTEN + 1
            first = run is None or done[0] != run
            annotate(unwritten(batch) if first else batch).repartitionByRange(tasks, "day", key).write.mode("append").partitionBy("day").parquet(out)
        finally:
            batch.unpersist()
        done[0] = run

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def sink_days(spark, out: str, first, last) -> DataFrame:
    """The sink's rows of some days: only their folders are read."""
    return spark.read.parquet(out).where(F.col("day").between(F.lit(first), F.lit(last)))


class _Elo(StatefulProcessor):
    """Ratings of a metric's items as one map-like list; each batch replays its matches in order."""

    def __init__(self, k: float, base: float, div: float):
        self.k, self.base, self.div = k, base, div

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "item string, rating double, wins long, losses long, ties long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ratings = {x[0]: list(x[1:]) for x in self.items.get()}
        for a, b, w in pd.concat(list(rows)).sort_values("seq")[["item_a", "item_b", "winner"]].itertuples(index=False):
            elo_step(ratings, a, b, w, self.k, self.base, self.div)
        self.items.put([(i, *r) for i, r in ratings.items()])
        yield pd.DataFrame([(key[0], i, *r) for i, r in ratings.items()], columns=["metric", "item", "rating", "wins", "losses", "ties"])

    def close(self) -> None:
        pass


def online_elo(matches: DataFrame, k: float = 32, base: float = 1200, div: float = 400) -> DataFrame:
    """Ratings after each batch of a match stream, by metric (update mode: the last row of an item holds)."""
    return matches.groupBy("metric").transformWithStateInPandas(_Elo(k, base, div), "metric string, item string, rating double, wins long, losses long, ties long", "update", "None")
