"""Time windows in batch (the streams have their own tests) and user-function hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import workspace
from paperloom.operators import encode
from paperloom.plans.base import ORACLE, add
from paperloom.plans.scoring import MATCHES
from paperloom.streaming import operators as st

C = F.col
_events = lambda t: t.events.select("event_id", (C("user_id")).alias("key"), "ts", F.length("props").cast("long").alias("tokens"))
# the twin folds each key's events into the allowed ones of the last day and the decisions
_k1_row = "{'us': %s, 'id': %s, 'kept': %s, 'out': %s}"
_k1_kept = "list_filter(acc.kept, lambda k: k > x.us - 86400000000)"
add("k1_rate_limit", lambda t: st.rate_limit_decisions(_events(t), "3/day"),
    f"""WITH e AS (SELECT user_id AS key, list({_k1_row % ("epoch_us(ts)", "event_id", "[]::BIGINT[]", "[]::STRUCT(id BIGINT, ok BOOLEAN)[]")} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT key, list_reduce(l, lambda acc, x: {_k1_row % ("0::BIGINT", "0::BIGINT", f"CASE WHEN len({_k1_kept}) < 3 THEN list_append({_k1_kept}, x.us) ELSE {_k1_kept} END", f"list_append(acc.out, {{'id': x.id, 'ok': len({_k1_kept}) < 3}})")}, {_k1_row % ("0::BIGINT", "0::BIGINT", "[]::BIGINT[]", "[]::STRUCT(id BIGINT, ok BOOLEAN)[]")}).out AS o FROM e)
SELECT key, o.id AS event_id, o.ok AS allowed FROM (SELECT key, unnest(o) AS o FROM f)""")  # fmt: skip
add("k2_usage_windows", lambda t: st.usage_windows(_events(t), 86400), "SELECT user_id AS key, event_id, count(*) OVER w AS requests, sum(length(props)) OVER w::BIGINT AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)".replace("OVER w::BIGINT", "OVER w").replace("sum(length(props)) OVER w AS tokens", "(sum(length(props)) OVER w)::BIGINT AS tokens"))



def _annotated(t):
    """A written table as a stream in small batches, each annotated once: the sink as it is when all is read."""
    source, out, state = (workspace.new_path(t.spark, n) for n in ("annotate-in", "annotate-out", "annotate-state"))
    t.documents.select("doc_id", "lang", "n_chars").write.option("maxRecordsPerFile", 20_000).parquet(source)
    stream = t.spark.readStream.schema("doc_id long, lang string, n_chars long").option("maxFilesPerTrigger", 8).parquet(source)
    annotate = lambda rows: rows.withColumn("label", F.concat_ws("-", "lang", (C("n_chars") % 5).cast("string")))
    st.incremental_annotate(stream, annotate, out, "doc_id", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


add("k3_incremental_annotate", _annotated, "SELECT doc_id, lang, n_chars, concat_ws('-', lang, n_chars % 5) AS label FROM documents")


def _annotated_by_day(t):
    """Events as a stream in small batches, each annotated once, into a sink dealt by day."""
    source, out, state = (workspace.new_path(t.spark, n) for n in ("annotate-in", "annotate-out", "annotate-state"))
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.unionByName(events.where("event_id % 5 = 0")).write.option("maxRecordsPerFile", 20_000).parquet(source)
    stream = t.spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 8).parquet(source)
    annotate = lambda rows: rows.withColumn("label", F.upper("event_type"))
    writer = st.incremental_annotate_by_day(stream, annotate, out, "event_id", "ts", "3650 days", state)
    with workspace.tasks_of_cores(t.spark):
        run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "event_type", "label")


add("k3_annotate_by_day", _annotated_by_day, "SELECT event_id, event_type, upper(event_type) AS label FROM events")


def _online_elo(t):
    """The Elo stream over the match log, in three runs that go on from each other's state; the last rating of each item.

    It runs in a session of its own, as it needs a state store that holds lists.
    """
    spark = t.spark.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, state = (workspace.new_path(t.spark, n) for n in ("elo-in", "elo-out", "elo-state"))
    log = MATCHES(t).select("seq", "metric", "item_a", "item_b", "winner")
    cuts = log.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    kinds = log.schema

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    for part in range(3):
        held = F.floor((C("seq") - F.lit(cuts["lo"])) * 3 / F.lit(cuts["hi"] - cuts["lo"] + 1)) == part
        log.where(held).write.mode("append").parquet(source)
        ratings = st.online_elo(spark.readStream.schema(kinds).parquet(source))
        ratings.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    last = t.spark.read.parquet(out).groupBy("metric", "item").agg(F.max_by(F.struct("rating", "wins", "losses", "ties"), "batch").alias("x"))
    return last.select("metric", "item", F.round("x.rating", 4).alias("rating"), "x.wins", "x.losses", "x.ties")


add("k4_online_elo", _online_elo, f"SELECT metric, item, rating, wins, losses, ties FROM ({ORACLE['j8_elo']})")


def _letters(texts):
    """Encoder for the hook: letter counts of a few letters."""
    return texts.map(lambda s: [float(s.count(c)) for c in "aeiou"])


add("l1_encoder_hook", lambda t: encode.encode_with(t.documents.select("doc_id", F.lower("text").alias("text")), "text", _letters, "letters").select("doc_id", C("embedding")[0].cast("double").alias("a"), C("embedding")[1].cast("double").alias("e")), "SELECT doc_id, (length(text) - length(replace(lower(text), 'a', '')))::DOUBLE AS a, (length(text) - length(replace(lower(text), 'e', '')))::DOUBLE AS e FROM documents")


def _reply(prompt):
    """Responder for the hook: deterministic, and failing for some prompts."""
    if len(prompt) % 5 == 0:
        raise RuntimeError("no answer")
    return f"Rating: {len(prompt) % 5}", 0.5


add("l2_responder_hook", lambda t: encode.respond_with(t.documents.select("doc_id", "text"), "text", _reply).select("doc_id", "response", "cost"), "SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN '<error>' ELSE 'Rating: ' || (length(text) % 5) END AS response, CASE WHEN length(text) % 5 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS cost FROM documents")
