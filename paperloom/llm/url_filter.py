"""URL filter: rules first, then a character language-model ratio for the rest.

Two interpolated variable-order Markov models (Witten-Bell smoothing) are counted from the URLs that rules accept and
reject; a URL's score is the difference of its log-likelihoods per character. One labelled URL of ``HOLD`` (by checksum)
is not counted: on these the threshold is calibrated, to where both labelled sets have the same distance in standard
deviations (on all labelled URLs if the held-out ones lack a label). Scores are whole millionths and all sums are of
whole numbers, so nothing depends on the order of rows. Only DataFrame functions are used.

Texts meet the table of gram scores in a join. Grams that occur very often are few by their number, so they are
broadcast; the join by shuffle is for the others, none of which can be hot.

A null URL, or one without ``://``, has empty host and path and meets no rule; its text is what there is. Equal URLs
share one score. With no accepted (or no rejected) examples every other URL gets the label that has examples, and
``allow`` if there are none at all. Other columns pass through; those with a name of ``OWN`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import cut, parts_for

#: The rules (verdict, host, path start).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 5
OWN = ["text", "host", "path", "rule", "rule_verdict", "verdict", "score", "threshold"]
START, END = "\x02", "\x03"
HOLD = 5
UNIT = 1_000_000
#: At most so many gram scores (of about 50 bytes) are broadcast: all of them if they are no more, else the most frequent.
BROADCAST_ROWS = 500_000
#: Distinct texts to a task when they are cut into grams.
TEXTS_ROWS = 5_000


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(u, rest, 1), UPPER, LOWER)
    text = F.when(u.contains("://"), F.regexp_replace(u, r"(?s)^.*?://|#.*$", "")).otherwise(u)
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(u, rest, 2)).withColumn("text", text)


def rule_column(kind: str, rules=RULES) -> Column:
    """``kind`` is "name" or "verdict" of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(host + path if kind == "name" else verdict)).otherwise(out)
    return out


def _grams(texts: DataFrame) -> DataFrame:
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("text"), F.lit(END))
    t = texts.withColumn("p", padded).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("text") + 1)))
    return t.withColumn("gram", F.expr(f"substring(p, i, {ORDER})")).drop("p", "i")


def gram_scores(counts: DataFrame) -> DataFrame:
    """``counts(gram, acc, rej)`` of full-length grams -> ``(gram, llr)`` by interpolation from one character upwards."""
    below = None
    for k in range(1, ORDER + 1):
        level = counts.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
        level = level.withColumn("ctx", F.expr(f"left(gram, {k - 1})"))
        sums = level.groupBy("ctx").agg(*[F.sum(c).alias(f"n_{c}") for c in ("acc", "rej")], *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in ("acc", "rej")], F.count("*").alias("v"))
        level = level.join(sums, "ctx")
        if below is None:
            level = level.withColumn("low_acc", 1.0 / (F.col("v") + 1)).withColumn("low_rej", 1.0 / (F.col("v") + 1))
        else:
            level = level.withColumn("tail", F.expr("substring(gram, 2)")).join(below.select(F.col("gram").alias("tail"), F.col("p_acc").alias("low_acc"), F.col("p_rej").alias("low_rej")), "tail")
        for c in ("acc", "rej"):
            n, t, low = F.col(f"n_{c}"), F.col(f"t_{c}"), F.col(f"low_{c}")
            level = level.withColumn(f"p_{c}", F.when(n > 0, (F.col(c) + t * low) / (n + t)).otherwise(low))
        below = level.select("gram", "p_acc", "p_rej")
    return below.select("gram", (F.ln("p_acc") - F.ln("p_rej")).alias("llr"))


def held_out(text: Column) -> Column:
    """Texts that the models do not learn from."""
    return F.crc32(text) % HOLD == 0


def _met(rows: DataFrame, llr: DataFrame) -> DataFrame:
    """``rows(tid, gram)`` with the gram's score in units: frequent grams by broadcast, the others by shuffle."""
    llr = llr.select("gram", "n", F.round(F.col("llr") * UNIT * 1000).cast("long").alias("units"))
    if llr.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(llr.drop("n")), "gram").select("tid", "units")
    # fewer than BROADCAST_ROWS grams can occur more often than this
    often = llr.agg(F.sum("n")).first()[0] / BROADCAST_ROWS
    hot = rows.join(F.broadcast(llr.where(F.col("n") > often).drop("n")), "gram", "left")
    cold = hot.where("units is null").select("tid", "gram").join(llr.where(F.col("n") <= often).drop("n"), "gram")
    return hot.where("units is not null").unionByName(cold).select("tid", "units")


def _threshold(scored: DataFrame) -> float:
    """From ``scored(acc, rej, held, units)``: exact sums of whole numbers over the held-out texts, or over all."""
    wide = F.col("units").cast("decimal(38,0)")
    sums = []
    for name, weight in (("acc", F.col("acc")), ("rej", F.col("rej"))):
        for part, w in (("held", F.when(F.col("held"), weight).otherwise(0)), ("all", weight)):
            w = w.cast("decimal(38,0)")
            sums += [F.sum(w).alias(f"n_{name}_{part}"), F.sum((w * wide).cast("decimal(38,0)")).alias(f"s_{name}_{part}"), F.sum((w * wide * wide).cast("decimal(38,0)")).alias(f"q_{name}_{part}")]
    s = scored.agg(*sums).first()
    part = "held" if s["n_acc_held"] and s["n_rej_held"] else "all"
    n = {c: int(s[f"n_{c}_{part}"] or 0) for c in ("acc", "rej")}
    if not (n["acc"] and n["rej"]):
        return float("inf") if n["rej"] else float("-inf")
    mean = {c: int(s[f"s_{c}_{part}"]) / n[c] for c in n}
    sd = {c: max(int(s[f"q_{c}_{part}"]) / n[c] - mean[c] ** 2, 1.0) ** 0.5 for c in n}
    return (mean["acc"] * sd["rej"] + mean["rej"] * sd["acc"]) / (sd["acc"] + sd["rej"]) / UNIT


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule, verdict, score and threshold to every row of ``pages``."""
    p = parts(pages.drop(*[c for c in OWN if c != url]), url)
    p = p.withColumn("rule", rule_column("name", rules)).withColumn("rule_verdict", rule_column("verdict", rules))
    texts = cut(p.groupBy("text").agg(F.count_if(F.col("rule_verdict") == "allow").alias("acc"), F.count_if(F.col("rule_verdict") == "block").alias("rej")))
    texts = texts.repartition(parts_for(texts.count(), TEXTS_ROWS), "text")
    texts = cut(texts.withColumn("tid", F.monotonically_increasing_id()).withColumn("held", held_out(F.col("text"))))
    learned = texts.withColumns({c: F.when(F.col("held"), 0).otherwise(F.col(c)) for c in ("acc", "rej")})
    counts = cut(_grams(learned).groupBy("gram").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"), F.count("*").alias("n")))
    llr = cut(gram_scores(counts).join(counts.select("gram", "n"), "gram"))
    rows = _grams(texts.select("tid", "text")).select("tid", "gram")
    scores = _met(rows, llr).groupBy("tid").agg((F.sum("units") / F.count("*") / 1000).alias("mean"))
    scored = cut(texts.join(scores, "tid").select("text", "acc", "rej", "held", F.round("mean").cast("long").alias("units")))
    threshold = _threshold(scored)
    scored = scored.withColumn("score", F.col("units") / UNIT)
    judged = scored.select(F.col("text").alias("__t"), "score")
    out = p.join(judged, p["text"] == judged["__t"], "left").drop("__t", "text")
    by_model = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return out.withColumn("verdict", F.coalesce("rule_verdict", by_model)).withColumn("threshold", F.lit(threshold)).drop("rule_verdict")
