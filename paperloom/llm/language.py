"""Language identification with a string kernel.

Features are the presence of character 1- to 3-grams (blended spectrum) of the lower-cased text, hashed to ``BUCKETS``
places; the kernel of two texts is the number of common grams over the root of the product of their numbers. A bounded
set of landmark texts gives a Nyström map, one-versus-rest kernel ridge regression is solved on a bounded sample of
labelled rows (``PER_LANG`` a language, ``MOST_ROWS`` in all), and whole texts are scored in batches by one matrix
product. Only packed presence bits of the sample reach the driver: BUCKETS / 8 bytes a row.

Null texts and texts without a letter are ``und`` with score 0; with no labelled rows everything is ``und``. Rows with
a null label are not learned from. Equal texts get equal predictions; ties go to the first label by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import cut, small

BUCKETS = 1 << 14
PER_LANG = 300
MOST_ROWS = 4000
LANDMARKS = 128
RIDGE = 1e-2
BATCH = 256


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def letters(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " ")), F.lit(" "))


def presence(texts: list[str]) -> np.ndarray:
    """0/1 matrix, one row a text: which hashed 1-, 2- and 3-grams occur in the whole text."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for row, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        grams = [c * np.uint32(0x9E3779B1)]
        two = c[:-1] * np.uint32(0x01000193) + c[1:]
        grams.append(two * np.uint32(0x85EBCA6B))
        three = two[:-1] * np.uint32(0x01000193) + c[2:]
        grams.append(three * np.uint32(0xC2B2AE35))
        for g in grams:
            out[row, g >> shift] = 1.0
    return out


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """Landmark matrix and weights. Rows come in random order; landmarks are dealt evenly over the languages."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    place = np.zeros(len(y), dtype=int)
    for k in range(len(names)):
        place[y == k] = np.arange((y == k).sum())
    chosen = np.argsort(place, kind="stable")[:landmarks]
    norm = lambda m: np.sqrt(np.maximum(m.sum(1), 1.0))
    z = bits[chosen] / norm(bits[chosen])[:, None]
    k_all = (bits / norm(bits)[:, None]) @ z.T
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    values = np.maximum(values, 1e-6)
    root = vectors / np.sqrt(values) @ vectors.T
    phi = k_all.astype(np.float64) @ root
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    target = np.eye(len(names))[y]
    w = np.linalg.solve(phi1.T @ phi1 + ridge * np.eye(phi1.shape[1]), phi1.T @ target)
    return {"names": names, "z": np.packbits(bits[chosen].astype(np.uint8), axis=1), "b": (root @ w[:-1]).astype(np.float32), "bias": w[-1].astype(np.float32)}


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> dict | None:
    """The model, from the ``PER_LANG`` rows a language with the smallest hashes (``None`` without labelled rows).

    Rows are counted by language first; then only rows whose hash lies below their language's share (twice the wanted
    number on average) are turned into presence bits, where they are read. Texts are never shuffled.
    """
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(id_col) & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("y"), F.col(text).alias("t"), F.col(id_col).cast("string").alias("i"))
    counts = small(cut(rows.groupBy("y").agg(F.count("*").alias("all"))), MOST_ROWS)
    rows = rows.withColumn("h", F.xxhash64("i", F.lit(7))).join(counts, "y")
    rows = rows.where(F.pmod("h", F.lit(1 << 40)) * F.col("all") <= F.lit(2 * PER_LANG) * F.lit(1 << 40)).select("y", "h", letters(F.col("t")).alias("t"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                b = batch.iloc[at : at + BATCH]
                packed = np.packbits(presence(list(b["t"])).astype(np.uint8), axis=1)
                yield pd.DataFrame({"y": b["y"].to_numpy(), "h": b["h"].to_numpy(), "bits": [p.tobytes() for p in packed]})

    packed = rows.mapInPandas(pack, "y string, h long, bits binary")
    order = Window.partitionBy("y").orderBy(F.pmod("h", F.lit(1 << 40)), "h", F.xxhash64("bits"))
    packed = packed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_LANG)
    got = packed.orderBy("n", "h", "y").limit(MOST_ROWS).collect()
    if not got:
        return None
    bits = np.unpackbits(np.array([np.frombuffer(r["bits"], dtype=np.uint8) for r in got]), axis=1).astype(np.float32)
    return fit(bits, [r["y"] for r in got])


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias(id_col), held_out(id_col).alias("held_out"), letters(F.col(text)).alias("t"))
    if model is None:
        return rows.select(F.col(id_col).cast(kind).alias(id_col), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        names = np.array(m["names"], dtype=object)
        z = np.unpackbits(m["z"], axis=1).astype(np.float32)
        weights = (z / np.sqrt(np.maximum(z.sum(1), 1.0))[:, None]).T @ m["b"]  # buckets x languages: both products in one
        for batch in batches:
            preds, scores = [], []
            texts = list(batch["t"])
            for at in range(0, len(texts), BATCH):
                x = presence(texts[at : at + BATCH])
                s = (x @ weights) / np.sqrt(np.maximum(x.sum(1), 1.0))[:, None] + m["bias"]
                best = s.argmax(1)
                preds += list(names[best])
                scores += list(np.clip(s[np.arange(len(best)), best], 0.0, 1.0).astype(float))
            bare = [not t.strip() for t in texts]
            yield pd.DataFrame({id_col: batch[id_col], "held_out": batch["held_out"], "lang_pred": ["und" if b else p for b, p in zip(bare, preds, strict=True)], "score": [0.0 if b else s for b, s in zip(bare, scores, strict=True)]})

    got = rows.mapInPandas(score, f"{id_col} string, held_out boolean, lang_pred string, score double")
    return got.withColumn(id_col, F.col(id_col).cast(kind))
