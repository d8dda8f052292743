"""Ranked lexical search: posting lists with range-maximum tables, searched best interval first.

Terms are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. One pass over the texts writes, for every
block of documents, how often each term of the questions occurs in each (a table in the shared folder); document and term
counts are added up from it. A second pass reads the blocks: each posting list becomes an array of impacts (what the term
adds to a document's score) with a sparse table over it, so the largest impact within any interval of documents is two
look-ups. For each question, a heap holds intervals of documents by the sum of its terms' largest impacts there, which no
document inside can exceed. The best interval is taken, split at the document of its largest impact, which is scored
exactly, and the two rests go back with bounds of their own; intervals of at most ``LEAF`` documents are scored whole.
Intervals whose bound is below the score of the best ``top`` so far are dropped. All questions take their steps together,
so that a step is a few array operations. Each block gives at most ``top`` documents a question; a window picks the final ones.

Questions come in groups of a bounded number of terms (``TERMS``); each group's terms and weights are broadcast, and its
results written, before the next. Documents to a block follow from the number of terms, so that a task's arrays stay small.

Cases: null and empty texts have no terms and are never results; questions without terms have no results. Questions with
equal id and text are one; with equal id and other texts each is ranked apart. Repeated documents are results of their
own. Equal scores go by ascending document id, documents without an id last. Empty tables give an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import cut, new_path, parts_for, release, written

TOP = 50
#: Terms (with repeats between questions) to a group of questions.
TERMS = 20_000
#: Documents to a block, and how many (term, document) places the block's table of positions may have.
BLOCK, PLACES = 4_096, 12_000_000
#: Intervals of so many documents are scored whole.
LEAF = 64
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SHIFT = 13  # room for the number of a document within its block


def terms_of(text: str | None) -> list[bytes]:
    """In UTF-8, every byte of a non-ASCII character is above 0x7F, and ``lower`` of bytes changes A-Z only."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Postings:
    """The posting lists of one block: impacts of each term by document, and range-maximum tables over them."""

    def __init__(self, n_docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        self.term, self.doc = term[order], doc[order]
        self.base = np.searchsorted(self.term, np.arange(n_terms + 1))
        # at[t, d]: how many documents before d the list of t holds
        self.at = np.zeros((n_terms, n_docs + 1), dtype=np.int32)
        self.at[self.term, self.doc + 1] = 1
        np.cumsum(self.at, axis=1, out=self.at)
        # the largest impact comes with its document, the smaller one of equals
        packed = (impact[order] << _SHIFT) | ((1 << _SHIFT) - 1 - self.doc)
        self.tables = [packed]
        most = int(np.diff(self.base).max()) if n_terms else 0
        while 2 << (len(self.tables) - 1) <= most:
            last, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.maximum(last[:-half], last[half:]))
        self.flat = np.concatenate(self.tables)
        self.starts = np.cumsum([0, *[len(t) for t in self.tables]])[:-1]

    def span(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of ``term`` in documents [lo, hi) stand."""
        return self.base[term] + self.at[term, lo], self.base[term] + self.at[term, hi]

    def largest(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Largest packed impact of each term within its interval of documents; 0 if it has none."""
        a, b = self.span(term, lo, hi)
        held = b > a
        out = np.zeros(len(term), dtype=np.int64)
        a, n = a[held], (b - a)[held]
        level = np.frexp(n.astype(np.float64))[1] - 1
        first = self.starts[level] + a
        out[held] = np.maximum(self.flat[first], self.flat[first + n - (1 << level)])
        return out

    def scores(self, term: np.ndarray, slot: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, slots: int) -> np.ndarray:
        """Exact scores of all documents of short intervals: a row a slot, ``width`` documents from ``lo`` on."""
        a, b = self.span(term, lo, hi)
        n = b - a
        places = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        cell = np.repeat(slot * width - lo, n) + self.doc[places]
        out = np.zeros(slots * width, dtype=np.int64)
        np.add.at(out, cell, self.tables[0][places] >> _SHIFT)
        return out.reshape(slots, width)


def best_first(lists: Postings, n_docs: int, questions: list[np.ndarray], rank: np.ndarray, top: int, leaf: int = LEAF) -> list[dict[int, int]]:
    """For each question (an array of terms) its best documents: {document: score}; ``rank`` orders documents of equal score."""
    best: list[list[tuple[int, int, int]]] = [[] for _ in questions]  # heaps of (score, -rank, document), worst first
    heaps: list[list[tuple[int, int, int]]] = [[] for _ in questions]  # (-bound, lo, hi)

    def offer(q: int, doc: int, score: int) -> None:
        if score > 0:
            entry = (score, -int(rank[doc]), doc)
            if len(best[q]) < top:
                heapq.heappush(best[q], entry)
            elif entry > best[q][0]:
                heapq.heapreplace(best[q], entry)

    def flat(asked: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(questions[q]) for q, _, _ in asked])
        slot = np.repeat(np.arange(len(asked)), sizes)
        lo, hi = np.array([x[1] for x in asked]), np.array([x[2] for x in asked])
        return np.concatenate([questions[q] for q, _, _ in asked]), slot, lo[slot], hi[slot], np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def bounds(asked: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the terms' largest impacts, the largest of them with its document) of each interval."""
        term, _, lo, hi, starts = flat(asked)
        packed = lists.largest(term, lo, hi)
        return np.add.reduceat(packed >> _SHIFT, starts), np.maximum.reduceat(packed, starts)

    whole = [(q, 0, n_docs) for q, terms in enumerate(questions) if len(terms) and n_docs]
    if whole:
        for (q, lo, hi), bound in zip(whole, bounds(whole)[0].tolist(), strict=True):
            if bound > 0:
                heaps[q].append((-bound, lo, hi))
    active = [q for q, _, _ in whole]
    while active:
        wide, short = [], []
        for q in active:
            heap = heaps[q]
            if heap and not (len(best[q]) == top and -heap[0][0] < best[q][0][0]):
                _, lo, hi = heapq.heappop(heap)
                (short if hi - lo <= leaf else wide).append((q, lo, hi))
            else:
                heap.clear()
        if short:
            term, slot, lo, hi, _ = flat(short)
            for (q, start, _), row in zip(short, lists.scores(term, slot, lo, hi, leaf, len(short)), strict=True):
                least = best[q][0][0] if len(best[q]) == top else 1
                for d in np.flatnonzero(row >= least).tolist():
                    offer(q, start + d, int(row[d]))
        if wide:
            split = (1 << _SHIFT) - 1 - (bounds(wide)[1] & ((1 << _SHIFT) - 1))
            at = [(q, int(d), int(d) + 1) for (q, _, _), d in zip(wide, split, strict=True)]
            for (q, d, _), score in zip(at, bounds(at)[0].tolist(), strict=True):  # an interval of one document: its score
                offer(q, d, score)
            rests = [x for (q, lo, hi), (_, d, _) in zip(wide, at, strict=True) for x in ((q, lo, d), (q, d + 1, hi)) if x[2] > x[1]]
            for (q, lo, hi), bound in zip(rests, bounds(rests)[0].tolist() if rests else [], strict=True):
                if bound > 0 and not (len(best[q]) == top and bound < best[q][0][0]):
                    heapq.heappush(heaps[q], (-bound, lo, hi))
        active = [q for q in active if heaps[q]]
    return [{d: s for s, _, d in b} for b in best]


def _group_hits(docs: DataFrame, kind: str, questions: list, top: int, block: int) -> DataFrame:
    """(question, doc_id, score): at most ``top`` rows a question and block. ``questions`` are one group's (number, text)."""
    spark = docs.sparkSession
    asked = [(r["number"], sorted(set(terms_of(r["text"])))) for r in questions]
    names = sorted({t for _, ts in asked for t in ts})
    number = {t: i for i, t in enumerate(names)}
    n_terms = len(names)
    block = max(256, min(block, PLACES // max(1, n_terms), 1 << _SHIFT))
    held = spark.sparkContext.broadcast((number, [(q, np.array([number[t] for t in ts], dtype=np.int64)) for q, ts in asked]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value[0]
        ids, sizes, term, doc, tf = [], [], [], [], []

        def made() -> pd.DataFrame:
            t = np.array(term, dtype=np.int32)
            used, df = np.unique(t, return_counts=True)
            row = {"ids": [list(ids)], "sizes": [np.array(sizes, dtype=np.int64).tobytes()], "n_docs": [sum(n > 0 for n in sizes)], "n_terms": [sum(sizes)]}
            row |= {"term": [t.tobytes()], "doc": [np.array(doc, dtype=np.int32).tobytes()], "tf": [np.array(tf, dtype=np.int32).tobytes()], "used": [used.tolist()], "df": [df.tolist()]}
            for x in (ids, sizes, term, doc, tf):
                x.clear()
            return pd.DataFrame(row)

        for batch in batches:
            for i, text in zip(batch["id"], batch["text"], strict=True):
                words = terms_of(text)
                for w, n in Counter(words).items():
                    t = known.get(w)
                    if t is not None:
                        term.append(t)
                        doc.append(len(ids))
                        tf.append(n)
                ids.append(i)
                sizes.append(len(words))
                if len(ids) == block:
                    yield made()
        if ids:
            yield made()
        release()

    schema = "ids array<string>, sizes binary, n_docs long, n_terms long, term binary, doc binary, tf binary, used array<int>, df array<long>"
    blocks = written(docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(count, schema), "search-blocks")
    total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    n_all, l_all = int(total["n"]), int(total["l"])
    found = blocks.select(F.explode(F.arrays_zip("used", "df")).alias("x")).groupBy(F.col("x.used").alias("t")).agg(F.sum("x.df").alias("n")).collect()
    weight = np.zeros(n_terms, dtype=np.int64)
    for r in found:
        weight[r["t"]] = math.floor(1000 * math.log((2 * n_all + 2) / (2 * r["n"] + 1)))
    weights = spark.sparkContext.broadcast(weight)
    numeric = kind in ("bigint", "int", "smallint", "tinyint")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, w = held.value[1], weights.value
        for batch in batches:
            for r in batch.itertuples():
                ids, n = list(r.ids), np.frombuffer(r.sizes, dtype=np.int64)
                term, doc, tf = (np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in (r.term, r.doc, r.tf))
                m = 50 + np.array([50 * int(x) * n_all // l_all for x in n], dtype=np.int64) if l_all else np.full(len(n), 50)
                impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                order = sorted(range(len(ids)), key=lambda d: (ids[d] is None, int(ids[d]) if numeric and ids[d] is not None else ids[d] or ""))
                rank = np.empty(len(ids), dtype=np.int64)
                rank[order] = np.arange(len(ids))
                lists = Postings(len(ids), term, doc, impact, n_terms)
                hits = best_first(lists, len(ids), [ts for _, ts in asked], rank, top)
                rows = [(q, ids[d], s) for (q, _), found in zip(asked, hits, strict=True) for d, s in found.items()]
                yield pd.DataFrame(rows, columns=["question", "doc_id", "score"])
        release()

    hits = blocks.select("ids", "sizes", "term", "doc", "tf").mapInPandas(search, "question long, doc_id string, score long")
    best = Window.partitionBy("question").orderBy(F.desc("score"), F.col("doc_id").cast(kind).asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", terms: int = TERMS, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``top`` best documents."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    # groups by hash; a text has fewer terms than half its length
    total = asked.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0)).cast("long").alias("n")).first()["n"]
    groups = parts_for(total, 5 * terms)
    asked = cut(asked.withColumn("number", F.monotonically_increasing_id()).withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))))
    path = new_path(spark, "search-hits")
    for g in range(groups):
        some = asked.where(F.col("g") == g).select("number", "text").collect()  # at most about 5 * ``terms`` terms
        if some:
            _group_hits(d, kinds[0], some, top, block).write.mode("append").parquet(path)
    schema = "question long, doc_id string, score long, rank int"
    hits = spark.read.schema(schema).parquet(path) if total else spark.createDataFrame([], schema)
    out = hits.join(asked.select(F.col("number").alias("question"), "item_id"), "question")
    return out.select(F.col("item_id").cast(kinds[1]).alias("item_id"), "rank", F.col("doc_id").cast(kinds[0]).alias("doc_id"), "score")
