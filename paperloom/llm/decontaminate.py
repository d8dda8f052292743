"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and runs of anything but letters and digits become one blank. An item of length L may differ by
``floor(rate * L)`` edits from a passage of the document; it is split into one piece more than that, so at least one
piece occurs unchanged. An automaton finds all piece hits in one pass over the whole text, and Myers' bit-parallel
distance (one big integer a column) verifies the window around them. Windows of an item that overlap are joined first,
so the work for an item in a document is bounded by the document's length.

Documents are never shuffled and no pairs of rows are made: the benchmark is taken in blocks of at most
``BLOCK_CHARS`` characters, and each block's pieces are broadcast to a scan of all documents.

Null or empty texts and items match nothing. Repeated items match each; repeated documents are reported each. Items
shorter than ``LEAST_CHARS`` are only matched unchanged and between word borders. Ties between equal distances go to
the first end. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import parts_for

RATE = 0.06
LEAST_CHARS = 24
BLOCK_CHARS = 2_000_000


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def split_pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """``errors + 1`` pieces (start, end) that cover ``length`` evenly."""
    n = errors + 1
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


def myers_best(pattern_bits: dict[str, int], length: int, text: str, limit: int) -> tuple[int, int] | None:
    """Smallest distance of the pattern to any substring of ``text`` and where that ends; None above ``limit``."""
    full = (1 << length) - 1
    top = 1 << (length - 1)
    pv, mv, score = full, 0, length
    best, best_end = limit + 1, -1
    for j, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, best_end = score, j + 1
            if best == 0:
                break
    return (best, best_end) if best_end >= 0 else None


def bits_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


class Matcher:
    """Piece automaton of one block of items, for use inside a task."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(i, t if len(t) >= LEAST_CHARS else f" {t} ", int(rate * len(t)) if len(t) >= LEAST_CHARS else 0) for i, t in items]
        self.bits: dict[int, dict[str, int]] = {}
        where = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            for a, b in split_pieces(len(t), k):
                where[t[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Item -> joined windows of ``text`` where it may lie, by their start."""
        out: dict[int, list[list[int]]] = {}
        if not self.items:
            return out
        for end, (size, uses) in self.automaton.iter(text):
            for n, at in uses:
                k, length = self.items[n][2], len(self.items[n][1])
                start = end + 1 - size - at
                lo, hi = max(0, start - k), start + length + k
                spans = out.setdefault(n, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(lo, spans[-1][0]), max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        return out

    def matches(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item id, distance, end of the best match, item length)."""
        text = f" {text} "
        for n, spans in self.windows(text).items():
            item, pattern, k = self.items[n]
            at = text.find(pattern, spans[0][0], spans[-1][1])
            if at >= 0:
                yield item, 0, at + len(pattern) - 1, len(pattern)
                continue
            if k == 0:
                continue
            if n not in self.bits:
                self.bits[n] = bits_of(pattern)
            best = None
            for lo, hi in spans:
                got = myers_best(self.bits[n], len(pattern), text[lo:hi], k if best is None else best[0] - 1)
                if got:
                    best = (got[0], lo + got[1] - 1)
            if best:
                yield item, best[0], best[1], len(pattern)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for every (document, item) within the item's error budget: id, item_id, distance, match_end, item_chars."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).cast("string").alias(id_col), normal(F.col(f"`{text}`")).alias("t"))
    items = benchmark.select("item_id", normal(F.col("text")).alias("t")).where("t <> ''")
    total = int(items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"])
    blocks = parts_for(total, block_chars)
    schema = f"{id_col} string, item_id {dict(items.dtypes)['item_id']}, distance int, match_end int, item_chars int"
    out = None
    for block in range(blocks):  # one pass over the documents a block; a block is bounded
        part = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(r["item_id"], r["t"]) for r in part.collect()])

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matcher = Matcher(held.value, rate)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch[id_col], batch["t"], strict=True) for m in matcher.matches(t)]
                yield pd.DataFrame(rows, columns=[id_col, "item_id", "distance", "match_end", "item_chars"])

        found = texts.where("t <> ''").mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumn(id_col, F.col(id_col).cast(kind))
