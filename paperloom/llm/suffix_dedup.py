"""Removal of repeated byte strings: column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

A byte goes if a string of ``DEPTH`` bytes that covers it also starts anywhere else, in the same or another document.

Documents are cut to pieces, so that the work of a collection is bounded and its rounds are few:

1. Every window of ``DEPTH`` bytes picks the anchor (``GRAM`` bytes) of smallest hash within it. Equal windows pick equal
   anchors at the same place within them, so they can only meet in pieces (the windows that pick one anchor) of equal anchor.
   Anchors that occur once in all documents need no second look: none of their windows is repeated.
2. Pieces of equal anchor and equal bytes are one; if it stands at several places, all its windows are repeated. Only
   anchors with several different pieces go on, and only one copy of each piece.
3. Pieces are dealt by anchor into collections of bounded size, lined up at their anchors. Column by column from the right,
   one symbol of each piece is inserted: the symbols in the order of the suffixes behind them are the column's part of the
   transform, sorting them stably gives the order of the longer suffixes, and the common prefix with the one before is one
   more than the smallest common prefix between their places in the column before (by a range-minimum table), up to
   ``DEPTH``. Suffixes that share ``DEPTH`` bytes stand in the same column, so a column's part is not needed beyond the
   next column, and is read and written front to back once. Neighbours with ``DEPTH`` common bytes are repeated windows.
4. Anchors with more than ``MOST`` different pieces (a short passage in very many surroundings) are split: neighbouring
   windows (``STEPS``, fewer each time) go by the bytes that all of them share; in the last split each window is a part of
   its own, so that different parts of one key are left only where hashes collide.

Repeated windows come together by document; the rest of its bytes are kept. Documents are told apart by two 64-bit hashes
of their text, so copies of a text are looked at once; all windows of a text that several rows hold are repeated.

Cases: null texts are empty; texts below ``DEPTH`` bytes keep all; repeated rows are copies of each other and lose all bytes
if they have ``DEPTH`` of them; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import cut, forget, parts_for, release, small, written

DEPTH = 200
GRAM = 48
#: Different pieces of one anchor that stay together in one collection, and pieces to a collection.
MOST = 20_000
COLLECTION = 16_000
#: How many neighbouring windows stay together when the pieces of a too frequent anchor are split, first and then.
STEPS = (16, 1)
#: Bytes whose hashes are made at once.
CHUNK = 1 << 19
SEED = 20240613

#: ``spot`` packs the first window's place, the number of windows and the anchor's place in the piece.
PIECE = "anchor long, digest long, h1 long, h2 long, spot long"
#: Some windows of the piece (p1, p2): ``n`` from the ``first`` on; ``at`` is the anchor's place in ``body``.
PARTS = "p1 long, p2 long, key long, digest long, at int, first int, n int, body binary"
RUNS = "p1 long, p2 long, first int, n int"


@cache
def _tables() -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng(SEED)
    base = int(rng.integers(1, 1 << 62)) * 2 + 1
    return rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


@cache
def _powers(x: np.uint64) -> np.ndarray:
    """Powers of ``x`` for all places of a chunk and the bytes that its last windows reach beyond it."""
    out = np.full(CHUNK + 2 * DEPTH, x, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at every place: mixed polynomial hashes, from differences of one running sum."""
    table, base, inverse = _tables()
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * _powers(base)[: len(data)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * _powers(inverse)[: len(data) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _window_least(key: np.ndarray, w: int) -> np.ndarray:
    """Smallest key of every ``w`` neighbouring ones: running minima of blocks of ``w`` from both ends."""
    n = len(key)
    blocks = -(-n // w)
    grid = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = key
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, number of windows, anchor's place from the first window) of the runs of windows of ``data`` that pick one anchor."""
    span, out = depth - gram + 1, []
    low = np.uint64((1 << 20) - 1)
    assert CHUNK + depth < 1 << 20
    for at in range(0, len(data) - depth + 1, CHUNK):
        part = data[at : at + CHUNK + depth - 1]
        h = gram_hashes(part, gram)
        # of equal hashes the last one: places count down in the low bits
        key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        place = (low - (_window_least(key, span) & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((h[place[first]].view(np.int64), first + at, np.diff(np.concatenate([first, [len(place)]])), place[first] - first))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _bytes_of(column: pa.Array) -> Iterator[memoryview]:
    """UTF-8 bytes of a text column without making strings."""
    for x in column:
        b = x.as_buffer() if x.is_valid else None
        yield memoryview(b) if b is not None else memoryview(b"")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("__t", t).withColumn("h1", F.xxhash64("__t")).withColumn("h2", F.xxhash64(F.lit(SEED), "__t"))


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _marks(keyed: DataFrame, depth: int, gram: int) -> DataFrame:
    """All pieces of all documents (PIECE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            out = []
            for k, raw in enumerate(_bytes_of(batch.column("__t"))):
                a, lo, n, at = anchors(np.frombuffer(raw, dtype=np.uint8), depth, gram)
                digests = (xxhash.xxh3_64_intdigest(raw[s : s + m + depth - 1]) for s, m in zip(lo.tolist(), n.tolist(), strict=True))
                out.append((a, np.fromiter(digests, dtype=np.uint64, count=len(lo)).view(np.int64), np.full(len(a), h1[k]), np.full(len(a), h2[k]), lo << 16 | n << 8 | at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor", "digest", "h1", "h2", "spot"])
        release()

    return keyed.where(F.octet_length("__t") >= depth).select("__t", "h1", "h2").mapInArrow(run, PIECE)


def common_columns(pieces: list[bytes], anchor: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each piece its windows (counted from its first) that another piece of the collection holds too.

    ``anchor``: where each piece's anchor stands. Pieces are lined up at their anchors.
    """
    m = len(pieces)
    sizes = np.array([len(p) for p in pieces])
    left, right = int(anchor.max()), int((sizes - anchor).max())
    begins, ends = left - anchor, left - anchor + sizes
    symbols = np.zeros((left + right, m), dtype=np.uint8)
    for i, p in enumerate(pieces):
        symbols[begins[i] : ends[i], i] = np.frombuffer(p, dtype=np.uint8)
    order, prefix = np.arange(m), np.zeros(m, dtype=np.int16)
    found = []
    for column in range(left + right - 1, -1, -1):
        # the column's part of the transform: bytes in the order of the suffixes behind them; 0 is outside of a piece
        inside = (begins <= column) & (column < ends)
        transform = np.where(inside, symbols[column] + np.uint16(1), np.uint16(0))[order]
        place = np.argsort(transform, kind="stable")
        symbol, order = transform[place], order[place]
        prefix = _prefixes(prefix, place, symbol, depth)
        if column <= left:
            full = np.flatnonzero(prefix >= depth)
            if len(full):
                both = np.unique(np.concatenate([order[full], order[full - 1]]))
                found.append((both, column - begins[both]))
    if not found:
        return [np.zeros(0, dtype=np.int64)] * m
    who, window = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((window, who))
    who, window = who[by], window[by]
    cuts = np.searchsorted(who, np.arange(m + 1))
    return [window[cuts[i] : cuts[i + 1]] for i in range(m)]


def _prefixes(before: np.ndarray, place: np.ndarray, symbol: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of neighbours after a column: one more than the least ones between their places before it."""
    new = np.zeros(len(before), dtype=np.int16)
    at = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0))
    if len(at) == 0:
        return new
    first, last = place[at] + 1, place[at + 1] + 1
    level = np.frexp((last - first).astype(np.float64))[1] - 1
    table, least = before, np.empty(len(at), dtype=np.int16)
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        on = np.flatnonzero(level == k)
        least[on] = np.minimum(table[first[on]], table[last[on] - (1 << k)])
    new[at + 1] = np.minimum(least + 1, depth)
    return new


def _runs(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the runs of neighbouring windows."""
    start = np.flatnonzero(np.concatenate([[True], np.diff(windows) > 1])) if len(windows) else np.zeros(0, dtype=np.int64)
    return windows[start], np.diff(np.concatenate([start, [len(windows)]]))


def _compared(parts: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The repeated windows of ``parts`` (RUNS), and the parts of keys that have too many different ones."""
    kinds = cut(parts.groupBy("key", "digest").agg(F.count("*").alias("copies")))
    keys = cut(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    copied = small(cut(kinds.where("copies > 1").select("key", "digest")))
    whole = parts.select("p1", "p2", "key", "digest", "first", "n").join(copied, ["key", "digest"]).select("p1", "p2", "first", "n")
    fit, over = keys.where(F.col("kinds") <= most), keys.where(F.col("kinds") > most).select("key")
    groups = parts_for(int(fit.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("n")).first()["n"]), COLLECTION)

    def collection(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        hits = common_columns(list(batch["body"]), batch["at"].to_numpy(), depth)
        for p1, p2, first, windows in zip(batch["p1"], batch["p2"], batch["first"], hits, strict=True):
            out += [(p1, p2, first + a, b) for a, b in zip(*_runs(windows), strict=True)]
        release()
        return pd.DataFrame(out, columns=["p1", "p2", "first", "n"])

    one = parts.join(small(cut(fit.select("key"))), "key").groupBy("key", "digest").agg(F.first(F.struct("p1", "p2", "at", "first", "body")).alias("x"))
    dealt = one.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g"), "x.*")
    found = dealt.groupBy("g").applyInPandas(collection, RUNS)
    rest = parts.join(small(cut(over)), "key") if not over.isEmpty() else None
    return whole.unionByName(found), rest


def _split(parts: DataFrame, step: int, depth: int) -> DataFrame:
    """The same windows, ``step`` neighbouring ones a part, keyed by the bytes that all windows of such a part share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 1_000):
                rows = []
                for r in batch.iloc[lo : lo + 1_000].itertuples():
                    # borders count from the anchor, so they are the same in all pieces of a key
                    for b in range(-r.at // step, (r.n - 1 - r.at) // step + 1):
                        edge = r.at + b * step
                        s, e = max(0, edge), min(r.n, edge + step)
                        body = r.body[s : e + depth - 1]
                        key = xxhash.xxh3_64_intdigest(b"%d:%d:" % (r.key, b) + r.body[edge + step - 1 : edge + depth])
                        rows.append((r.p1, r.p2, _long(key), _long(xxhash.xxh3_64_intdigest(body)), r.at - s, r.first + s, e - s, body))
                yield pd.DataFrame(rows, columns=["p1", "p2", "key", "digest", "at", "first", "n", "body"])

    return parts.select("p1", "p2", "key", "digest", "at", "first", "n", "body").mapInPandas(run, PARTS)


def _fetched(wanted: DataFrame, keyed: DataFrame, depth: int) -> DataFrame:
    """Bodies of the pieces ``wanted(anchor, digest, h1, h2, spot)`` (PARTS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw, pieces in zip(_bytes_of(batch.column("__t")), batch.column("pieces"), strict=True):
                for x in pieces.as_py():
                    lo, n, at = x["spot"] >> 16, x["spot"] >> 8 & 255, x["spot"] & 255
                    rows.append((x["anchor"], x["digest"], x["anchor"], x["digest"], at, 0, n, bytes(raw[lo : lo + n + depth - 1])))
            frame = pd.DataFrame(rows, columns=["p1", "p2", "key", "digest", "at", "first", "n", "body"])
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([(c, pa.int64()) for c in ("p1", "p2", "key", "digest")] + [(c, pa.int32()) for c in ("at", "first", "n")] + [("body", pa.binary())]), preserve_index=False)
        release()

    texts = keyed.select("h1", "h2", "__t").dropDuplicates(["h1", "h2"])
    of_text = wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("anchor", "digest", "spot")).alias("pieces"))
    return texts.join(of_text, ["h1", "h2"]).select("__t", "pieces").mapInArrow(run, PARTS)


def repeated_spans(keyed: DataFrame, depth: int = DEPTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(h1, h2, spans): for each text with repeated windows the [start, end) they cover; a span (0, -1) is the whole text."""
    spark = keyed.sparkSession
    marks = written(_marks(keyed, depth, gram), "repeat-marks")
    own = F.xxhash64("h1", "h2", "spot")
    seen = cut(marks.select("anchor", own.alias("x")).groupBy("anchor").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a <> b").select("anchor"))
    pieces = written(marks.join(small(seen), "anchor").distinct(), "repeat-pieces")
    forget(spark)
    least = F.min("x").alias("a"), F.max("x").alias("b"), *[F.min_by(c, "x").alias(c) for c in ("h1", "h2", "spot")]
    kinds = written(pieces.withColumn("x", own).groupBy("anchor", "digest").agg(*least), "repeat-kinds")
    several = small(cut(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")))
    parts = written(_fetched(kinds.join(several, "anchor").select("anchor", "digest", "h1", "h2", "spot"), keyed, depth), "repeat-parts")
    forget(spark)
    found, rest = _compared(parts, depth, most)
    for step in STEPS:
        if rest is None:
            break
        parts = written(_split(rest, step, depth), "repeat-parts")
        more, rest = _compared(parts, depth, most)
        found = found.unionByName(more)
    if rest is not None:  # only where many different windows share a 64-bit hash
        found = found.unionByName(_compared(rest, depth, 1 << 62)[0])
    found = written(found, "repeat-runs")
    forget(spark)
    place = F.shiftright("spot", 16)
    whole = kinds.where("a <> b").select("anchor", "digest", F.lit(0).alias("first"), F.lit(None).cast("int").alias("n"))
    runs = cut(whole.unionByName(found.select(F.col("p1").alias("anchor"), F.col("p2").alias("digest"), "first", "n")))
    n = F.coalesce("n", F.shiftright("spot", 8).bitwiseAND(255).cast("int"))
    covers = pieces.join(small(runs), ["anchor", "digest"]).select("h1", "h2", (place + F.col("first")).alias("s"), (place + F.col("first") + n - 1 + depth).alias("e"))
    copies = keyed.where(F.octet_length("__t") >= depth).groupBy("h1", "h2").count().where("count > 1")
    covers = covers.unionByName(copies.select("h1", "h2", F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("e")))
    return covers.groupBy("h1", "h2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def removed(size: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    if any(e < 0 for _, e in spans):
        return [(0, size)] if size else []
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary, kept_sha256) of every row."""
    kind = dict(docs.dtypes)[id_col]
    keyed = _keyed(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("__text")), "__text")
    spans = written(repeated_spans(keyed, depth, gram, most), "repeat-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, found in zip(_bytes_of(batch.column("__t")), batch.column("spans"), strict=True):
                gone = removed(len(raw), [(x["s"], x["e"]) for x in found.as_py()]) if found.is_valid else []
                edges = [0, *[p for run in gone for p in run], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        release()

    out = keyed.select("id", "h1", "h2", "__t").join(spans, ["h1", "h2"], "left").select("id", "__t", "spans").mapInArrow(run, "id string, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
