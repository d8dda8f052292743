"""N-gram Jaccard join: blocked product of the document by shingle incidence matrix with itself.

A document's set holds its distinct ``WORDS``-word shingles as 64-bit hashes; two documents link when
100 * overlap >= 80 * union. Overlap counts are accumulated where they can still matter; size bounds discard the rest:

1. Shared columns. A link needs an overlap of at least 80% of either set, so that share of a document's shingles must
   occur in another document. Blocks of documents send their distinct shingles (sorted, delta-packed, one message a
   block and shard) to the shards of the columns; the shards answer how many of each document's are shared. A shingle
   that is frequent within a block is sent once, so a hot column has at most one entry a block.
2. Equal sets are one class; only one text of each surviving class is read again.
3. Over these classes the rows are cut to prefixes in order of column frequency (rarest first): linked sets share a
   column of their prefixes and have sizes within a factor. Classes that share one, directly or by others, form a group;
   each group is dealt into chunks by band of size. Chunks of a band and of neighbouring bands are multiplied, others are
   discarded by size before. Inside a task the incidence of a pair of chunks is multiplied over blocks of columns (each
   block as a dense 0/1 matrix), overlaps are accumulated, pairs below the bound are discarded, and only links that join
   classes come out, so the rows made grow with the classes and pairs of chunks, not with the pairs of classes.
4. Links of classes become components; each document gets the smallest id of its component.

No links between different texts that join two components are lost: every pair of classes that shares a prefix column is
in one group and is verified on whole sets.

Null and empty texts and texts without words have an empty set and link with nothing. A text with fewer words has its
whole word sequence as its only shingle. Rows with a null id take part; a component's id is its smallest id that is not
null. Rows of equal id and different text are told apart by their sets. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import TEXT_ROWS, batches_of, components, cut, parts_for, release, text_bytes, written

WORDS = 5
SIMILAR = 80
BLOCK_ROWS = 4096
BLOCK_CHARS = 4_000_000
SHARD_BYTES = 12_000_000
HASH_BITS = 48
MANY = 0xFFFF
#: A chunk of a group holds about so many sets or shingles; a product is made over so many columns at a time.
CHUNK_SETS = 256
CHUNK_SHINGLES = 400_000
COLUMNS = 8192
#: Class keys of up to so many rows (of about 30 bytes) are broadcast when the texts are read again.
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    got = text.encode("utf-8", "replace").lower().split() if text else []
    if not got:
        return np.empty(0, dtype=np.uint64)
    if len(got) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(got), seed=size)], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, got), dtype=np.uint64, count=len(got))
    n = len(w) - size + 1
    h = w[:n].copy()
    for i in range(1, size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += w[i : i + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def set_key(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def squeeze(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed planes of their differences."""
    import zstandard

    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(data: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


MESSAGE = "part int, block long, hashes binary, owners binary, ids array<string>, sizes binary, keys binary, counts binary, entries long"


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Messages as a frame; what a message lacks is None."""
    out = {c: pd.Series([r.get(c) for r in rows], dtype=object) for c in (x.split()[0] for x in MESSAGE.split(", "))}
    return pd.DataFrame(out).astype({"part": "int32", "block": "int64", "entries": "Int64"})


def _messages(shards: int, size: int):
    def close(made: int, ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
        block = xxhash.xxh3_64_intdigest(repr((TaskContext.get().partitionId(), made, ids)).encode() + b"".join(set_key(s) or b"-" for s in sets)) >> 1
        owners = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        all_ = np.concatenate(sets) >> np.uint64(64 - HASH_BITS) if sets else np.empty(0, np.uint64)
        order = np.argsort(all_, kind="stable")
        all_, owners = all_[order], owners[order]
        first = np.ones(len(all_), dtype=bool)
        first[1:] = all_[1:] != all_[:-1]
        lone = first.copy()
        lone[:-1] &= first[1:]
        local = np.bincount(owners[~lone], minlength=len(sets)).astype("<u4")
        to = np.where(lone, owners, MANY).astype("<u2")[first]
        sent = all_[first]
        where = np.searchsorted(sent, (np.arange(shards + 1, dtype=np.float64) * (2.0**HASH_BITS / shards)).astype(np.uint64))
        where[-1] = len(sent)
        rows = [{"part": s, "block": block, "hashes": squeeze(sent[a:b]), "owners": to[a:b].tobytes()} for s, (a, b) in enumerate(zip(where[:-1], where[1:], strict=True)) if b > a]
        keys = b"".join(set_key(s) or bytes(16) for s in sets)
        rows.append({"part": -1 - block % shards, "block": block, "ids": ids, "sizes": np.array([len(s) for s in sets], "<u4").tobytes(), "keys": keys, "counts": local.tobytes(), "entries": len(sent)})
        return _frame(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, ids, sets, chars = 0, [], [], 0
        for batch in batches:
            for key, text in zip(batch["id"], batch["text"], strict=True):
                ids.append(key)
                sets.append(shingles(text, size))
                chars += len(text) if text else 0
                if len(ids) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield close(made, ids, sets)
                    made, ids, sets, chars = made + 1, [], [], 0
                    release()
        if ids:
            yield close(made, ids, sets)
        ids, sets = [], []
        release()

    return run


def _answer(shard: pd.DataFrame) -> pd.DataFrame:
    """For one shard of columns: to every block, how many of each document's shingles occur elsewhere."""
    release()
    if shard["part"].iloc[0] < 0:
        return shard
    sets = [expand(b) for b in shard["hashes"]]
    owners = [np.frombuffer(b, "<u2") for b in shard["owners"]]
    all_, to = np.concatenate(sets), np.concatenate(owners)
    order = np.argsort(all_, kind="stable")
    s = all_[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    credit = np.zeros(len(s), dtype=bool)
    credit[order] = twice
    credit &= to != MANY
    rows, at = [], 0
    for block, own in zip(shard["block"], owners, strict=True):
        got = credit[at : at + len(own)]
        rows.append({"part": shard["part"].iloc[0], "block": block, "counts": np.bincount(own[got]).astype("<u4").tobytes(), "entries": len(own)})
        at += len(own)
    return _frame(rows)


def _gather(block: pd.DataFrame) -> pd.DataFrame:
    head = block[block["part"] < 0]
    rest = block[block["part"] >= 0]
    if len(head) != 1 or head["entries"].iloc[0] != rest["entries"].sum():
        raise RuntimeError("a block's messages are not complete: its rows came in another order on a retry")
    h = head.iloc[0]
    shared = np.frombuffer(h["counts"], "<u4").astype(np.int64)
    for c in rest["counts"]:
        c = np.frombuffer(c, "<u4")
        shared[: len(c)] += c
    sizes = np.frombuffer(h["sizes"], "<u4")
    keys = [h["keys"][16 * i : 16 * i + 16] if n else None for i, n in enumerate(sizes)]
    return pd.DataFrame({"id": list(h["ids"]), "n": sizes.astype(np.int64), "key": keys, "shared": shared})


def set_sizes(docs: DataFrame, id_col: str, text: str, size: int = WORDS) -> DataFrame:
    """(id as text, n, key, shared) of every row: set size, key of the set, how many of its shingles other rows have."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    shards = parts_for(text_bytes(docs, text), SHARD_BYTES)
    sent = rows.mapInPandas(_messages(shards, size), MESSAGE)
    answered = sent.groupBy("part").applyInPandas(_answer, MESSAGE)
    return answered.groupBy("block").applyInPandas(_gather, "id string, n long, key binary, shared long")


def _class_sets(docs: DataFrame, classes: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(cid, key, n, hashes) of one text of every class, written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch["text"]]
            yield pd.DataFrame({"key": [set_key(s) for s in sets], "n": [len(s) for s in sets], "hashes": [s.view(np.int64) for s in sets]})
            del sets, batch
            release()

    wanted = classes.select(F.col("rep").alias("__rep"))
    if classes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("__rep")), "left_semi").select("text")
    sets = rows.mapInPandas(run, "key binary, n long, hashes array<long>")
    sets = sets.join(classes.select("key"), "key", "left_semi").dropDuplicates(["key"])
    with batches_of(docs.sparkSession, TEXT_ROWS):
        return written(sets.withColumn("cid", F.monotonically_increasing_id()), "shingle-sets")


def overlaps(values: np.ndarray, sizes: np.ndarray, left: int, width: int = COLUMNS) -> np.ndarray:
    """Overlap counts of the first ``left`` sets with the others: the sparse product, accumulated over blocks of columns.

    ``values`` holds the sets one after the other, ``sizes`` their lengths. With ``left`` = all, all are met with all.
    """
    columns, place = np.unique(values, return_inverse=True)
    place = place.ravel().astype(np.int32)
    order = np.argsort(place, kind="stable")
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    place = place[order]
    right = slice(0, left) if left == len(sizes) else slice(left, None)
    out = np.zeros((left, left if left == len(sizes) else len(sizes) - left), dtype=np.float32)
    for lo in range(0, len(columns), width):
        i, j = np.searchsorted(place, [lo, lo + width])
        m = np.zeros((len(sizes), min(width, len(columns) - lo)), dtype=np.float32)
        m[rows[i:j], place[i:j] - lo] = 1.0
        out += m[:left] @ m[right].T
    return out.astype(np.int64)


def joined(on: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each node of a symmetric link matrix."""
    label = np.arange(len(on))
    while True:
        near = np.where(on, label[None, :], len(on)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _product(similar: int):
    """Pairs of chunks to the links that join their classes: at most one a class and pair of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch["one"], batch["two"], strict=True):
                parts = [x.values for x in (one, two) if len(x.values)]
                ids = np.concatenate([p.field("cid").to_numpy() for p in parts])
                sizes = np.concatenate([p.field("hashes").value_lengths().to_numpy() for p in parts])
                values = np.concatenate([p.field("hashes").flatten().to_numpy() for p in parts])
                left = len(parts[0])
                both = overlaps(values, sizes, left)
                own, other = sizes[:left].astype(np.int64), (sizes if left == len(ids) else sizes[left:]).astype(np.int64)
                on = 100 * both >= similar * (own[:, None] + other[None, :] - both)
                if left < len(ids):
                    hit, on = on, np.zeros((len(ids), len(ids)), dtype=bool)
                    on[:left, left:] = hit
                    on[left:, :left] = hit.T
                label = joined(on)
                moved = np.flatnonzero(label != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])
                del parts, values, both, on
            del batch, one, two
            release()

    return run


def class_links(sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Pairs (a, b) of classes that join every component: see step 3 of the module's text."""
    e = sets.select("cid", "n", F.explode("hashes").alias("h"))
    df = e.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rows = e.join(df, "h").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("cols"))
    # columns of frequency 1 come first in the order and meet nobody; what is left of the prefix is this
    left = (F.size("cols") - F.ceil(F.col("n") * similar / 100) + 1).cast("int")
    prefix = rows.where(left > 0).select("cid", "n", F.explode(F.slice("cols", F.lit(1), left)).alias("c")).select("cid", "n", F.col("c.h").alias("h"))
    # sets link only within a factor of their sizes: columns are split into bands of size, each row in two of them
    band = F.floor(F.log(100.01 / similar, F.col("n"))).cast("int")
    prefix = written(prefix.select("cid", F.explode(F.array(band, band + 1)).alias("band"), "h"), "shingle-prefixes")
    ends = prefix.groupBy("h", "band").agg(F.min("cid").alias("a"), F.max("cid").alias("hi")).where("a < hi").drop("hi")
    near = prefix.join(ends, ["h", "band"]).where("cid <> a").select("a", F.col("cid").alias("b")).distinct()
    groups = cut(components(near).withColumnRenamed("node", "cid").withColumnRenamed("root", "grp"))
    rows = sets.join(groups, "cid").withColumn("band", band)
    sized = cut(rows.groupBy("grp", "band").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks")))
    place = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("chunk")
    rows = rows.join(sized, ["grp", "band"]).select("cid", "hashes", "grp", "band", place)
    chunks = written(rows.groupBy("grp", "band", "chunk").agg(F.collect_list(F.struct("cid", "hashes")).alias("sets")), "shingle-chunks")
    pairs = chunk_pairs(sized)
    one, two = (chunks.select("grp", F.col("band").alias(f"b{i}"), F.col("chunk").alias(f"c{i}"), F.col("sets").alias(n)) for i, n in ((1, "one"), (2, "two")))
    itself = (F.col("b1") == F.col("b2")) & (F.col("c1") == F.col("c2"))
    met = pairs.join(one, ["grp", "b1", "c1"]).join(two, ["grp", "b2", "c2"])
    met = met.withColumn("two", F.when(itself, F.array().cast(dict(chunks.dtypes)["sets"])).otherwise(F.col("two")))
    return met.select("one", "two").mapInArrow(_product(similar), "a long, b long")


def chunk_pairs(sized: DataFrame) -> DataFrame:
    """(grp, b1, c1, b2, c2) of the pairs of chunks to multiply, from ``sized(grp, band, chunks)``.

    A chunk meets the later chunks of its band and all chunks of the next one, as other sizes cannot link, and
    itself. These rows are numbers only and are dealt by chunk before they are many, so one large group's
    pairs are made, joined and multiplied by many tasks.
    """
    first = sized.select("grp", F.col("band").alias("b1"), F.col("chunks").alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c1"))
    after = sized.select("grp", (F.col("band") - 1).alias("b1"), F.col("chunks").alias("next"))
    first = first.join(after, ["grp", "b1"], "left").repartition("grp", "b1", "c1")
    numbers = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    same = F.transform(numbers(F.col("c1") + 1, F.col("own") - 1), lambda c: F.struct(F.col("b1").alias("b2"), c.alias("c2")))
    other = F.transform(numbers(F.lit(0), F.coalesce("next", F.lit(0)) - 1), lambda c: F.struct((F.col("b1") + 1).alias("b2"), c.alias("c2")))
    alone = F.array(F.struct(F.col("b1").alias("b2"), F.col("c1").alias("c2")))
    return first.select("grp", "b1", "c1", F.explode(F.concat(alone, same, other)).alias("x")).select("grp", "b1", "c1", "x.b2", "x.c2")


def join_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """(id_col, n_shingles, component_id, key): one row a row of ``docs``; ``key`` tells its set (null: empty)."""
    kind = dict(docs.dtypes)[id_col]
    with batches_of(docs.sparkSession, TEXT_ROWS):
        light = cut(set_sizes(docs, id_col, text, size).withColumn("id", F.col("id").cast(kind)))
    near = light.where((F.col("n") > 0) & (100 * F.col("shared") >= similar * F.col("n")))
    classes = cut(near.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    sets = _class_sets(docs, classes.select("key", F.col("least").cast("string").alias("rep")), id_col, text, size)
    roots = components(class_links(sets, similar)).withColumnRenamed("node", "cid")
    named = classes.join(sets.select("key", "cid"), "key").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "root").select("key", "component_id"))
    own = lambda d: d.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "key")
    linked = near.join(named, "key", "left")
    alone = light.where(~((F.col("n") > 0) & (100 * F.col("shared") >= similar * F.col("n")))).withColumn("component_id", F.lit(None).cast(kind))
    return own(linked).unionByName(own(alone.select(linked.columns)))
