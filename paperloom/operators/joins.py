"""Joins and matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions.fuzzy import fuzzy_partial_ratio, lcs_length, sequence_ratio_from
from paperloom.operators.aggregate import first_by
from paperloom.workspace import cut


def join_reviews_metadata(reviews: DataFrame, metadata: DataFrame) -> DataFrame:
    return reviews.join(metadata, ["conference", "id"])


def only_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(keys), keys, "left_semi")


def enrich_references(papers: DataFrame, catalogue: DataFrame, order_by: str, min_refs: int = 1) -> DataFrame:
    """``papers(paper_id, refs array<string>)`` with ``catalogue(title, ...)``: (paper_id, references) of matched rows in order.

    Titles meet clean; of equal catalogue titles the last by ``order_by`` wins; papers with fewer matches go.
    """
    c = first_by(catalogue.withColumn("__clean", tx.clean_title(F.col("title"))), ["__clean"], F.desc(order_by))
    r = papers.select("paper_id", F.posexplode("refs").alias("pos", "ref")).withColumn("__clean", tx.clean_title(F.col("ref")))
    j = r.join(c, "__clean").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("pos", *[x for x in catalogue.columns]))).alias("references"))
    return j.where(F.size("references") >= min_refs)


def filter_recommended(papers: DataFrame, recs: DataFrame, title: str = "title", sources: str = "sources") -> DataFrame:
    """Recommendations of which some source title is a paper's title."""
    e = recs.select("rec_id", F.explode(sources).alias(title))
    return recs.join(e.join(papers.select(title), title, "left_semi").select("rec_id").distinct(), "rec_id", "left_semi")


def attach_content(papers: DataFrame, contents: DataFrame, keys: list[str], content: str) -> tuple[DataFrame, DataFrame]:
    """(matched papers with content, report by keys[0] of matched and unmatched)."""
    j = papers.join(contents, keys, "left")
    report = j.groupBy(keys[0]).agg(F.count_if(F.col(content).isNotNull()).alias("matched"), F.count_if(F.col(content).isNull()).alias("unmatched"))
    return j.where(F.col(content).isNotNull()), report


def remaining(rows: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that are done, rows that remain)."""
    return rows.join(done.select(key), key, "left_semi"), rows.join(done.select(key), key, "left_anti")


def restrict_to_test_set(df: DataFrame, test: DataFrame, title: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the test set, test titles that are missing)."""
    return df.join(test.select(title), title, "left_semi"), test.select(title).distinct().join(df.select(title), title, "left_anti")


#: Titles to a block when blocks of titles are compared.
TITLE_BLOCK = 2_048
#: Longest title (in characters) that is aligned beside others; longer ones are aligned one by one.
ALIGNED = 512


def _letter_counts(titles: list[str]) -> np.ndarray:
    """One row a title: how often characters fall into each of 64 places."""
    out = np.zeros((len(titles), 64), dtype=np.int32)
    for row, t in enumerate(titles):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[row] = np.bincount(codes % 64, minlength=64)
    return out.astype(np.int16) if out.sum(1, dtype=np.int64).max(initial=0) < 1 << 15 else out


def _common_lengths(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a[i]`` and ``b[j]``: ``lcs_length`` with many pairs side by side."""
    words = max(len(x) for x in a) + 63 >> 6
    letters = {x: n for n, x in enumerate(sorted(set().union(*a)), 1)}
    places = np.zeros((words, len(a) * (len(letters) + 1)), dtype=np.uint64)
    for row, t in enumerate(a):
        for at, x in enumerate(t):
            places[at >> 6, row * (len(letters) + 1) + letters[x]] |= np.uint64(1 << (at & 63))
    spelt = np.zeros((max(1, *(len(x) for x in b)), len(b)), dtype=np.int64)
    for column, t in enumerate(b):
        spelt[: len(t), column] = [letters.get(x, 0) for x in t]
    out = np.empty(len(i), dtype=np.int64)
    for lo in range(0, len(i), 4_096):
        first, second = i[lo : lo + 4_096] * (len(letters) + 1), j[lo : lo + 4_096]
        row = np.full((words, len(first)), ~np.uint64(0), dtype=np.uint64)
        for line in spelt:
            at, carry = first + line[second], None
            for w in range(words):
                was = row[w]
                hit = was & places[w][at]
                more = was + hit
                over = more < was
                if carry is not None:
                    more += carry
                    over |= more < carry
                row[w] = more | (was ^ hit)
                carry = over.astype(np.uint64)
        out[lo : lo + 4_096] = 64 * words - np.bitwise_count(row).sum(0, dtype=np.int64)
    return out


def _agreeing(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs of rows that agree in some column, each pair once, some rows of ``a`` at a time."""
    orders = np.argsort(b, axis=0, kind="stable")
    for lo in range(0, len(a), 256):
        some = np.zeros((len(a[lo : lo + 256]), len(b)), dtype=bool)
        for column in range(a.shape[1]):
            order = orders[:, column]
            held, asked = b[order, column], a[lo : lo + 256, column]
            left, right = np.searchsorted(held, asked, "left"), np.searchsorted(held, asked, "right")
            for row in np.flatnonzero(right > left):
                some[row, order[left[row] : right[row]]] = True
        i, j = np.nonzero(some)
        yield i + lo, j


def close_pairs(a: list[str], b: list[str], least: int, keys: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int, int]]:
    """(i, j, score) of all pairs whose rounded indel ratio is at least ``least``; with ``keys`` of those that share one.

    What letters two titles have in common bounds their common subsequence, for all pairs at once; only the rest is
    aligned, many pairs side by side.
    """
    share = (least - 0.5) / 100
    one, two = _letter_counts(a), _letter_counts(b)
    kind = np.int32 if one.dtype != two.dtype else one.dtype
    one, two = one.astype(kind), np.ascontiguousarray(two.astype(kind).T)
    na, nb = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    shared = np.flatnonzero(one.any(0) & two.any(1))

    def all_pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(0, len(a), 32):
            both, lesser = (np.zeros((len(one[lo : lo + 32]), len(b)), dtype=kind) for _ in range(2))
            for letter in shared:
                both += np.minimum(one[lo : lo + 32, letter, None], two[letter], out=lesser)
            i, j = np.nonzero(2.0 * both >= share * (na[lo : lo + 32, None] + nb))
            yield i + lo, j

    def keyed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in _agreeing(*keys):
            ok = np.concatenate([2.0 * np.minimum(one[i[lo : lo + 16_384]], two.T[j[lo : lo + 16_384]]).sum(1, dtype=np.int64) >= share * (na[i[lo : lo + 16_384]] + nb[j[lo : lo + 16_384]]) for lo in range(0, max(1, len(i)), 16_384)])
            yield i[ok], j[ok]

    found = list(all_pairs() if keys is None else keyed())
    i, j = (np.concatenate([x[side] for x in found]) if found else np.zeros(0, dtype=np.int64) for side in (0, 1))
    if len(i) == 0:
        return
    if max(na[i].max(), nb[j].max()) <= ALIGNED:
        own, i_own = np.unique(i, return_inverse=True)
        common = _common_lengths([a[x] for x in own], b, i_own, j)
    else:
        common = np.array([lcs_length(a[x], b[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    length = na[i] + nb[j]
    scores = np.rint(np.where(length > 0, 200.0 * common / np.maximum(length, 1), 100.0)).astype(np.int64)
    ok = scores >= least
    yield from zip(i[ok].tolist(), j[ok].tolist(), scores[ok].tolist(), strict=True)


def fuzzy_title_join(queries: DataFrame, candidates: DataFrame, least: int = 80, k: int = 5, band: int = 8) -> DataFrame:
    """``queries(query)``, ``candidates(title)`` -> (query, title, score): the best ``k`` distinct titles a query.

    The ratio bounds the lengths: 2 * min / (a + b) >= (least - 0.5) / 100. Both sides meet in bands of length, every
    query in all bands its bound allows, so no pair that can reach ``least`` is lost. A band's titles are cut into blocks,
    and pairs of blocks are numbered first and dealt by both numbers, so a band that holds most titles is as many keys as
    it has pairs of blocks. Pairs of titles never become rows (see ``close_pairs``); a pair of blocks gives at most ``k``
    titles a query.
    """
    q = queries.select("query").distinct().withColumn("clean", tx.match_title(F.col("query")))
    c = candidates.select("title").distinct().withColumn("clean", tx.match_title(F.col("title")))
    return _title_blocks(q, c, least, k, band)


def _title_blocks(q: DataFrame, c: DataFrame, least: int, k: int, band: int) -> DataFrame:
    """``fuzzy_title_join`` of ``q(query, clean)`` and ``c(title, clean)``; with a column ``keys`` pairs must share a key."""
    share = (least - 0.5) / 100
    held_columns = [x for x in ("clean", "keys") if x in q.columns]
    lo, hi = F.floor(F.length("clean") * share / (2 - share)), F.ceil(F.length("clean") * (2 - share) / share)
    q = q.withColumn("band", F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band))))
    c = c.withColumn("band", F.floor(F.length("clean") / band))

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("band").agg(F.ceil(F.count("*") / TITLE_BLOCK).cast("int").alias(f"{name}_blocks"))

    # one row a band: numbers only
    met = cut(sizes(q, "q").join(sizes(c, "c"), "band"))

    def blocked(df: DataFrame, text: str, name: str, other: str) -> DataFrame:
        """Blocks of a side, once for each block of the other side that they meet."""
        df = df.join(F.broadcast(met), "band").withColumn(f"{name}_block", F.pmod(F.xxhash64(text), F.col(f"{name}_blocks")).cast("int"))
        held = df.groupBy("band", f"{name}_block", f"{other}_blocks").agg(F.collect_list(F.struct(F.col(text).alias("text"), *held_columns)).alias(name))
        return held.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).drop(f"{other}_blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asking, answering in zip(batch["q"], batch["c"], strict=True):
                keys = tuple(np.array([x["keys"] for x in side], dtype=np.int64) for side in (asking, answering)) if "keys" in held_columns else None
                found = close_pairs([x["clean"] for x in asking], [x["clean"] for x in answering], least, keys)
                made = pd.DataFrame([(asking[i]["text"], answering[j]["text"], score) for i, j, score in found], columns=["query", "title", "score"])
                yield made.sort_values(["score", "title"], ascending=False).groupby("query", sort=False).head(k)

    keys = ["band", "q_block", "c_block"]
    pairs = blocked(q, "query", "q", "c").join(blocked(c, "title", "c", "q"), keys)
    return _best_titles(pairs.select("q", "c").mapInPandas(run, "query string, title string, score int"), k)


def _best_titles(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("title")))).where(F.col("r") <= k).drop("r")


def band_keys(titles: list[str], rows: int, bands: int, seed: int = 1) -> np.ndarray:
    """A row a title: for each band a hash of its ``rows`` MinHashes over the title's runs of three characters."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 62, (2, rows * bands), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(titles), bands), dtype=np.int64)
    with np.errstate(over="ignore"):
        for row, t in enumerate(titles):
            codes = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            codes = np.pad(codes, (0, max(0, 3 - len(codes))))
            grams = np.unique((codes[:-2] * np.uint64(1 << 42)) ^ (codes[1:-1] * np.uint64(1 << 21)) ^ codes[2:])
            mixed = (grams[:, None] ^ (grams[:, None] >> np.uint64(29))) * odd[0] + odd[1]
            least = (mixed ^ (mixed >> np.uint64(32))).min(0).reshape(bands, rows)
            key = np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                key = (key ^ least[:, r]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            out[row] = key.view(np.int64)
    return out


def minhash_title_join(queries: DataFrame, candidates: DataFrame, least: int = 80, k: int = 5, rows: int = 3, bands: int = 48, band: int = 8) -> DataFrame:
    """``fuzzy_title_join`` without comparing all titles of a length: only pairs that agree in a band of MinHashes are scored.

    Approximate: scores are right, but pairs with few common runs of characters may be missed (``title_join_recall``
    measures it). Titles of much the same vocabulary agree in some band in large part, so these pairs are found within
    blocks of about one length and never become rows either.
    """

    @F.pandas_udf("array<bigint>")
    def keys(clean: pd.Series) -> pd.Series:
        return pd.Series(list(band_keys(list(clean), rows, bands)), dtype="object")

    def keyed(df: DataFrame, text: str) -> DataFrame:
        df = df.select(text).distinct().withColumn("clean", tx.match_title(F.col(text))).where("clean is not null")
        return df.withColumn("keys", keys("clean"))

    return _title_blocks(keyed(queries, "query"), keyed(candidates, "title"), least, k, band)


def title_join_recall(queries: DataFrame, candidates: DataFrame, least: int = 80, k: int = 5, rows: int = 3, bands: int = 48, sample: int = 500) -> float:
    """Share of the exact join's rows of a sample of queries (by hash) that the MinHash join finds; 1 if there are none."""
    some = cut(queries.select("query").distinct().orderBy(F.xxhash64("query")).limit(sample))
    truth = cut(fuzzy_title_join(some, candidates, least, k))
    found = minhash_title_join(some, candidates, least, k, rows, bands)
    total = truth.count()
    return truth.join(found, ["query", "title", "score"], "left_semi").count() / total if total else 1.0


def levenshtein_title_join(queries: DataFrame, candidates: DataFrame, most: int, k: int = 5) -> DataFrame:
    """The same with Spark's own edit distance of clean titles, at most ``most`` edits: (query, title, distance)."""
    q = queries.select("query").distinct().withColumn("__q", tx.clean_title(F.col("query")))
    c = candidates.select("title").distinct().withColumn("__c", tx.clean_title(F.col("title")))
    q = q.withColumn("__len", F.explode(F.sequence(F.greatest(F.length("__q") - most, F.lit(0)), F.length("__q") + most)))
    j = q.join(c.withColumn("__len", F.length("__c")), "__len").select("query", "title", F.levenshtein("__q", "__c", most).alias("distance")).where("distance >= 0")
    return j.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", "title"))).where(F.col("r") <= k).drop("r")


def validate_title_match(df: DataFrame, searched: str, returned: str, least: int = 80) -> DataFrame:
    return df.where(fuzzy_partial_ratio(tx.clean_title(F.col(searched)), tx.clean_title(F.col(returned))) >= least)


def containment_match(a: DataFrame, b: DataFrame, order_by: str) -> DataFrame:
    """``a(a_title, order_by)``, ``b(b_title)``: equal or one inside the other, ignoring case; first ``a`` wins a ``b``.

    Both sides meet on pieces of three letters: the title that lies inside brings only its rarest one (of those that the
    other side has), the other side all of its own, so frequent pieces are seldom keys. Titles of one or two letters meet
    on themselves. Empty titles match nothing.
    """
    x = a.withColumn("__a", F.lower("a_title")).where("__a <> ''")
    y = b.withColumn("__b", F.lower("b_title")).where("__b <> ''")

    def pieces(c: Column, sizes: tuple[int, ...]) -> Column:
        """All distinct pieces of ``c`` of these lengths."""

        def of(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.length(c) - n + 1)
            return F.when(F.length(c) >= n, F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.flatten(F.array(*[of(n) for n in sizes])))

    def inside(small: DataFrame, s: str, large: DataFrame, t: str) -> DataFrame:
        held = large.select(t).distinct().withColumn("__g", F.explode(pieces(F.col(t), (1, 2, 3))))
        counts = held.groupBy("__g").agg(F.count("*").alias("n"))
        own = F.when(F.length(s) < 3, F.array(F.col(s))).otherwise(pieces(F.col(s), (3,)))
        rarest = small.select(s).distinct().withColumn("__g", F.explode(own)).join(counts, "__g").groupBy(s).agg(F.min_by("__g", F.struct("n", "__g")).alias("__g"))
        return rarest.join(held, "__g").where(F.contains(t, s)).select(s, t)

    pairs = inside(x, "__a", y, "__b").unionByName(inside(y, "__b", x, "__a")).distinct()
    return first_by(x.join(pairs, "__a").join(y, "__b").drop("__a", "__b").distinct(), ["b_title"], order_by)


def match_aspects(papers: DataFrame, aspects: DataFrame, least: float = 0.8) -> DataFrame:
    """``papers(paper_id, title, reviews array<string>)``, ``aspects(title, review, labels)``: (paper_id, ord, labels).

    Titles meet squashed; an aspect's labels go to the paper's best-matching review if its ratio is at least ``least``.
    """
    p = papers.select("paper_id", tx.squash_title(F.col("title")).alias("t"), F.posexplode("reviews").alias("ord", "text"))
    a = aspects.select(tx.squash_title(F.col("title")).alias("t"), "review", "labels")
    j = p.join(a, "t", "left").withColumn("score", sequence_ratio_from(least, "text", "review"))
    best = first_by(j.where("review is not null"), ["paper_id", "review"], F.desc("score"), "ord").where(F.col("score") >= least)
    out = p.select("paper_id", "ord").join(best.groupBy("paper_id", "ord").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels")), ["paper_id", "ord"], "left")
    return out.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def merge_catalogues(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer on ``key``: lists joined, structs merged field by field, other values of ``a`` first."""
    from pyspark.sql import types as T

    def both(x: Column, y: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.concat(x, y))
        if isinstance(kind, T.StructType):
            return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.struct(*[both(x[f.name], y[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return F.coalesce(x, y)

    x, y = a.alias("x"), b.alias("y")
    j = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    mine, theirs = {f.name: f.dataType for f in a.schema.fields}, [f.name for f in b.schema.fields]
    cols = [F.coalesce(f"x.{key}", f"y.{key}").alias(key)]
    cols += [(both(F.col(f"x.{c}"), F.col(f"y.{c}"), k) if c in theirs else F.col(f"x.{c}")).alias(c) for c, k in mine.items() if c != key]
    return j.select(*cols, *[F.col(f"y.{c}").alias(c) for c in theirs if c not in mine])


def common_ids(frames: list[DataFrame], key: str) -> DataFrame:
    out = frames[0].select(key).distinct()
    for f in frames[1:]:
        out = out.join(f.select(key), key, "left_semi")
    return out


def all_pairings(items: DataFrame, item: str, others: list[DataFrame] = ()) -> DataFrame:
    """Ordered pairs of different items with every row of ``others`` (papers, metrics). Items are a short list of systems."""
    a, b = items.select(F.col(item).alias("item_a")), items.select(F.col(item).alias("item_b"))
    out = a.join(b, F.col("item_a") != F.col("item_b"))
    for o in others:
        out = out.join(o)
    return out


def diff_rows(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fields): names of the fields that differ; scalar lists compare as multisets, a missing side differs in all."""
    kinds = dict(a.dtypes)
    x, y = a.withColumn("__in", F.lit(True)).alias("x"), b.withColumn("__in", F.lit(True)).alias("y")
    j = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    norm = lambda c, n: F.sort_array(c) if kinds[n].startswith("array") else c
    missing = F.col("x.__in").isNull() | F.col("y.__in").isNull()
    names = F.array_compact(F.array(*[F.when(missing | ~norm(F.col(f"x.{c}"), c).eqNullSafe(norm(F.col(f"y.{c}"), c)), F.lit(c)) for c in columns]))
    return j.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), names.alias("fields")).where(F.size("fields") > 0)


def neighbours(related: DataFrame, papers: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """``papers(paper)``: (paper, neighbour, similarity, r). Citation edges go out, semantic edges both ways."""
    e = related.where(F.col("type") == kind)
    out = e.select(F.col("source").alias("paper"), F.col("target").alias("neighbour"), "similarity")
    if kind == "semantic":
        out = out.unionByName(e.select(F.col("target").alias("paper"), F.col("source").alias("neighbour"), "similarity"))
    out = out.join(papers, "paper", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("paper").orderBy(F.desc("similarity"), "neighbour")))
    return out.where(F.col("r") <= limit) if limit else out


def related_edges(related: DataFrame, paper: Column, kind: str | None = None) -> DataFrame:
    e = related if kind is None else related.where(F.col("type") == kind)
    return e.where((F.col("source") == paper) | (F.col("target") == paper))


def backfill(df: DataFrame, lookup: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(filled rows, report of filled, missing and the rate)."""
    j = df.join(lookup.select(key, F.col(column).alias("__new")).dropDuplicates([key]), key, "left")
    was = F.col(column).isNull()
    report = j.agg(F.count_if(was & F.col("__new").isNotNull()).alias("filled"), F.count_if(was & F.col("__new").isNull()).alias("missing"))
    report = report.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("filled") * 100.0, F.col("filled") + F.col("missing")), F.lit(0.0)), 4))
    return j.withColumn(column, F.coalesce(column, "__new")).drop("__new"), report


def contexts_by_reference(bib: DataFrame, contexts: DataFrame) -> DataFrame:
    """``bib(paper_id, key, title, authors)``, ``contexts(paper_id, key, sentence)``: cited keys with their sentences."""
    c = contexts.groupBy("paper_id", "key").agg(F.array_sort(F.collect_set("sentence")).alias("contexts"))
    j = c.join(bib, ["paper_id", "key"], "left")
    return j.select("paper_id", "key", F.coalesce("title", F.lit("Unknown Reference")).alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "contexts")


def concat_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
