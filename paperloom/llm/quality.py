"""Quality classifier: interpolated modified Kneser-Ney character n-grams, counted from trusted text.

Counts. Words of trusted texts (``^word$``) give one gram an event: the character with up to four characters before it.
Tasks count their own words first, so what is shuffled are distinct (language, gram) counts, not text. Lower orders take
continuation counts, discounts come from the counts of counts of each language and order, and all orders meet in joins on
(language, gram): one table of log-probabilities and back-off weights. Contexts stop at word borders, so the order of
words has no effect on a text's score, but for a word that repeats the word before it: that is one event of its own
kind, so runs of one word are as unlikely as they are rare.

Scores. The table is never broadcast: it is dealt into shards by a 64-bit key of (language, gram). Texts are packed into
blocks: distinct words, and for each text which of them it holds and how often. A block asks every shard once for the
distinct grams it needs (sorted keys, packed), the shard answers with as many log-probabilities and back-off weights,
and the answers meet the block again, so memory is bounded by a block or a shard, and a frequent gram is asked for once
a block.

Decision. A text's excess is its log-perplexity over its language's trusted mean, shrunk for short texts by
n / (n + PRIOR). It is rejected if that is above the ``QUANTILE`` of the trusted texts' excesses in that language (the
smallest excess that at least this share does not exceed). Sums are made in fixed point, so decisions do not depend on
the order of rows. A text in a language without trusted rows, or without words, is kept.

Null languages are a language of their own (``""``). Null and empty texts have perplexity null and are kept. Repeated
rows are judged alike; a text whose excess equals the threshold is kept. Words are runs without ASCII white space;
digits count as one character. An empty table gives an empty result. Other columns are ignored, whatever their names.

Blocks are made twice, once to ask and once to score, from the same partitions of the input; a retry reads the same
rows again if the input is a table. If a block comes out differently the job fails, it never scores with wrong answers.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import TEXT_ROWS, batches_of, cut, forget, parts_for, release, small, text_bytes

ORDER = 5
QUANTILE = 0.9995
PRIOR = 25
BLOCK_CHARS = 12_000_000
BLOCK_ROWS = 20_000
#: Bytes of text to a shard of the gram table and of the requests for it.
SHARD_BYTES = 24_000_000
#: Units of the fixed-point sums: of an event's log-probability, and of a text's excess.
LOG_UNIT, EXCESS_UNIT = 1 << 24, 1_000_000
#: Grams are cut from so many words at a time.
WORDS_AT_ONCE = 10_000
#: A task hands over its counts when it holds so many distinct words.
HELD_WORDS = 500_000

#: Digits count as one character; the border marks cannot occur in a word.
_plain = bytes.maketrans(b"123456789^$", b"000000000\x02\x03")
#: Stands for a word that repeats the one before it: one event, whatever the word.
AGAIN = b"\x01"
REPEAT = "^\x01"
#: What tells a row apart: its id, a hash of its text, whether its language is null.
KEYS = ["k", "h", "ln"]


class Vocabulary:
    """Numbers words in order of first sight; number 0 is the repeat of the word before."""

    def __init__(self):
        self.ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids[AGAIN]

    def read(self, text: str) -> np.ndarray:
        """The text as word numbers."""
        got = text.encode("utf-8", "replace").translate(_plain).split()
        out = np.fromiter(map(self.ids.__getitem__, got), dtype=np.int32, count=len(got))
        again = out[1:] == out[:-1]
        out[1:][again] = 0
        return out

    def grams(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct grams of all words, each event's gram number, and where each word's events begin."""
        names: dict[str, int] = {REPEAT: 0}
        numbers, sizes = [np.zeros(1, dtype=np.int32)], [np.ones(1, dtype=np.int32)]
        rest = itertools.islice(self.ids, 1, None)
        while part := list(itertools.islice(rest, WORDS_AT_ONCE)):
            own, number, size = _events([w.decode("utf-8", "replace") for w in part])
            numbers.append(np.array([names.setdefault(g, len(names)) for g in own], dtype=np.int32)[number])
            sizes.append(size)
        return list(names), np.concatenate(numbers), np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])


def _mark(words: list[str]) -> str:
    return "".join([REPEAT if w == "\x01" else f"^{w}$" for w in words])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Keys of grams with one more character in front."""
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(1)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace")))


def _ends(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All character codes of the marked words, where their events end, how long each gram is, and each word's events."""
    codes = _codes(_mark(words))
    border = codes == ord("^")
    first = np.maximum.accumulate(np.where(border, np.arange(len(codes)), 0))
    ends = np.flatnonzero(~border)
    depth = np.minimum(ends - first[ends] + 1, ORDER)
    return codes, ends, depth, np.bincount(np.cumsum(border)[ends] - 1, minlength=len(words)).astype(np.int32)


def _full_keys(codes: np.ndarray, ends: np.ndarray, depth: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = np.full(len(ends), seed, dtype=np.uint64)
    for back in range(ORDER):
        on = depth > back
        h[on] = _step(h[on], codes[ends[on] - back])
    return h


def _events(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct grams of the words, each event's gram number, and the number of events of each word."""
    codes, ends, depth, sizes = _ends(words)
    marked = _mark(words)
    _, at, number = np.unique(_full_keys(codes, ends, depth, np.uint64(0)), return_index=True, return_inverse=True)
    names = [marked[b - d + 1 : b + 1] for b, d in zip(ends[at].tolist(), depth[at].tolist(), strict=True)]
    return names, number.ravel(), sizes


class Grams:
    """A vocabulary's events as numbered distinct grams, with the keys of their tails and contexts."""

    def __init__(self, words: list[str], lang: str):
        keys, chars, depths, numbers, sizes = [], [], [], [], []
        seed = _seed(lang)
        for at in range(0, len(words), WORDS_AT_ONCE):
            codes, ends, depth, size = _ends(words[at : at + WORDS_AT_ONCE])
            own, first, number = np.unique(_full_keys(codes, ends, depth, seed), return_index=True, return_inverse=True)
            ends, depth = ends[first], depth[first]
            got = np.zeros((len(own), ORDER), dtype=np.uint32)
            for back in range(ORDER):
                on = depth > back
                got[on, back] = codes[ends[on] - back]
            numbers.append((number.ravel() + sum(map(len, keys))).astype(np.int32))
            keys.append(own)
            chars.append(got)
            depths.append(depth.astype(np.int8))
            sizes.append(size)
        _, first, merged = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        #: Each event's gram, where each word's events begin, and the length and characters (last one first) of each gram.
        self.number = merged.ravel().astype(np.int32)[np.concatenate(numbers)]
        self.sizes = np.concatenate(sizes)
        self.depth, self.chars = np.concatenate(depths)[first], np.concatenate(chars)[first]
        self.seed = seed

    def tails(self) -> Iterator[np.ndarray]:
        """Keys of each gram's last 0, 1, .. ORDER characters (of shorter grams whatever comes out)."""
        return self._keys(0)

    def contexts(self) -> Iterator[np.ndarray]:
        """Keys of the 0, 1, .. ORDER - 1 characters before each gram's last one."""
        return self._keys(1)

    def _keys(self, skip: int) -> Iterator[np.ndarray]:
        h = np.full(len(self.depth), self.seed, dtype=np.uint64)
        yield _spread(h)
        for back in range(skip, ORDER):
            h = _step(h, self.chars[:, back].astype(np.uint64))
            yield _spread(h)

    def wanted(self) -> np.ndarray:
        """Sorted distinct keys of all tails and contexts."""
        tails = [k[self.depth >= n] for n, k in enumerate(self.tails())]
        contexts = [k[self.depth > n] for n, k in enumerate(self.contexts())]
        return np.unique(np.concatenate(tails + contexts))

    def logs(self, keys: np.ndarray, logp: np.ndarray, bow: np.ndarray) -> np.ndarray | None:
        """Log-probability of each word in fixed point; None if the model does not know the language.

        ``keys`` are sorted; what the model lacks is NaN. A gram that was not seen gets its context's back-off weight
        and the log-probability of its next shorter tail.
        """
        tails = self.tails()
        base = logp[np.searchsorted(keys, next(tails)[:1])]
        if np.isnan(base).all():
            return None
        p = np.full(len(self.depth), float(base[0]))
        for n, (tail, context) in enumerate(zip(tails, self.contexts(), strict=True), 1):
            on = np.flatnonzero(self.depth >= n)
            seen = logp[np.searchsorted(keys, tail[on])].astype(np.float64)
            back = np.nan_to_num(bow[np.searchsorted(keys, context[on])].astype(np.float64), nan=0.0)
            p[on] = np.where(np.isnan(seen), back + p[on], seen)
        units = np.rint(p * LOG_UNIT).astype(np.int64)[self.number]
        return np.add.reduceat(units, np.concatenate([[0], np.cumsum(self.sizes[:-1], dtype=np.int64)]))


def count_grams(trusted: DataFrame) -> DataFrame:
    """``(lang, text)`` -> ``(lang, gram, n)``, summed over all trusted rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[Vocabulary, list]] = {}

        def hand_over() -> Iterator[pd.DataFrame]:
            for lang, (vocabulary, texts) in held.items():
                names, number, begins = vocabulary.grams()
                times = np.bincount(np.concatenate(texts), minlength=len(vocabulary.ids))
                n = np.bincount(number, weights=np.repeat(times, np.diff(begins)), minlength=len(names)).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "gram": names, "n": n})[n > 0]
            held.clear()
            release()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                vocabulary, texts = held.setdefault(lang, (Vocabulary(), []))
                texts.append(vocabulary.read(text))
            if sum(len(v.ids) for v, _ in held.values()) > HELD_WORDS:
                yield from hand_over()
        yield from hand_over()

    rows = trusted.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` -> ``(lang, gram, logp, bow)``.

    logp: natural log of P(last character | the rest), null if the gram was not seen as such. bow: log weight of the next
    lower order after this context (null if it is no context). The empty gram holds the chance of an unseen character.
    Every gram meets the terms of all its tails in one join: p = own + gamma * (next own + next gamma * (...)).
    """
    counts = cut(counts)
    tails = lambda c, least: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substr(c, i)))
    seen = counts.select("lang", tails(F.col("gram"), 1).alias("gram")).distinct()
    extended = seen.where("length(gram) > 1").groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
    own = counts.where(F.col("gram").startswith("^") | (F.length("gram") == ORDER))
    levels = cut(own.unionByName(extended).withColumn("k", F.length("gram")))
    c = levels.groupBy("lang", "k").agg(*[F.count_if(F.col("n") == i).alias(f"c{i}") for i in (1, 2, 3, 4)])
    y = F.when(F.col("c1") + 2 * F.col("c2") > 0, F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(0.5)
    d = [F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"c{i + 1}"), F.col(f"c{i}")), F.lit(0.5 * i)))).alias(f"d{i}") for i in (1, 2, 3)]
    paid = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    levels = levels.join(c.select("lang", "k", *d), ["lang", "k"]).select("lang", "gram", "k", "n", paid.alias("paid"), F.expr("left(gram, k - 1)").alias("ctx"))
    sums = cut(levels.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("types"), F.sum("paid").alias("taken")).withColumn("gamma", F.col("taken") / F.col("total")))
    terms = levels.join(sums, ["lang", "ctx"])
    base = F.when(F.col("k") == 1, F.col("gamma") / (F.col("types") + 1)).otherwise(0.0)
    terms = cut(terms.select("lang", "gram", ((F.col("n") - F.col("paid")) / F.col("total") + base).alias("own"), "gamma"))
    parts = terms.select("lang", F.col("gram").alias("whole"), tails(F.col("gram"), 1).alias("gram")).join(terms, ["lang", "gram"])
    steps = F.sort_array(F.collect_list(F.struct(F.length("gram").alias("k"), "own", "gamma")))
    chain = F.aggregate(steps, F.lit(0.0), lambda p, x: x["own"] + F.when(x["k"] == 1, 0.0).otherwise(x["gamma"] * p))
    logs = parts.groupBy("lang", F.col("whole").alias("gram")).agg(F.ln(chain).alias("logp")).withColumn("bow", F.lit(None).cast("double"))
    bows = sums.select("lang", F.col("ctx").alias("gram"), F.when(F.col("ctx") == "", F.ln(F.col("gamma") / (F.col("types") + 1))).alias("logp"), F.when(F.col("ctx") == "", 0.0).otherwise(F.ln("gamma")).alias("bow"))
    return logs.unionByName(bows).groupBy("lang", "gram").agg(F.max("logp").cast("float").alias("logp"), F.max("bow").cast("float").alias("bow"))


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _expanded(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Block:
    """Some rows of one task: by language the distinct words, the rows' ids and which words each row holds."""

    def __init__(self, bags: bool):
        self.bags = bags
        self.langs: dict[str, tuple[Vocabulary, list[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray]]]] = {}
        self.chars = self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        rows: dict[str, list[int]] = defaultdict(list)
        for i, lang in enumerate(batch["lang"].to_pylist()):
            rows[lang].append(i)
        texts = batch["text"]
        for lang, own in rows.items():
            vocabulary, ids, words = self.langs.setdefault(lang, (Vocabulary(), [], []))
            ids.append(batch.select(KEYS).take(pa.array(own)))
            for i in own:
                got = vocabulary.read(texts[i].as_py())
                if self.bags:
                    words.append(np.unique(got, return_counts=True))
        self.chars += batch.nbytes
        self.rows += batch.num_rows

    def number(self) -> int:
        """A hash of the block's ids and words: the same each time the same rows are read."""
        h = xxhash.xxh3_64()
        for lang in sorted(self.langs):
            vocabulary, ids, _ = self.langs[lang]
            h.update(repr((lang, len(vocabulary.ids))).encode())
            h.update(b"\n".join(vocabulary.ids))
            h.update(_ipc(ids))
        return h.intdigest() >> 1


def _ipc(ids: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ids[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(pa.Table.from_batches(ids).combine_chunks())
    return sink.getvalue().to_pybytes()


def _words(vocabulary: Vocabulary) -> list[str]:
    return [w.decode("utf-8", "replace") for w in vocabulary.ids]


def _blocks(batches: Iterator[pa.RecordBatch], bags: bool) -> Iterator[Block]:
    """What a task reads in blocks of up to BLOCK_CHARS bytes or BLOCK_ROWS rows."""
    block = Block(bags)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            block.add(batch.slice(at, 1000))
            if block.chars > BLOCK_CHARS or block.rows >= BLOCK_ROWS:
                yield block
                block = Block(bags)
                release()
    if block.rows:
        yield block
    del block
    release()


def requests(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, block, keys): which grams each block needs, full grams with all their tails and contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, bags=False):
            number = block.number()
            wanted = []
            for lang in sorted(block.langs):
                wanted.append(Grams(_words(block.langs.pop(lang)[0]), lang).wanted())
            keys = np.unique(np.concatenate(wanted))
            shard, begins = np.unique(_shard(keys, shards), return_index=True)
            parts = np.split(keys, begins[1:])
            packed = [_squeezed(np.diff(p, prepend=np.uint64(0))) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array(packed, pa.binary())], names=["shard", "block", "keys"])

    return rows.mapInArrow(run, "shard int, block long, keys binary")


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Which range of the keys a key falls into."""
    return np.minimum((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.uint64(shards - 1)).astype(np.int32)


def dealt(table: DataFrame, shards: int) -> DataFrame:
    """(shard, key, logp, bow): the gram table by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, langs = batch["gram"].to_pylist(), batch["lang"].to_pylist()
            seeds = {lang: _seed(lang) for lang in set(langs)}
            codes, size = _codes("".join(grams)), np.array([len(g) for g in grams], dtype=np.int64)
            ends = np.cumsum(size) - 1
            h = np.array([seeds[x] for x in langs], dtype=np.uint64)
            for back in range(ORDER):
                on = size > back
                h[on] = _step(h[on], codes[ends[on] - back])
            h = _spread(h)
            yield pa.RecordBatch.from_arrays([pa.array(_shard(h, shards)), pa.array(h.view(np.int64)), batch["logp"], batch["bow"]], names=["shard", "key", "logp", "bow"])

    return table.select("lang", "gram", "logp", "bow").mapInArrow(run, "shard int, key long, logp float, bow float")


def answers(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(block, shard, logp, bow): for the keys a block asks a shard for, in their order; NaN for what the table lacks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        known = right["key"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        known = np.append(known[order], np.uint64(2**64 - 1))
        values = [np.append(right[c].to_numpy().astype(np.float32)[order], np.float32("nan")) for c in ("logp", "bow")]
        out: dict[str, list] = {"block": left["block"].to_pylist(), "shard": left["shard"].to_pylist(), "logp": [], "bow": []}
        for packed in left["keys"]:
            keys = np.cumsum(_expanded(packed.as_py(), np.uint64), dtype=np.uint64)
            at = np.searchsorted(known, keys)
            met = known[at] == keys
            for name, of in zip(("logp", "bow"), values, strict=True):
                out[name].append(_squeezed(np.where(met, of[at], np.float32("nan"))))
        return pa.table({"block": pa.array(out["block"], pa.int64()), "shard": pa.array(out["shard"], pa.int32()), "logp": pa.array(out["logp"], pa.binary()), "bow": pa.array(out["bow"], pa.binary())})

    return asked.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(run, "block long, shard int, logp binary, bow binary")


PACKED = "block long, lang string, ids binary, words binary, sizes binary, held binary, times binary"


def pack(rows: DataFrame) -> DataFrame:
    """``rows(k, h, ln, lang, text)`` in blocks, one row a block and language: the words, and for each text which it holds and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for block in _blocks(batches, bags=True):
            number = block.number()
            out = []
            while block.langs:
                lang, (vocabulary, ids, bags) = block.langs.popitem()
                sizes = np.array([len(held) for held, _ in bags], dtype=np.uint32)
                held = np.concatenate([np.diff(held, prepend=0) for held, _ in bags]).astype(np.uint32)
                times = np.concatenate([n for _, n in bags]).astype(np.uint32)
                words = zstandard.ZstdCompressor(level=9).compress(b"\n".join(vocabulary.ids))
                out.append({"block": number, "lang": lang, "ids": _ipc(ids), "words": words, "sizes": _squeezed(sizes), "held": _squeezed(held), "times": _squeezed(times)})
                del vocabulary, ids, bags
            yield from pa.Table.from_pylist(out, schema=pa.schema([(c, {"long": pa.int64(), "string": pa.string()}.get(k, pa.binary())) for c, k in (x.split() for x in PACKED.split(", "))])).to_batches()

    return rows.mapInArrow(run, PACKED)


def score_blocks(blocks: DataFrame, answered: DataFrame, kind: str) -> DataFrame:
    """Per row: k, h, ln (see ``judge``), lang, n_events and units, the natural log-likelihood of the whole text in fixed point."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        release()  # what the group before has left
        got = {s: (p, b) for s, p, b in zip(right["shard"].to_pylist(), right["logp"].to_pylist(), right["bow"].to_pylist(), strict=True)}
        logp, bow = (np.concatenate([_expanded(got[s][i], np.float32) for s in sorted(got)]) if got else np.empty(0, np.float32) for i in (0, 1))
        del got
        texts = [(r["lang"], Grams(zstandard.ZstdDecompressor().decompress(r["words"]).decode("utf-8", "replace").split("\n"), r["lang"]), r) for r in left.to_pylist()]
        keys = np.unique(np.concatenate([grams.wanted() for _, grams, _ in texts])) if texts else np.empty(0, np.uint64)
        if len(keys) != len(logp):
            raise RuntimeError("a block's rows differ between two reads of the input; write the input to a table first")
        out = []
        for lang, grams, r in texts:
            ids = pa.ipc.open_stream(r["ids"]).read_all()
            events, units = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            word_units = grams.logs(keys, logp, bow)
            if word_units is not None:
                sizes, times = _expanded(r["sizes"], np.uint32).astype(np.int64), _expanded(r["times"], np.uint32).astype(np.int64)
                begins = np.cumsum(sizes) - sizes
                steps = np.cumsum(_expanded(r["held"], np.uint32).astype(np.int64))
                before = np.append(0, steps)[begins]
                held = steps - np.repeat(before, sizes)
                total = lambda per_word: np.diff(np.append(0, np.cumsum(per_word[held] * times))[np.append(begins, len(held))])  # noqa: B023, E731
                events, units = total(grams.sizes.astype(np.int64)), total(word_units)
            for name, values in (("lang", pa.array([lang] * len(ids), pa.string())), ("n_events", pa.array(events)), ("units", pa.array(units))):
                ids = ids.append_column(name, values)
            out.append(ids)
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, f"k {kind}, h long, ln boolean, lang string, n_events long, units long")


def limits(good: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang_key, mean, threshold) of trusted rows ``(lang_key, n_events, log_perplexity)``.

    Means are sums in fixed point, and the quantile is found in a table of counts by language and excess (in steps of one
    ``EXCESS_UNIT``-th), so no task sees all rows of a language: the smallest excess that a share ``quantile`` of the
    rows does not exceed.
    """
    units = F.round(F.col("log_perplexity") * EXCESS_UNIT).cast("long")
    means = cut(good.groupBy("lang_key").agg((F.sum(units) / F.count("*") / EXCESS_UNIT).alias("mean")))
    steps = good.join(small(means), "lang_key").groupBy("lang_key", F.round(excess() * EXCESS_UNIT).cast("long").alias("step")).agg(F.count("*").alias("n"))
    # counts of equal ranges of 1000 steps come first, so that a window sees a bounded number of rows of a language
    steps = cut(steps.withColumn("range", F.floor(F.col("step") / 1000)))
    by = Window.partitionBy("lang_key").orderBy("range")
    ranges = steps.groupBy("lang_key", "range").agg(F.sum("n").alias("rows"))
    ranges = ranges.withColumn("upto", F.sum("rows").over(by)).withColumn("all", F.sum("rows").over(Window.partitionBy("lang_key")))
    met = ranges.where((F.col("upto") >= F.col("all") * quantile) & (F.col("upto") - F.col("rows") < F.col("all") * quantile)).withColumn("before", F.col("upto") - F.col("rows"))
    inside = steps.join(small(cut(met.select("lang_key", "range", "before", "all"))), ["lang_key", "range"])
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("lang_key").orderBy("step")))
    found = inside.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang_key").agg((F.min("step") / EXCESS_UNIT).alias("threshold"))
    return cut(means.join(found, "lang_key"))


def excess() -> Column:
    return (F.col("log_perplexity") - F.col("mean")) * F.col("n_events") / (F.col("n_events") + PRIOR)


def judge(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", quantile: float = QUANTILE) -> DataFrame:
    """(id_col, text_hash, lang, n_events, perplexity, excess, threshold, keep): one row a row of ``docs``.

    ``docs`` needs id_col, text, lang; ``trusted_ids`` holds the ids of trusted rows. (id, text_hash, lang) tells rows apart.
    """
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col), "text", "lang")
    trusted = small(cut(trusted_ids.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct()))
    shards = parts_for(text_bytes(base), SHARD_BYTES)
    with batches_of(docs.sparkSession, TEXT_ROWS):
        table = cut(model(count_grams(base.join(trusted, id_col, "left_semi"))))
    forget(docs.sparkSession)  # the model is written: its shuffle files need not wait for the driver's next collection
    text = F.coalesce("text", F.lit(""))
    rows = base.select(F.col(id_col).alias("k"), F.xxhash64(text).alias("h"), F.col("lang").isNull().alias("ln"), F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"))
    answered = answers(requests(rows, shards), dealt(table, shards))
    with batches_of(docs.sparkSession, TEXT_ROWS):
        scored = cut(score_blocks(pack(rows), answered, kind))
    forget(docs.sparkSession)
    lang = F.when(~F.col("ln"), F.col("lang")).alias("lang")
    log_perplexity = F.when(F.col("n_events") > 0, -F.col("units") / LOG_UNIT / F.col("n_events")).alias("log_perplexity")
    scored = scored.select(F.col("k").alias(id_col), F.col("h").alias("text_hash"), lang, F.col("lang").alias("lang_key"), "n_events", log_perplexity)
    good = scored.join(trusted, id_col, "left_semi").where("log_perplexity is not null")
    # one row a language
    out = scored.join(small(limits(good, quantile)), "lang_key", "left").withColumn("excess", F.round(F.round(excess() * EXCESS_UNIT) / EXCESS_UNIT, 6))
    out = out.withColumn("perplexity", F.exp("log_perplexity")).withColumn("keep", F.coalesce(F.col("excess") <= F.col("threshold"), F.lit(True)))
    return out.select(id_col, "text_hash", "lang", "n_events", "perplexity", "excess", "threshold", "keep")
