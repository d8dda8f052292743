"""Edit-aware token counts.

Each document keeps a segment tree over blocks of pre-tokens: leaves hold a block's length and token count, inner nodes
the sums. Blocks are cut before a blank that stands between two letters; such a blank always begins a pre-token, so the
counts of the blocks add up to the count of the whole text. An edit re-encodes only the blocks it touches plus one block
of context on either side, and updates the sums on the paths to the root; the other blocks are never encoded again.

``build_trees`` encodes whole texts once; its result is kept as a table. ``edit_trees`` takes rows of that table with edits,
in the same or any later job, and encodes only what they touch; its result can be kept and edited again.

Every document is handled by itself, whatever its length, in Arrow batches: no shuffle, no hot key. Null and empty texts
have one empty leaf and 0 tokens. Null or empty edit lists change nothing. Edits are (start, end, replacement) in code
points of the old text; they are clipped to the text, and an edit that overlaps an earlier one is clipped to what
is left. Equal rows give equal results. Extra columns pass through; those named as an added
one are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 512

_made: dict[int, Callable[[str], int]] = {}


def counter(vocabulary: bytes) -> Callable[[str], int]:
    """Token counter of a vocabulary file's bytes; made once a worker."""
    key = hash(vocabulary)
    if key not in _made:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encoding = tiktoken.Encoding("pre-token-trees", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _made[key] = lambda t: len(encoding.encode_ordinary(t)) if t else 0
    return _made[key]


def is_cut(text: str, i: int) -> bool:
    """Whether a block may begin at ``i``."""
    return 0 < i < len(text) - 1 and text[i] == " " and text[i - 1].isalpha() and text[i + 1].isalpha()


def blocks(text: str, size: int = LEAF_CHARS) -> list[str]:
    out, start = [], 0
    while True:
        i = text.find(" ", start + size)
        while i >= 0 and not is_cut(text, i):
            i = text.find(" ", i + 1)
        if i < 0:
            return [*out, text[start:]]
        out.append(text[start:i])
        start = i


def build(counts: list[int]) -> list[int]:
    """Segment tree as a heap: node i has children 2i and 2i+1, leaves stand at the end; node 1 is the sum."""
    n = 1 << (len(counts) - 1).bit_length()
    tree = [0] * n + list(counts) + [0] * (n - len(counts))
    for i in range(n - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def put(tree: list[int], leaf: int, value: int) -> None:
    i = len(tree) // 2 + leaf
    more = value - tree[i]
    while i and more:
        tree[i] += more
        i //= 2


def apply_edits(text: str, lengths: list[int], tree: list[int], edits: list[tuple[int, int, str]], count: Callable[[str], int]) -> tuple[str, list[int], list[int], int]:
    """New text, leaf lengths and tree, and how many characters were encoded again. The leaves keep their places."""
    starts, at = [], 0
    for n in lengths:
        starts.append(at)
        at += n
    tidy, done = [], 0
    for a, b, new in sorted(edits, key=lambda e: (e[0], e[1])):
        a, b = max(done, min(a, len(text))), max(done, min(b, len(text)))
        tidy.append((a, max(a, b), new or ""))
        done = max(a, b)
    touched: list[list[int]] = []
    last = len(lengths) - 1
    for a, b, _ in tidy:
        lo = max(0, bisect.bisect_right(starts, a) - 2)
        hi = min(last, bisect.bisect_right(starts, max(a, b)))
        if touched and lo <= touched[-1][1] + 1:
            touched[-1][1] = max(touched[-1][1], hi)
        else:
            touched.append([lo, hi])
    out, at, again = [], 0, 0
    lengths, tree = list(lengths), list(tree)

    def edited(lo: int, hi: int) -> str:
        a0, b0 = starts[lo], starts[hi] + old[hi]
        got, here = [], a0
        for a, b, new in tidy:
            if a0 <= a and b <= b0:
                got += [text[here:a], new]
                here = b
        return "".join([*got, text[here:b0]])

    old = list(lengths)
    for n, (lo, hi) in enumerate(touched):
        while True:  # context: the region must still begin and end at a border of blocks
            new = edited(lo, hi)
            before, after = starts[lo], starts[hi] + old[hi]
            if lo > 0 and not is_cut(text[before - 1] + new, 1):
                lo -= 1
            elif hi < last and not (new and new[-1].isalpha() and is_cut(text, after)):
                hi += 1
            else:
                break
        touched[n] = [lo, hi]
        if n and lo <= touched[n - 1][1]:  # grew into its neighbour: do both as one
            return apply_whole(text, tidy, len(lengths), count)
        out += [text[at : starts[lo]], new]
        at = starts[hi] + old[hi]
        again += len(new)
        for leaf in range(lo, hi + 1):
            lengths[leaf] = len(new) if leaf == lo else 0
            put(tree, leaf, count(new) if leaf == lo else 0)
    return "".join([*out, text[at:]]), lengths, tree, again


def apply_whole(text: str, edits: list[tuple[int, int, str]], leaves: int, count: Callable[[str], int]) -> tuple[str, list[int], list[int], int]:
    """Edit and count anew, for regions that run into each other."""
    out, at = [], 0
    for a, b, new in edits:
        out += [text[at:a], new]
        at = b
    new = "".join([*out, text[at:]])
    made = blocks(new)
    return new, [len(b) for b in made], build([count(b) for b in made]), len(new)


TREE = {"n_tokens": "long", "leaf_chars": "array<int>", "tree": "array<int>"}
EDITED = {"n_tokens_edited": "long", "n_leaves": "int", "chars_again": "long"}


def _added(df: DataFrame, make: Callable[[pd.DataFrame, Callable[[str], int]], dict], columns: dict[str, str], vocabulary: str) -> DataFrame:
    """``df`` with columns that ``make`` works out for a batch."""
    with open(vocabulary, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(held.value)
        for batch in batches:
            yield batch.assign(**{k: pd.Series(v, index=batch.index, dtype=None if len(v) else object) for k, v in make(batch, count).items()})[names]

    kinds = {k: v for k, v in df.dtypes if k not in columns} | columns
    names = list(kinds)
    return df.select(*[f"`{c}`" for c in df.columns]).mapInPandas(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))


def build_trees(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with n_tokens, leaf_chars and tree: every text is encoded once, block by block."""

    def make(batch: pd.DataFrame, count: Callable[[str], int]) -> dict:
        made = [blocks(t or "") for t in batch[text]]
        trees = [build([count(b) for b in m]) for m in made]
        return {"n_tokens": [t[1] for t in trees], "leaf_chars": [[len(b) for b in m] for m in made], "tree": trees}

    return _added(docs, make, TREE, vocabulary)


def edit_trees(stored: DataFrame, edits: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of ``build_trees`` with the column ``edits`` (array of struct start, end, replacement) applied.

    text, leaf_chars and tree are then those after the edits; n_tokens stays. Adds n_tokens_edited, n_leaves and
    chars_again (characters encoded again).
    """

    def make(batch: pd.DataFrame, count: Callable[[str], int]) -> dict:
        out: dict[str, list] = {k: [] for k in ("text", "leaf_chars", "tree", *EDITED)}
        for t, lengths, tree, e in zip(batch[text], batch["leaf_chars"], batch["tree"], batch[edits], strict=True):
            again, lengths, tree = 0, [int(x) for x in lengths], [int(x) for x in tree]
            if e is not None and len(e):
                t, lengths, tree, again = apply_edits(t or "", lengths, tree, [(x["start"], x["end"], x["replacement"]) for x in e], count)
            for k, v in zip(out, (t, lengths, tree, tree[1], len(lengths), again), strict=True):
                out[k].append(v)
        return {text if k == "text" else k: v for k, v in out.items()}

    kind = "array<struct<start:int,end:int,replacement:string>>"
    return _added(stored.withColumn(edits, F.col(f"`{edits}`").cast(kind)), make, {text: "string", "leaf_chars": "array<int>", "tree": "array<int>"} | EDITED, vocabulary)


def counted(docs: DataFrame, edits: Column, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Both steps in one job: id, n_tokens, n_tokens_edited, n_leaves, chars_again, leaf_chars and tree of each document."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").alias("__text"), edits.alias("__edits"))
    got = edit_trees(build_trees(rows, "__text", vocabulary), "__edits", "__text", vocabulary)
    return got.select(id_col, "n_tokens", "n_tokens_edited", "n_leaves", "chars_again", "leaf_chars", "tree")
