"""Ordered folds: a key's rows in order, one batch after the other, with nothing held but the state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _breaks(keys: pd.DataFrame) -> np.ndarray:
    """Where a batch's keys change; nulls equal each other."""
    if len(keys) == 0:
        return np.zeros(0, dtype=np.int64)
    before, after = keys.iloc[:-1].reset_index(drop=True), keys.iloc[1:].reset_index(drop=True)
    same = ((before == after) | (before.isna() & after.isna())).all(axis=1).to_numpy()
    return np.concatenate([[0], np.flatnonzero(~same) + 1])


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame | None], end: Callable[[Any], pd.DataFrame | None], schema: str, parts: int | None = None) -> DataFrame:
    """Fold each key's rows in their order: ``schema`` are the keys and what ``step`` and ``end`` return.

    Rows are dealt by key and sorted within partitions (Spark spills what does not fit), then pass through Arrow batches:
    ``step(state, rows)`` gets a key's next rows and may change the state and return a row for each; ``end(state)`` may
    return rows when the key is done. Only the state lives on between batches, so a key may have any number of rows; they
    are worked off one after the other, as an ordered fold must.
    """
    n = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def named(made: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
            if made is not None and len(made):
                for at, (name, value) in enumerate(zip(keys, now, strict=True)):
                    made.insert(at, name, pd.Series([None if value is pd.NA else value] * len(made), index=made.index, dtype="object" if value is pd.NA else None))
                yield made

        for batch in batches:
            cuts = [*_breaks(batch[keys]), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.iloc[lo:hi]
                key = tuple(pd.NA if pd.isna(v) else v for v in rows[keys].iloc[0])
                if now is None or any((a is pd.NA) != (b is pd.NA) or (a is not pd.NA and a != b) for a, b in zip(now, key, strict=True)):
                    if now is not None:
                        yield from named(end(state))
                    now, state = key, start()
                yield from named(step(state, rows))
        if now is not None:
            yield from named(end(state))

    kinds = dict(df.dtypes)
    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    whole = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema])
    assert n == len(set(keys))
    return dealt.sortWithinPartitions(*keys, *[F.col(o) for o in order]).mapInPandas(run, whole)
