"""Text encoders: a hashing one without a model, and the hook for any other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Prompts of a batch that a task holds as Python objects.
ASKED = 100


def hashing_encoder(df: DataFrame, text: str, dim: int = 256, out: str = "embedding") -> DataFrame:
    """Word counts hashed into ``dim`` places, weighted by inverse document frequency over ``df``, as unit vectors.

    A text without words (or with words that every text has) is all zeros. The frequencies are one pass over ``df`` with
    ``dim`` numbers as result.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("__words", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    counts = HashingTF(numFeatures=dim, inputCol="__words", outputCol="__tf").transform(words)
    weighted = IDF(inputCol="__tf", outputCol="__weighted").fit(counts).transform(counts)
    unit = Normalizer(p=2.0, inputCol="__weighted", outputCol="__unit").transform(weighted)
    return unit.withColumn(out, vector_to_array("__unit").cast("array<float>")).drop("__words", "__tf", "__weighted", "__unit")


def encode_with(df: DataFrame, text: str, encoder: Callable[[pd.Series], pd.Series], name: str, out: str = "embedding") -> DataFrame:
    """Any encoder (texts -> lists of floats), applied once to each distinct text; ``name`` becomes column metadata."""
    wrapped = F.pandas_udf(encoder, "array<float>")
    distinct = df.select(text).distinct().withColumn(out, wrapped(F.col(text)))
    joined = df.join(distinct.withColumnRenamed(text, "__t"), F.col(text).eqNullSafe(F.col("__t")), "left").drop("__t")
    return joined.withMetadata(out, {"encoder": name})


def encoder_of(df: DataFrame, column: str = "embedding") -> str | None:
    """The name of the encoder that made a column; null if it is not known (other sources keep no metadata)."""
    return df.schema[column].metadata.get("encoder")


def require_encoder(df: DataFrame, name: str, column: str = "embedding") -> DataFrame:
    """``df``, if its vectors come from this encoder: vectors of different models have nothing to say to each other."""
    own = encoder_of(df, column)
    if own != name:
        raise ValueError(f"incompatible encoder: expected {name!r}, got {own!r}")
    return df


def respond_with(df: DataFrame, prompt: str, responder: Callable[[str], tuple[str, float]], error: str = "<error>") -> DataFrame:
    """Rows of prompts to rows of responses: adds response and cost; a failed call is the sentinel at cost 0.

    Columns stay Arrow's; only ``ASKED`` prompts at a time are Python objects.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                part = batch.slice(at, ASKED)
                out = []
                for p in part[prompt].to_pylist():
                    try:
                        out.append(responder(p))
                    except Exception:
                        out.append((error, 0.0))
                replies = [pa.array([x[0] for x in out], pa.string()), pa.array([float(x[1]) for x in out], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *replies], names=[*columns, "response", "cost"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.select(columns).mapInArrow(run, f"{schema}, response string, cost double")
