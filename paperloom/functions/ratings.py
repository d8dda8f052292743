"""Rating and label maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale_recommendation(r: Column) -> Column:
    """1-9 to 1-4."""
    return F.when(r <= 1, 1).when(r <= 5, 2).when(r <= 7, 3).when(r.isNotNull(), 4)


def parse_rating(c: Column) -> Column:
    """The whole number before the first separator; a text without separator is null."""
    return F.nullif(F.regexp_extract(c, r"^([0-9]+)[\s\W]+", 1), F.lit("")).try_cast("int")


def clamp(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def apply_rating_mode(r: Column, mode: str) -> Column:
    if mode == "original":
        return r
    if mode == "binary":
        return (r >= 4).cast("int")
    return F.when(r <= 2, 1).when(r == 3, 2).when(r.isNotNull(), 3)


def score_to_rating(s: Column) -> Column:
    return F.when(s < 0.2, 1).when(s < 0.4, 2).when(s < 0.6, 3).when(s < 0.8, 4).when(s.isNotNull(), 5)


def binary_label(r: Column) -> Column:
    return (r >= 3).cast("int")


def novelty_probability(label: Column, p: Column) -> Column:
    return F.when(p.isNull(), F.when(label >= 4, 1.0).otherwise(0.0)).when(label < 4, F.least(p, F.lit(0.4))).otherwise(F.greatest(p, F.lit(0.6)))


def final_rating(main_recommendation: Column, main_rating: Column) -> Column:
    return F.coalesce(scale_recommendation(main_recommendation), main_rating, F.lit(0))


def conference_parts(conf: Column, year: Column) -> Column:
    """Struct (name, year): trailing four digits fill a null year and leave the name."""
    tail = F.nullif(F.regexp_extract(conf, r"([0-9]{4})$", 1), F.lit("")).try_cast("int")
    return F.struct(F.regexp_replace(conf, r"[0-9]{4}$", "").alias("name"), F.coalesce(year, tail).alias("year"))
