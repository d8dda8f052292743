"""Row filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import strip


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all columns are there and not empty (texts, lists, maps)."""
    kinds = dict(df.dtypes)
    for c in columns:
        kind = kinds[c]
        col = F.col(c)
        df = df.where(col.isNotNull() & ((F.size(col) > 0) if kind.startswith(("array", "map")) else (col != "") if kind == "string" else F.lit(True)))
    return df


def non_blank(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def valid_annotations(df: DataFrame, lists: list[str], relations: str = "relations", background: str = "background", target: str = "target") -> DataFrame:
    """At least one relation, two filled lists of terms, and both texts."""
    filled = sum((F.coalesce(F.size(c) > 0, F.lit(False)).cast("int") for c in lists[1:]), F.coalesce(F.size(lists[0]) > 0, F.lit(False)).cast("int"))
    return df.where((F.size(relations) > 0) & (filled >= 2) & (F.coalesce(background, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != ""))


def partition_errors(df: DataFrame, column: str, sentinel: str = "<error>") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, error rows, one-line report)."""
    bad = F.coalesce(F.col(column) == sentinel, F.lit(False))
    report = df.agg(F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_error"), F.count("*").alias("n"))
    report = report.select("n_good", "n_error", *[F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n")), F.lit(0.0)), 4).alias(f"{c}_pct") for c in ("n_good", "n_error")])
    return df.where(~bad), df.where(bad), report


def drop_empty(df: DataFrame, column: str, marks: list[str]) -> DataFrame:
    """Rows whose text is not empty and none of the marks for "nothing"."""
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").where(~F.col(column).isin(marks))


def resolve_year_month(year: Column, published: Column, arxiv: Column) -> Column:
    """Struct (year, month): of the arXiv id if its year agrees, else of the publication date if its year agrees."""
    own = lambda y, m: F.struct(y.alias("year"), m.alias("month"))
    return F.coalesce(F.when(arxiv["year"] == year, own(arxiv["year"], arxiv["month"])), F.when(F.year(published) == year, own(F.year(published), F.month(published))))


def published_not_after(main_year: Column, main_month: Column, year: Column, published: Column) -> Column:
    """Earlier year: yes, later: no; in the same year only if the candidate's month is known and not after."""
    month = F.when(F.year(published) == year, F.month(published))
    return F.coalesce(F.when(year.isNull() | main_year.isNull(), False).when(year < main_year, True).when(year > main_year, False).otherwise(month <= main_month), F.lit(False))


def published_before_year(df: DataFrame, year: str, limit: int) -> DataFrame:
    return df.where(F.col(year).isNotNull() & (F.col(year) != 0) & (F.col(year) < limit))


def threshold(df: DataFrame, score: str, t: float) -> DataFrame:
    return df.where(F.col(score) >= t)


def icase_get(m: Column, key: str, default: str | None = None) -> Column:
    hit = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == key.lower())
    return F.coalesce(F.try_element_at(hit, F.lit(1))["value"], F.lit(default))


def path_get(json: Column, path: str, default: str | None = None) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit(default))


def unwrap_value(json: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{key}.value"), F.get_json_object(json, f"$.{key}"))


def submission_valid(replies: Column, pdf: Column, title: Column, abstract: Column, rating_keys: list[str]) -> Column:
    """``replies``: array of maps. Some reply has a rating, some has a decision, and the three texts are there."""
    has = lambda keys: F.exists(replies, lambda m: F.exists(F.map_keys(m), lambda k: k.isin(keys)))
    return F.coalesce(has(rating_keys) & has(["decision"]) & non_blank(pdf) & non_blank(title) & non_blank(abstract), F.lit(False))


def find_approval(replies: Column) -> Column:
    """Whether the first reply with a decision is not a rejection; null without one."""
    first = F.try_element_at(F.filter(replies, lambda m: F.map_contains_key(m, "decision")), F.lit(1))
    return F.lower(F.try_element_at(first, F.lit("decision"))) != "reject"


def correct_predictions(df: DataFrame, y_true: str, y_pred: str, rationale: str, related: str) -> DataFrame:
    return df.where((F.col(y_true) == F.col(y_pred)) & non_blank(F.col(rationale)) & (F.col(rationale) != "<error>") & (F.size(related) > 0))


def convert_keys(df: DataFrame, mode: str) -> DataFrame:
    """Rename nested fields between snake_case and camelCase; values stay as they are."""

    def name(n: str) -> str:
        if mode == "camel":
            head, *rest = n.split("_")
            return head + "".join(x[:1].upper() + x[1:] for x in rest)
        return "".join(f"_{c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(n))

    def kind(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(name(f.name), kind(f.dataType), f.nullable) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(kind(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(t.keyType, kind(t.valueType), t.valueContainsNull)
        return t

    return df.select(*[F.col(f"`{f.name}`").cast(kind(f.dataType)).alias(name(f.name)) for f in df.schema.fields])


def slice_counts(related: DataFrame, key: str = "paper_id") -> DataFrame:
    """Counts a paper of each (source, polarity) slice."""
    pairs = [(s, p) for s in ("citation", "semantic") for p in ("positive", "negative")]
    return related.groupBy(key).agg(*[F.count_if((F.col("source") == s) & (F.col("polarity") == p)).alias(f"{s}_{p}") for s, p in pairs])
