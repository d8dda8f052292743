"""Prompt and evidence texts built from rows: lists, bibliographies, sections, size statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators.aggregate import describe

NO_RELATED = "[No related papers available]"
NO_SECTION = "[Section not available]"


def ordered_text(value: Column, order: Column, sep: str) -> Column:
    """Aggregate: the values joined in the order of ``order``."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def size_stats(df: DataFrame, prompt: str, keys: list[str]) -> DataFrame:
    return describe(df.withColumn("__n", tx.count_tokens(F.col(prompt))), "__n", keys)


def format_related(related: DataFrame, use_abstracts: bool = False) -> DataFrame:
    """(paper_id, related, retrieved): both texts of a paper's related papers, by score."""
    r = related.withColumn("r", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "related_id")))
    body = F.col("abstract" if use_abstracts else "summary")
    line = F.concat(F.lit("ID: "), "related_id", F.lit("\nTitle: "), "title", F.lit("\nSource: "), "source", F.lit("\nAbstract: " if use_abstracts else "\nSummary: "), body, F.lit("\n"))
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    paper = F.concat(F.lit("Paper "), F.col("r").cast("string"), F.lit(": "), "title", year, F.lit("\nAbstract: "), body)
    return r.groupBy("paper_id").agg(ordered_text(line, F.col("r"), "\n\n").alias("related"), ordered_text(paper, F.col("r"), "\n\n").alias("retrieved"))


def bibliography(refs: DataFrame, key: str) -> DataFrame:
    line = tx.bibliography_line(*[F.col(c) for c in ("citation_key", "title", "authors", "year")])
    return refs.where(F.coalesce("citation_key", F.lit("")) != "").groupBy(key).agg(ordered_text(line, F.col("ord"), "\n").alias("bibliography"))


def imrad(sections: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """One column a section kind: its texts joined by a blank line, cut to ``most`` tokens."""
    s = sections.withColumn("__kind", tx.section_kind(tx.strip(F.col("heading"))))
    out = s.groupBy(key).pivot("__kind", list(tx.SECTION_KINDS)).agg(ordered_text(F.col("text"), F.col("ord"), "\n\n"))
    shown = lambda k: F.coalesce(tx.truncate_tokens(F.col(k), most) if most else F.col(k), F.lit(NO_SECTION)).alias(k)
    return out.select(key, *[shown(k) for k in tx.SECTION_KINDS])


def bibitems(df: DataFrame, column: str, default: str = "Unknown Title") -> DataFrame:
    """Explode ``\\bibitem`` blocks: key, title (``default`` if it is missing), year, authors (joined by ``|``)."""
    rows = df.withColumn("__b", F.explode(tx.bibitem_blocks(F.col(column)))).drop(column)
    return rows.withColumn("__f", tx.bibitem_fields(F.col("__b"), default)).select(*[c for c in rows.columns if c != "__b"], "__f.*")


def sanitise(df: DataFrame, list_most: int = 50, text_most: int = 1000, depth_most: int = 6, key_most: int | None = None) -> DataFrame:
    """Cut every nested column: entries of lists and maps, lengths of texts and of map keys, and levels of nesting.

    Maps keep their first entries by key; of keys that become equal when cut the first stays. What lies deeper than
    ``depth_most`` levels (lists, maps and structs count) becomes the text ``...``.
    """
    from pyspark.sql import types as T

    keys = key_most or text_most

    def entries(c: Column) -> Column:
        """Sorted entries with cut keys, the first of equal ones."""
        cut = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.struct(F.left(e["key"].cast("string"), F.lit(keys)).alias("key"), e["value"].alias("value")))
        return F.filter(cut, lambda e, i: (i == 0) | ~F.exists(F.slice(cut, 1, i), lambda x: x["key"] == e["key"]))

    def fix(c: Column, kind: T.DataType, depth: int) -> Column:
        if isinstance(kind, T.StringType):
            return F.left(c, F.lit(text_most))
        if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return c
        if depth >= depth_most:
            return F.when(c.isNotNull(), F.lit("..."))
        if isinstance(kind, T.ArrayType):
            return F.transform(F.slice(c, 1, list_most), lambda x: fix(x, kind.elementType, depth + 1))
        if isinstance(kind, T.MapType):
            return F.map_from_entries(F.transform(F.slice(entries(c), 1, list_most), lambda e: F.struct(e["key"].alias("key"), fix(e["value"], kind.valueType, depth + 1).alias("value"))))
        return F.when(c.isNotNull(), F.struct(*[fix(c[f.name], f.dataType, depth + 1).alias(f.name) for f in kind.fields]))

    return df.select(*[fix(F.col(f"`{f.name}`"), f.dataType, 1).alias(f.name) for f in df.schema.fields])


def longest_by_words(df: DataFrame, key: str, text: str, order_by: str) -> DataFrame:
    """(key, order_by, n): the row with the most words, first by ``order_by`` on ties."""
    n = df.select(key, order_by, tx.word_count(F.col(text)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), order_by))).where("r = 1").drop("r")
