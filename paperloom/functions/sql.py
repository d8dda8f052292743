"""The column functions by name in ``spark.sql``.

``register(spark)`` makes a temporary SQL function of each: its body is the SQL text of the column expression, so Catalyst
puts it in place of the call and optimises it with the rest of the query. Only the three text ratios, which have no
expression, are Arrow functions.

    register(spark)
    spark.sql("SELECT clean_title(title), word_count(abstract) FROM papers")
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import fuzzy, ratings, variant
from paperloom.functions import text as tx

EVIDENCE = "ARRAY<STRUCT<text: STRING, paper_title: STRING>>"
RELATED = "ARRAY<STRUCT<related_id: STRING, title: STRING, source: STRING, body: STRING, year: INT, score: DOUBLE>>"
REFERENCES = "ARRAY<STRUCT<citation_key: STRING, title: STRING, authors: ARRAY<STRING>, year: INT>>"
SECTIONS = "ARRAY<STRUCT<heading: STRING, text: STRING>>"
_T = "t STRING"

#: Name -> (parameters, the expression over them).
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "strip_text": (_T, tx.strip),
    "squeeze_text": (_T, tx.squeeze),
    "casefold": (_T, tx.casefold),
    "clean_title": (_T, tx.clean_title),
    "clean_title_alpha": (_T, tx.clean_title_alpha),
    "match_title": (_T, tx.match_title),
    "normalise_text": (_T, tx.normalise_text),
    "squash_title": (_T, tx.squash_title),
    "alpha_ascii": (_T, tx.alpha_ascii),
    "clean_query": (_T, tx.clean_query),
    "remove_line_numbers": (_T, tx.remove_line_numbers),
    "remove_page_numbers": (_T, tx.remove_page_numbers),
    "compress_whitespace": (_T, tx.compress_whitespace),
    "trim_paragraphs": (_T, tx.trim_paragraphs),
    "clean_maintext": (_T, tx.clean_maintext),
    "fix_spaces_before_punctuation": (_T, tx.fix_spaces_before_punctuation),
    "section_number": (_T, tx.section_number),
    "remove_parenthetical": (_T, tx.remove_parenthetical),
    "removeprefix_icase": ("t STRING, prefix STRING", tx.remove_prefix_icase),
    "clean_summary": (_T, tx.clean_summary),
    "truncate_chars": ("t STRING, n INT, suffix STRING DEFAULT ''", tx.truncate_chars),
    "count_tokens": (_T, tx.count_tokens),
    "truncate_tokens": ("t STRING, n INT", tx.truncate_tokens),
    "fit_prompt": ("system STRING, prompt STRING, most INT", tx.fit_prompt),
    "render_template": ("template STRING, fields MAP<STRING, STRING>", tx.fill_template),
    "prompt_tokens": ("template STRING, fields MAP<STRING, STRING>", lambda t, f: tx.count_tokens(tx.fill_template(t, f))),
    "numbered_list": ("items ARRAY<STRING>", tx.numbered_list),
    "bullet_list": ("items ARRAY<STRING>", tx.bullet_list),
    "format_related": (f"related {RELATED}", tx.related_list),
    "format_retrieved": (f"related {RELATED}", tx.retrieved_list),
    "format_bibliography": (f"refs {REFERENCES}", tx.bibliography_lines),
    "format_authors": ("names ARRAY<STRING>", tx.format_authors),
    "bibliography_authors": ("names ARRAY<STRING>", tx.bibliography_authors),
    "bullets_of_type": ("entities ARRAY<STRUCT<type: STRING, label: STRING>>, kind STRING", tx.bullets_of_type),
    "truncate_evidence": ("t STRING, most INT DEFAULT 5", tx.truncate_evidence),
    "structured_rationale": (f"summary STRING, supporting {EVIDENCE}, contradictory {EVIDENCE}, comparisons ARRAY<STRING>, conclusion STRING", tx.structured_rationale),
    "parse_label_line": (_T, tx.parse_label_line),
    "parse_label": (_T, tx.parse_label),
    "parse_rating_line": (_T, tx.parse_rating),
    "section_kind": ("heading STRING", tx.section_kind),
    "imrad_text": (f"sections {SECTIONS}, kind STRING", tx.imrad_text),
    "any_phrase": ("t STRING, phrases ARRAY<STRING>", tx.any_phrase_of),
    "extract_spans": ("t STRING, spans STRING", tx.extract_spans),
    "strip_tex_comments": (_T, tx.strip_tex_comments),
    "strip_tex": (_T, tx.strip_tex),
    "citation_keys": (_T, tx.citation_keys),
    "citing_sentences": (_T, tx.citing_sentences),
    "parse_bibitems": (_T, tx.parse_bibitems),
    "split_sentences": (_T, tx.split_sentences),
    "split_markdown": (_T, tx.split_markdown),
    "arxiv_year_month": (_T, tx.arxiv_year_month),
    "arxiv_id_from_url": (_T, tx.arxiv_id_from_url),
    "parse_publication_date": (_T, tx.parse_publication_date),
    "year_from_epoch_ms": ("ms BIGINT", tx.year_from_epoch_ms),
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", tx.cosine),
    "safediv": ("a DOUBLE, b DOUBLE", tx.safediv),
    "sanitise_json": ("v VARIANT, list_most INT DEFAULT 50, text_most INT DEFAULT 1000", variant.sanitise),
    "content_id": ("title STRING, abstract STRING", tx.content_id),
    "cache_key": ("parts ARRAY<STRING>", tx.cache_key_of),
    "word_count": (_T, tx.word_count),
    "longest_by_words": ("texts ARRAY<STRING>", tx.longest_of),
    "abstract_demo": ("sentences ARRAY<STRING>, labels ARRAY<STRING>", tx.abstract_demo),
    "hashed_words": ("t STRING, places INT DEFAULT 256", tx.hashed_words),
    "path_get": ("v VARIANT, path STRING", variant.path_get),
    "unwrap_value": ("v VARIANT, key STRING", variant.unwrap_value),
    "scale_recommendation": ("r INT", ratings.scale_recommendation),
    "parse_rating": (_T, ratings.parse_rating),
    "score_to_rating": ("s DOUBLE", ratings.score_to_rating),
    "binary_label": ("r INT", ratings.binary_label),
    "novelty_probability": ("label INT, p DOUBLE", ratings.novelty_probability),
    "final_rating": ("recommendation INT, rating INT", ratings.final_rating),
    "conference_parts": ("conference STRING, year INT", ratings.conference_parts),
}


def _text(s: str) -> str:
    out = s.replace("\\", "\\\\").replace("'", "\\'")
    for mark, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = out.replace(mark, name)
    return f"'{out}'"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, float):
        return f"{value!r}D" if value == value and abs(value) != float("inf") else f"double('{value}')"
    if isinstance(value, int):
        return f"{value}{'L' if abs(value) >= 1 << 31 else ''}"
    raise TypeError(f"no SQL text for the literal {value!r}")


def sql_of(column: Column) -> str:
    """SQL text of a column expression of named parameters, literals, casts, fields and (lambda) functions."""
    return _node(column._jc.node())


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _node(n) -> str:
    kind = n.getClass().getSimpleName()
    if kind == "UnresolvedAttribute":
        return ".".join(f"`{p}`" for p in _seq(n.nameParts()))
    if kind == "UnresolvedNamedLambdaVariable":
        return n.name()
    if kind == "Literal":
        return _literal(n.value())
    if kind == "Alias":
        return f"{_node(n.child())} AS `{n.name().apply(0)}`"
    if kind == "Cast":
        name = "TRY_CAST" if "TRY" in n.sql().upper().split("(", 1)[0] else "CAST"
        return f"{name}({_node(n.child())} AS {n.dataType().sql()})"
    if kind == "LambdaFunction":
        names = [a.name() for a in _seq(n.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_node(n.function())}"
    if kind == "UnresolvedExtractValue":
        return f"{_node(n.child())}[{_node(n.extraction())}]"
    if kind == "CaseWhenOtherwise":
        cases = " ".join(f"WHEN {_node(b._1())} THEN {_node(b._2())}" for b in _seq(n.branches()))
        other = n.otherwise()
        return f"CASE {cases} {'ELSE ' + _node(other.get()) if other.isDefined() else ''} END"
    if kind == "UnresolvedFunction" and n.functionName() == "struct":
        fields = [(_field(a), a.child() if a.getClass().getSimpleName() == "Alias" else a) for a in _seq(n.arguments())]
        return f"named_struct({', '.join(f'{_text(name)}, {_node(value)}' for name, value in fields)})"
    if kind == "UnresolvedFunction":
        return f"`{n.functionName()}`({', '.join(_node(a) for a in _seq(n.arguments()))})"
    raise TypeError(f"no SQL text for {kind}")


def _field(n) -> str:
    """The name that a column has within a struct."""
    kind = n.getClass().getSimpleName()
    if kind == "Alias":
        return n.name().apply(0)
    if kind == "UnresolvedExtractValue":
        return n.extraction().value()
    return _seq(n.nameParts())[-1]


def body_of(name: str) -> str:
    """The SQL expression of a function."""
    parameters, build = FUNCTIONS[name]
    return sql_of(build(*[F.col(p) for p in names_of(parameters)]))


def names_of(parameters: str) -> list[str]:
    """Names of ``a STRING, b MAP<STRING, INT>``: commas inside angle brackets separate nothing."""
    depth, out, start = 0, [], True
    for word in parameters.replace(",", " , ").replace("<", " < ").replace(">", " > ").split():
        if start and word != ",":
            out.append(word)
            start = False
        depth += (word == "<") - (word == ">")
        start = start or (word == "," and depth == 0)
    return out


def register(spark: SparkSession, again: bool = False) -> list[str]:
    """Create the functions that the session does not have yet (all of them with ``again``); returns all names."""
    for name, (parameters, _) in FUNCTIONS.items():
        if again or not spark.catalog.functionExists(name):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body_of(name)}")
    fuzzy.register(spark)
    return [*FUNCTIONS, *fuzzy.NAMES]
