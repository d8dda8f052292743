"""Queries written in SQL with the library's functions by name, and values of unknown shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import sql, variant
from paperloom.plans.base import add
from paperloom.plans.texts import SQL_TITLE, _fold, _squeezed, _words

C = F.col

_CALLS = {
    "title": ("clean_title(text)", _squeezed(_fold("text"))),
    "alpha": ("clean_title_alpha(text)", _squeezed(_fold(r"regexp_replace(text, '[^\p{L}\s]', '', 'g')"))),
    "normal": ("normalise_text(text)", r"regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '^\s+|\s+$', '', 'g')"),
    "squashed": ("squash_title(text)", _fold(r"regexp_replace(text, '\s+', '', 'g')")),
    "query": ("clean_query(text)", _squeezed(r"regexp_replace(text, '[^\p{L}\p{N}\s]', ' ', 'g')")),
    "spaced": ("fix_spaces_before_punctuation(text)", r"regexp_replace(text, '\s+([.!?;:,)\]}])', '\1', 'g')"),
    "without": ("removeprefix_icase(text, 'THE ')", "CASE WHEN starts_with(lower(text), 'the ') THEN substr(text, 5) ELSE text END"),
    "short": ("truncate_chars(text, 256, '...')", "CASE WHEN length(text) > 256 THEN left(text, 256) || '...' ELSE text END"),
    "tokens": ("count_tokens(text)", f"len({_words})::BIGINT"),
    "some": ("truncate_tokens(text, 50)", f"CASE WHEN len({_words}) > 50 THEN array_to_string(({_words})[1:50], ' ') ELSE text END"),
    "words": ("word_count(text)", r"len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+'))::BIGINT"),
    "prompt": ("render_template('{{source}}: {source}', map('source', source))", "'{source}: ' || source"),
    "cid": ("content_id(source, text)", "sha256(source || text)"),
    "ck": ("cache_key(array(lang, source))", "left(sha256(lang || '|' || source), 16)"),
    "ratio": ("safediv(n_chars, count_tokens(text) + 1)", f"n_chars::DOUBLE / (len({_words}) + 1)"),
}


def _by_name(t):
    sql.register(t.spark)
    calls = ", ".join(f"{call} AS {name}" for name, (call, _) in _CALLS.items()).replace("{", "{{").replace("}", "}}")
    return t.spark.sql(f"SELECT doc_id, {calls} FROM {{docs}}", docs=t.documents)


add("l3_sql_functions", _by_name, f"SELECT doc_id, {', '.join(f'{twin} AS {name}' for name, (_, twin) in _CALLS.items())} FROM documents")


def _matched_titles(t):
    """A whole search in SQL: titles by language, cleaned, counted and ranked with functions by name."""
    sql.register(t.spark)
    query = """WITH d AS (SELECT doc_id, lang, match_title(CASE WHEN instr(text, '.') > 0 THEN substring_index(text, '.', 1) ELSE left(text, 100) END) AS title FROM {docs}),
        g AS (SELECT lang, title, count(*) AS n, min(doc_id) AS doc_id FROM d WHERE word_count(title) > 2 GROUP BY lang, title)
        SELECT * FROM (SELECT lang, title, n, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n DESC, title) AS place FROM g) WHERE place <= 20"""
    return t.spark.sql(query, docs=t.documents)


_title = rf"array_to_string(list_filter(string_split({_squeezed(r'regexp_replace(' + _fold(SQL_TITLE) + r", '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g')")}, ' '), lambda w: w NOT IN ('a','an','the','and','or','but','in','on','at','to','for')), ' ')"
add(
    "l3_sql_titles",
    _matched_titles,
    rf"WITH g AS (SELECT lang, title, count(*) AS n, min(doc_id) AS doc_id FROM (SELECT doc_id, lang, {_title} AS title FROM documents) WHERE len(regexp_extract_all(title, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+')) > 2 GROUP BY 1, 2) SELECT lang, title, n, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY n DESC, title))::INTEGER AS place FROM g QUALIFY place <= 20",
)

#: Four shapes of raw JSON around an event's properties; the last is no JSON.
_SHAPES = ["props", "concat('{\"long key name\": [\"abcdefghij\", ', props, ', 3], \"b\": null}')", "concat('{\"k\": {\"value\": ', props, '}, \"a\": {\"b c\": {\"d\": [1.5, true, [[1]]]}}}')", "concat('{', props)"]
_raw = f"CASE event_id % 4 {' '.join(f'WHEN {i} THEN {s}' for i, s in enumerate(_SHAPES))} END"
_json = lambda t: t.events.select("event_id", F.try_parse_json(F.expr(_raw)).alias("v"))
_k = "json_extract_string(props, '$.k')"
add(
    "g41_sanitise_variant",
    lambda t: _json(t).select("event_id", variant.sanitise(C("v"), list_most=2, text_most=6, depth_most=3).alias("clean")),
    f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{{\"k\":' || {_k} || '}}' WHEN 1 THEN '{{\"b\":null,\"long k… [truncated]\":[\"abcdef… [truncated]\",{{\"k\":\"[truncated-depth]\"}}]}}' WHEN 2 THEN '{{\"a\":{{\"b c\":{{\"d\":\"[truncated-depth]\"}}}},\"k\":{{\"value\":{{\"k\":\"[truncated-depth]\"}}}}}}' END AS clean FROM events",
)
_text = lambda v: F.coalesce(variant.text_of(v), F.lit("none"))
add(
    "b11_variant_path",
    lambda t: _json(t).select("event_id", _text(variant.path_get(C("v"), "k.value.k")).alias("nested"), _text(variant.path_get(C("v"), "a.b c.d")).alias("spaced"), _text(variant.path_get(C("v"), "k.x", "other")).alias("filled")),
    f"SELECT event_id, CASE WHEN event_id % 4 = 2 THEN {_k} ELSE 'none' END AS nested, CASE WHEN event_id % 4 = 2 THEN '[1.5,true,[[1]]]' ELSE 'none' END AS spaced, 'other' AS filled FROM events",
)
add(
    "b12_variant_unwrap",
    lambda t: _json(t).select("event_id", _text(variant.unwrap_value(C("v"), "k")).alias("v")),
    f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_k} WHEN 2 THEN '{{\"k\":' || {_k} || '}}' ELSE 'none' END AS v FROM events",
)
