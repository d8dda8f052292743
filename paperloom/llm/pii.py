"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions: every row is handled by itself, so there is no shuffle and no hot key, and the work grows with
the text and its number of hits. Positions are code points, end exclusive. A null or empty text has no spans. Rows are
never merged: equal rows give equal results.

A candidate starts with its kind's points, gets ``NEAR`` more if one of the kind's context words stands in the
``REACH`` characters before it, and loses ``DOUBT`` if a word of doubt does. The four base kinds always stay, whatever
their points; the added kinds need ``LEAST`` points. So an account number that fits its checksum goes if it is said to
be an example, and a run of digits or a random-looking string counts as an account or a secret only where a word says so.

The base patterns are the stated ones with possessive repeats and look-behinds where those cannot change a match; that
keeps the Java matcher iterative and linear on very long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order, their patterns, starting points and context words.
KINDS = ["email", "ip", "card", "phone", "iban", "account", "secret"]
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
    "account": r"[0-9]+",
    "secret": r"[A-Za-z0-9+/_=-]{20,}",
}
POINTS = {"email": 70, "ip": 60, "card": 90, "phone": 60, "iban": 90, "account": 40, "secret": 40}
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "host|server|address|login",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "phone|call|mobile|fax|telefon",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "account": "iban|bank|account|konto|compte|cuenta|kunde",
    "secret": "token|secret|password|passwd|api.?key|access.?key|credential",
}
DOUBT_WORDS = "example|sample|version|isbn|checksum|commit"
NEAR, DOUBT, LEAST, REACH = 30, 40, 60, 40
#: What a text must hold before a pattern is tried at all.
HINT = {"email": "@", "ip": ".", "phone": "+"}
#: Running sums go by runs of so many hits, texts are cut in pieces of so many characters: both bound the work for a hit.
FEW, PIECE = 64, 1024


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """Luhn check of the digits in ``value``; null or no digits: false."""
    back = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(back, lambda d, i: (lambda x: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))(F.coalesce(d.try_cast("int"), F.lit(0))))
    return F.coalesce((F.length(_digits(value)) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0), F.lit(False))


def mod97_ok(value: Column) -> Column:
    """Mod-97 check of an account number: first four characters moved to the end, letters as 10 to 35."""
    v = F.regexp_replace(value, " ", "")
    chars = F.split(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4))), "")
    numbers = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(numbers, F.lit(0), lambda a, x: F.when(x < 10, a * 10 + x).otherwise(a * 100 + x) % 97)
    return F.coalesce(rest == 1, F.lit(False))


def ip_ok(value: Column) -> Column:
    short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    return {
        "email": F.lit(True),
        "ip": ip_ok(v),
        "card": n.between(12, 19) & luhn_ok(v),
        "phone": n.between(9, 15),
        "iban": mod97_ok(v),
        "account": n.between(8, 17),
        "secret": v.rlike("[0-9]") & v.rlike("[A-Za-z]"),
    }[kind]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each number the fold of all numbers before it, from 0.

    Folds of runs of ``FEW`` numbers come first, so the work for one number does not grow with its place.
    """

    def of(v: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FEW).cast("int"))
        run = lambda r: F.slice(v, r * FEW + 1, FEW)
        fold = lambda a, start: F.aggregate(a, start, op)
        folds = F.transform(runs, lambda r: fold(run(r), F.lit(0)))
        inside = lambda q, start: F.transform(q, lambda _, i: fold(F.slice(q, 1, i), start))
        made = _let(folds, lambda t: F.flatten(F.transform(runs, lambda r: _let(run(r), lambda q: _let(fold(F.slice(t, 1, r), F.lit(0)), lambda start: inside(q, start))))))
        return F.when(F.size(v) > 0, made).otherwise(F.array().cast("array<int>"))

    return _let(values, of)


SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string,score:int>"


def _hits(text: Column, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    """The wanted hits of one pattern from left to right: array of (start, value, near), near being the characters before."""
    found = lambda hits: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    pieces = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)

    def of(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda a, n: a + n)
        placed = F.zip_with(p, ends, lambda x, end: F.struct((end + F.length(x["gap"])).alias("start"), x["hit"].alias("value")))
        numbered = F.transform(placed, lambda h, i: F.struct(h["start"].alias("start"), h["value"].alias("value"), i.alias("i")))
        # a hit and what stands before it have two characters at least
        before = lambda i: F.array_join(F.transform(F.slice(p, F.greatest(i - REACH // 2, F.lit(0)) + 1, F.least(i, F.lit(REACH // 2))), lambda x: F.concat(x["gap"], x["hit"])), "")
        near = lambda i: F.right(F.concat(before(i), F.get(p, i)["gap"]), F.lit(REACH))
        return F.transform(F.filter(numbered, lambda h: wanted(h["value"])), lambda h: F.struct(h["start"].alias("start"), h["value"].alias("value"), near(h["i"]).alias("near")))

    return _let(pieces, of)


def _points(kind: str, near: Column) -> Column:
    more = F.when(near.rlike(f"(?i){CONTEXT[kind]}"), NEAR).otherwise(0)
    less = F.when(near.rlike(f"(?i){DOUBT_WORDS}"), DOUBT).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(POINTS[kind]) + more - less))


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind that are valid and, if it is an added kind, have the points: array of ``SPAN``."""
    pattern = PATTERNS[kind]
    made = F.transform(
        _hits(text, pattern, lambda value: _valid(kind, value)),
        lambda h: F.struct(
            h["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"),
            (h["start"] + F.length(h["value"])).alias("end"),
            h["value"].alias("value"),
            _points(kind, h["near"]).cast("int").alias("score"),
        ),
    )
    found = text.rlike(pattern)
    if kind in HINT:
        found = text.contains(HINT[kind]) & found
    if POINTS[kind] < LEAST:  # nothing can come of it without a word that speaks for it
        found = text.rlike(f"(?i){CONTEXT[kind]}") & found
    if kind not in BASE:
        made = F.filter(made, lambda s: s["score"] >= LEAST)
    return F.when(found, made.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_personal_data(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (start, rank, kind, end, value, score), by start, then kind.

    The four base kinds are always kept; the others need ``LEAST`` points. Where an added span overlaps another one both
    stay. Extra columns are untouched; ``out`` replaces a column of that name.
    """
    raw, src = "__pii_raw", "__pii_src"
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.withColumn(src, F.when(t.rlike("[@0-9]"), t).otherwise(F.lit("")))
    spans = F.flatten(F.array(*[_spans(F.col(src), k) for k in KINDS]))
    df = df.withColumn(raw, F.when(F.col(src) == "", F.array().cast(f"array<{SPAN}>")).otherwise(spans))
    return df.withColumn(out, F.when(F.size(raw) > 1, F.array_sort(raw)).otherwise(F.col(raw))).drop(raw, src)


def digest(df: DataFrame, pii: str = "pii") -> DataFrame:
    """The contract's columns, derived from the spans, and their scores in the same order."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda a, of: F.array_join(F.transform(a, of), ",")
    count = lambda k: F.size(F.filter(F.col(pii), lambda s: s["kind"] == k)).cast("long")
    base = F.filter(F.col(pii), lambda s: s["rank"] < len(BASE))
    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base, line), 256).alias("base_sha256"),
        joined(F.col(pii), line).alias("spans"),
        joined(F.col(pii), lambda s: s["score"].cast("string")).alias("scores"),
    )


def _between(pieces: Column) -> Callable[[Column, Column], Column]:
    """Characters from a to b of a text that is given in pieces of ``PIECE`` characters."""

    def of(a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        part = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(b > a, F.substr(part, a - first * PIECE + 1, b - a)).otherwise(F.lit(""))

    return of


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replace every span in ``text`` by its kind in brackets, e.g. ``[EMAIL]``; overlapping spans become one."""
    pieces, marks = "__pii_pieces", "__pii_marks"
    before = _running(F.transform(F.col(pii), lambda s: s["end"]), lambda a, n: F.greatest(a, n))
    firsts = F.filter(F.zip_with(F.col(pii), before, lambda s, b: F.struct(b.alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))), lambda m: m["end"] >= m["start"])
    last = F.aggregate(F.col(pii), F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    walked = F.struct(firsts.alias("all"), last.alias("at"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    some = F.size(pii) > 0
    df = df.withColumn(pieces, F.when(some, F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))).withColumn(marks, F.when(some, walked))
    between = _between(F.col(pieces))
    kept = F.transform(F.col(f"{marks}.all"), lambda m: F.concat(between(m["start"], m["end"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
    rest = between(F.col(f"{marks}.at"), F.length(F.col(f"`{text}`")))
    return df.withColumn(text, F.when(some, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col(f"`{text}`"))).drop(pieces, marks)
