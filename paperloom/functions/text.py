"""Text functions over columns. Every function takes and returns a Column; null in gives null out unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that title matching ignores.
TITLE_STOP_WORDS = ["a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for"]
#: Formulaic openings, most specific first.
SUMMARY_OPENINGS = [
    r"(?i)^the\s+(development|introduction|use|application)\s+of\s+[^.]+?\s+in\s+the\s+(related|supporting|contrasting|second|first|target|main|prior)\s+paper\s+(provides?|demonstrates?|shows?|offers?|enables?)\s+",
    r"(?i)^the\s+findings\s+(from|of|in)\s+the\s+(related|supporting|contrasting|second|first|target|main|prior)\s+paper\s+(demonstrate|show|highlight|emphasi[sz]e|indicate|suggest|reveal)\s+(that\s+)?",
    r"(?i)^(the\s+)?(related|supporting|contrasting|second|first|target|main|prior)\s+paper(,\s*[^,]+,)?\s+(also\s+)?(demonstrates?|shows?|highlights?|emphasi[sz]es?|provides?|presents?|introduces?|focuses\s+on|supports?|contrasts?(\s+with(\s+the\s+first)?)?|corroborates?|reinforces?|validates?|confirms?|aligns?\s+with|diverges?\s+from|differs?\s+from)\s+(that\s+|by\s+)?",
]
#: Section headings, exclusion first, then the first category that fits.
SECTIONS_EXCLUDED = r"(?i)related.work|background|preliminary|appendix|acknowledge|reference"
SECTION_KINDS = {
    "introduction": r"(?i)introduction",
    "methods": r"(?i)method|methodology|approach|framework|model|proposed|technique",
    "results": r"(?i)result|experiment|evaluation|empirical|analysis",
    "discussion": r"(?i)discussion|conclusion|limitation|future.work|summary",
}
#: What ``\s`` holds.
BLANKS = " \t\n\x0b\f\r"
#: ``[^a-z0-9\s]`` and ``[^a-zA-Z\s]`` as ranges, which took a seventh of the negated classes' time on check_s.
NOT_LOWER_OR_DIGIT = r"[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x60\x7B-\x{10FFFF}]"
NOT_ASCII_LETTER = r"[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x{10FFFF}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def clean_title(c: Column) -> Column:
    return squeeze(casefold(c))


def clean_title_alpha(c: Column, fold: bool = True) -> Column:
    kept = F.regexp_replace(c, r"[^\p{L}\s]", "")
    return squeeze(casefold(kept) if fold else kept)


def match_title(c: Column) -> Column:
    words = F.split(squeeze(F.regexp_replace(casefold(c), r"(?U)[^\w\s]", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(TITLE_STOP_WORDS)), " ")


def normalise_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), NOT_LOWER_OR_DIGIT, ""))


def squash_title(c: Column) -> Column:
    return casefold(F.regexp_replace(c, r"\s+", ""))


def alpha_ascii(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(c, NOT_ASCII_LETTER, "")))


def clean_query(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", " "))


def remove_line_numbers(c: Column) -> Column:
    # a line's end is no white space to remove: only what stands on the same line goes
    return F.regexp_replace(c, r"(?m)^[0-9]+[ \t\x0B\f\r]*", "")


def remove_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^[ \t\x0B\f\r]*[0-9]+[ \t\x0B\f\r]*$", "")


def compress_whitespace(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {2,}", " ")


def fix_spaces_before_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+([.!?;:,)\]}])", "$1")


def trim_paragraphs(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n\n", -1), strip), "\n\n")


def clean_maintext(c: Column) -> Column:
    for step in (remove_line_numbers, remove_page_numbers, compress_whitespace, fix_spaces_before_punctuation, trim_paragraphs):
        c = step(c)
    return c


def section_number(c: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(strip(c), r"\s+"), 1), r"\."), 1).try_cast("int")


def remove_parenthetical(c: Column, passes: int = 4) -> Column:
    """Drop matched brackets and what they hold, at any depth; unmatched ones stay.

    Nests of up to ``passes`` levels, as nearly all are, go by as many replacements; only texts with deeper ones are
    walked through bracket by bracket.
    """
    for _ in range(passes):
        c = F.regexp_replace(c, r"\([^()]*\)", "")
    return fix_spaces_before_punctuation(squeeze(F.when(c.rlike(r"\([^()]*\)"), _matched_brackets_out(c)).otherwise(c)))


def _matched_brackets_out(c: Column) -> Column:
    """One pass over a text's brackets with a stack of open ones, each with the text since it; a closing one drops its top."""
    top = lambda s: F.element_at(s, -1)
    under = lambda s: F.slice(s, F.lit(1), F.size(s) - 1)

    def step(stack: Column, piece: Column) -> Column:
        closes = (piece == ")") & (F.size(stack) > 1)
        return F.when(piece == "(", F.array_append(stack, F.lit(""))).when(closes, under(stack)).otherwise(F.array_append(under(stack), F.concat(top(stack), piece)))

    return F.aggregate(F.split(c, r"(?=[()])|(?<=[()])"), F.array(F.lit("")), step, lambda stack: F.array_join(stack, "("))


def _column(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def remove_prefix_icase(c: Column, prefix: Column | str) -> Column:
    prefix = _column(prefix)
    return F.when(F.startswith(F.lower(c), F.lower(prefix)), F.substr(c, F.length(prefix) + 1)).otherwise(c)


def _capital(c: Column) -> Column:
    """The capital of one letter, always one letter: upper() makes two or three of some ("ß" to "SS")."""
    long = [chr(i) for i in range(0x80, 0x10000) if len(chr(i).upper()) > 1]
    single = ["ẞ" if x == "ß" else x.title() if len(x.title()) == 1 else x for x in long]
    return F.when(F.length(F.upper(c)) > 1, F.translate(c, "".join(long), "".join(single))).otherwise(F.upper(c))


def clean_summary(c: Column) -> Column:
    out = c
    for pattern in reversed(SUMMARY_OPENINGS):
        rest = F.regexp_replace(c, pattern, "")
        out = F.when(c.rlike(pattern), F.when(rest == "", c).otherwise(F.concat(_capital(F.left(rest, F.lit(1))), F.substr(rest, F.lit(2))))).otherwise(out)
    return out


def truncate_chars(c: Column, n: Column | int, suffix: Column | str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, _column(n)), _column(suffix))).otherwise(c)


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def count_tokens(c: Column) -> Column:
    return F.size(word_list(c)).cast("long")


def truncate_tokens(c: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(count_tokens(c) > n, F.array_join(F.slice(word_list(c), F.lit(1), F.greatest(n, F.lit(0)).cast("int")), " ")).otherwise(c)


def fit_prompt(system: Column, user: Column, most: Column | int) -> Column:
    """The user part cut to what the system part leaves."""
    return truncate_tokens(user, F.greatest(_column(most) - count_tokens(system), F.lit(0)))


def render_template(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a template from columns; null fills as empty, doubled braces are braces."""
    made = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            made.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{\w+\}", piece):
            made.append(F.coalesce(fields[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            made.append(F.lit(piece))
    return F.concat(*made)


def fill_template(template: Column, fields: Column) -> Column:
    """``render_template`` with a template that is a column itself, and a map of the fields; unknown names are null."""
    pieces = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|\{\w+\}|[^{}]+|[{}])"), F.lit(1))
    name = lambda p: F.substr(p, F.lit(2), F.length(p) - 2)
    known = lambda p: F.array_contains(F.map_keys(fields), name(p))
    fill = lambda p: F.when(p.isin("{{", "}}"), F.left(p, F.lit(1))).when(~p.rlike(r"^\{\w+\}$"), p).when(known(p), F.coalesce(F.try_element_at(fields, name(p)), F.lit("")))
    made = F.transform(pieces, fill)
    return F.when(~F.exists(made, lambda p: p.isNull()), F.array_join(made, ""))


def numbered_list(items: Column, prefix: str = "", suffix: str = ".", indent: int = 0, start: int = 1, sep: str = "\n") -> Column:
    line = lambda x, i: F.concat(F.lit(" " * indent + prefix), (i + start).cast("string"), F.lit(f"{suffix} "), x)
    return F.array_join(F.transform(items, line), sep)


def bullet_list(items: Column, prefix: str = "-", indent: int = 0) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"{' ' * indent}{prefix} "), x)), "\n")


def format_authors(names: Column) -> Column:
    some = F.concat(F.element_at(names, 1), F.lit(", "), F.try_element_at(names, F.lit(2)), F.lit(", ... ("), F.size(names).cast("string"), F.lit(" authors)"))
    return F.when(F.size(names) <= 3, F.array_join(names, ", ")).otherwise(some)


def bibliography_authors(names: Column, most: int = 2, default: str = "Unknown authors") -> Column:
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.lit(default)).when(F.size(names) <= most, F.array_join(names, ", ")).otherwise(F.concat(F.try_element_at(names, F.lit(1)), F.lit(" et al.")))


def structured_rationale(summary: Column, supporting: Column, contradictory: Column, comparisons: Column, conclusion: Column) -> Column:
    """Evidence lists (struct text, paper_title) as one text."""
    line = lambda e: F.concat(F.lit("- "), e["text"], F.when(F.coalesce(e["paper_title"], F.lit("")) != "", F.concat(F.lit(" (from: "), e["paper_title"], F.lit(")"))).otherwise(F.lit("")))
    extra = F.when(F.size(comparisons) > 0, F.concat(F.array(F.lit(""), F.lit("Key Comparisons:")), F.transform(comparisons, lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(
        F.array(F.concat(F.lit("Paper Summary: "), summary), F.lit(""), F.lit("Supporting Evidence:")), F.transform(supporting, line),
        F.array(F.lit(""), F.lit("Contradictory Evidence:")), F.transform(contradictory, line), extra,
        F.array(F.lit(""), F.concat(F.lit("Conclusion: "), conclusion)),
    )
    return F.array_join(parts, "\n")


def bullets_of_type(entities: Column, kind: Column | str) -> Column:
    """Bullets of the labels of one type of entities (structs of type and label)."""
    return bullet_list(F.transform(F.filter(entities, lambda e: e["type"] == kind), lambda e: e["label"]))


def _by_score(related: Column) -> Column:
    """Related papers by falling score, then by id."""

    def before(a: Column, b: Column) -> Column:
        return F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["related_id"] < b["related_id"], -1).when(a["related_id"] > b["related_id"], 1).otherwise(0)

    return F.array_sort(related, before)


def related_list(related: Column, label: str = "Summary") -> Column:
    """Related papers (structs related_id, title, source, body, year, score) as text blocks, best first."""
    block = lambda r: F.concat(F.lit("ID: "), r["related_id"], F.lit("\nTitle: "), r["title"], F.lit("\nSource: "), r["source"], F.lit(f"\n{label}: "), r["body"], F.lit("\n"))
    return F.array_join(F.transform(_by_score(related), block), "\n\n")


def retrieved_list(related: Column) -> Column:
    """The same papers numbered, with their years."""
    year = lambda r: F.coalesce(F.concat(F.lit(" ("), r["year"].cast("string"), F.lit(")")), F.lit(""))
    block = lambda r, i: F.concat(F.lit("Paper "), (i + 1).cast("string"), F.lit(": "), r["title"], year(r), F.lit("\nAbstract: "), r["body"])
    return F.array_join(F.transform(_by_score(related), block), "\n\n")


def bibliography_line(key: Column, title: Column, authors: Column, year: Column) -> Column:
    return F.concat(F.lit("["), key, F.lit("] "), title, F.lit(". "), bibliography_authors(authors), F.lit(", "), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("n.d.")), F.lit("."))


def bibliography_lines(refs: Column) -> Column:
    """Lines of references (structs citation_key, title, authors, year) that have a key."""
    named = F.filter(refs, lambda r: F.coalesce(r["citation_key"], F.lit("")) != "")
    return F.array_join(F.transform(named, lambda r: bibliography_line(r["citation_key"], r["title"], r["authors"], r["year"])), "\n")


def imrad_text(sections: Column, kind: Column | str) -> Column:
    """Texts of one kind of sections (structs heading, text), joined by a blank line; null if there are none."""
    texts = F.transform(F.filter(sections, lambda s: section_kind(strip(s["heading"])) == kind), lambda s: s["text"])
    return F.nullif(F.array_join(texts, "\n\n"), F.lit(""))


def truncate_evidence(c: Column, most: Column | int = 5) -> Column:
    """Keep the first ``most`` bullets of each evidence section."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        bare = strip(line)
        header = bare.rlike(r"(?i)^\*?\*?(supporting|contradictory|related)\s")
        bullet, other = bare.startswith("-") & acc["inside"], (bare != "") & ~bare.startswith("-")
        n = F.when(header | (~bullet & other), 0).when(bullet, acc["n"] + 1).otherwise(acc["n"])
        inside = F.when(header, True).when(~bullet & other, False).otherwise(acc["inside"])
        keep = header | ~bullet | (acc["n"] + 1 <= most)
        return F.struct(inside.alias("inside"), n.alias("n"), F.when(keep, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(c, "\n", -1), start, step, lambda acc: F.array_join(acc["out"], "\n"))


_LABEL = r"(?i)\*{0,2}(?:label|rating)\*{0,2}\s*:\*{0,2}\s*([1-5])"


def parse_label_line(c: Column) -> Column:
    """The digit of the first line ``label: d``; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(c), r"(?m)^[ \t]*label:[ \t]*([0-9])", 1), F.lit("")).try_cast("int")


def parse_label(c: Column) -> Column:
    """Struct (label, rationale): a rating 1-5 anywhere, the other lines as rationale; null label if there is none."""
    label = F.nullif(F.regexp_extract(c, _LABEL, 1), F.lit("")).try_cast("int")
    rest = strip(F.array_join(F.filter(F.split(c, "\r?\n", -1), lambda x: ~x.rlike(_LABEL) & (strip(x) != "")), "\n"))
    return F.struct(label.alias("label"), F.when(label.isNotNull(), rest).alias("rationale"))


def parse_rating(c: Column) -> Column:
    d = F.nullif(F.regexp_extract(c, r"(?i)Rating:\s*([0-9])", 1), F.lit("")).try_cast("int")
    return F.when(d.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), d)))


def section_kind(heading: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SECTION_KINDS.items()):
        out = F.when(heading.rlike(pattern), F.lit(kind)).otherwise(out)
    return F.when(~heading.rlike(SECTIONS_EXCLUDED), out)


def any_phrase(c: Column, phrases: list[str]) -> Column:
    """Whether a whole phrase occurs, with flexible blanks; line breaks count as blanks."""
    one = "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in phrases)
    return normalise_text(F.regexp_replace(c, r"\s+", " ")).rlike(rf"\b(?:{one})\b")


def any_phrase_of(c: Column, phrases: Column) -> Column:
    """``any_phrase`` with a column of phrases."""
    literal = lambda p: F.regexp_replace(F.regexp_replace(strip(p), r"([^\w\s])", r"\\$1"), r"\s+", r"\\s+")
    plain = normalise_text(F.regexp_replace(c, r"\s+", " "))
    return F.exists(phrases, lambda p: F.regexp_like(plain, F.concat(F.lit(r"\b(?:"), literal(p), F.lit(r")\b"))))


def extract_spans(text: Column, spans: Column) -> Column:
    """Slices [start, end) of a JSON span list, joined by line breaks; null for missing or invalid JSON."""
    parsed = F.from_json(spans, "array<struct<start:int,end:int>>", {"mode": "PERMISSIVE"})
    pieces = F.transform(parsed, lambda s: F.substr(text, s["start"] + 1, F.greatest(s["end"] - s["start"], F.lit(0))))
    return F.when(F.exists(parsed, lambda s: s["start"].isNull() | s["end"].isNull()), None).otherwise(F.array_join(pieces, "\n"))


def strip_tex_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^[ \t]*%.*(\n|$)", "")


def strip_tex(c: Column) -> Column:
    """Drop maths and commands, keep the text of simple arguments."""
    c = F.regexp_replace(c, r"\$[^$]*\$", "")
    c = F.regexp_replace(c, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1")
    return squeeze(F.regexp_replace(c, r"\\[a-zA-Z]+\*?|[{}]", ""))


def citation_keys(c: Column) -> Column:
    """Distinct keys of ``\\cite``-like commands, sorted."""
    lists = F.regexp_extract_all(c, F.lit(r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.transform(lists, lambda k: F.split(k, ","))), strip), lambda k: k != "")))


def citing_sentences(c: Column) -> Column:
    """Distinct (key, sentence) of all sentences that cite something."""
    sentences = F.filter(split_sentences(strip_tex_comments(c)), lambda s: s.rlike(r"\\cite"))
    return F.array_distinct(F.flatten(F.transform(sentences, lambda s: F.transform(citation_keys(s), lambda k: F.struct(k.alias("key"), s.alias("sentence"))))))


def bibitem_fields(block: Column, default: str = "Unknown Title") -> Column:
    """Struct (key, title, year, authors joined by ``|``) of one ``\\bibitem`` block; ``default`` stands for a missing title."""
    body = F.regexp_replace(block, r"^\\bibitem(\[[^\]]*\])?\{[^}]*\}", "")
    parts = F.transform(F.split(body, r"\\newblock"), lambda p: strip(F.regexp_replace(squeeze(p), r"[.,]$", "")))
    year = F.nullif(F.regexp_extract(block, r"(?s)^.*\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).try_cast("int")
    authors = F.array_join(F.transform(F.split(F.try_element_at(parts, F.lit(1)), r",\s+|\s+and\s+"), strip), "|")
    title = F.coalesce(F.nullif(F.try_element_at(parts, F.lit(2)), F.lit("")), F.lit(default))
    key = F.regexp_extract(block, r"^\\bibitem(?:\[[^\]]*\])?\{([^}]*)\}", 1)
    return F.struct(key.alias("key"), title.alias("title"), year.alias("year"), authors.alias("authors"))


def bibitem_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)(\\bibitem.*?)(?=\\bibitem|$)"), F.lit(1))


def parse_bibitems(c: Column) -> Column:
    return F.transform(bibitem_blocks(c), lambda b: bibitem_fields(b))


def split_sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")


def split_markdown(c: Column) -> Column:
    """Sections (heading, text) at lines ``# heading``; the whole text as "Document" if there is none."""
    parts = F.filter(F.split(c, r"(?m)^(?=# )"), lambda s: s.startswith("# "))
    made = F.transform(parts, lambda s: F.struct(strip(F.regexp_extract(s, r"^# ([^\n]*)", 1)).alias("heading"), strip(F.regexp_replace(s, r"^# [^\n]*\n?", "")).alias("text")))
    whole = F.array(F.struct(F.lit("Document").alias("heading"), strip(c).alias("text")))
    return F.when(F.size(parts) > 0, made).otherwise(whole)


def arxiv_year_month(c: Column) -> Column:
    """Struct (year, month) of a new-style id, else null."""
    fits = c.rlike(r"^[0-9]{2}(0[1-9]|1[0-2])\.[0-9]{4,5}(v[0-9]+)?$")
    return F.when(fits, F.struct((2000 + F.left(c, F.lit(2)).try_cast("int")).alias("year"), F.substring(c, 3, 2).try_cast("int").alias("month")))


def arxiv_id_from_url(c: Column) -> Column:
    path = F.regexp_extract(c, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.nullif(F.regexp_replace(F.regexp_extract(path, r"([^/]+)/?$", 1), r"(v[0-9]+)?(\.[a-z]+)?$", ""), F.lit(""))


def parse_publication_date(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.left(c, F.lit(10)).try_cast("date"))


def year_from_epoch_ms(c: Column) -> Column:
    return F.year(F.timestamp_millis(c))


def content_id(title: Column, abstract: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))), 256)


def cache_key(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(16))


def cache_key_of(parts: Column) -> Column:
    """``cache_key`` with the parts in an array; null parts are empty."""
    return F.left(F.sha2(F.array_join(parts, "|", ""), 256), F.lit(16))


def longest_of(texts: Column) -> Column:
    """The text with the most words, the first of equals."""
    most = F.array_max(F.transform(texts, word_count))
    return F.try_element_at(F.filter(texts, lambda t: word_count(t) == most), F.lit(1))


def hashed_words(c: Column, places: Column | int = 256) -> Column:
    """How many words fall into each place by hash: a vector without a model (for one with weights see ``encode``)."""
    words = F.transform(word_list(F.lower(c)), lambda w: F.pmod(F.xxhash64(w), _column(places)).cast("int"))
    return F.transform(F.sequence(F.lit(0), _column(places) - 1), lambda i: F.size(F.filter(words, lambda w: w == i)).cast("double"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\w+")).cast("long")


def abstract_demo(sentences: Column, labels: Column) -> Column:
    """Struct (background, target): sentences labelled so, and the rest."""
    both = F.zip_with(sentences, labels, lambda s, l: F.struct(s.alias("s"), l.alias("l")))
    pick = lambda on: F.array_join(F.transform(F.filter(both, lambda x: (x["l"] == "background") == on), lambda x: x["s"]), " ")
    return F.struct(pick(True).alias("background"), pick(False).alias("target"))


def safediv(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float("nan")))


def cosine(a: Column, b: Column, clip: bool = True, eps: float = 1e-8) -> Column:
    """Cosine in double precision, clipped to [0, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    c = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + eps)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) if clip else c
