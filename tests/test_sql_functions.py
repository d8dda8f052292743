"""SQL functions by name, against the column functions they are made of; values of unknown shape against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import sql, variant
from paperloom.functions import text as tx


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark)


def test_names_of():
    assert sql.names_of("a STRING, b MAP<STRING, INT>, c INT DEFAULT 5") == ["a", "b", "c"]


TEXTS = [
    "The  findings from the target paper show that it's \"good\" (see (1) and (x)) .", "1 Intro\n\n 12 \nText\n\n\n\nmore  text ,", "# A\nbody\n# B\nx 'y' \\ z", "Label: 3\nrest **Rating**: 4", "ß Größe_1-2",
    r"\cite{a,b} says $x$. Then \citep[p]{c}! % no" + "\n% gone\nEnd.", r"\bibitem{k} A B and C D. \newblock A title. \newblock 2019." "\n" r"\bibitem[x]{l} Z.", "2101.00123v2", "https://arxiv.org/abs/2101.00123v2.pdf", "2024-02-30", "2024-02-28T10:00", "3.1 Methods", "4 - good", "", None,
    "Supporting evidence:\n- a\n- b\n- c\n- d\n- e\n- f\nother", "[{\"start\":0,\"end\":3}]",
]


def test_each_text_function_equals_its_column(spark, names):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    df.createOrReplaceTempView("some_texts")
    one = [n for n, (parameters, _) in sql.FUNCTIONS.items() if parameters in ("t STRING", "heading STRING")]
    assert len(one) > 30
    want = df.select("i", *[sql.FUNCTIONS[n][1](F.col("t")).alias(n) for n in one]).orderBy("i").collect()
    got = spark.sql(f"SELECT i, {', '.join(f'{n}(t) AS {n}' for n in one)} FROM some_texts ORDER BY i")
    assert got.collect() == want
    assert "Python" not in got._jdf.queryExecution().toString()


def test_functions_of_several_columns(spark, names):
    def value(q):
        return spark.sql(f"SELECT {q} AS v").first()["v"]

    assert value("truncate_chars('abcdef', 3, '..')") == "abc.." and value("truncate_chars('abcdef', 3)") == "abc"
    assert value("truncate_tokens('a b c d', 2)") == "a b" and value("fit_prompt('a b', 'c d e', 3)") == "c"
    assert value("render_template('{{x}} {a}-{b}!', map('a', '{b}', 'b', 'q'))") == "{x} {b}-q!"
    assert value("render_template('{a}{zz}', map('a', 'q'))") is None and value("prompt_tokens('x {a}', map('a', 'q r'))") == 3
    assert value("removeprefix_icase('THE Cat', 'the ')") == "Cat"
    assert value("numbered_list(array('a', 'b'))") == "1. a\n2. b" and value("bullet_list(array('a'))") == "- a"
    assert value("bullets_of_type(array(named_struct('type', 'm', 'label', 'x'), named_struct('type', 'c', 'label', 'y')), 'm')") == "- x"
    assert value("cosine(array(1.0D, 0.0D), array(1.0D, 1.0D))") == pytest.approx(0.7071, abs=1e-4)
    assert value("safediv(1.0D, 0.0D)") != value("safediv(1.0D, 0.0D)")
    assert value("extract_spans('abcdef', '[{\"start\":0,\"end\":2},{\"start\":4,\"end\":6}]')") == "ab\nef"
    assert value("any_phrase('the Big\nData (venue)', array('no', 'big data'))") and not value("any_phrase('bigger data', array('big data'))")
    related = "array(named_struct('related_id', 'i', 'title', 't', 'source', 's', 'body', 'b', 'year', {y}, 'score', 0.5D), named_struct('related_id', 'a', 'title', 'u', 'source', 's', 'body', 'c', 'year', 2001, 'score', 0.5D))"
    assert value(f"format_related({related.format(y='null')})").startswith("ID: a\nTitle: u\n") and value(f"format_retrieved({related.format(y='null')})").endswith("Paper 2: t\nAbstract: b")
    assert value("format_bibliography(array(named_struct('citation_key', 'k', 'title', 't', 'authors', array('A', 'B', 'C'), 'year', null)))") == "[k] t. A et al., n.d.."
    assert value("imrad_text(array(named_struct('heading', ' Methods ', 'text', 'm'), named_struct('heading', 'Results', 'text', 'r')), 'methods')") == "m"
    assert value("abstract_demo(array('a', 'b'), array('background', 'x'))") == ("a", "b")
    assert value("longest_by_words(array('a b', 'c d', 'e'))") == "a b" and sum(value("hashed_words('a b a', 8)")) == 3
    assert value("cache_key(array('a', null))") == spark.range(1).select(tx.cache_key(F.lit("a"), F.lit(None)).alias("v")).first()["v"]
    assert value("content_id('a', 'b')") == spark.range(1).select(tx.content_id(F.lit("a"), F.lit("b")).alias("v")).first()["v"]
    assert value("structured_rationale('s', array(named_struct('text', 'e', 'paper_title', 'p')), array(), array('c'), 'z')").endswith("Conclusion: z")
    assert value("fuzzy_ratio('abc', 'abd')") == 67 and value("fuzzy_partial_ratio('b', 'abc')") == 100 and value("sequence_ratio('a', 'A')") == 1.0
    assert value("year_from_epoch_ms(0)") == 1970 and value("final_rating(9, 1)") == 4 and value("conference_parts('ICLR2017', null)") == ("ICLR", 2017)
    assert value("novelty_probability(5, 0.1D)") == 0.6


def test_every_function_has_a_body(spark):
    for name in sql.FUNCTIONS:
        assert sql.body_of(name)


def test_characters_to_remove(spark):
    """Over every character: the ranges hold what the negated classes do, and only ASCII blanks at the very ends go."""
    chars = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x110000, 7), 0x10FFFF]]
    df = spark.createDataFrame([(chars[i : i + 5000],) for i in range(0, len(chars), 5000)], "a array<string>")
    kept = lambda pattern: {r[0] for r in df.select(F.explode("a").alias("c")).where(F.regexp_replace("c", pattern, "") != "").collect()}
    assert kept(tx.NOT_LOWER_OR_DIGIT) == {c for c in chars if re.fullmatch(r"[a-z0-9\s]", c, re.A)}
    assert kept(tx.NOT_ASCII_LETTER) == {c for c in chars if re.fullmatch(r"[a-zA-Z\s]", c, re.A)}
    ends = ["\t a \u2028", " a \x85", "\x0b\f\r\n", "\u3000a ", "b \n", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(ends)], "i int, t string").orderBy("i").select(tx.strip(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a \u2028", "a \x85", "", "\u3000a", "b", "", None]


# -- values of unknown shape


def clean(v, n, text, depth=0, most=6):
    cut = lambda t: t if len(t) <= text else t[:text] + "… [truncated]"
    if depth >= most:
        return "[truncated-depth]"
    if isinstance(v, str):
        return cut(v)
    if isinstance(v, list):
        return [clean(x, n, text, depth + 1) for x in v[:n]]
    if isinstance(v, dict):
        out = {}
        for k in sorted(v)[:n]:
            out.setdefault(cut(k), clean(v[k], n, text, depth + 1))
        return out
    return v


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([None, True, 5, -1.25, "", 'q"uo\\te', "é" * 12, "text"])
    if kind < 0.6:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 5))]
    return {rng.choice(["a", "b", "key long enough", "key long enough too", "ß"]): made(rng, depth - 1) for _ in range(rng.randint(0, 5))}


def test_sanitise_of_unknown_shape(spark):
    rng = random.Random(4)
    values = [made(rng, rng.choice([1, 3, 8])) for _ in range(120)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "{bad"), (901, None)], "i int, j string")
    got = {r.i: r.v for r in df.select("i", variant.sanitise(F.try_parse_json("j"), 3, 8).alias("v")).collect()}
    assert got.pop(900) is None and got.pop(901) is None
    for i, v in enumerate(values):
        assert json.loads(got[i]) == clean(v, 3, 8), values[i]


def test_paths_and_wrapped_values(spark, names):
    j = '{"a": {"b": {"c": [1, 2]}, "x y": "z"}, "k": {"value": 7}, "m": 8, "n": {"other": 1}, "o": null}'
    df = spark.createDataFrame([(j,)], "j string").withColumn("v", F.parse_json("j"))
    p = lambda path, d=None: variant.text_of(variant.path_get(F.col("v"), path, d))
    u = lambda key: variant.text_of(variant.unwrap_value(F.col("v"), key))
    row = df.select(p("a.b.c"), p("a.x y"), p("a.q.c", "none"), p("a.b.c.d", "none"), p("m.z"), u("k"), u("m"), u("n"), u("o"), u("zz")).first()
    assert list(row) == ["[1,2]", "z", "none", "none", None, "7", "8", None, None, None]
    df.createOrReplaceTempView("values_of_unknown_shape")
    assert spark.sql("SELECT CAST(path_get(v, 'a.x y') AS STRING), CAST(unwrap_value(v, 'k') AS INT) FROM values_of_unknown_shape").first() == ("z", 7)
    assert json.loads(spark.sql("SELECT sanitise_json(v, 1, 3) FROM values_of_unknown_shape").first()[0]) == {"a": {"b": {"c": [1]}}}


# -- brackets


def without_brackets(t):
    stack, drop = [], set()
    for i, c in enumerate(t):
        if c == "(":
            stack.append(i)
        elif c == ")" and stack:
            drop |= set(range(stack.pop(), i + 1))
    return "".join(c for i, c in enumerate(t) if i not in drop)


def test_brackets_at_any_depth(spark):
    rng = random.Random(6)
    texts = ["(" * 50 + "x" + ")" * 50 + "y", "a" + "(" * 60 + "b" + ")" * 50, ")" * 3 + "c(d)" + "(" * 3, "(" * 9 + "in" + ")" * 9] + ["".join(rng.choice("()ab") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", tx.remove_parenthetical(F.col("t")).alias("v")).collect():
        assert r.v.replace(" ", "") == without_brackets(texts[r.i]), texts[r.i]
