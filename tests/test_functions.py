"""Input and output pairs of text, date, rating and fuzzy functions."""

import datetime as dt
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import fuzzy as fz
from paperloom.functions import ratings as rt
from paperloom.functions import stem
from paperloom.functions import text as tx
from paperloom.operators import aggregate, metrics
from paperloom.operators import filters as fl


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["v"] for r in df.orderBy("i").select(column(F.col("x")).alias("v")).collect()]


@pytest.mark.parametrize(
    "f, pairs",
    [
        (tx.match_title, {"On the Sorting of a Large Table": "sorting of large table", "Cut-Keys, Found by Counting!": "cut keys found by counting", "": ""}),
        (tx.clean_title, {" Straßen \t und\nWege": "strassen und wege", "": ""}),
        (tx.remove_line_numbers, {"7 first line\n18 second line": "first line\nsecond line"}),
        (tx.remove_page_numbers, {"end of page\n41\nnext page": "end of page\n\nnext page"}),
        (tx.compress_whitespace, {"upper\n\n\n\n\nlower": "upper\n\nlower", "left    right": "left right"}),
        (tx.fix_spaces_before_punctuation, {"a , b .": "a, b."}),
        (tx.remove_parenthetical, {"A table (in parts)": "A table", "a (b (c) d) e": "a e", "open ( only": "open ( only"}),
        (lambda c: tx.remove_prefix_icase(c, "abc"), {"ABCdef": "def", "xabc": "xabc"}),
        (tx.clean_summary, {"The supporting paper demonstrates that models work.": "Models work.", "The findings from the target paper show that x": "X", "Plain.": "Plain."}),
        (tx.parse_rating, {"Rating: 9": 5, "rating:0": 1, "none": None}),
        (tx.parse_label_line, {"x\nLabel: 1\n": 1, "y": None}),
        (rt.parse_rating, {"4 - good": 4, "7": None, " 4 - x": None, "10: top": 10}),
        (tx.section_number, {"2.1 Data": 2, "A Appendix": None, "1. Introduction": 1}),
    ],
)
def test_pairs(spark, f, pairs):
    assert values(spark, f, list(pairs)) == list(pairs.values())


def test_capital_is_one_letter(spark):
    opening = "The supporting paper shows that "
    got = values(spark, tx.clean_summary, [opening + x for x in ("ßieung a", "ﬁn", "ᾳb", "östen", "ab")])
    assert got == ["ẞieung a", "ﬁn", "ᾼb", "Östen", "Ab"]


def test_nulls(spark):
    for f in (tx.clean_title, tx.match_title, tx.clean_maintext, tx.clean_summary, tx.truncate_evidence, rt.parse_rating):
        assert values(spark, f, [None]) == [None]


def test_label_anywhere(spark):
    got = values(spark, tx.parse_label, ["Good.\n\n**Label**: 3\nEnd", "no label"])
    assert got[0]["label"] == 3 and got[0]["rationale"] == "Good.\nEnd"
    assert got[1]["label"] is None


def test_dates(spark):
    ids = ["1911.00042", "1911.00042v12", "math/9901123", "no id at all", None]
    got = values(spark, tx.arxiv_year_month, ids)
    assert [(x["year"], x["month"]) if x else None for x in got] == [(2019, 11), (2019, 11), None, None, None]
    assert values(spark, tx.parse_publication_date, ["2019-11-30", "2019-11-30T23:59", "2019-11", None]) == [dt.date(2019, 11, 30)] * 2 + [None, None]


@pytest.mark.parametrize(
    "month, year, date, expected",
    [
        (6, 2018, None, True),
        (6, 2020, dt.date(2018, 3, 4), False),
        (6, 2019, dt.date(2019, 6, 30), True),
        (6, 2019, dt.date(2019, 5, 1), True),
        (6, 2019, dt.date(2019, 7, 1), False),
        (6, 2019, None, False),
        (None, 2019, dt.date(2019, 1, 1), False),
        (6, 2019, dt.date(2018, 12, 31), False),
        (6, None, dt.date(2019, 1, 1), False),
    ],
)
def test_published_not_after(spark, month, year, date, expected):
    df = spark.createDataFrame([(2019, month, year, date)], "y int, m int, cy int, cd date")
    assert df.select(fl.published_not_after(F.col("y"), F.col("m"), F.col("cy"), F.col("cd"))).first()[0] is expected


def test_scale_recommendation(spark):
    assert values(spark, rt.scale_recommendation, list(range(1, 10)), "int") == [1, 2, 2, 2, 2, 3, 3, 4, 4]


def test_spans(spark):
    text = "Rivers bend. Stones stay put; gulls do not."
    df = spark.createDataFrame([(text, '[{"start": 13, "end": 19}]'), (text, '[{"start": 0, "end": 6}, {"start": 30, "end": 35}]'), (text, "{oops"), (text, None), (text, "[]")], "t string, s string")
    assert [r[0] for r in df.select(tx.extract_spans(F.col("t"), F.col("s"))).collect()] == ["Stones", "Rivers\ngulls", None, None, ""]


def test_any_phrase(spark):
    phrases = ["tidal letters", "journal of slow rivers", "pebble"]
    got = values(spark, lambda c: tx.any_phrase(c, phrases), ["Tidal\n Letters, vol. 3", "JOURNAL of  slow\trivers", "a Pebble!", "pebbles and tides", "letters, tidal", ""])
    assert got == [True, True, True, False, False, False]


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
def test_lcs(a, b):
    assert fz.lcs_length(a, b) == naive_lcs(a, b)


def test_title_matches(spark):
    rows = [("Attention Is All You Need", "attention is all you need", True), ("Attention", "Self-Attention with Relative Position Representations", True), ("Neural Machine Translation", "Deep Learning for Natural Language Processing", False), ("CoRR", "Spontaneous Reconstruction of Copper Active Sites", False), ("", "", True), ("Some Title", "", False)]
    df = spark.createDataFrame(rows, "a string, b string, e boolean")
    got = df.select("e", (fz.fuzzy_partial_ratio(tx.clean_title(F.col("a")), tx.clean_title(F.col("b"))) >= 80).alias("v")).collect()
    assert all(r["e"] == r["v"] for r in got)


def test_sql_registry(spark):
    fz.register(spark)
    assert spark.sql("SELECT fuzzy_ratio('abcd', 'abxd') AS v").first()["v"] == 75


def test_truncate_evidence(spark):
    text = "Summary\nSupporting Evidence:\n- a\n- b\n- c\n\nContradictory Evidence:\n- d\nConclusion: x\n- y"
    assert values(spark, lambda c: tx.truncate_evidence(c, 2), [text]) == ["Summary\nSupporting Evidence:\n- a\n- b\n\nContradictory Evidence:\n- d\nConclusion: x\n- y"]


def test_stems():
    """Words for each rule of the published algorithm."""
    pairs = "caresses caress ponies poni ties ti cats cat caress caress feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stem.stem(word) == want, word
    assert stem.stem("is") == "is" and stem.stem("ärger") == "ärger" and stem.stem("") == "" and stem.stem("don't") == "don't"
    assert stem.measure("tree") == 0 and stem.measure("trouble") == 1 and stem.measure("oaten") == 2


def test_rouge_with_stems(spark):
    rows = [(1, "The running dogs", "a dog was running"), (2, "", ""), (3, None, "x"), (4, "jumping jumping cats", "cat jumped"), (5, "a b a b", "a b c a b")]
    got = {r.i: r for r in metrics.rouge(spark.createDataFrame(rows, "i int, p string, r string"), "i", "p", "r").collect()}

    def f1(p, r, n):
        cut = lambda t: [stem.stem(w) if len(w) > 3 else w for w in re.findall(r"[^\W_]+", (t or "").lower())]
        a, b = (Counter(zip(*[cut(t)[i:] for i in range(n)], strict=False)) for t in (p, r))
        return 2 * (a & b).total() / (a.total() + b.total()) if a.total() + b.total() else 0.0

    for i, p, r in rows:
        assert got[i].rouge_1 == pytest.approx(f1(p, r, 1)) and got[i].rouge_2 == pytest.approx(f1(p, r, 2))
    assert got[5].rouge_l == pytest.approx(2 * 4 / 9) and got[2].rouge_l == 0


def test_noise_share(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (None,)], "spread double")
    assert [tuple(r) for r in aggregate.noise_share(df, "spread", [0.0, 1.0, 5.0]).orderBy("limit").collect()] == [(0.0, 1, 0.333333), (1.0, 2, 0.666667), (5.0, 3, 1.0)]
    assert aggregate.noise_share(df.limit(0), "spread", [1.0]).first()["share"] == 0
