"""Queries against their SQL twins over documents whose texts are empty, blank, or begin with a blank or a full stop."""

import os

import pytest
from pyspark.sql import functions as F

from oracle import TABLES, difference, duck
from paperloom.functions import text as tx
from paperloom.operators import prompts
from paperloom.plans import registry
from paperloom.sources import records

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXTS = ["", " ", "\n", "\t\n ", " alpha beta. gamma", "\nalpha beta", ".", ". alpha", " . alpha", "alpha.", "alpha "]


@pytest.fixture(scope="module")
def blank_texts(spark, tmp_path_factory):
    """The smallest tables, with every text of ``TEXTS`` at twelve ids as documents."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    made = tmp_path_factory.mktemp("blank")
    for name in TABLES:
        if name != "documents":
            os.symlink(f"{SF}/{name}.parquet", made / f"{name}.parquet")
    rows = [(10_000 + 12 * i + k, text, "en", f"src{k % 3}", len(text)) for i, text in enumerate(TEXTS) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(made / "documents.parquet")
    return str(made)


@pytest.mark.parametrize("name", ["a8_review_table", "g13_clean_summary", "g33_bibitems"])
def test_query(spark, blank_texts, name):
    assert difference(registry.QUERIES[name](spark, blank_texts), duck(blank_texts), registry.ORACLE[name]) == ""


def test_review_table_without_blank_rationales(spark):
    """Unless told otherwise, the operator takes blank rationales for missing, line breaks too."""
    rows = [(i, "t", ["a"], r, p, [("claim", "c")]) for i, (r, p) in enumerate([("x", "y"), ("", "y"), ("\n\t", "y"), ("x", " \n"), (None, "y"), ("x", None)])]
    df = spark.createDataFrame(rows, "paper_id int, title string, authors array<string>, rationale string, rationale_pred string, entities array<struct<type:string,label:string>>")
    ids = lambda **how: sorted(r["paper_id"] for r in records.review_table(df, ["claim"], **how).collect())
    assert ids() == [0]
    assert ids(blank=True) == [0, 1, 2, 3]


def test_missing_titles(spark):
    """A title of white space alone is missing; without a default of the caller's own it is unknown."""
    blocks = [rf"\bibitem{{k}} A. Author. \newblock {t}. \newblock Venue, 2001." for t in ("", " \n", "alpha")]
    df = spark.createDataFrame(list(enumerate(blocks)), "i int, b string")
    titles = lambda **how: [r["title"] for r in prompts.bibitems(df, "b", **how).orderBy("i").collect()]
    assert titles() == ["Unknown Title", "Unknown Title", "alpha"]
    assert titles(default="") == ["", "", "alpha"]
    assert [r["v"][0]["title"] for r in df.orderBy("i").select(tx.parse_bibitems(F.col("b")).alias("v")).collect()] == titles()
