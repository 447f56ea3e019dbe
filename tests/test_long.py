"""Very long texts end in seconds: no pattern recurses or backtracks over them, no window is read anew for each row."""

import time

import pytest
from pyspark.sql import functions as F

from aulamill.functions import text as X
from aulamill.operators import gift

LONG = {
    "colons": "::" + "a:b " * 250_000 + "::Q {=a}",
    "unclosed": "::" + "a:b " * 250_000 + "{=a}",
    "comments": "//c\n" * 100_000 + "q {=a\n~b}",
    "blank": "x\n" + " \n" * 100_000 + "y",
    "newlines": "x" + "\n" * 200_000 + "y",
    "categories": "$CATEGORY: x\n" * 50_000,
    "gap": "Q {=" + " " * 20_000 + "x ~ a->b}",
}


@pytest.fixture(scope="module")
def long_files(spark):
    return spark.createDataFrame(list(LONG.items()), "filepath string, content string").repartition(8).cache()


def test_parser_on_long_texts(long_files):
    began = time.time()
    rows = gift.parse(long_files).groupBy("filepath").agg(F.count("*").alias("n"), F.max(F.length("title")).alias("t")).collect()
    found = {r.filepath: (r.n, r.t) for r in rows}
    assert found["colons"] == (1, 999_999) and found["unclosed"] == (1, None)
    assert found["comments"] == (1, None) and found["blank"][0] == found["newlines"][0] == 2
    assert found["categories"] == (50_000, 1) and found["gap"][0] == 1
    assert time.time() - began < 60


@pytest.mark.parametrize("change", [X.format_gift, X.indent_code, X.map_code, X.html_to_markdown, X.gift_blocks, X.clean_text, X.sanitize_filename])
def test_functions_on_long_texts(long_files, change):
    began = time.time()
    assert long_files.select(F.max(F.length(change(F.col("content")).cast("string")))).head()[0] > 0
    assert time.time() - began < 60


def test_notes_before_a_question(value):
    text = "// one\n\x0b// two\r$CATEGORY: c\n::T:: Q {\n=a\x0b~b\n}"
    assert value(X.format_gift, text) == "// one\n// two\n$CATEGORY: c\n::T::\nQ\n{\n    =a\n    ~b\n}\n"
    assert value(X.format_gift, "// only") == "// only\n"
