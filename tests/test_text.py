"""Character classes and column functions on small values."""

import math
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from pagegrid.functions import cells as C
from pagegrid.functions import lines as L
from pagegrid.functions import metrics as M
from pagegrid.functions import patterns as P
from pagegrid.functions import text as T
from pagegrid.operators.routing import retry_delay


def values(spark, rows, *columns):
    """Evaluate column expressions over one string column ``s``."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_whitespace_is_the_unicode_set():
    assert set(T.WHITESPACE) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}


def test_classes_match_character_by_character(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    got = values(
        spark,
        chars,
        F.col("s").rlike(f"[{T.SPACE}]"),
        F.col("s").rlike(f"[^{T.SPACE}]"),
        F.col("s").rlike(f"[{T.DIGIT_SIGN}]"),
        T.strip(F.col("s")) == "",
    )
    for c, (space, no_space, digit, blank) in zip(chars, got):
        assert space == c.isspace() == (not no_space) == blank, hex(ord(c))
        assert digit == c.isdigit(), hex(ord(c))


def test_words_and_strip(spark):
    rows = ["  a\tb  c　", "", " \n ", "x"]
    got = values(spark, rows, T.words(F.col("s")), T.strip(F.col("s")))
    assert [g[0] for g in got] == [r.split() for r in rows]
    assert [g[1] for g in got] == [r.strip() for r in rows]


@pytest.mark.parametrize(
    ("line", "table", "separator"),
    [
        ("|---|---|", True, True),
        (" | - |  ", True, True),
        ("|:---|---|", True, False),
        ("a | b", False, False),
        ("||", True, True),
        ("|\t|", True, False),
    ],
)
def test_table_and_separator_lines(spark, line, table, separator):
    got = values(spark, [line], L.is_table_line(F.col("s")), L.is_separator(F.col("s")))
    assert got == [(table, separator)]


def test_split_cells(spark):
    rows = ["| a | b |", "a | b | c", "| a || b |", " |x|y ", "|\t|"]
    got = [g[0] for g in values(spark, rows, C.split_cells(F.col("s")))]
    assert got == [["a", "b"], ["a", "b", "c"], ["a", "", "b"], ["x", "y"], [""]]


def test_data_lines(spark):
    rows = {
        "due 1/2/24": True,
        "paid 3.50": True,
        "room 123": True,
        "x123": False,
        "a1-b2": True,
        "plain words only": False,
        "a12 b": False,
        "": False,
        "   ": False,
        "١٢٣": True,
    }
    got = [g[0] for g in values(spark, list(rows), L.looks_like_data_line(F.col("s")))]
    assert got == list(rows.values())


def test_tabular_cells(spark):
    yes = ["12", "3.5", "ABCDE", "1-2-24", "1/2/2024", "$1,234.56", "1,234", "B77", "P"]
    no = ["", "ABCDEF", "ab", "3.555", "1,23", "B7x", "-5", "1" * 51]
    got = [g[0] for g in values(spark, yes + no, L.looks_like_tabular(F.col("s")))]
    assert got == [True] * len(yes) + [False] * len(no)


def test_tabular_layout_counts_empty_lines(spark):
    rows = ["a b c d\n\n\n\n", "a b c d\n\n\n", "one two three", "  a  b c d \n x", ""]
    got = values(
        spark,
        rows,
        L.tabular_line_count(F.col("s")),
        L.line_count(F.col("s")),
        L.is_tabular_layout(F.col("s")),
    )
    assert got == [(1, 5, False), (1, 4, True), (0, 1, False), (1, 2, True), (0, 1, False)]


def test_attempt_class_order(spark):
    rows = ["file TOO Large", "limit 600", "HTTP 502 size 600", "Gateway", "timeout", "401"]
    got = [g[0] for g in values(spark, rows, L.attempt_class(F.col("s")))]
    assert got == ["too_large", "too_large", "too_large", "retry", "retry", "fatal"]


def test_retry_delay(spark):
    got = spark.range(3).select(retry_delay(F.col("id"))).collect()
    assert [r[0] for r in got] == [10, 25, 0]


def test_element_patterns(spark):
    line = "AB12 1,234.56 -1,234.56 10/12/2020 *REF#: A-12 132710.38 x99y"
    found = values(spark, [line], *[T.find_all(F.col("s"), p) for p in P.ELEMENT_PATTERNS.values()])
    assert dict(zip(P.ELEMENT_PATTERNS, found[0])) == {
        "numbers": ["234", "234", "2020", "132710"],
        "amounts": ["1,234.56", "1,234.56"],
        "negative_amounts": ["-1,234.56"],
        "dates": ["10/12/2020"],
        "references": ["*REF#: A-12"],
        "codes": ["AB12"],
    }


def test_patterns_equal_unicode_regex(spark):
    """The rewritten patterns find what plain Unicode-aware ones find, on random text."""
    plain = {
        "numbers": r"\b\d{3,}\b",
        "amounts": r"\b\d{1,3}(?:,\d{3})*\.\d{2}\b",
        "negative_amounts": r"-\d{1,3}(?:,\d{3})*\.\d{2}\b",
        "dates": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
        "references": r"\*[A-Z]+#:?\s*[\w\d#\-]+",
        "codes": r"\b[A-Z]{1,3}\d{2,6}[A-Z]?\b",
        "numeric": r"\b\d+(?:\.\d+)?\b",
        "date": r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
        "currency": r"\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b",
        "identifier": r"\b[A-Z]{2,}\d+\b|\b\d{5,}\b",
        "ledger_amount": r"[\d,]+\.\d{2}",
    }
    ours = P.ELEMENT_PATTERNS | P.PROFILE_PATTERNS | {"ledger_amount": P.LEDGER_AMOUNT}
    rng = random.Random(5)
    alphabet = "0123456789" * 3 + "..,,//--  AZBz#*:$_é١٢"
    rows = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    found = values(spark, rows, *[T.find_all(F.col("s"), p) for p in ours.values()])
    for row, got in zip(rows, found):
        for (name, _), mine in zip(ours.items(), got):
            assert mine == re.findall(plain[name], row), (name, row)


def test_reference_and_currency_quirks(spark):
    got = values(
        spark,
        ["220426 I *PO#: Tom9172024", "12345", "1abc", "é12"],
        F.regexp_extract("s", P.LEDGER_REFERENCE, 1),
        T.find_all(F.col("s"), P.PROFILE_PATTERNS["currency"]),
    )
    assert [g[0] for g in got] == ["220426", "12345", "", "é12"]
    assert got[1][1] == ["345"]


def test_csv_quoting(spark):
    row = F.split("s", "~")
    rows = ['a~b,c~d"e~f\ng', "", "~", "x"]
    got = [g[0] for g in values(spark, rows, C.csv_row(row))]
    assert got == ['a,"b,c","d""e","f\ng"\r\n', '""\r\n', ",\r\n", "x\r\n"]


def test_linspace_ends(spark):
    low, high = F.lit(2.3), F.lit(3.3)
    got = spark.range(1).select(T.linspace(low, high, 5)).first()[0]
    assert got == pytest.approx([2.3, 2.55, 2.8, 3.05, 3.3]) and got[-1] == 3.3


def scores(spark, pairs, metric):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    rows = df.select("i", metric(F.col("a"), F.col("b"))).orderBy("i").collect()
    return [r[1] for r in rows]


def test_error_rates(spark):
    pairs = [("", ""), ("", "a"), ("ab", "abcde"), ("été", "ete"), (None, "a"), ("a", None)]
    assert scores(spark, pairs, M.cer) == [0.0, 1.0, 1.5, pytest.approx(2 / 3), None, None]
    pairs = [("the cat sat", "the dog sat down"), (" ", ""), ("", "a b"), ("a b", "a b"), ("a", "")]
    assert scores(spark, pairs, M.wer) == [pytest.approx(2 / 3), 0.0, 1.0, 0.0, 1.0]
    assert scores(spark, [("abcd", "abXdEFG")], M.cer_positional) == [0.25]
    assert scores(spark, [("a b c", "a x c d")], M.wer_positional) == [pytest.approx(1 / 3)]


def edit_distance(a, b):
    best = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i, j] = min(
                best[i - 1, j] + 1,
                best[i, j - 1] + 1,
                best[i - 1, j - 1] + (a[i - 1] != b[j - 1]),
            )
    return best[len(a), len(b)]


def test_wer_by_brute_force(spark):
    """Also beyond 127 distinct words, where the SQL oracle would no longer be exact."""
    rng = random.Random(3)
    pairs = []
    for size in (3, 20, 400):
        vocabulary = [f"w{i}" for i in range(size)]
        for _ in range(5):
            a, b = rng.choices(vocabulary, k=size), rng.choices(vocabulary, k=size)
            pairs.append((a, b))
    got = scores(spark, [(" ".join(a), " ".join(b)) for a, b in pairs], M.wer)
    assert got == [pytest.approx(edit_distance(a, b) / len(a)) for a, b in pairs]
    assert not any(math.isnan(g) for g in got)
