"""The index of a page's lines against plain containment, and its cost on long pages."""

import random

import pytest
from pyspark.sql import functions as F

from pagegrid.functions.page_index import LineIndex, Substrings
from pagegrid.operators import context


def related(signature, line):
    return sum(part in line for part in signature) >= len(signature) // 2 + 1


@pytest.mark.parametrize("seed", range(4))
def test_related_lines_are_those_that_contain_the_parts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("ab1 é漢", k=rng.randint(4, 9)))
    lines = ["".join(rng.choices("ab1 é漢", k=rng.randint(0, 60))) for _ in range(300)] + ["", "ab1"]
    signatures = [[word() for _ in range(rng.randint(1, 3))] for _ in range(200)]
    signatures += [[lines[k][5:12]] for k in range(20) if len(lines[k]) > 12] + [["abab"] * 3, ["abab", "abab"]]
    index = LineIndex(lines, [part for s in signatures for part in s])
    for signature in signatures:
        assert index.related(signature) == [k for k, line in enumerate(lines) if related(signature, line)]


def test_nothing_asked():
    assert LineIndex(["a line"], []).postings == LineIndex(["a line"] * 999, []).postings == {}


@pytest.mark.parametrize("seed", range(3))
def test_substrings(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices("ab12|", k=70 + 300 * seed))
    tokens = ["".join(rng.choices("ab12|", k=rng.randint(1, 5))) for _ in range(300)] + [text, text + "x", ""]
    assert Substrings(text).without(tokens) == [t for t in tokens if t not in text]


def ledger(rows):
    """A page whose every row has its own reference, and as many lines that name one."""
    table = [f"| REF{k:07d} | item {k} |" for k in range(rows)]
    notes = [f"REF{k:07d} item {k} paid {k}.25 on 01/02/2023" for k in range(rows)]
    return "\n".join(["| Reference | Text |", "|---|---|", *table, "", *notes])


def test_work_on_a_long_page_is_linear(monkeypatch):
    """Lines that are verified for all rows of a page, four times as many for four times the page."""

    class Line(str):
        looked = 0

        def __contains__(self, part):
            Line.looked += 1
            return super().__contains__(part)

    counts = []
    for rows in (500, 2000):
        Line.looked = 0
        lines = [Line(x) for x in ledger(rows).split("\n") if x.strip()]
        signatures = [[f"REF{k:07d}", f"item {k}"] for k in range(rows)]
        index = LineIndex(lines, [part for s in signatures for part in s])
        # The row itself and its note.
        assert all(index.related(x) == [k + 2, k + 2 + rows] for k, x in enumerate(signatures))
        counts.append(Line.looked)
    assert counts[1] < 6 * counts[0]


def test_pages_of_any_key_and_length(spark):
    rows = [("a", 1, ledger(400)), ("b", 2, "no table"), ("c", 3, "| only | \n"), ("d", 4, "|x|\n| yyyy |\nyyyy 12.50 z")]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, markdown string")
    found = context.related_lines(pages).where("doc_id = 'a' and row_no > 1")
    assert found.count() == 800 and found.schema["doc_id"].dataType.simpleString() == "string"
    missing = context.missing_row_data(pages).where("doc_id = 'a'")
    assert missing.where(F.array_contains("missing", "7.25")).count() >= 1
    assert context.candidates(pages.where("false")).count() == 0
