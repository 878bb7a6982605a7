"""Pages read in plain Python against the same rules as built-in functions, on odd random pages."""

import os
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagegrid.functions import cells as C
from pagegrid.functions import page_index, page_scan
from pagegrid.functions import patterns as P
from pagegrid.operators import context, extraction

# No digits beyond the basic plane: a look-behind of the built-in functions sees half of such a character.
PARTS = (
    "Invoice No Type Reference|12345 I *PO#: A12|100200 *PO#:PO7 D|55555 P|*CK#:4 77777|"
    "01/02/2023|1/2/2024|12/31/1999/7|1,234.56|12.3456.78|,,5.00|-12.50|-1,234.567|$5.00|$1,234|173665.47|123|1234|"
    "AB123|ABC123456X|A1|P|U|x9 REF77|*REF#: R-9|*AB:|**|**bold|# head|STRIVING TO EARN|---|- -|9.5|9-1-23|"
    "١٢٣|١٢/٠١/٢٠٢٣|²³¹²³|½ 4|é12|_12|Übung 12345| | x|\t|, |漢字123|\U0001f600123|\r|\x1c|\"q\"|"
    "2022 General Requirements Invoice Backup|Alpha Beta|total|Alpha,12, 7.25|Ⅷ 300|a²|12345²"
).split("|")


def texts(seed, count):
    rng = random.Random(seed)

    def line():
        kind = rng.random()
        some = [rng.choice(PARTS) for _ in range(rng.randint(0, 6))]
        if kind < 0.35:
            return "| " + rng.choice((" | ", "|", " |")).join(some) + rng.choice((" |", "|", "  ", ""))
        if kind < 0.4:
            return rng.choice(("|---|---|", "||", "| - |", "|", "|  |"))
        if kind < 0.55:
            return ""
        return rng.choice(("", " ", " ")) + rng.choice((" ", "", " \t")).join(some)

    return ["\n".join(line() for _ in range(rng.choice((0, 1, 9, 30, 70)))) for _ in range(count)] + ["", "|", "\n", None]


def frame(spark, pages):
    rows = [(i, 1, text) for i, text in enumerate(pages)]
    return spark.createDataFrame(rows, "doc_id bigint, page_no int, markdown string").repartition(8)


def by_columns(text):
    """Tables as the built-in functions find them."""
    found = F.concat(*[method(text) for method in extraction.METHODS])
    return F.filter(found, lambda t: C.is_meaningful(t["rows"], P.NOISE_CELLS))


def test_tables_and_csv_are_those_of_the_columns(spark):
    pages = frame(spark, texts(1, 400))
    slow = pages.select("doc_id", "page_no", F.explode(F.array(by_columns(F.col("markdown")))).alias("tables"))
    expected = {r.doc_id: r.tables for r in slow.collect()}
    got = {r.doc_id: r.tables for r in extraction.page_results(pages).collect()}
    assert len(expected) == 404 and sum(map(bool, expected.values())) > 200
    assert {t.method for tables in expected.values() for t in tables} == {"markdown", "invoice", "scattered"}
    for doc_id, tables in expected.items():
        assert got[doc_id] == tables, doc_id
    files = {r.doc_id: r.csv_text for r in extraction.page_csv(slow).collect()}
    assert {r.doc_id: r.csv_text for r in extraction.page_csv(pages).collect()} == files


def test_some_methods_and_other_noise(spark):
    pages = frame(spark, ["| x |", "| y |\n\n12345 1.50\n77777\n\n\n\nAB12\nAB13"])
    only = lambda methods, noise: [r.method for r in extraction.extract_tables(pages, methods, noise).collect()]
    assert only(extraction.METHODS[:1], ["x"]) == ["markdown"]
    assert set(only(extraction.METHODS[2:], [])) == {"scattered"}


def test_tokens_are_those_of_the_columns(spark):
    lines = sorted({line for text in texts(2, 80) if text for line in text.split("\n")})
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    expected = dict(rows.select("line", context.cell_tokens(F.col("line"))).collect())
    assert sum(map(bool, expected.values())) > 300
    for number, line in enumerate(lines):
        assert page_scan.LineTokens(lines)[number] == expected[line], line


def test_values_of_other_lines_are_found_one_by_one(spark):
    """Every row against every line of its page, by the definition."""
    pages = [t for t in texts(3, 200) if t and "|" in t]
    found = {}
    for r in context.candidates(frame(spark, pages)).collect():
        found.setdefault((r.doc_id, r.table_no, r.row_no), []).append((r.line_no, r.candidate))
    missing = {(r.doc_id, r.table_no, r.row_no): r.missing for r in context.missing_row_data(frame(spark, pages)).collect()}
    expected, distinct = {}, {}
    for doc_id, text in enumerate(pages):
        lines = text.split("\n")
        tokens = page_scan.LineTokens(lines)
        for table_no, table in enumerate(page_scan.pipe_tables(lines), 1):
            for row_no, cells in enumerate(table, 1):
                asked = [c for c in cells if len(c) > 3][:3]
                related = [
                    k for k, line in enumerate(lines)
                    if asked and line.strip() and sum(part in line for part in asked) >= len(asked) // 2 + 1
                ]
                row = " ".join(cells)
                lacking = [(k, token) for k in related for token in tokens[k] if token not in row]
                if lacking:
                    expected[doc_id, table_no, row_no] = lacking
                    distinct[doc_id, table_no, row_no] = list(dict.fromkeys(token for _, token in lacking))
    assert len(expected) > 50
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert missing == distinct


@pytest.mark.parametrize(
    "operator", [extraction.extract_tables, extraction.page_csv, context.candidates, context.missing_row_data]
)
def test_no_lambda_is_interpreted_per_line(spark, operator):
    plan = operator(frame(spark, ["| a | b |"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp" not in plan


def test_what_is_remembered_is_bounded():
    known = page_scan._ByShape(len)
    for k in range(3 * page_scan.SHAPES):
        assert known[str(k)] == len(str(k))
    assert known["x" * 99] == 99 and "x" * 99 not in known
    assert len(known) <= page_scan.SHAPES


def test_workers_need_no_import_path(tmp_path):
    calls = [
        (page_scan.tables_of, ("| a | b |\n12345 I", ("markdown", "invoice", "scattered"), frozenset())),
        (page_scan.csv_text, ([[["a", 'b"']]],)),
        (page_scan.nested_tables, ([[("markdown", [["a"]])]],)),
        (page_scan.LineTokens, (["| 7 |"],)),
        (page_index.LineIndex, (["| 7 |"], [])),
    ]
    (tmp_path / "calls").write_bytes(cloudpickle.dumps(calls))
    code = "import sys; from pyspark import cloudpickle; [f(*a) for f, a in cloudpickle.load(open(sys.argv[1], 'rb'))]"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "calls")], cwd=tmp_path, env=clean, check=True)
