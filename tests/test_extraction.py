"""Table reconstruction on hand-made pages with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pagegrid.operators import context, extraction, ledgers, pages, scattered


def page_frame(spark, *texts):
    rows = [(1, i, text) for i, text in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, page_no int, markdown string")


def tables(spark, text):
    """``[(method, rows), ...]`` of one page."""
    rows = extraction.extract_page_tables(page_frame(spark, text)).orderBy("table_no").collect()
    assert [r.table_no for r in rows] == list(range(1, len(rows) + 1))
    return [(r.method, [list(x) for x in r.rows]) for r in rows]


def ledger(spark, text):
    rows = ledgers.invoice_rows(page_frame(spark, text)).orderBy("header_line", "row_no").collect()
    return [tuple(r)[4:] for r in rows]


def test_runs_separators_and_padding(spark):
    text = "| a | b |\n|---|---|\n| 1 | 2 | 3 |\nprose\n|:---|---|\n|---|---|\nend"
    assert tables(spark, text) == [("markdown", [["a", "b", ""], ["1", "2", "3"]])] + [
        ("markdown", [[":---", "---"]])
    ]


def test_separator_does_not_end_a_run_but_a_one_pipe_line_does(spark):
    text = "| a | b |\n|---|\n|-|-|\n| c | d |\nx | y\n| e | f |"
    got = tables(spark, text)
    assert [rows for _, rows in got] == [[["a", "b"], ["c", "d"]], [["e", "f"]]]


def test_noise_tables(spark):
    noise = "| --- x | b |\n"
    assert len(tables(spark, noise)) == 1
    assert tables(spark, "|   | ---\t |") == []
    assert tables(spark, "| 2022 General Requirements Invoice Backup | |") == []
    assert len(tables(spark, "|  | \t|\n|  |\t |")) == 1  # two blank rows are kept


HEAD = "Invoice No Type Reference\n"


def test_ledger_row(spark):
    got = ledger(spark, HEAD + "220426 I *PO#: Tom9172024")
    assert got == [("220426", "I", "220426", "", "", "", "")]


def test_ledger_positional_dates(spark):
    text = HEAD + "11111 I\n22222 P x\n| 01/02/2024 | 02/02/2024 | 03/02/2024 | 04/02/2024 | 5.00 |"
    assert ledger(spark, text) == [
        ("11111", "I", "11111", "01/02/2024", "02/02/2024", "5.00", ""),
        ("22222", "P", "22222", "03/02/2024", "04/02/2024", "", ""),
    ]


def test_ledger_last_money_line_wins(spark):
    text = HEAD + "11111 I\n22222 P x\n| 01/01/2024 | 02/01/2024 |\n| 03/01/2024 | 04/01/2024 |"
    got = ledger(spark, text)
    assert got[0][3:5] == ("03/01/2024", "04/01/2024")
    assert got[1][3:5] == ("", "")


def test_ledger_last_type_wins_and_order_is_textual(spark):
    text = HEAD + "99999 I\n100000 D\n99999 x9\n100000 P z"
    assert [r[:3] for r in ledger(spark, text)] == [
        ("100000", "P", "100000"),
        ("99999", "I", "99999"),
    ]


def test_ledger_window_is_49_lines(spark):
    lines = [f"{10000 + i} I" for i in range(60)]
    assert len(ledger(spark, HEAD + "\n".join(lines))) == 49


def test_ledger_stops_at_section(spark):
    for stop in ("# next", "| x |", "now STRIVING TO EARN it"):
        assert len(ledger(spark, HEAD + f"11111 I\n{stop}\n22222 I")) == 1
    pipe_head = "| Invoice No | Type | Reference |\n| 11111 | I |"
    assert ledger(spark, pipe_head) == []


def test_header_line_counts_as_money_line(spark):
    text = "Invoice No | Type | Reference 01/02/2024 02/02/2024 7.50\n11111 I"
    assert ledger(spark, text) == [("11111", "I", "11111", "01/02/2024", "02/02/2024", "7.50", "")]


def test_scattered_debit_and_credit(spark):
    text = "paid -1,234.56\nAB12 2020\n\n\n\nx 500\ny 10/12/2020"
    assert tables(spark, text) == [
        (
            "scattered",
            [
                ["Code", "Date", "Number", "Debit", "Credit"],
                ["AB12", "", "234 | 2020", "1,234.56", "-1,234.56"],
                ["", "10/12/2020", "500 | 2020", "", ""],
            ],
        )
    ]


def test_scattered_amount_without_credit(spark):
    text = "a 1.00\nb 2.00\n\n\nc 3.00\nd 400"
    assert tables(spark, text)[0][1] == [["Amount", "Number"], ["1.00 | 2.00", ""], ["3.00", "400"]]


def test_session_gap(spark):
    text = "n 100\n\nn 200\n\n\nn 300\nn 400\n\n\n\nn 500"
    rows = scattered.scattered_groups(page_frame(spark, text)).collect()
    assert sorted((r.group_no, r.line_no) for r in rows) == [(1, 0), (1, 2), (2, 5), (2, 6)]


def test_one_group_or_comments_give_no_table(spark):
    assert tables(spark, "n 100\nn 200") == []
    assert tables(spark, "# 100\n# 200\n\n\n\n** 300\n** 400") == []


def test_position_is_the_first_occurrence(spark):
    found = scattered.scattered_elements(page_frame(spark, "  x1234 234 234")).collect()
    assert [(r.type, r.value, r.position) for r in found] == [("numbers", "234", 2)] * 2


def test_own_patterns(spark):
    patterns = {"mails": r"[a-z]+@[a-z]+", "colours": "red|blue"}
    text = "me@home red\nblue\n\n\n\nyou@work\nred"
    rows = scattered.scattered_rows(page_frame(spark, text), patterns).orderBy("row_no").collect()
    assert [(r.header, r.cells) for r in rows] == [
        (["Colours", "Mails"], ["red | blue", "me@home"]),
        (["Colours", "Mails"], ["red", "you@work"]),
    ]


def test_methods_are_an_extension_point(spark):
    def shouting(text):
        rows = F.array(F.array(F.upper(text)))
        table = F.struct(F.lit("shout").alias("method"), rows.alias("rows"))
        return F.array(table)

    methods = (*extraction.METHODS, shouting)
    got = extraction.extract_tables(page_frame(spark, "| a | b |"), methods).collect()
    assert [(r.method, r.cells) for r in got] == [("markdown", ["a", "b"]), ("shout", ["| A | B |"])]


def test_page_csv(spark):
    text = '| a | b,"c" |\n\n| x | y |'
    row = extraction.page_csv(page_frame(spark, "none", text)).first()
    assert row.file_name == "1_page_2.csv"
    assert row.csv_text == 'a,"b,""c"""\r\n\r\n--- Table 2 ---\r\nx,y\r\n'


def test_page_number_from_name(spark):
    df = spark.createDataFrame([("a_page_12.csv",), ("a_page_x.csv",), ("page_1.csv.gz",)], "n string")
    got = [r[0] for r in df.select(extraction.page_no_from_name(F.col("n"))).collect()]
    assert got == [12, None, None]


def test_run_summary(spark):
    df = page_frame(spark, "| a | b |", "none", "| a | b |\nx\n| c | d |")
    row = extraction.run_summary(df).first()
    assert (row.pages_processed, row.tables_found, row.pages_with_tables) == (3, 3, 2)
    assert sorted(r.page_no for r in extraction.run_table_pages(df).collect()) == [1, 3]


def test_flag_cascade_boundaries(spark):
    rows = [
        (1, 0.030, 0.006, "x"),
        (2, 0.031, 0.006, "x"),
        (3, 0.025, 0.006, "x"),
        (4, 0.031, 0.005, "x"),
        (5, 0.0, 0.0, "a b c d"),
    ]
    df = spark.createDataFrame(rows, "page_no int, edge_density double, line_density double, text string")
    got = pages.flag_pages(df.withColumn("doc_id", F.lit(1))).orderBy("page_no").collect()
    assert [r.reason for r in got] == [
        "moderate_density",
        "density",
        "none",
        "none",
        "tabular_layout",
    ]


@pytest.mark.parametrize(
    ("cells", "signature"),
    [
        (["abcd", "ab", " efgh ", "ijkl", "mnop"], ["abcd", "efgh", "ijkl"]),
        (["abc", ""], []),
    ],
)
def test_row_signature(spark, cells, signature):
    got = spark.range(1).select(context.row_signature(F.array(*[F.lit(c) for c in cells]))).first()
    assert got[0] == signature


def test_missing_row_data(spark):
    text = "| Alpha | Beta1 |\n\nAlpha Beta1 77 $5.00 P\nAlpha only 88\n\tAlpha,Beta1, 9.5 ,77"
    rows = context.missing_row_data(page_frame(spark, text)).collect()
    assert [(r.row_no, r.missing) for r in rows] == [(1, ["77", "$5.00", "P", "9.5"])]
    related = context.related_lines(page_frame(spark, text)).collect()
    assert sorted(r.line_no for r in related) == [0, 2, 4]


def test_results_can_be_reused(spark):
    df = page_frame(spark, "| a | b |", "none", "Invoice No Type Reference\n11111 I\n| x |y |")
    results = extraction.page_results(df)
    assert results.count() == 3
    for operator in (extraction.extract_tables, extraction.page_csv, extraction.run_summary):
        again = operator(results)
        assert sorted(map(str, again.collect())) == sorted(map(str, operator(df).collect()))
