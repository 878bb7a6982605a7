"""Rebuild a ledger whose rows are scattered after an ``Invoice No .. Type .. Reference`` line.

Each header line carries the 49 lines after it. That window is cut from the page's own
line array, so the look-ahead costs no join, and everything derived from it is an array
of at most 49 entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.functions import lines as L
from pagegrid.functions import patterns as P
from pagegrid.functions.text import DIGIT_SIGN, find_all, last, let, lines_of, strip, words
from pagegrid.operators.pages import PAGE


def header_windows(lines: Column) -> Column:
    """``array<struct<line_no, window>>``; ``window[0]`` is the header line itself."""
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    headers = F.filter(numbered, lambda x: L.is_ledger_header(x["line"]))
    return F.transform(
        headers,
        lambda h: F.struct(
            h["line_no"].alias("line_no"),
            F.slice(lines, h["line_no"] + 1, F.lit(P.LEDGER_WINDOW)).alias("window"),
        ),
    )


def window_data(window: Column, phrases: list[str] = P.STOP_PHRASES) -> Column:
    """Data lines of a window up to the first section stop: ``array<struct<offset, line>>``."""
    body = F.transform(
        F.slice(window, 2, P.LEDGER_WINDOW - 1),
        lambda line, i: F.struct((i + 1).alias("offset"), strip(line).alias("line")),
    )

    def until_stop(lines: Column) -> Column:
        stop = F.array_position(
            F.transform(lines, lambda x: L.is_section_stop(x["line"], phrases)), True
        )
        kept = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
        return F.filter(kept, lambda x: L.has_digit(x["line"]) & L.has_data_shape(x["line"]))

    return let(body, until_stop)


def invoice_number(line: Column) -> Column:
    """First all-digit word of five digits or more in a line of two words or more."""
    plain = reduce(lambda s, label: F.replace(s, F.lit(label), F.lit("")), P.LEDGER_LABELS, line)
    number = rf"\A[{DIGIT_SIGN}]{{5,}}\z"
    return let(
        words(plain),
        lambda w: F.when(
            F.size(w) >= 2, F.get(F.filter(w, lambda part: part.rlike(number)), F.lit(0))
        ),
    )


def invoice_type(line: Column) -> Column:
    """The first type letter that stands alone inside or at the end of a stripped line."""
    tests = [(line.contains(f" {t} ") | line.endswith(f" {t}"), t) for t in P.LEDGER_TYPES]
    return reduce(lambda chain, test: chain.when(*test), tests[1:], F.when(*tests[0]))


def invoice_reference(line: Column) -> Column:
    """First word part that ends in digits."""
    return F.nullif(F.regexp_extract(line, P.LEDGER_REFERENCE, 1), F.lit(""))


def money_lines(window: Column) -> Column:
    """Dates and amounts of pipe lines; the header line counts, section stops do not."""
    numbered = F.transform(
        window, lambda line, i: F.struct(i.alias("offset"), line.alias("line"))
    )
    return F.transform(
        F.filter(numbered, lambda x: L.is_money_line(x["line"])),
        lambda x: F.struct(
            x["offset"].alias("offset"),
            find_all(x["line"], P.LEDGER_DATE).alias("dates"),
            find_all(x["line"], P.LEDGER_AMOUNT).alias("amounts"),
        ),
    )


def ledger_rows(window: Column, phrases: list[str] = P.STOP_PHRASES) -> Column:
    """Ledger rows of one window, sorted by invoice number as text; empty without invoices.

    Invoices are numbered by first appearance. Invoice ``j`` takes the ``j``-th date pair
    and amount of a pipe line; later lines overwrite, so the last one that reaches it wins.
    Amounts always go to Debit.
    """
    hits = F.filter(
        F.transform(
            window_data(window, phrases),
            lambda x: F.struct(
                invoice_number(x["line"]).alias("no"),
                invoice_type(x["line"]).alias("type"),
                invoice_reference(x["line"]).alias("reference"),
            ),
        ),
        lambda h: h["no"].isNotNull(),
    )

    def row(no: Column, j: Column, hits: Column, money: Column) -> Column:
        mine = F.filter(hits, lambda h: h["no"] == no)
        kind = lambda m: last(F.filter(m, lambda h: h["type"].isNotNull()))["type"]
        reference = lambda m: last(F.filter(m, lambda h: h["reference"].isNotNull()))["reference"]
        dates = last(F.filter(money, lambda m: F.size(m["dates"]) >= 2 * j + 2))["dates"]
        pair = lambda d: F.array(F.get(d, 2 * j), F.get(d, 2 * j + 1))
        amounts = last(F.filter(money, lambda m: F.size(m["amounts"]) > j))["amounts"]
        cells = F.concat(
            F.array(no),
            let(mine, lambda m: F.array(kind(m), reference(m))),
            F.coalesce(let(dates, pair), F.array(F.lit(""), F.lit(""))),
            F.array(F.get(amounts, j), F.lit("")),
        )
        return F.transform(cells, lambda c: F.coalesce(c, F.lit("")))

    def rows(hits: Column) -> Column:
        return let(
            money_lines(window),
            lambda money: F.sort_array(
                F.transform(
                    F.array_distinct(F.transform(hits, lambda h: h["no"])),
                    lambda no, j: row(no, j, hits, money),
                )
            ),
        )

    return let(hits, lambda h: F.when(F.size(h) > 0, rows(h)).otherwise(_no_rows()))


def _no_rows() -> Column:
    return F.array().cast("array<array<string>>")


def has_ledger(text: Column) -> Column:
    """Cheap page test before lines are split."""
    return L.is_ledger_header(text)


def ledger_tables(lines: Column, phrases: list[str] = P.STOP_PHRASES) -> Column:
    """``array<table>``: for each header with invoices, the fixed columns and the rows."""
    header = F.array(F.array(*[F.lit(c) for c in P.LEDGER_COLUMNS]))
    windows = let(lines, header_windows)
    rows = F.transform(windows, lambda h: ledger_rows(h["window"], phrases))
    found = F.filter(rows, lambda r: F.size(r) > 0)
    return F.transform(found, lambda r: F.concat(header, r))


def invoice_headers(pages: DataFrame) -> DataFrame:
    """One row per header line with its window of up to 50 lines."""
    found = pages.filter(has_ledger(F.col("markdown"))).select(
        *PAGE, F.explode(let(lines_of(F.col("markdown")), header_windows)).alias("h")
    )
    return found.select(*PAGE, F.col("h.line_no").alias("header_line"), "h.window")


def invoice_window(pages: DataFrame, phrases: list[str] = P.STOP_PHRASES) -> DataFrame:
    """Data lines after each header, cut at the first section stop."""
    lines = invoice_headers(pages).select(
        *PAGE, "header_line", F.explode(window_data(F.col("window"), phrases)).alias("d")
    )
    return lines.select(
        *PAGE, "header_line", (F.col("header_line") + F.col("d.offset")).alias("line_no"), "d.line"
    )


def invoice_money_lines(pages: DataFrame) -> DataFrame:
    lines = invoice_headers(pages).select(
        *PAGE, "header_line", F.explode(money_lines(F.col("window"))).alias("m")
    )
    return lines.select(
        *PAGE,
        "header_line",
        (F.col("header_line") + F.col("m.offset")).alias("line_no"),
        "m.dates",
        "m.amounts",
    )


def invoice_rows(pages: DataFrame, phrases: list[str] = P.STOP_PHRASES) -> DataFrame:
    """One row per invoice, seven text columns, numbered in invoice-number order."""
    rows = invoice_headers(pages).select(
        *PAGE,
        "header_line",
        F.posexplode(ledger_rows(F.col("window"), phrases)).alias("pos", "cells"),
    )
    names = [c.lower().replace(" ", "_") for c in P.LEDGER_COLUMNS]
    return rows.select(
        *PAGE,
        "header_line",
        (F.col("pos") + 1).alias("row_no"),
        *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)],
    )
