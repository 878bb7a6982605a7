"""Cells, rows and tables as nested arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrid.functions.lines import is_separator
from pagegrid.functions.text import let, lines_of, strip

# A maximal run of lines with two pipes or more. Anchored at line starts and possessive,
# so the scan is linear and needs no recursion however long the run is.
TABLE_RUN = r"(?md)^(?:[^|\n]*+\|[^|\n]*+\|[^\n]*+(?:\n|\z))++"


def table_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TABLE_RUN), F.lit(0))


def split_cells(line: Column) -> Column:
    """Stripped cells of a pipe row without the empty one before and after the outer pipes."""
    inner = F.regexp_replace(strip(line), r"\A\||\|\z", "")
    return F.transform(F.split(inner, r"\|"), strip)


def row_width(rows: Column) -> Column:
    return F.array_max(F.transform(rows, F.size))


def pad_rows(rows: Column) -> Column:
    """Fill ragged rows with empty cells up to the widest one."""
    return let(
        rows,
        lambda r: let(
            row_width(r),
            lambda width: F.transform(
                r, lambda row: F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))
            ),
        ),
    )


def run_rows(run: Column) -> Column:
    """Rows of one run of table lines, separators skipped, not padded."""
    return F.transform(F.filter(lines_of(run), lambda line: ~is_separator(line)), split_cells)


def pipe_tables(text: Column, pad: bool = True) -> Column:
    """All pipe tables of a page text as ``array<table>``, in order."""
    shape = (lambda run: pad_rows(run_rows(run))) if pad else run_rows
    tables = F.transform(table_runs(text), shape)
    return F.filter(tables, lambda table: F.size(table) > 0)


def find_column(headers: Column, name: Column) -> Column:
    """0-based position of a header, case ignored; null when absent."""
    position = F.array_position(F.transform(headers, F.lower), F.lower(name))
    return F.when(position > 0, position - 1)


def csv_field(value: Column) -> Column:
    """Minimal quoting."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def csv_row(row: Column) -> Column:
    """One CSV record with its line end; a lone empty field is written as ``""``."""
    text = let(
        F.array_join(F.transform(row, csv_field), ","),
        lambda t: F.when((F.size(row) == 1) & (t == ""), '""').otherwise(t),
    )
    return F.concat(text, F.lit("\r\n"))


def csv_tables(tables: Column) -> Column:
    """CSV text of all tables of a page; from the second on, each is announced by its number."""

    def one(table: Column, index: Column) -> Column:
        title = F.concat(
            F.lit("\r\n--- Table "), (index + 1).cast("string"), F.lit(" ---\r\n")
        )
        body = F.array_join(F.transform(table, csv_row), "")
        return F.concat(F.when(index > 0, title).otherwise(""), body)

    return F.array_join(F.transform(tables, one), "")


def is_meaningful(table: Column, noise: list[str]) -> Column:
    """More than one row, or a cell that is neither blank nor a known noise text."""
    ignored = [""] + list(noise)
    content = F.exists(
        table, lambda row: F.exists(row, lambda cell: ~strip(cell).isin(ignored))
    )
    return (F.size(table) > 1) | content
