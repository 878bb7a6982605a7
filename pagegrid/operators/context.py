"""Look for values that belong to a table row elsewhere on its page.

Rows and lines of a page meet inside the page's task, in an index of the page's lines
(``page_index``), so only matches are ever emitted and a page costs its length plus its matches, not
rows times lines. Built-in functions have no keyed look-up inside an array, so this step runs by Arrow
batches in Python, which also reads the rows and the tokens it needs out of the text (``page_scan``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.functions import cells as C
from pagegrid.functions import page_index, page_scan
from pagegrid.functions.lines import looks_like_tabular
from pagegrid.functions.text import strip, words
from pagegrid.operators.pages import PAGE


SIGNATURE_PARTS = 3


def row_signature(cells: Column) -> Column:
    """The first cells longer than three characters."""
    return F.slice(
        F.filter(F.transform(cells, strip), lambda c: F.length(c) > 3), 1, SIGNATURE_PARTS
    )


def cell_tokens(line: Column) -> Column:
    """Cell-like tokens of a line: its words and its parts between tabs, pipes and commas."""

    def split_on(separator: str, pattern: str) -> Column:
        parts = F.transform(F.split(line, pattern), strip)
        return F.when(line.contains(separator), parts).otherwise(F.array().cast("array<string>"))

    tokens = F.concat(
        words(line), split_on("\t", "\t"), split_on("|", r"\|"), split_on(",", ",")
    )
    return F.filter(tokens, lambda t: (t != "") & looks_like_tabular(t))


#: Matches after which a task hands a batch on.
BATCH = 50_000
#: Pages whose texts and matches a task holds as Python values at a time.
PAGES = 256
#: From the lines related to a row, the row's own line and cells, the page's lines and their tokens:
#: the values to emit.
Match = Callable[[list[int], int, list[str], list[str], page_scan.LineTokens], list[tuple]]

# Python workers get these by value, whatever their import path.
cloudpickle.register_pickle_by_value(page_index)
cloudpickle.register_pickle_by_value(page_scan)


def _matcher(match: Match, keys: list[str], kinds: list[pa.DataType], names: list[str]):
    index_of, most, size = page_index.LineIndex, PAGES, BATCH
    tables_of, signature_of, tokens_of = page_scan.numbered_tables, page_scan.signature, page_scan.LineTokens

    def matches(text: str) -> Iterator[tuple]:
        lines = text.split("\n")
        tables = tables_of(lines)
        if not tables:
            return
        # Parts of a signature are not blank, so no blank line is related to a row.
        signatures = [[signature_of(cells) for cells in table] for _, table in tables]
        index = index_of(lines, [part for table in signatures for x in table for part in x])
        tokens = tokens_of(lines)
        for number, ((places, table), asked) in enumerate(zip(tables, signatures, strict=True), 1):
            for row, signature in enumerate(asked):
                if signature:
                    for values in match(index.related(signature), places[row], table[row], lines, tokens):
                        yield number, row + 1, *values

    def batch_of(batch: pa.RecordBatch, places: list[int], rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array(places, pa.int64())
        values = zip(*rows, strict=True) if rows else [()] * len(kinds)
        columns = [pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                places: list[int] = []
                rows: list[tuple] = []
                for page, text in enumerate(part.column("markdown").to_pylist()):
                    for row in matches(text):
                        places.append(page)
                        rows.append(row)
                        if len(rows) >= size:
                            yield batch_of(part, places, rows)
                            places, rows = [], []
                if rows:
                    yield batch_of(part, places, rows)

    return run


def _each_row(pages: DataFrame, match: Match, out: str, *kinds: pa.DataType) -> DataFrame:
    """``(.., table_no, row_no, *out)`` for what ``match`` gives of every pipe-table row.

    A row without a signature is related to no line.
    """
    out = f"table_no int, row_no int, {out}"
    names = [*PAGE, *(x.split()[0] for x in out.split(", "))]
    run = _matcher(match, PAGE, [pa.int32(), pa.int32(), *kinds], names)
    keys = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in PAGE)
    with_tables = pages.filter(F.col("markdown").contains("|")).select(*PAGE, "markdown")
    return with_tables.mapInArrow(run, f"{keys}, {out}")


ROW = [*PAGE, "table_no", "row_no"]


def row_signatures(pages: DataFrame) -> DataFrame:
    tables = pages.filter(F.col("markdown").contains("|")).select(
        *PAGE, F.posexplode(C.pipe_tables(F.col("markdown"))).alias("pos", "rows")
    )
    rows = tables.select(
        *PAGE, (F.col("pos") + 1).alias("table_no"), F.posexplode("rows").alias("row_pos", "cells")
    )
    return rows.select(
        *PAGE,
        "table_no",
        (F.col("row_pos") + 1).alias("row_no"),
        row_signature(F.col("cells")).alias("signature"),
    )


def related_lines(pages: DataFrame) -> DataFrame:
    """Lines of the page that share more than half of a row's signature."""

    def match(found, own, cells, lines, tokens):
        text = " ".join(cells)
        return [(text, k, lines[k]) for k in found]

    out = "row_text string, line_no int, line string"
    return _each_row(pages, match, out, pa.string(), pa.int32(), pa.string())


# A row's own line is always related to it and lacks nothing: a cell-like token holds neither a
# blank nor a pipe, so it lies inside one cell.


def candidates(pages: DataFrame) -> DataFrame:
    """Cell-like tokens of each related line that do not occur in the row text."""
    substrings = page_index.Substrings

    def match(found, own, cells, lines, tokens):
        if found == [own]:
            return []
        row = substrings(" ".join(cells))
        return [(k, token) for k in found if k != own for token in row.without(tokens[k])]

    return _each_row(pages, match, "line_no int, candidate string", pa.int32(), pa.string())


def missing_row_data(pages: DataFrame) -> DataFrame:
    """Distinct candidates of each row over its related lines, in order of appearance."""
    substrings = page_index.Substrings

    def match(found, own, cells, lines, tokens):
        if found == [own]:
            return []
        every = [token for k in found if k != own for token in tokens[k]]
        missing = substrings(" ".join(cells)).without(dict.fromkeys(every))
        return [(missing,)] if missing else []

    return _each_row(pages, match, "missing array<string>", pa.list_(pa.string()))
