"""All extraction methods together, and what is derived from their result.

The methods are columns of built-in functions, so that callers can add their own. Where only those
given here are asked for, a page is read once in plain Python by Arrow batches (``page_scan``), with
the same result and several times as fast: built-in functions interpret every lambda of every line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.functions import cells as C
from pagegrid.functions import page_scan
from pagegrid.functions import patterns as P
from pagegrid.functions.text import let, lines_of
from pagegrid.operators.ledgers import has_ledger, ledger_tables
from pagegrid.operators.pages import PAGE
from pagegrid.operators.scattered import scattered_table

_TABLES = "array<struct<method:string,rows:array<array<string>>>>"


def _tagged(method: str, tables: Column) -> Column:
    return F.transform(
        tables, lambda t: F.struct(F.lit(method).alias("method"), t.alias("rows"))
    )


def _none() -> Column:
    return F.array().cast(_TABLES)


def pipe_method(text: Column) -> Column:
    found = _tagged("markdown", C.pipe_tables(text))
    return F.when(text.contains("|"), found).otherwise(_none())


def ledger_method(text: Column) -> Column:
    found = _tagged("invoice", ledger_tables(lines_of(text)))
    return F.when(has_ledger(text), found).otherwise(_none())


def scattered_method(text: Column) -> Column:
    table = let(
        scattered_table(lines_of(text)),
        lambda t: F.when(t.isNotNull(), _tagged("scattered", F.array(t))).otherwise(_none()),
    )
    return F.when(text.rlike(r"[\p{Nd}*]"), table).otherwise(_none())


METHODS = (pipe_method, ledger_method, scattered_method)

_SCANNED = {pipe_method: "markdown", ledger_method: "invoice", scattered_method: "scattered"}
#: Pages whose tables a task holds as Python values at a time.
PAGES = 256

# Python workers get the functions by value, whatever their import path.
cloudpickle.register_pickle_by_value(page_scan)


def _by_pages(values_of: Callable[[list], pa.Array], kind: str) -> Callable[[Column], Column]:
    """Column function that turns texts into values, a few pages at a time."""
    most = PAGES

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for start in range(0, len(texts), most):
                yield values_of(texts.slice(start, most).to_pylist())

    return F.arrow_udf(run, kind)


def _scan(text: Column, methods, noise: list[str]) -> Column:
    names, ignored = tuple(_SCANNED[m] for m in methods), frozenset(noise)
    tables_of, nested = page_scan.tables_of, page_scan.nested_tables
    found = _by_pages(lambda pages: nested([tables_of(page, names, ignored) for page in pages]), _TABLES)
    return found(text)


def _scan_csv(text: Column) -> Column:
    """CSV text of the tables of a page; null without tables."""
    names, ignored = tuple(_SCANNED.values()), frozenset(P.NOISE_CELLS)
    tables_of, csv_text = page_scan.tables_of, page_scan.csv_text

    def text_of(page: str | None) -> str | None:
        found = tables_of(page, names, ignored)
        return csv_text([rows for _, rows in found]) if found else None

    return _by_pages(lambda pages: pa.array([text_of(page) for page in pages], pa.string()), "string")(text)


def page_tables(text: Column, methods=METHODS, noise: list[str] = P.NOISE_CELLS) -> Column:
    """Meaningful tables of one page text, in method order."""
    if all(method in _SCANNED for method in methods):
        return _scan(text, methods, noise)
    found = F.concat(*[method(text) for method in methods])
    return F.filter(found, lambda t: C.is_meaningful(t["rows"], noise))


def _keys(pages: DataFrame) -> list[str]:
    """The key of a page, with the document's name where pages carry one."""
    return [*PAGE, "name"] if "name" in pages.columns else [*PAGE]


def _stem(pages: DataFrame) -> Column:
    return F.col("name") if "name" in pages.columns else F.col("doc_id").cast("string")


def page_results(pages: DataFrame, methods=METHODS, noise=P.NOISE_CELLS) -> DataFrame:
    """``(doc_id, page_no, tables)``, and ``name`` if pages have it; every page kept. Map-only.

    Write this once when several results are wanted: the operators below accept it in
    place of pages and then extract nothing again.
    """
    found = page_tables(F.col("markdown"), methods, noise)
    return pages.select(*_keys(pages), F.explode(F.array(found)).alias("tables"))


def _results(pages: DataFrame, *settings) -> DataFrame:
    return pages if "tables" in pages.columns else page_results(pages, *settings)


def extract_page_tables(pages: DataFrame, methods=METHODS, noise=P.NOISE_CELLS) -> DataFrame:
    """One row per table: ``(doc_id, page_no, table_no, method, rows)``. Map-only."""
    tables = _results(pages, methods, noise).select(
        *PAGE, F.posexplode("tables").alias("pos", "t")
    )
    return tables.select(*PAGE, (F.col("pos") + 1).alias("table_no"), "t.method", "t.rows")


def table_rows(tables: DataFrame) -> DataFrame:
    """Explode the ``rows`` of each table; other columns are kept."""
    keep = [c for c in tables.columns if c != "rows"]
    rows = tables.select(*keep, F.posexplode("rows").alias("pos", "cells"))
    return rows.select(*keep, (F.col("pos") + 1).alias("row_no"), "cells")


def table_cells(rows: DataFrame) -> DataFrame:
    """Explode the ``cells`` of each row; other columns are kept."""
    keep = [c for c in rows.columns if c != "cells"]
    cells = rows.select(*keep, F.posexplode("cells").alias("pos", "value"))
    return cells.select(*keep, (F.col("pos") + 1).alias("col_no"), "value")


def extract_tables(pages: DataFrame, methods=METHODS, noise=P.NOISE_CELLS) -> DataFrame:
    """One row per table row, numbered across methods within the page. Map-only."""
    return table_rows(extract_page_tables(pages, methods, noise))


def _pipe_tables(pages: DataFrame, pad: bool) -> DataFrame:
    tables = pages.filter(F.col("markdown").contains("|")).select(
        *PAGE, F.posexplode(C.pipe_tables(F.col("markdown"), pad)).alias("pos", "rows")
    )
    return tables.select(*PAGE, (F.col("pos") + 1).alias("table_no"), "rows")


def markdown_tables(pages: DataFrame) -> DataFrame:
    """Rows of the pipe tables as written, ragged."""
    return table_rows(_pipe_tables(pages, pad=False))


def padded_tables(pages: DataFrame) -> DataFrame:
    """Rows of the pipe tables, each padded to its table's width."""
    return table_rows(_pipe_tables(pages, pad=True))


def meaningful_tables(tables: DataFrame, noise: list[str] = P.NOISE_CELLS) -> DataFrame:
    """Keep tables ``(.., rows)`` with content or more than one row."""
    return tables.filter(C.is_meaningful(F.col("rows"), noise))


def csv_name(name: Column, page_no: Column) -> Column:
    return F.format_string("%s_page_%d.csv", name, page_no)


def page_no_from_name(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"_page_(\p{Nd}+)\.csv\z", 1).try_cast("bigint")


def page_csv(pages: DataFrame, name: Column | None = None) -> DataFrame:
    """One CSV text per page with tables: ``(doc_id, page_no, file_name, csv_text)``. Map-only.

    Files are called after ``name``, an expression over pages; without it after their column
    ``name`` if they have one, else after the document's id.
    """
    named = pages if name is None else pages.withColumn("name", name)
    if "tables" in named.columns:
        found = named.filter(F.size("tables") > 0)
        text = C.csv_tables(F.transform("tables", lambda t: t["rows"]))
    else:
        texts = F.explode(F.array(_scan_csv(F.col("markdown"))))
        found = named.select(*_keys(named), texts.alias("csv_text")).filter("csv_text IS NOT NULL")
        text = F.col("csv_text")
    return found.select(
        *PAGE,
        csv_name(_stem(found), F.col("page_no")).alias("file_name"),
        text.alias("csv_text"),
    )


def _table_counts(pages: DataFrame) -> DataFrame:
    found = _results(pages)
    return found.select(*_keys(found), F.size("tables").alias("n_tables"))


def run_summary(pages: DataFrame) -> DataFrame:
    """Pages, tables and pages with tables of each document; combined map-side.

    A document without pages (a null ``page_no``) counts none and stays.
    """
    counts = _table_counts(pages)
    return counts.groupBy(*[c for c in ("doc_id", "name") if c in counts.columns]).agg(
        F.count("page_no").alias("pages_processed"),
        F.sum(F.col("n_tables").cast("bigint")).alias("tables_found"),
        F.count_if(F.col("n_tables") > 0).alias("pages_with_tables"),
        F.count_if(F.col("n_tables") > 0).alias("csv_files"),
        F.lit(1).cast("bigint").alias("chunks_processed"),
    )


def run_table_pages(pages: DataFrame) -> DataFrame:
    """The list of pages with tables, in long form so that no document is gathered."""
    counts = _table_counts(pages).filter(F.col("n_tables") > 0)
    return counts.withColumn("file_name", csv_name(_stem(counts), F.col("page_no")))
