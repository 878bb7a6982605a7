"""OCR responses of any size, read by byte ranges of their files.

A file holds one response or many, one after the other, in lines or not. A byte range cannot
tell by itself whether it starts inside a string, how deep it lies and of which response, so
three passes over the bytes settle that, each by as many tasks as there are ranges:

1. Each range counts its unescaped quotes, and how much deeper its braces lead if it starts
   outside or inside a string. Sums over the ranges before give each range its state.
2. With it, each range finds the responses, lists and pages that start in it. The last ones of
   the ranges before say which response and list a range goes on with, and with which page.
3. Each range gives the pages that start in it, and reads on to the end of the last one.

Between passes a row per range is shuffled, never text. Results do not depend on the ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegrid.sources.readers import CORRUPT, PAGE_FIELDS, stem

SPLIT_BYTES = 32 << 20
BLOCK = 1 << 20
QUOTE, SLASH = b'"\\'
RANGE = "path string, length bigint, start bigint, stop bigint"
SURVEY = f"{RANGE}, flips int, outside bigint, inside bigint"
STARTS = (
    f"{RANGE}, in_string boolean, depth bigint, lead bigint, mid bigint, tail bigint, "
    "opening bigint, record bigint, in_pages boolean"
)
PAGES = "path string, record bigint, is_first boolean, page_no bigint, is_whole boolean, json string"


def byte_ranges(
    spark: SparkSession, path: str, glob: str = "*.json", split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """``(path, length, start, stop)`` for every range of every file; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
        .where("length > 0")
    )
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    return ranges.withColumn("stop", F.least(F.col("start") + split_bytes, "length"))


class Bytes:
    """Bytes of one file by their places."""

    def __init__(self, path: str) -> None:
        uri = re.sub(r"\Afile:/+", "file:///", path)
        files, name = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(name)
        self.length = self.file.size()

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def at(self, start: int, stop: int) -> bytes:
        return self.file.read_at(max(0, min(stop, self.length) - start), start)

    def blocks(self, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        for at in range(start, stop, BLOCK):
            yield at, self.at(at, min(at + BLOCK, stop))

    def after_slashes(self, place: int) -> bool:
        """Whether an odd number of backslashes stands directly before ``place``."""
        run, step = 0, 64
        while True:
            piece = self.at(max(0, place - run - step), place - run)
            kept = len(piece.rstrip(b"\\"))
            run += len(piece) - kept
            if kept or not piece:
                return run % 2 == 1
            step *= 2

    def opens_pages(self, place: int) -> bool:
        """Whether the bracket at ``place`` is the value of a key ``pages``."""
        step = 64
        while True:
            start = max(0, place - step)
            before = self.at(start, place).rstrip()
            if before.endswith(b":"):
                before = before[:-1].rstrip()
                if len(before) >= 8 or not start:
                    return before.endswith(b'"pages"') and not before.endswith(b'\\"pages"')
            elif before or not start:
                return False
            step *= 2


def braces(block: bytes, odd: bool):
    """Places of braces and brackets, their bytes, and the quotes' parity before each.

    Then the parity of all quotes and whether an odd run of backslashes ends the block; ``odd``
    says so of what stands before it. Escaped quotes are none.
    """
    data = np.frombuffer(block, np.uint8)
    quotes = np.flatnonzero(data == QUOTE)
    ends_odd = False
    if odd or b"\\" in block:
        # The last byte before each place that is no backslash.
        last = np.maximum.accumulate(np.where(data != SLASH, np.arange(len(data)), -1 - odd))
        run = quotes - 1 - np.append(-1 - odd, last)[quotes]
        quotes = quotes[run % 2 == 0]
        ends_odd = bool((len(data) - 1 - last[-1]) % 2)
    places = np.flatnonzero(np.isin(data, np.frombuffer(b"{}[]", np.uint8)))
    return places, data[places], np.searchsorted(quotes, places) % 2, len(quotes) % 2, ends_odd


def opens(codes: np.ndarray) -> np.ndarray:
    return (codes == ord("{")) | (codes == ord("["))


def survey(source: Bytes, start: int, stop: int) -> tuple[int, int, int]:
    """Parity of a range's quotes, and the change of depth if it starts outside or inside a string."""
    flips, change, odd = 0, [0, 0], source.after_slashes(start)
    for _, block in source.blocks(start, stop):
        _, codes, parity, more, odd = braces(block, odd)
        step = np.where(opens(codes), 1, -1)
        for inside in (0, 1):
            change[inside] += int(step[(parity + flips) % 2 == inside].sum())
        flips = (flips + more) % 2
    return flips, *change


def events(source: Bytes, start: int, in_string: bool, depth: int) -> Iterator[tuple[int, str]]:
    """What starts or ends from ``start`` to the end of the file, in order.

    ``record`` and ``record_end``, ``pages`` or ``other`` for what opens inside a record,
    ``page`` for any object directly in that, ``page_end`` where it ends.
    """
    odd, flips = source.after_slashes(start), int(in_string)
    for at, block in source.blocks(start, source.length):
        places, codes, parity, more, odd = braces(block, odd)
        outside = (parity + flips) % 2 == 0
        places, codes = places[outside], codes[outside]
        opening = opens(codes)
        step = np.where(opening, 1, -1)
        ahead = depth + np.cumsum(step) - step
        told = np.where(opening, ahead <= 2, (ahead == 1) | (ahead == 3))
        for place, code, level in zip(
            (places[told] + at).tolist(), codes[told].tolist(), ahead[told].tolist(), strict=True
        ):
            if code == ord("{") and level in (0, 2):
                yield place, "record" if level == 0 else "page"
            elif code in b"{[" and level == 1:
                yield place, "pages" if code == ord("[") and source.opens_pages(place) else "other"
            elif code == ord("}"):
                yield place, "record_end" if level == 1 else "page_end"
        depth += int(step.sum())
        flips = (flips + more) % 2
        yield at + len(block) - 1, "block_end"


def starts(source: Bytes, start: int, stop: int, in_string: bool, depth: int):
    """What a range says to those behind it.

    ``lead`` objects that are pages if the list before the range is ``pages``, ``mid`` pages
    of the response before, ``tail`` pages of the last response that starts here, places of
    the first and the last such response, and whether the last list is ``pages`` (null: as
    before the range).
    """
    lead, counts, opening, record, in_pages = 0, [0, 0], None, None, None
    for place, kind in events(source, start, in_string, depth):
        if place >= stop:
            break
        if kind == "record":
            opening = place if opening is None else opening
            record, in_pages, counts[1] = place, False, 0
        elif kind in ("pages", "other"):
            in_pages = kind == "pages"
        elif kind == "page" and in_pages is None:
            lead += 1
        elif kind == "page" and in_pages:
            counts[record is not None] += 1
        if place == stop - 1:
            break
    return lead, *counts, opening, record, in_pages


def pages_of(source: Bytes, row: dict) -> Iterator[tuple]:
    """(record, is_first, page_no, is_whole, json) of the pages and empty responses of a range."""
    record, in_pages, page_no = row["carried"], row["in_pages"], row["base"]
    first = row["first"]
    # A response that has started here and shown no page yet; the start of an open page.
    bare, page, stop = False, None, row["stop"]
    for place, kind in events(source, row["start"], row["in_string"], row["depth"]):
        if place >= stop and page is None and not bare:
            return
        if kind == "record":
            first = place if first is None else first
            record, in_pages, page_no, bare = place, False, 0, True
        elif kind in ("pages", "other"):
            in_pages = kind == "pages"
        elif kind == "page" and in_pages:
            bare, page_no = False, page_no + 1
            page = place if place < stop else None
        elif kind == "page_end" and page is not None:
            text = source.at(page, place + 1).decode("utf-8", "replace")
            yield record, record == first, page_no, True, text
            page = None
        elif kind == "record_end" and bare:
            bare = False
            yield record, record == first, None, True, None
    if page is not None or bare:
        # Cut off by the end of the file.
        yield record, record == first, None, False, None


def _mapped(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work(source, row)`` gives tuples for each range, in the order of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    kind = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with Bytes(row["path"]) as source:
                    found, size = [], 0
                    for values in work(source, row):
                        found.append(dict(zip(names, values, strict=True)))
                        size += len(found[-1].get("json") or "")
                        if size > BLOCK:
                            yield pa.RecordBatch.from_pylist(found, kind)
                            found, size = [], 0
                    yield pa.RecordBatch.from_pylist(found, kind)

    return rows.mapInArrow(run, schema)


def _range(row: dict) -> tuple:
    return row["path"], row["length"], row["start"], row["stop"]


def _survey(source: Bytes, row: dict) -> Iterator[tuple]:
    yield (*_range(row), *survey(source, row["start"], row["stop"]))


def _starts(source: Bytes, row: dict) -> Iterator[tuple]:
    state = row["in_string"], row["depth"]
    yield (*_range(row), *state, *starts(source, row["start"], row["stop"], *state))


def _pages(source: Bytes, row: dict) -> Iterator[tuple]:
    for values in pages_of(source, row):
        yield (row["path"], *values)


def read_split_pages(
    spark: SparkSession,
    path: str,
    glob: str = "*.json",
    split_bytes: int = SPLIT_BYTES,
    page_fields: str = PAGE_FIELDS,
    tasks: int | None = None,
) -> DataFrame:
    """``(doc_id, name, is_readable, page_no, markdown, record)``, a row per page.

    ``doc_id`` hashes the path and the byte at which the response starts, so it is the same
    for any split size and reading. ``name`` is the file's, with that byte behind it for all
    but a file's first response. Pages are numbered by position from 1. A response without
    pages has one row with null ``page_no``. What the end of a file cuts off, or a page that is
    no JSON, has a row with ``is_readable`` false and null ``page_no``; whole pages before stay.
    Files without a response give no rows. Compressed files cannot be read by ranges.
    ``tasks`` is the number of tasks per pass, the shuffle partitions unless the caller says more.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(tasks, "path", "start")
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sum_ahead = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    last_ahead = lambda c: F.last(c, ignorenulls=True).over(ahead)

    found = _mapped(dealt(byte_ranges(spark, path, glob, split_bytes)), SURVEY, _survey)
    found = found.withColumn("in_string", sum_ahead("flips") % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    found = found.withColumn("change", change).withColumn("depth", sum_ahead("change"))

    told = _mapped(dealt(found), STARTS, _starts)
    told = told.withColumns(
        {
            "first": F.min("opening").over(ahead),
            "carried": last_ahead("record"),
            "known": F.coalesce(last_ahead("in_pages"), F.lit(False)),
        }
    )
    own = F.when(F.col("known"), F.col("lead")).otherwise(0) + F.col("mid")
    told = told.withColumn("n", F.when(F.isnotnull("record"), F.col("tail")).otherwise(own))
    told = told.withColumn("total", sum_ahead("n"))
    # Pages before the range in which the response started.
    told = told.withColumn("mark", F.when(F.isnotnull("record"), F.col("total")))
    base = F.col("total") - F.coalesce(last_ahead("mark"), F.lit(0))
    state = told.withColumn("base", base).drop("in_pages").withColumnRenamed("known", "in_pages")

    rows = _mapped(dealt(state), PAGES, _pages)
    kind = f"struct<{page_fields},{CORRUPT}:string>"
    parsed = F.from_json("json", kind, {"columnNameOfCorruptRecord": CORRUPT})
    rows = rows.withColumn("parsed", parsed)
    readable = F.col("is_whole") & F.isnull(f"parsed.{CORRUPT}")
    place = F.when(F.col("is_first"), F.lit("")).otherwise(F.concat(F.lit("_"), F.col("record")))
    page_no = F.when(readable, F.col("page_no"))
    return rows.select(
        F.md5(F.concat_ws(":", "path", "record")).alias("doc_id"),
        F.concat(stem(F.col("path")), place).alias("name"),
        readable.alias("is_readable"),
        page_no.alias("page_no"),
        F.when(F.isnotnull(page_no), F.coalesce("parsed.markdown", F.lit(""))).alias("markdown"),
        F.when(F.isnotnull(page_no), F.col("parsed").dropFields(CORRUPT)).alias("record"),
    )
