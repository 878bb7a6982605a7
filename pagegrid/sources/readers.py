"""Read documents, OCR responses and ground truth into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrid.functions.text import size_mb, strip

# Only what is read later is parsed; images and coordinates in the files are skipped unless
# the caller names them among the page fields.
PAGE_FIELDS = "index:int,markdown:string"
RESPONSE = f"pages array<struct<{PAGE_FIELDS}>>"
CORRUPT = "_corrupt_record"
GROUND_TRUTH = (
    "pages array<struct<blocks:array<struct<lines:array<struct<words:array<"
    "struct<value:string>>>>>>>>"
)


def spread(rows: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Deal rows out to as many partitions as the caller names; ``None`` leaves the scan as is.

    Text work is heavy per row, so a file of one split keeps one core busy. The caller knows
    its files; nothing here looks at the data.
    """
    return rows if partitions is None else rows.repartition(partitions, *keys)


def _file_key() -> Column:
    """A 128-bit hash of the path, so that a billion files keep distinct keys."""
    return F.md5("_metadata.file_path")


def stem(path: Column, suffix: str = r"\.[^.]*\z") -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), suffix, "")


def scan_docs(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Inventory of files: ``(doc_id, name, size_bytes, size_mb)``; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    return files.select(
        F.md5("path").alias("doc_id"),
        stem(F.col("path")).alias("name"),
        F.col("length").alias("size_bytes"),
        size_mb(F.col("length")).alias("size_mb"),
    )


def response_pages(
    responses: DataFrame, keys: list[str], records: bool = False, keep_empty: bool = False
) -> DataFrame:
    """Pages of OCR responses ``(.., pages)``, numbered by position from 1.

    ``records`` adds each page's whole record as ``record``. With ``keep_empty`` a response
    without pages gives one row with a null ``page_no``, which no page operator extracts from.
    """
    each = F.posexplode_outer("pages") if keep_empty else F.posexplode("pages")
    pages = responses.select(*keys, each.alias("pos", "page"))
    text = F.when(F.col("pos").isNotNull(), F.coalesce(F.col("page.markdown"), F.lit("")))
    return pages.select(
        *keys,
        (F.col("pos") + 1).alias("page_no"),
        (text if keep_empty else F.coalesce(F.col("page.markdown"), F.lit(""))).alias("markdown"),
        *([F.col("page").alias("record")] if records else []),
    )


def parse_response(json: Column) -> Column:
    return F.from_json(json, RESPONSE)["pages"]


def read_responses(
    spark: SparkSession,
    path: str,
    lines: bool = False,
    id_field: str | None = None,
    page_fields: str = PAGE_FIELDS,
) -> DataFrame:
    """One row per OCR response: ``(doc_id, name, is_readable, pages)``.

    One JSON file per document, or with ``lines=True`` one response per line, which keeps
    files splittable. ``doc_id`` is the string in ``id_field`` if the caller names one, which is
    then the ``name`` too. Otherwise it is a hash of the path and, with ``lines``, of the
    record's position: its split and its place there, so it holds for one layout of the files and
    one reading; name a field where keys must outlive that. A response that is not JSON, or
    has no value in ``id_field``, keeps a row under the hashed key; its pages are null.
    """
    ids = f", `{id_field}` string" if id_field else ""
    files = (
        spark.read.schema(f"pages array<struct<{page_fields}>>{ids}, {CORRUPT} string")
        .option("multiLine", str(not lines).lower())
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    key, name = _file_key(), stem(F.col("_metadata.file_path"))
    if lines:
        place = F.concat_ws(":", "_metadata.file_path", F.monotonically_increasing_id())
        key, name = F.md5(place), F.concat_ws("_", name, F.md5(place))
    if id_field:
        key, name = F.coalesce(F.col(id_field), key), F.coalesce(F.col(id_field), name)
    return files.select(
        key.alias("doc_id"), name.alias("name"), F.isnull(CORRUPT).alias("is_readable"), "pages"
    )


def read_ocr_json(
    spark: SparkSession,
    path: str,
    lines: bool = False,
    id_field: str | None = None,
    page_fields: str = PAGE_FIELDS,
    records: bool = False,
) -> DataFrame:
    """``(doc_id, name, is_readable, page_no, markdown)``, a row per page of ``read_responses``.

    Responses without pages, unreadable ones included, keep one row with a null ``page_no``.
    """
    responses = read_responses(spark, path, lines, id_field, page_fields)
    return response_pages(responses, ["doc_id", "name", "is_readable"], records, keep_empty=True)


def ground_truth_text(pages: Column) -> Column:
    """Words joined without separator, a blank after each line, a newline after each block."""
    word_values = lambda line: F.array_join(
        F.transform(
            F.coalesce(line["words"], F.array().cast("array<struct<value:string>>")),
            lambda w: w["value"],
        ),
        "",
    )
    line_text = lambda line: F.concat(word_values(line), F.lit(" "))
    block_text = lambda block: F.concat(
        F.coalesce(F.array_join(F.transform(block["lines"], line_text), ""), F.lit("")),
        F.lit("\n"),
    )
    page_text = lambda page: F.coalesce(
        F.array_join(F.transform(page["blocks"], block_text), ""), F.lit("")
    )
    return strip(F.coalesce(F.array_join(F.transform(pages, page_text), ""), F.lit("")))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, name, ground_truth)`` from word-level annotations, gzip or plain JSON.

    ``name`` is the file name without ``.json`` or ``.json.gz``, as ``read_ocr_json`` gives it,
    so that annotations join the OCR text of the same document.
    """
    files = spark.read.schema(GROUND_TRUTH).option("multiLine", "true").json(path)
    return files.select(
        _file_key().alias("sample_id"),
        stem(F.col("_metadata.file_path"), r"(\.json)?(\.gz)?\z").alias("name"),
        ground_truth_text(F.col("pages")).alias("ground_truth"),
    )
