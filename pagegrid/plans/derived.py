"""Input tables of the registered queries, derived row by row from the given tables.

Each has the same definition as SQL in ``oracle.py``. Pages are built from one row each, so
the derivation adds no shuffle and a page has a bounded number of lines.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrid.functions.text import div
from pagegrid.operators.evaluation import combo_sample_grid
from pagegrid.operators.ranking import explode_range
from pagegrid.operators.routing import plan_chunks
from pagegrid.operators.search import FOCUSED_SPREAD, params_with_defaults
from pagegrid.plans import page_text
from pagegrid.sources.readers import spread

# Python workers get the functions by value, whatever their import path.
cloudpickle.register_pickle_by_value(page_text)

#: Session setting: partitions of the tables that become pages, for files of a single split.
PARTITIONS = "spark.pagegrid.inputPartitions"
COMBOS = 6
FOLDS = 5
PER_FOLD = 3

# Error texts of the attempts of a request, by request id modulo 8; null is success.
ATTEMPT_LOGS = [
    [None],
    ["504 Gateway Timeout", None],
    ["504 Gateway Timeout", "HTTP 502", None],
    ["timeout", "HTTP 503", "500 internal"],
    ["file too large"],
    ["504 Gateway Timeout", "limit 600"],
    ["401 unauthorized"],
    ["HTTP 502 size 600"],
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table whose rows become pages, in as many partitions as the session asks for."""
    asked = spark.conf.get(PARTITIONS, None)
    return spread(table(spark, sf_dir, name), int(asked) if asked else None, *keys)


def seeds(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of narrow rows, each of which costs far more than its bytes.

    A split of such a file is small on disk and long to work on, and one row group is one task.
    Rows are dealt out by all their columns, so that neither null nor repeated keys meet, to as
    many partitions as shuffles have, and at least one per core, unless the session names a number.
    """
    asked = spark.conf.get(PARTITIONS, None)
    usual = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = table(spark, sf_dir, name).select(*columns)
    return spread(rows, int(asked) if asked else usual, *columns)


def _once(value: Column) -> Column:
    """Build a derived text once per row, however often it is read afterwards.

    A stored column needs no such barrier; a computed one would be copied into every filter
    and projection above it.
    """
    return F.explode(F.array(value))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one page."""
    return texts(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", F.lit(1).alias("page_no"), F.col("text").alias("markdown")
    )


def conv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a document, every turn a page."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        F.col("text").alias("markdown"),
    )


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every web page is a page, markup included."""
    return texts(spark, sf_dir, "pages", "page_id").select(
        F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), F.col("html").alias("markdown")
    )


def _text(i: Column) -> Column:
    return i.cast("string")


def _cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def _plain_amount(cents: Column) -> Column:
    return F.concat(_text(div(cents, 100)), F.lit("."), F.lpad(_text(cents % 100), 2, "0"))


def _grouped_amount(cents: Column) -> Column:
    units = div(cents, 100)
    grouped = F.when(
        units >= 1000,
        F.concat(_text(div(units, 1000)), F.lit(","), F.lpad(_text(units % 1000), 3, "0")),
    ).otherwise(_text(units))
    return F.concat(grouped, F.lit("."), F.lpad(_text(cents % 100), 2, "0"))


def _day(date: Column, days: Column) -> Column:
    return F.date_format(F.date_add(date, days.cast("int")), "MM/dd/yyyy")


def _ledger_texts() -> Callable[..., Column]:
    """The texts of ledger pages, made in Python: some thirty calls of formatting functions each."""
    page, days = page_text.ledger_page, page_text.Days()

    def texts_of(keys: pa.Array, customers: pa.Array, dates: pa.Array, cents: pa.Array) -> pa.Array:
        rows = zip(*[c.to_pylist() for c in (keys, customers, dates, cents)], strict=True)
        return pa.array([page(*row, days) for row in rows], pa.string())

    return F.arrow_udf(texts_of, "string")


def invoice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger page per order: 1 to 12 invoice lines, then a pipe table of dates and amounts.

    Some pages hold a footer phrase inside the ledger, some a second header line.
    """
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    day, cents = F.unix_date(F.col("o_orderdate").cast("date")), _cents(F.col("o_totalprice"))
    columns = "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    return seeds(spark, sf_dir, "orders", *columns).select(
        div(key, 2).alias("doc_id"),
        (key % 2 + 1).cast("int").alias("page_no"),
        _once(_ledger_texts()(key, customer, day, cents)).alias("markdown"),
    )


def scattered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order with 1 to 4 groups of values and no layout."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    date, cents = F.col("o_orderdate").cast("date"), _cents(F.col("o_totalprice"))

    def group(g: Column) -> Column:
        amount = _grouped_amount(cents + g * 1001)
        code = F.concat(F.lit("AB"), F.lpad(_text((customer + g) % 1000), 3, "0"))
        credit = F.when((key + g) % 3 == 0, F.concat(F.lit(" -"), amount))
        lines = [
            F.concat(code, F.lit(" "), _day(date, g)),
            F.concat(F.lit("paid "), amount, F.coalesce(credit, F.lit(""))),
            F.when((key + g) % 4 == 1, F.concat(F.lit("  *REF#: R-"), _text(key))),
            F.lit("**"),
        ]
        return F.concat(F.concat_ws("\n", *lines), F.repeat(F.lit("\n"), ((key + g) % 3).cast("int")))

    groups = F.transform(F.sequence(F.lit(0), (customer % 4).cast("int")), group)
    columns = "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    return seeds(spark, sf_dir, "orders", *columns).select(
        div(key, 4).alias("doc_id"),
        (key % 4 + 1).cast("int").alias("page_no"),
        _once(F.concat(F.lit("# Ledger\n"), F.array_join(groups, "\n"))).alias("markdown"),
    )


def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OCR response per document as JSON text; its paragraphs are the pages."""
    pages = F.transform(
        F.split("text", "\n\n"),
        lambda p, i: F.struct(i.alias("index"), p.alias("markdown")),
    )
    return texts(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", _once(F.to_json(F.struct(pages.alias("pages")))).alias("json")
    )


def annotated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level annotations per document: paragraphs are blocks; words ending in a dot
    come without a value."""
    word = lambda w: F.struct(F.when(~w.endswith("."), w).alias("value"))
    line = lambda l: F.struct(F.transform(F.split(l, " "), word).alias("words"))
    block = lambda b: F.struct(F.transform(F.split(b, "\n"), line).alias("lines"))
    blocks = F.transform(F.split("text", "\n\n"), block)
    return texts(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("sample_id"),
        F.array(F.struct(blocks.alias("blocks"))).alias("pages"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer; sizes hit and cross 400, 600 and 800 MB."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("doc_id"),
        F.col("c_name").alias("name"),
        (key * 37 % 1001).cast("double").alias("size_mb"),
        (key * 53 % 1001).cast("double").alias("enhanced_mb"),
        (key * 7 % 40 + 1).cast("int").alias("total_pages"),
    )


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = explode_range(docs(spark, sf_dir), F.lit(1), F.col("total_pages"), "page_no")
    key = F.col("doc_id") * 131 + F.col("page_no") * 17
    return pages.select(
        "doc_id",
        "page_no",
        (key % 40 * 1048576).alias("size_bytes"),
        ((F.col("doc_id") + F.col("page_no")) % 6 == 0).alias("flagged"),
    )


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities that hit every threshold exactly, and 1 to 8 lines of which one is wide."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.repeat(F.lit("total\n"), (customer % 8).cast("int")),
        F.concat_ws(" ", F.lit("order"), _text(key), F.lit("is"), F.col("o_orderstatus")),
    )
    return seeds(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
        key.alias("doc_id"),
        F.lit(1).alias("page_no"),
        (key % 60 / 1000.0).alias("edge_density"),
        (div(key, 60) % 12 / 1000.0).alias("line_density"),
        _once(text).alias("text"),
    )


def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result per planned chunk; about one in nine failed."""
    doc, chunk = F.col("doc_id"), F.col("chunk_no")
    plan = plan_chunks(docs(spark, sf_dir))
    pages = F.col("to_page") - F.col("from_page") + 1
    return plan.select(
        "doc_id",
        "chunk_no",
        F.when((doc * 31 + chunk * 7) % 9 == 0, "error").otherwise("ok").alias("status"),
        pages.alias("pages"),
        ((doc + chunk) % 5).alias("tables"),
        F.filter(F.sequence(F.lit(1), pages), lambda p: (p + doc) % 3 == 0).alias("table_pages"),
    )


def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per conversation turn: title and one page, some with a header inside the text."""
    turn = F.col("turn")
    inner = F.when(turn % 3 == 1, "\n## Page 99 appendix").otherwise("")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (turn + 1).cast("int").alias("chunk_no"),
        F.concat(
            F.lit("# Enhanced OCR Results\n\n## Page 1\n\n"),
            F.col("text"),
            inner,
            F.lit("\n\n---\n\n"),
        ).alias("markdown"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt logs ``(request_id, attempt, error)``, one request per order."""
    log = lambda errors: F.array(*[F.lit(e).cast("string") for e in errors])
    logs = F.array(*[log(errors) for errors in ATTEMPT_LOGS])
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.posexplode(F.get(logs, (key % 8).cast("int"))).alias("attempt", "error"),
    )


def eval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two sources, some without text or image."""
    key = F.col("item_id")
    truth = F.when(key % 13 == 5, " \t ").when(key % 17 != 3, F.col("text"))
    return table(spark, sf_dir, "benchmark").select(
        key.alias("sample_id"),
        F.when(key % 2 == 0, "even").otherwise("odd").alias("source"),
        truth.alias("ground_truth"),
        (key % 10 != 9).alias("has_image"),
    )


def _degraded(text: Column, combo: Column, key: Column) -> Column:
    """Predicted text of a combination: 0 and 1 tie, 5 always fails, 4 fails on even ids."""
    swapped = F.translate(text, "aeiou", "eioua")
    return (
        F.when(combo <= 1, swapped)
        .when(combo == 2, F.translate(text, ".,", ""))
        .when(combo == 3, F.replace(text, F.lit("the "), F.lit("")))
        .when((combo == 4) & (key % 2 == 1), F.concat(text, F.lit(" end")))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, combo = F.col("item_id"), F.col("combo_id")
    return combo_sample_grid(table(spark, sf_dir, "benchmark"), COMBOS).select(
        "combo_id",
        key.alias("sample_id"),
        _degraded(F.col("text"), combo, key).alias("predicted"),
        F.lit(0.95).alias("confidence"),
        (key % 7 + combo * 0.5).alias("seconds"),
    )


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth and prediction of every benchmark item and combination but the failing one."""
    key, combo = F.col("item_id"), F.col("combo_id")
    return combo_sample_grid(texts(spark, sf_dir, "benchmark", "item_id"), COMBOS - 1).select(
        "combo_id",
        key.alias("sample_id"),
        F.col("text").alias("truth"),
        F.coalesce(_degraded(F.col("text"), combo, key), F.lit("")).alias("predicted"),
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn and a damaged copy of it."""
    return seeds(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        "conv_id",
        "turn",
        F.col("text").alias("truth"),
        F.translate(F.replace("text", F.lit("en"), F.lit("")), "aeioué", "eiouae").alias(
            "predicted"
        ),
    )


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline per part; some parameters are missing."""
    size = F.col("p_size")
    return seeds(spark, sf_dir, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").alias("set_id"),
        F.when(size % 5 != 0, 2.0 + size / 50.0).alias("table_contrast_factor"),
        F.when(size % 3 != 0, 0.5 + size / 200.0).alias("table_brightness_factor"),
        F.when(size % 7 != 0, 1.5 + size / 40.0).alias("table_sharpness_factor"),
        F.when(size % 2 == 0, F.lit(9.0)).alias("bilateral_d"),
    )


def mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One baseline: the means of all of them."""
    filled = params_with_defaults(baselines(spark, sf_dir))
    means = filled.agg(*[F.avg(k).alias(k) for k in FOCUSED_SPREAD])
    return means.withColumn("set_id", F.lit(0))
