"""Which documents are split, into which page chunks, and how chunk results come together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrid.functions.lines import attempt_class
from pagegrid.functions.text import div
from pagegrid.operators.ranking import block_running_sum, explode_range

# Size limits in MB, chunk divisors, retry schedule, resolution tiers.
ORIGINAL_LIMIT_MB = 400
ENHANCED_LIMIT_MB = 600
MAX_ATTEMPTS = 3
BASE_DELAY = 10
PROJECTED_LIMIT_MB = 500
HIGH_TIER = (4.5, 500)
LOW_TIER = (2.5, 250)
DOCUMENT_TITLE = "# Enhanced OCR Results"

MB = 1048576
PAGE_HEADER = r"(?md)^## Page \p{Nd}+"


def route_docs(docs: DataFrame) -> DataFrame:
    """``chunked`` above a size limit of the original or the enhanced file, else ``single``."""
    route = (
        F.when(F.col("size_mb") > ORIGINAL_LIMIT_MB, "chunked")
        .when(F.col("enhanced_mb") > ENHANCED_LIMIT_MB, "chunked")
        .otherwise("single")
    )
    return docs.select("doc_id", "name", "size_mb", "enhanced_mb", route.alias("route"))


def pages_per_chunk(size_mb: Column, total_pages: Column) -> Column:
    divisor = F.when(size_mb > 800, 6).when(size_mb > 400, 4).otherwise(2)
    return F.greatest(F.lit(1), div(total_pages, divisor).cast("int"))


def plan_chunks(docs: DataFrame) -> DataFrame:
    """Page ranges (1-based, inclusive) of each document's chunks.

    The remainder makes extra chunks, so a document has at most 11.
    """
    starts = F.sequence(F.lit(0), F.col("total_pages") - 1, F.col("ppc"))
    chunks = (
        docs.filter("total_pages > 0")
        .withColumn("ppc", pages_per_chunk(F.col("size_mb"), F.col("total_pages")))
        .select("doc_id", "total_pages", "ppc", F.posexplode(starts).alias("pos", "start"))
    )
    return chunks.select(
        "doc_id",
        (F.col("pos") + 1).alias("chunk_no"),
        (F.col("start") + 1).alias("from_page"),
        F.least(F.col("start") + F.col("ppc"), F.col("total_pages")).alias("to_page"),
    )


def chunk_pages(plan: DataFrame) -> DataFrame:
    """One row per page with the chunk that holds it and its number there."""
    pages = explode_range(plan, F.col("from_page"), F.col("to_page"), "page_no")
    local = F.col("page_no") - F.col("from_page") + 1
    return pages.select("doc_id", "page_no", "chunk_no", local.alias("local_page"))


def failed_chunks(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Planned chunks without a successful result."""
    done = results.filter("status = 'ok'").select("doc_id", "chunk_no")
    return plan.join(done, ["doc_id", "chunk_no"], "left_anti")


def chunk_offsets(results: DataFrame) -> DataFrame:
    """Successful chunks with the number of pages in earlier successful ones."""
    done = results.filter("status = 'ok'")
    return block_running_sum(done, "doc_id", "chunk_no", "pages").withColumnRenamed(
        "sum_before", "page_offset"
    )


def global_pages(results: DataFrame) -> DataFrame:
    """Document-wide number of every page of the successful chunks."""
    chunks = chunk_offsets(results).select("doc_id", "chunk_no", "pages", "page_offset")
    pages = explode_range(chunks, F.lit(1), F.col("pages"), "local_page")
    return pages.select(
        "doc_id",
        "chunk_no",
        "local_page",
        (F.col("page_offset") + F.col("local_page")).alias("page_no"),
    )


def chunk_combine(results: DataFrame) -> DataFrame:
    """Totals over successful chunks; the chunk count includes failed ones."""
    ok = F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(F.when(ok, c.cast("bigint"))), F.lit(0))
    return results.groupBy("doc_id").agg(
        total(F.col("pages")).alias("pages_processed"),
        total(F.col("tables")).alias("tables_found"),
        total(F.size("table_pages")).alias("pages_with_tables"),
        F.count("*").alias("chunks_processed"),
    )


def combined_table_pages(results: DataFrame) -> DataFrame:
    """Document-wide numbers of the pages with tables, in long form."""
    pages = chunk_offsets(results).select(
        "doc_id", "page_offset", F.explode("table_pages").alias("local_page")
    )
    return pages.select("doc_id", (F.col("page_offset") + F.col("local_page")).alias("page_no"))


def renumber_headers(chunks: DataFrame) -> DataFrame:
    """Combined markdown of a document's chunks with page headers numbered 1, 2, 3, ...

    Input ``(doc_id, chunk_no, markdown)``. Chunk titles go, every header line counts even
    inside page content. The text stays one part per chunk; the parts in chunk order,
    concatenated, are the combined file. Headers are counted per chunk and the counts summed
    in blocks, so a document of any length is renumbered by many tasks.
    """
    title = rf"\A{DOCUMENT_TITLE}[^\n]*(?:\n[^\n]*)?(?:\n|\z)"
    titled = F.col("markdown").startswith(DOCUMENT_TITLE)
    has_body = ~titled | F.col("markdown").rlike(r"\A[^\n]*\n[^\n]*\n")
    bodies = chunks.filter(has_body).select(
        "doc_id",
        "chunk_no",
        F.regexp_replace("markdown", title, "").alias("body"),
    )
    counted = bodies.withColumn("n_headers", F.regexp_count("body", F.lit(PAGE_HEADER)))
    numbered = block_running_sum(counted, "doc_id", "chunk_no", "n_headers", block=16)
    pieces = F.split(F.col("body"), PAGE_HEADER)
    header = lambda piece, i: F.concat(
        F.lit("## Page "), (F.col("sum_before") + i).cast("string"), piece
    )
    text = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(header(p, i))), ""
    )
    lead = F.when(F.col("rows_before") == 0, DOCUMENT_TITLE + "\n\n").otherwise("\n")
    return numbered.select("doc_id", "chunk_no", F.concat(lead, text).alias("markdown"))


def resolution_tier(pages: DataFrame) -> DataFrame:
    """Scale and dpi per page of ``(doc_id, page_no, size_bytes, flagged)``.

    At every fifth page the size of the pages before it is projected to the whole document;
    once above the limit, unflagged pages from there on drop to the lower tier.
    """
    summed = block_running_sum(pages, "doc_id", "page_no", "size_bytes")
    index = F.col("page_no").cast("bigint") - 1
    over_limit = (index > 0) & (index % 5 == 0) & (
        F.col("sum_before") * F.col("key_rows") > index * PROJECTED_LIMIT_MB * MB
    )
    checked = summed.withColumn("over", over_limit)
    # The first page above the limit is sticky: earliest per block, then over earlier blocks.
    firsts = checked.groupBy("doc_id", "block_no").agg(
        F.min(F.when(F.col("over"), F.col("page_no"))).alias("first_over")
    )
    so_far = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    firsts = firsts.withColumn("first_over", F.min("first_over").over(so_far))
    low = ~F.col("flagged") & F.coalesce(F.col("page_no") >= F.col("first_over"), F.lit(False))
    tier = lambda i: F.when(low, LOW_TIER[i]).otherwise(HIGH_TIER[i])
    # As in the running sum, blocks are as many as documents: never gathered on the driver.
    return checked.join(firsts.hint("merge"), ["doc_id", "block_no"]).select(
        "doc_id", "page_no", "flagged", tier(0).alias("scale"), tier(1).alias("dpi")
    )


def attempt_classes(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("class", attempt_class(F.col("error")))


def retry_delay(attempt: Column) -> Column:
    """Seconds waited after a failed attempt; the last one is not followed by a wait."""
    delay = (F.pow(F.lit(2), attempt) * BASE_DELAY + attempt * 5).cast("bigint")
    return F.when(attempt < MAX_ATTEMPTS - 1, delay).otherwise(0)


def retry_outcomes(attempts: DataFrame) -> DataFrame:
    """Final state, attempts and waiting time of each request in an attempt log.

    The last class is carried as the low digit of the largest attempt number, which keeps
    the aggregate on fixed-width values.
    """
    classes = ["ok", "too_large", "retry", "fatal"]
    names = F.array(*[F.lit(c) for c in classes])
    code = F.array_position(names, F.col("class")) - 1
    delay = F.when(F.col("class") == "retry", retry_delay(F.col("attempt"))).otherwise(0)
    out = (
        attempt_classes(attempts)
        .groupBy("request_id")
        .agg(
            F.max(F.col("attempt") * len(classes) + code).alias("last"),
            F.count("*").alias("attempts"),
            F.sum(delay.cast("bigint")).alias("delay_seconds"),
        )
    )
    last_class = F.get(names, (F.col("last") % len(classes)).cast("int"))
    exhausted = (last_class == "retry") & (F.col("attempts") >= MAX_ATTEMPTS)
    outcome = F.when(exhausted, "exhausted").otherwise(last_class)
    return out.select("request_id", outcome.alias("outcome"), "attempts", "delay_seconds")
