"""Render pages, tables and tuning results, and write them.

Everything that belongs to one document is rendered in parts of a bounded number of pages,
so a document of any size is written by many tasks. Parts in order, concatenated, are the
document's file.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegrid.functions.text import div
from pagegrid.operators.evaluation import best_combo
from pagegrid.operators.extraction import page_csv
from pagegrid.operators.routing import DOCUMENT_TITLE

PAGES_PER_PART = 64


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    A temporary folder takes its place only where driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pagegrid-work-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _part_no(pages_per_part: int) -> Column:
    """A document without pages has the part 0, which is empty."""
    return F.coalesce(div(F.col("page_no") - 1, pages_per_part), F.lit(0)).alias("part_no")


def _in_order(entry: Column) -> Column:
    """Entries of real pages by page number; ``collect_list`` leaves the null ones out."""
    return F.sort_array(F.collect_list(F.when(F.col("page_no").isNotNull(), entry)))


def document_markdown(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """``(doc_id, part_no, markdown)``: title, then number, text and rule of every page."""
    section = lambda p: F.concat(
        F.lit("## Page "),
        p["page_no"].cast("string"),
        F.lit("\n\n"),
        p["markdown"],
        F.lit("\n\n---\n\n"),
    )
    collected = _in_order(F.struct("page_no", "markdown"))
    parts = pages.groupBy("doc_id", _part_no(pages_per_part)).agg(
        F.array_join(F.transform(collected, section), "").alias("sections")
    )
    title = F.when(F.col("part_no") == 0, DOCUMENT_TITLE + "\n\n").otherwise("")
    return parts.select("doc_id", "part_no", F.concat(title, "sections").alias("markdown"))


def ocr_json_parts(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """``(doc_id, part_no, pages)`` with the pages of a part in order.

    Where pages carry their whole ``record``, all its fields are written, else the text.
    """
    fields = F.col("record.*") if "record" in pages.columns else F.col("markdown")
    entry = F.struct(F.col("page_no").alias("page_number"), fields)
    return pages.groupBy("doc_id", _part_no(pages_per_part)).agg(_in_order(entry).alias("pages"))


def _save(rows: DataFrame, path: str, fmt: str, by: str | None) -> None:
    writer = rows.write.mode("overwrite").format(fmt)
    (writer.partitionBy(by) if by else writer).save(path)


def write_ocr_json(pages: DataFrame, path: str, by_document: bool = False) -> None:
    """One JSON record per part; ``by_document`` gives each document its own folder."""
    _save(ocr_json_parts(pages), path, "json", "doc_id" if by_document else None)


def write_document_markdown(pages: DataFrame, path: str) -> None:
    """One folder per document and part, each with one text file."""
    text = F.regexp_replace("markdown", r"\n\z", "").alias("value")
    parts = document_markdown(pages).select("doc_id", "part_no", text)
    parts.write.mode("overwrite").partitionBy("doc_id", "part_no").text(path)


def write_page_csv(
    pages: DataFrame, path: str, per_file: bool = False, name: Column | None = None
) -> None:
    """CSV text of every page with tables, called as in ``page_csv``.

    By default a Parquet set ``(doc_id, page_no, file_name, csv_text)``, which stays cheap
    to list however many pages there are; ``per_file`` gives each page its own folder with
    the CSV file in it.
    """
    texts = page_csv(pages, name)
    if not per_file:
        _save(texts, path, "parquet", None)
        return
    value = F.regexp_replace("csv_text", r"\n\z", "").alias("value")
    texts.select("file_name", value).write.mode("overwrite").partitionBy("file_name").text(path)


def tuning_report(
    results: DataFrame, params: DataFrame, metric: str = "mean_cer"
) -> DataFrame:
    """``(section, combo_id, report)``: a result per combination and one summary, as JSON.

    ``results`` is ``combo_scores``, ``cv_scores`` or ``cv_results``. It is read once: the
    combinations, few as they are, are ranked in one task and the first one also yields the
    summary.
    """
    names = [c for c in params.columns if c not in ("combo_id", "set_id")]
    settings = params.select("combo_id", F.struct(*names).alias("parameters"))
    metrics = [c for c in results.columns if c != "combo_id"]
    order = Window.orderBy(F.round(metric, 12), "combo_id")
    ranked = results.join(settings, "combo_id", "left").withColumns(
        {
            "place": F.row_number().over(order),
            "total_combinations_tested": F.count("*").over(Window.partitionBy()),
        }
    )
    fields = [*metrics, "parameters"]
    scalars = [c for c in fields if c != "fold_results"]
    entry = lambda section, columns: F.struct(
        F.lit(section).alias("section"), F.to_json(F.struct(*columns)).alias("report")
    )
    result = entry("result", fields)
    summary = entry("summary", ["total_combinations_tested", *scalars])
    sections = F.when(F.col("place") == 1, F.array(summary, result)).otherwise(F.array(result))
    return ranked.select("combo_id", F.explode(sections).alias("s")).select(
        "s.section", "combo_id", "s.report"
    )


def best_params_kv(scores: DataFrame, params: DataFrame, metric: str = "mean_cer") -> DataFrame:
    """Parameters and metrics of the best combination as ``(key, value)`` rows."""
    best = best_combo(scores, metric).join(params, "combo_id")
    keys = [c for c in params.columns if c not in ("combo_id", "set_id")]
    keys += [c for c in scores.columns if c != "combo_id"]
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys]
    return best.select(F.explode(F.array(*pairs)).alias("p")).select("p.key", "p.value")


def write_tuning_report(report: DataFrame, path: str) -> None:
    _save(report, path, "json", "section")
