"""Registered queries: every operator over whole tables.

Results are given plain column types (bigint, double rounded to 9 digits, string, boolean)
so that two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrid.functions import metrics as M
from pagegrid.functions.cells import find_column
from pagegrid.functions.text import packed
from pagegrid.operators import context, evaluation, extraction, ledgers, pages, routing
from pagegrid.operators import scattered, search
from pagegrid.plans import derived as D
from pagegrid.sources import readers, split_json, writers

Query = Callable[[SparkSession, str], DataFrame]
Source = Callable[[SparkSession, str], DataFrame]


def plain(rows: DataFrame) -> DataFrame:
    """Widen integers, round doubles, join string arrays."""

    def column(field: T.StructField):
        col = F.col(field.name)
        if isinstance(field.dataType, T.IntegralType):
            col = col.cast("bigint")
        elif isinstance(field.dataType, T.FractionalType):
            col = F.round(col.cast("double"), 9)
        elif isinstance(field.dataType, T.ArrayType):
            col = packed(col)
        return col.alias(field.name)

    return rows.select(*[column(f) for f in rows.schema.fields])


def _on(source: Source, operator: Callable[[DataFrame], DataFrame], *keep: str) -> Query:
    """Query that applies an operator to a derived table and keeps some columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = operator(source(spark, sf_dir))
        return plain(rows.select(*keep) if keep else rows)

    return run


# Shared inputs ------------------------------------------------------------------------------


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sample_scores(D.eval_samples(spark, sf_dir), D.predictions(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.valid_samples(D.eval_samples(spark, sf_dir))


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.kfold_assign(_valid(spark, sf_dir), D.FOLDS)


def _fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fold_scores(_scores(spark, sf_dir), _folds(spark, sf_dir), D.FOLDS)


def _silent_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that leave out failed samples and all of some combinations' folds."""
    folds = _folds(spark, sf_dir)
    told = _scores(spark, sf_dir).filter("cer IS NOT NULL").join(folds, "sample_id")
    scores = told.filter(F.col("fold") != F.col("combo_id") + 1).drop("fold", "position")
    return evaluation.cv_scores(
        evaluation.fold_scores(scores, folds, D.FOLDS, D.predictions(spark, sf_dir))
    )


def _cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cv_scores(_fold_scores(spark, sf_dir))


def _combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline = D.mean_baseline(spark, sf_dir)
    return search.random_picks(baseline, search.focused_ranges(), D.COMBOS)


def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.params_with_defaults(D.baselines(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.plan_chunks(D.docs(spark, sf_dir))


# Queries that need more than one step ---------------------------------------------------------


def _markdown_cells(rows: DataFrame) -> DataFrame:
    return extraction.table_cells(extraction.padded_tables(rows))


def _meaningful(rows: DataFrame) -> DataFrame:
    """All tables of a page by every method, each with its number of rows."""
    tables = extraction.extract_page_tables(rows)
    return tables.select(*pages.PAGE, "method", "table_no", F.size("rows").alias("n_rows"))


def _find_column(rows: DataFrame) -> DataFrame:
    names = ["Number", "Debit", "AMOUNT", "code", "Missing"]
    asked = scattered.scattered_headers(rows).withColumn(
        "name", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    return asked.select(
        *pages.PAGE, "name", find_column(F.col("header"), F.col("name")).alias("position")
    )


def _csv_names(rows: DataFrame) -> DataFrame:
    stem = F.concat(F.lit("conv "), F.col("doc_id").cast("string"))
    named = rows.select("doc_id", extraction.csv_name(stem, F.col("page_no")).alias("file_name"))
    return named.withColumn("page_no", extraction.page_no_from_name(F.col("file_name")))


def _ocr_json(rows: DataFrame) -> DataFrame:
    responses = rows.select("doc_id", readers.parse_response(F.col("json")).alias("pages"))
    return readers.response_pages(responses, ["doc_id"])


def _split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of responses that were written one after the other and read by byte ranges.

    Keys are places in files that Spark names, so pages are counted by number and text.
    """
    folder = writers.work_folder(spark, "responses")
    D.response_json(spark, sf_dir).select("json").write.text(folder)
    rows = split_json.read_split_pages(spark, folder, glob="*.txt")
    return plain(rows.groupBy("page_no", "markdown").agg(F.count("*").alias("n")))


def _ground_truth(rows: DataFrame) -> DataFrame:
    return rows.select("sample_id", readers.ground_truth_text(F.col("pages")).alias("ground_truth"))


def _pair_metric(name: str, metric, *keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.select(
        *keys, metric(F.col("truth"), F.col("predicted")).alias(name)
    )


def _mixed(samples: DataFrame) -> DataFrame:
    sources = [samples.filter(F.col("source") == s) for s in ("even", "odd")]
    return evaluation.mixed_samples(sources, evaluation.CV_SAMPLES // 2)


def _failed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(routing.failed_chunks(_plan(spark, sf_dir), D.chunk_results(spark, sf_dir)))


def _best_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(writers.best_params_kv(_cv(spark, sf_dir), _combos(spark, sf_dir)))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = evaluation.cv_results(_fold_scores(spark, sf_dir))
    return plain(writers.tuning_report(results, _combos(spark, sf_dir)))


def _document_folds(documents: DataFrame) -> DataFrame:
    ids = documents.select(F.col("doc_id").alias("sample_id"))
    return evaluation.kfold_assign(ids, 7, seed=7)


def _grid(baselines: DataFrame) -> DataFrame:
    ranges = {k: r for k, r in search.focused_ranges().items() if k in search.FOCUSED_SPREAD}
    return search.param_combinations(baselines, ranges, 50)


def _random(baselines: DataFrame) -> DataFrame:
    return search.param_combinations(baselines, search.focused_ranges(), 15)


def _grid_of_samples(assigned: DataFrame) -> DataFrame:
    chosen = evaluation.fold_samples(assigned, D.PER_FOLD)
    return evaluation.combo_sample_grid(chosen, D.COMBOS)


def queries() -> dict[str, Query]:
    """One entry per operator, and further inputs for the ones that matter most."""
    docs, turns, ledger, loose = D.doc_pages, D.conv_pages, D.invoice_pages, D.scattered_pages
    broad = search.broad_ranges
    few = 4
    return {
        # lines and predicates
        "page_lines": _on(docs, pages.page_lines),
        "page_lines_turns": _on(turns, pages.page_lines),
        "table_line_stats": _on(docs, pages.table_line_stats),
        "table_line_stats_ledger": _on(ledger, pages.table_line_stats),
        "data_lines": _on(docs, pages.data_lines),
        "char_ratios": _on(docs, pages.char_ratios),
        "word_counts": _on(docs, pages.word_counts),
        "tabular_tokens": _on(docs, pages.tabular_tokens),
        "pattern_counts": _on(docs, pages.pattern_counts),
        "pattern_counts_ledger": _on(loose, pages.pattern_counts),
        "column_patterns": _on(loose, pages.column_patterns),
        "column_pattern_counts": _on(docs, pages.column_pattern_counts),
        "tabular_layout": _on(turns, pages.tabular_layout),
        "tabular_layout_documents": _on(docs, pages.tabular_layout),
        "financial_keywords": _on(docs, pages.financial_keywords),
        "financial_keywords_ledger": _on(ledger, pages.financial_keywords),
        "flag_pages": _on(D.page_features, pages.flag_pages),
        "first_pages": _on(turns, pages.first_pages),
        # pipe tables
        "markdown_tables": _on(docs, extraction.markdown_tables),
        "markdown_tables_ledger": _on(ledger, extraction.markdown_tables),
        "padded_tables": _on(ledger, extraction.padded_tables),
        "markdown_cells": _on(docs, _markdown_cells),
        "meaningful_tables": _on(docs, _meaningful),
        # ledgers
        "invoice_headers": _on(
            ledger,
            lambda p: ledgers.invoice_headers(p).withColumn("line", F.col("window")[0]),
            "doc_id",
            "page_no",
            "header_line",
            "line",
        ),
        "invoice_window": _on(ledger, ledgers.invoice_window),
        "invoice_money_lines": _on(ledger, ledgers.invoice_money_lines),
        "invoice_rows": _on(ledger, ledgers.invoice_rows),
        # scattered values
        "scattered_elements": _on(loose, scattered.scattered_elements),
        "scattered_elements_documents": _on(docs, scattered.scattered_elements),
        "scattered_groups": _on(loose, scattered.scattered_groups),
        "scattered_headers": _on(loose, scattered.scattered_headers),
        "scattered_rows": _on(loose, scattered.scattered_rows),
        "find_column": _on(loose, _find_column),
        # all methods
        "extract_tables": _on(ledger, extraction.extract_tables),
        "extract_tables_scattered": _on(loose, extraction.extract_tables),
        "extract_tables_documents": _on(docs, extraction.extract_tables),
        "extract_tables_web": _on(D.web_pages, extraction.extract_tables),
        "page_csv": _on(ledger, extraction.page_csv),
        "page_csv_documents": _on(docs, extraction.page_csv),
        "csv_names": _on(turns, _csv_names),
        "run_summary": _on(ledger, extraction.run_summary),
        "run_table_pages": _on(docs, extraction.run_table_pages),
        # context of a row
        "row_signatures": _on(ledger, context.row_signatures),
        "related_lines": _on(ledger, context.related_lines, *context.ROW, "line_no", "line"),
        "line_candidates": _on(ledger, context.candidates),
        "missing_row_data": _on(ledger, context.missing_row_data),
        # sources and sinks
        "ocr_json_pages": _on(D.response_json, _ocr_json),
        "split_response_pages": _split_pages,
        "ground_truth_text": _on(D.annotated_pages, _ground_truth),
        "document_markdown": _on(turns, lambda p: writers.document_markdown(p, few)),
        "document_text": _on(turns, lambda p: evaluation.document_text(p, few)),
        # routing and chunks
        "route_docs": _on(D.docs, routing.route_docs),
        "plan_chunks": _on(D.docs, routing.plan_chunks),
        "chunk_pages": _on(_plan, routing.chunk_pages),
        "failed_chunks": _failed_chunks,
        "global_pages": _on(D.chunk_results, routing.global_pages),
        "chunk_combine": _on(D.chunk_results, routing.chunk_combine),
        "combined_table_pages": _on(D.chunk_results, routing.combined_table_pages),
        "renumber_headers": _on(D.chunk_markdown, routing.renumber_headers),
        "resolution_tier": _on(D.page_sizes, routing.resolution_tier),
        "attempt_classes": _on(D.attempts, routing.attempt_classes),
        "retry_outcomes": _on(D.attempts, routing.retry_outcomes),
        # scores
        "cer": _on(D.text_pairs, _pair_metric("cer", M.cer, "combo_id", "sample_id")),
        "wer": _on(D.text_pairs, _pair_metric("wer", M.wer, "combo_id", "sample_id")),
        "cer_turns": _on(D.turn_pairs, _pair_metric("cer", M.cer, "conv_id", "turn")),
        "cer_positional": _on(
            D.text_pairs, _pair_metric("cer", M.cer_positional, "combo_id", "sample_id")
        ),
        "wer_positional": _on(
            D.turn_pairs, _pair_metric("wer", M.wer_positional, "conv_id", "turn")
        ),
        "sample_scores": _on(_scores, lambda s: s),
        "combo_scores": _on(_scores, evaluation.combo_scores),
        "fold_scores": _on(_fold_scores, lambda s: s),
        "cv_scores": _on(_cv, lambda s: s),
        "cv_scores_silent": _on(_silent_cv, lambda s: s),
        "best_combo": _on(_cv, evaluation.best_combo),
        "best_progress": _on(_cv, evaluation.best_progress),
        # samples and folds
        "mixed_samples": _on(D.eval_samples, _mixed),
        "min_samples_check": _on(_valid, lambda s: evaluation.min_samples_check(s, D.FOLDS)),
        "kfold_assign": _on(_folds, lambda s: s, "sample_id", "fold", "position"),
        "kfold_assign_documents": _on(
            lambda spark, sf_dir: D.table(spark, sf_dir, "documents"), _document_folds
        ),
        "kfold_split": _on(_folds, lambda s: evaluation.kfold_split(s, D.FOLDS)),
        "fold_samples": _on(
            _folds, lambda s: evaluation.fold_samples(s, D.PER_FOLD), "fold", "position", "sample_id"
        ),
        "combo_sample_grid": _on(_folds, _grid_of_samples, "combo_id", "fold", "sample_id"),
        "deal_samples": _on(
            D.eval_samples, lambda s: evaluation.deal_samples(s, D.COMBOS, few)
        ),
        # parameter space
        "params_with_defaults": _on(_baselines, lambda b: b),
        "param_ranges": _on(_baselines, search.param_ranges),
        "param_ranges_broad": _on(_baselines, lambda b: search.param_ranges(b, broad())),
        "param_space_size": _on(_baselines, search.param_space_size),
        "param_space_size_broad": _on(_baselines, lambda b: search.param_space_size(b, broad())),
        "param_grid": _on(_baselines, _grid),
        "param_random": _on(_baselines, _random),
        "evaluation_budget": _on(
            _baselines,
            lambda b: evaluation.evaluation_budget(_random(b), D.FOLDS, D.PER_FOLD),
        ),
        "best_params_kv": _best_params,
        "tuning_report": _report,
    }
