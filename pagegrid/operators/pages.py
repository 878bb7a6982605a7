"""Pages and lines: explode, profile, flag.

Input is always ``pages(doc_id, page_no, markdown)``, one row per page. A table never spans
pages, so every operator here is a projection or a generate: no shuffle, and a document
holding a third of all pages is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.functions import lines as L
from pagegrid.functions import patterns as P
from pagegrid.functions.text import count_class, count_special, DIGIT_SIGN, find_all, lines_of, words

PAGE = ["doc_id", "page_no"]


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per line with its 0-based index."""
    return pages.select(*PAGE, F.posexplode(lines_of(F.col("markdown"))).alias("line_no", "line"))


def table_line_stats(pages: DataFrame) -> DataFrame:
    """Lines with two pipes or more, and whether each is a separator."""
    lines = page_lines(pages.filter(F.col("markdown").contains("|")))
    return lines.filter(L.is_table_line(F.col("line"))).withColumn(
        "is_separator", L.is_separator(F.col("line"))
    )


def data_lines(pages: DataFrame) -> DataFrame:
    return page_lines(pages).filter(L.looks_like_data_line(F.col("line")))


def char_ratios(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """Digits, letters and special characters of each page, absolute and per character."""
    col = F.col(text)
    counted = pages.select(
        *PAGE,
        F.length(col).alias("total_chars"),
        count_class(col, DIGIT_SIGN).alias("digits"),
        count_class(col, r"\p{L}").alias("letters"),
        count_special(col).alias("specials"),
    )
    total = F.nullif(F.col("total_chars"), F.lit(0))
    return counted.withColumns(
        {
            "digit_ratio": F.coalesce(F.col("digits") / total, F.lit(0.0)),
            "special_ratio": F.coalesce(F.col("specials") / total, F.lit(0.0)),
        }
    )


def word_counts(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE, F.size(words(F.col("markdown"))).alias("n_words"))


def tabular_tokens(pages: DataFrame) -> DataFrame:
    """Words of each page, and how many of them are shaped like a table cell."""
    tokens = pages.select(*PAGE, F.explode(F.array(words(F.col("markdown")))).alias("tokens"))
    return tokens.select(
        *PAGE,
        F.size("tokens").alias("n_tokens"),
        F.size(F.filter("tokens", L.looks_like_tabular)).alias("n_tabular"),
    )


def pattern_counts(pages: DataFrame) -> DataFrame:
    """Hits of every fixed pattern on each page."""
    col = F.col("markdown")
    patterns = P.ELEMENT_PATTERNS | {f"profile_{k}": v for k, v in P.PROFILE_PATTERNS.items()}
    return pages.select(
        *PAGE, *[F.size(find_all(col, p)).alias(name) for name, p in patterns.items()]
    )


def column_patterns(pages: DataFrame) -> DataFrame:
    """Numbers, dates, currency values and identifiers found on each page, as arrays.

    A document profile is the union of its pages; it stays one row per page so that no
    document is gathered into one task. ``text_patterns`` is always empty.
    """
    col = F.col("markdown")
    found = [find_all(col, p).alias(f"{name}_patterns") for name, p in P.PROFILE_PATTERNS.items()]
    return pages.select(*PAGE, *found, F.array().cast("array<string>").alias("text_patterns"))


def column_pattern_counts(pages: DataFrame) -> DataFrame:
    """Length of each profile list per document, combined map-side."""
    profile = column_patterns(pages)
    names = [c for c in profile.columns if c not in PAGE]
    return profile.groupBy("doc_id").agg(
        *[F.sum(F.size(n).cast("bigint")).alias(n.replace("_patterns", "_count")) for n in names]
    )


def tabular_layout(pages: DataFrame) -> DataFrame:
    col = F.col("markdown")
    return pages.select(
        *PAGE,
        L.line_count(col).alias("n_lines"),
        L.tabular_line_count(col).alias("n_tabular_lines"),
        L.is_tabular_layout(col).alias("is_tabular"),
    )


def financial_keywords(pages: DataFrame, keywords: list[str] = P.FINANCIAL_KEYWORDS) -> DataFrame:
    return pages.select(
        *PAGE, L.has_financial_keywords(F.col("markdown"), keywords).alias("is_financial")
    )


def page_flag(
    text: Column,
    edge: Column,
    line: Column,
    edge_threshold: float = 0.030,
    line_threshold: float = 0.005,
) -> Column:
    """Why a page gets the costly treatment; ``none`` when it does not. First rule wins."""
    return (
        F.when(L.is_tabular_layout(text), "tabular_layout")
        .when((edge > edge_threshold) & (line > line_threshold), "density")
        .when((edge > 0.025) & (edge < 0.040) & (line > 0.005), "moderate_density")
        .otherwise("none")
    )


def flag_pages(features: DataFrame, **thresholds: float) -> DataFrame:
    """Flag ``features(doc_id, page_no, edge_density, line_density, text)``."""
    reason = page_flag(
        F.col("text"), F.col("edge_density"), F.col("line_density"), **thresholds
    )
    return features.select(*PAGE, reason.alias("reason")).withColumn(
        "flagged", F.col("reason") != "none"
    )


def first_pages(pages: DataFrame, count: int = 3) -> DataFrame:
    return pages.filter(F.col("page_no") <= count)
