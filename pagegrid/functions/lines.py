"""Predicates and counters on one line, one cell or one page text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrid.functions import patterns as P
from pagegrid.functions.text import (
    DIGIT,
    DIGIT_SIGN,
    INLINE_SPACE,
    SPACE,
    WORD_END,
    WORD_START,
    count_class,
    count_special,
    let,
    remove_chars,
    strip,
)


def is_table_line(line: Column) -> Column:
    """At least two pipes."""
    return (F.length(line) - F.length(remove_chars(line, "|"))) >= 2


def is_separator(line: Column) -> Column:
    """Nothing but pipes, dashes and blanks between the outer whitespace."""
    return remove_chars(strip(line), "|- ") == ""


def has_digit(line: Column) -> Column:
    return line.rlike(f"[{DIGIT_SIGN}]")


def has_data_shape(line: Column) -> Column:
    """``looks_like_data_line`` for a line that is stripped and not empty."""
    found = "|".join(
        [
            rf"{DIGIT}/{DIGIT}+/{DIGIT}",
            rf"{DIGIT}\.{DIGIT}{{2}}",
            rf"(?={DIGIT}){WORD_START}{DIGIT}{{3,}}+{WORD_END}",
        ]
    )
    length = F.length(line)
    return line.rlike(found) | (
        (count_class(line, DIGIT_SIGN) / length > 0.1) & (count_special(line) / length > 0.05)
    )


def looks_like_data_line(line: Column) -> Column:
    """Digits and punctuation dense enough, or a date, an amount or an id in the line."""
    return let(strip(line), lambda s: F.when(s == "", False).otherwise(has_data_shape(s)))


def looks_like_tabular(cell: Column) -> Column:
    """Short enough and shaped like a table cell."""
    any_shape = "|".join(f"(?:{p})" for p in P.CELL_PATTERNS.values())
    return (cell != "") & (F.length(cell) <= P.MAX_CELL_LENGTH) & cell.rlike(rf"\A(?:{any_shape})\z")


def tabular_line_count(text: Column, min_words: int = 4) -> Column:
    """Number of lines with at least ``min_words`` words, in one pass over the text."""
    gap, word = f"[{INLINE_SPACE}]", f"[^{SPACE}]"
    rest = rf"(?:{gap}++{word}++){{{min_words - 1}}}"
    return F.regexp_count(text, F.lit(rf"(?:\A|\n){gap}*+{word}++{rest}"))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(remove_chars(text, "\n")) + 1


def is_tabular_layout(text: Column, share: float = 0.2) -> Column:
    """More than ``share`` of all lines, empty ones included, hold four words or more."""
    return tabular_line_count(text) > line_count(text) * F.lit(share)


def has_financial_keywords(text: Column, keywords: list[str] = P.FINANCIAL_KEYWORDS) -> Column:
    return let(F.upper(text), lambda u: reduce(or_, [u.contains(k) for k in keywords]))


def is_section_stop(line: Column, phrases: list[str] = P.STOP_PHRASES) -> Column:
    """A stripped line that starts a heading or a pipe table, or holds a stop phrase."""
    tests = [line.startswith("#"), line.startswith("|")] + [line.contains(p) for p in phrases]
    return reduce(or_, tests)


def is_money_line(line: Column) -> Column:
    """A pipe, a digit, and text in at least two cells."""
    two_cells = rf"(?s)[^|{SPACE}][^|]*+\|.*[^|{SPACE}]"
    return line.contains("|") & has_digit(line) & line.rlike(two_cells)


def is_ledger_header(line: Column) -> Column:
    return reduce(lambda a, b: a & b, [line.contains(w) for w in P.LEDGER_HEADER_WORDS])


def attempt_class(error: Column) -> Column:
    """``ok``, ``too_large`` (fatal), ``retry`` or ``fatal``; the size test wins."""
    text = F.lower(error)
    return (
        F.when(error.isNull(), "ok")
        .when(text.contains("too large") | error.contains("600"), "too_large")
        .when(text.rlike("504|gateway|timeout|502|503|500"), "retry")
        .otherwise("fatal")
    )
