"""String primitives whose notion of space, digit and word is Unicode-wide.

Spark's ``trim`` removes blanks only and Java's ``\\s``, ``\\d``, ``\\b`` are ASCII by
default, so the classes are spelled out here once and used everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set for use inside a regex character class, with and without the newline.
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
INLINE_SPACE = r"\t\x0b-\r\x1c-\x1f\x85\p{Z}"

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
# Superscript, subscript, circled and similar signs that count as digits
# of a text although they are not decimal digits.
DIGIT_SIGNS = (
    DIGIT + r"\xb2\xb3\xb9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    r"\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff"
    r"\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
# The same set, tested only for characters that are numbers at all.
DIGIT_SIGN = rf"\p{{N}}&&[{DIGIT_SIGNS}]"
SPECIAL = ".,#*:/-()$"

# Word boundaries before and after a word character.
WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression used in several places, or inside a lambda, would otherwise be
    copied there by the optimizer and run once per use or per array element.
    """
    return F.transform(F.array(value), body)[0]


def div(a: Column, b: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def last(values: Column) -> Column:
    """Last array element, null when there is none."""
    return F.try_element_at(values, F.lit(-1))


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.trim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Maximal runs of non-whitespace."""
    return find_all(text, f"[^{SPACE}]+")


def lines_of(text: Column) -> Column:
    """Lines of a text, trailing empty ones kept."""
    return F.split(text, "\n")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches, left to right."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def remove_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def count_class(text: Column, char_class: str) -> Column:
    """Number of characters of ``text`` inside a regex class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def count_special(text: Column) -> Column:
    return F.length(text) - F.length(remove_chars(text, SPECIAL))


def size_mb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(1048576.0)


def linspace(low: Column, high: Column, count: int) -> Column:
    """``count`` evenly spaced values, both ends included."""
    step = (high - low) / F.lit(float(count - 1))
    inner = F.transform(
        F.sequence(F.lit(0), F.lit(count - 2)), lambda i: low + i.cast("double") * step
    )
    return F.concat(inner, F.array(high))


def linspace_at(low: Column, high: Column, count: int, position: Column) -> Column:
    """The entry of ``linspace`` at a 0-based position."""
    step = (high - low) / F.lit(float(count - 1))
    return F.when(position == count - 1, high).otherwise(low + position.cast("double") * step)


def packed(values: Column) -> Column:
    """An array of strings as one string, parts separated by U+001F."""
    return F.array_join(values, "\x1f")
