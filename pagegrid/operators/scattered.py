"""Rebuild a table from typed values when nothing of its layout is left.

Lines holding values are grouped while the gap to the previous such line is at most two
lines. Sessions are slices of the page's own array of hits, found in one linear pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.functions import patterns as P
from pagegrid.functions.text import DIGIT, find_all, let, lines_of, strip
from pagegrid.operators.pages import PAGE, page_lines

MAX_GAP = 2
PAIR = {"amounts", "negative_amounts"}
_NEEDED = rf"[{DIGIT}*]"
_ELEMENTS = "array<struct<type:string,value:string>>"


def _guarded(text: Column, name: str, patterns: dict[str, str]) -> Column:
    """Matches of one pattern; texts without a character every match holds are skipped."""
    found = find_all(text, patterns[name])
    if patterns is not P.ELEMENT_PATTERNS or name not in P.ELEMENT_MARKS:
        return found
    none = F.array().cast("array<string>")
    return F.when(text.contains(P.ELEMENT_MARKS[name]), found).otherwise(none)


def line_elements(line: Column, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> Column:
    """Typed values of a stripped line in pattern order, then left to right."""

    def typed(name: str) -> Column:
        return F.transform(
            _guarded(line, name, patterns),
            lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")),
        )

    found = F.concat(*[typed(name) for name in patterns])
    return F.when(_may_hold_elements(line, patterns), found).otherwise(
        F.array().cast(_ELEMENTS)
    )


def _may_hold_elements(line: Column, patterns: dict[str, str]) -> Column:
    """Not empty, no heading, no bold line; the fixed patterns also need a digit or a star."""
    kept = (line != "") & ~(line.startswith("#") | line.startswith("**"))
    return kept & line.rlike(_NEEDED) if patterns is P.ELEMENT_PATTERNS else kept


def page_hits(lines: Column, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> Column:
    """Stripped lines with at least one value: ``array<struct<line_no, line>>``."""
    any_value = "|".join(f"(?:{p})" for p in patterns.values())
    stripped = F.transform(
        lines, lambda line, i: F.struct(i.alias("line_no"), strip(line).alias("line"))
    )
    return F.filter(
        stripped, lambda x: _may_hold_elements(x["line"], patterns) & x["line"].rlike(any_value)
    )


def sessions(hits: Column) -> Column:
    """Groups of two hit lines or more; empty unless the page has two such groups."""

    def cut(hits: Column) -> Column:
        first = lambda i: (i == 0) | (
            F.get(hits, i)["line_no"] - F.get(hits, i - 1)["line_no"] > MAX_GAP
        )
        starts = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), first)
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, k: F.slice(
                    hits, start + 1, F.coalesce(F.get(s, k + 1), F.size(hits)) - start
                ),
            ),
        )

    def kept(hits: Column) -> Column:
        groups = F.filter(cut(hits), lambda g: F.size(g) >= 2)
        return F.when(F.size(hits) >= 2, groups)

    return let(let(hits, kept), lambda g: F.when(F.size(g) >= 2, g))


def session_values(groups: Column, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> Column:
    """Values of each group, one array per pattern in pattern order.

    The lines of a group are joined by newlines, which no pattern crosses, and searched
    once per pattern.
    """

    def values(text: Column) -> Column:
        return F.array(*[_guarded(text, name, patterns) for name in patterns])

    joined = lambda g: F.array_join(F.transform(g, lambda x: x["line"]), "\n")
    return F.transform(groups, lambda g: let(joined(g), values))


def session_columns(values: Column, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> Column:
    """Columns of the rebuilt table: ``array<struct<place, name>>``.

    Types found, in alphabetical order of type; when positive and negative amounts both
    occur they move to the end as Debit and Credit. ``place`` is the pattern's position.
    """
    place = {t: i for i, t in enumerate(patterns)}
    paired = {"amounts": "Debit", "negative_amounts": "Credit"} if PAIR <= set(patterns) else {}
    occurs = lambda i: F.exists(values, lambda v: F.size(v[i]) > 0)
    found = F.array(*[occurs(i) for i in place.values()])

    def columns(found: Column) -> Column:
        has = lambda t: found[place[t]]
        both = has("amounts") & has("negative_amounts") if paired else F.lit(False)
        entry = lambda t, n: F.struct(F.lit(place[t]).alias("place"), F.lit(n).alias("name"))
        single = [
            F.when(has(t) & ~both if t in paired else has(t), entry(t, P.element_header(t)))
            for t in sorted(patterns)
        ]
        ends = [F.when(both, entry(t, n)) for t, n in paired.items()]
        return F.filter(F.array(*single, *ends), lambda c: c.isNotNull())

    return let(found, columns)


def session_row(values: Column, columns: Column) -> Column:
    """Cells of one group: the values of each type joined by ``' | '``."""
    return F.transform(columns, lambda c: F.array_join(F.get(values, c["place"]), " | "))


def scattered_parts(lines: Column, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> Column:
    """``struct<groups, values, columns>`` of a page; null when there is no such table.

    Values are extracted only once the page is known to have enough groups.
    """

    def parts(groups: Column) -> Column:
        found = let(
            session_values(groups, patterns),
            lambda v: F.struct(
                groups.alias("groups"),
                v.alias("values"),
                session_columns(v, patterns).alias("columns"),
            ),
        )
        return F.when(groups.isNotNull(), found)

    return let(sessions(page_hits(lines, patterns)), parts)


def scattered_table(lines: Column, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> Column:
    """The rebuilt table, header row first; null when there is none."""

    def table(parts: Column) -> Column:
        header = F.transform(parts["columns"], lambda c: c["name"])
        rows = F.transform(parts["values"], lambda v: session_row(v, parts["columns"]))
        return F.when(parts.isNotNull(), F.concat(F.array(header), rows))

    return let(scattered_parts(lines, patterns), table)


def _pages_with_values(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    return pages.filter(F.col("markdown").rlike(_NEEDED)) if patterns is P.ELEMENT_PATTERNS else pages


def scattered_elements(pages: DataFrame, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> DataFrame:
    """One row per typed value; ``position`` is its first index in the stripped line."""
    lines = page_lines(_pages_with_values(pages, patterns)).withColumn("line", strip(F.col("line")))
    found = lines.filter(_may_hold_elements(F.col("line"), patterns)).select(
        *PAGE, "line_no", "line", F.explode(line_elements(F.col("line"), patterns)).alias("e")
    )
    return found.select(
        *PAGE,
        "line_no",
        "e.type",
        "e.value",
        (F.expr("instr(line, e.value)") - 1).alias("position"),
    )


def _page_parts(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    parts = F.explode(F.array(scattered_parts(lines_of(F.col("markdown")), patterns)))
    return _pages_with_values(pages, patterns).select(*PAGE, parts.alias("p")).filter("p is not null")


def scattered_groups(pages: DataFrame, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> DataFrame:
    """Kept groups of each page with the lines they hold."""
    groups = _page_parts(pages, patterns).select(*PAGE, F.posexplode("p.groups").alias("pos", "g"))
    return groups.select(
        *PAGE, (F.col("pos") + 1).alias("group_no"), F.explode("g.line_no").alias("line_no")
    )


def scattered_headers(pages: DataFrame, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> DataFrame:
    return _page_parts(pages, patterns).select(*PAGE, F.col("p.columns.name").alias("header"))


def scattered_rows(pages: DataFrame, patterns: dict[str, str] = P.ELEMENT_PATTERNS) -> DataFrame:
    """One row per group with the page's columns and the group's cells."""
    groups = _page_parts(pages, patterns).select(
        *PAGE, F.col("p.columns").alias("columns"), F.posexplode("p.values").alias("pos", "v")
    )
    return groups.select(
        *PAGE,
        (F.col("pos") + 1).alias("row_no"),
        F.col("columns.name").alias("header"),
        session_row(F.col("v"), F.col("columns")).alias("cells"),
    )
