"""The tables of one page text, the tokens of a line and the CSV of a page in plain Python.

The same rules as the columns of ``cells``, ``lines``, ``operators.ledgers``, ``operators.scattered``
and ``operators.context``, run by Arrow batches inside Spark's tasks: built-in functions interpret
every lambda and every line, which costs several times as much. ``\\d``, ``\\w``, ``\\s`` and
``str.isdigit`` are Unicode-wide here, as the classes in ``text`` are. No state beyond a page.

A pattern starts with the class of its first character, by which the engine skips, and looks
back over it afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate, compress

import pyarrow as pa

from pagegrid.functions import patterns as P
from pagegrid.functions.text import DIGIT_SIGNS, SPECIAL, WHITESPACE

# Functions name no other module, so that Python workers can get them by value.
_ELEMENT_HEADERS, _STOP_PHRASES, _MAX_CELL_LENGTH = P.ELEMENT_HEADERS, P.STOP_PHRASES, P.MAX_CELL_LENGTH
_LEDGER_HEADER_WORDS, _LEDGER_COLUMNS = P.LEDGER_HEADER_WORDS, P.LEDGER_COLUMNS
_LEDGER_LABELS, _LEDGER_WINDOW = P.LEDGER_LABELS, P.LEDGER_WINDOW

_GROUPED = r"\d{1,3}(?:,\d{3})*"
_AT_DIGIT = r"\d(?<!\w\d)"
#: Element types that hold no blank, in evaluation order; references come before the last one.
_IN_WORD = {
    "numbers": rf"{_AT_DIGIT}\d{{2,}}+(?!\w)",
    "amounts": rf"{_AT_DIGIT}\d{{0,2}}(?:,\d{{3}})*\.\d{{2}}(?!\w)",
    "negative_amounts": rf"-{_GROUPED}\.\d{{2}}(?!\w)",
    "dates": rf"{_AT_DIGIT}\d?/\d{{1,2}}/\d{{4}}(?!\w)",
    "codes": r"[A-Z](?<!\w[A-Z])[A-Z]{0,2}\d{2,6}[A-Z]?(?!\w)",
}
_TYPES_IN_ORDER = list(P.ELEMENT_PATTERNS)
_FINDERS = [(_TYPES_IN_ORDER.index(t), re.compile(p).finditer) for t, p in _IN_WORD.items()]
_REFERENCES = re.compile(r"\*[A-Z]+#:?[^\S\n]*[\w#\-]+").findall
_REFERENCES_AT = _TYPES_IN_ORDER.index("references")
_HAS_SHAPE = re.compile(r"\d(?:/\d+/\d|\.\d{2}|(?<!\w\d)\d{2,}+(?!\w))").search
_SIGNS = re.compile(
    "[" + re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{m[1]:0>8}", DIGIT_SIGNS.replace(r"\p{Nd}", r"\d")) + "]+"
)
_REFERENCE = re.compile(r"\b\w+\d").search
_DATES = re.compile(r"\d{2}/\d{2}/\d{4}").findall
# A run of digits and commas is tried at its start; further amounts inside it follow at once.
_AMOUNTS = re.compile(r"[\d,](?<![\d,][\d,])[\d,]*+\.\d{2}(?:[\d,]++\.\d{2})*+").findall
_AMOUNT = re.compile(r"[\d,]++\.\d{2}").findall
_CELL = re.compile(
    rf"\d+(?:\.\d{{1,2}})?|[A-Z]{{1,5}}|[A-Z]\d+|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|\$?{_GROUPED}(?:\.\d{{2}})?"
).fullmatch
_NOT_SPECIAL = str.maketrans("", "", SPECIAL)
_EDGE = WHITESPACE + "|"
_TYPES = [(t, f" {t} ", f" {t}") for t in P.LEDGER_TYPES]
_HEADINGS = ("#", "**")
_SECTION = ("#", "|")
_MAX_GAP = 2

Row = list[str]
Table = list[Row]


def split_cells(stripped: str) -> Row:
    """Stripped cells of a stripped pipe row without the outer pipes."""
    inner = stripped[1:] if stripped[:1] == "|" else stripped
    inner = inner[:-1] if inner[-1:] == "|" else inner
    return list(map(str.strip, inner.split("|")))


def _padded(rows: Table) -> Table:
    width = max(map(len, rows))
    return [row if len(row) == width else row + [""] * (width - len(row)) for row in rows]


def numbered_tables(lines: list[str]) -> list[tuple[list[int], Table]]:
    """Pipe tables, each with the numbers of the lines that its rows are."""
    tables: list[tuple[list[int], Table]] = []
    rows: Table = []
    numbers: list[int] = []
    for number, line in enumerate(lines):
        if line.count("|") >= 2:
            stripped = line.strip()
            if stripped.strip("|- "):
                rows.append(split_cells(stripped))
                numbers.append(number)
        elif rows:
            tables.append((numbers, _padded(rows)))
            rows, numbers = [], []
    if rows:
        tables.append((numbers, _padded(rows)))
    return tables


def pipe_tables(lines: list[str]) -> list[Table]:
    """Runs of lines with two pipes or more, separators skipped, rows padded to the widest."""
    return [rows for _, rows in numbered_tables(lines)]


def has_data_shape(line: str) -> bool:
    if _HAS_SHAPE(line):
        return True
    size = len(line)
    digits = size - len(_SIGNS.sub("", line))
    return digits / size > 0.1 and (size - len(line.translate(_NOT_SPECIAL))) / size > 0.05


def invoice_number(line: str) -> str | None:
    """First all-digit word of five digits or more in a line of two words or more."""
    if "*" in line:
        for label in _LEDGER_LABELS:
            line = line.replace(label, "")
    words = line.split()
    if len(words) >= 2:
        for word in words:
            if word.isdigit() and len(word) >= 5:
                return word
    return None


def amounts(line: str) -> list[str]:
    found = _AMOUNTS(line)
    if "".join(found).count(".") > len(found):
        return [part for chain in found for part in _AMOUNT(chain)]
    return found


def _money(window: list[str]) -> tuple[list[list[str]], list[list[str]]]:
    """Dates of the last pipe line that reaches a position, per date pair; the same for amounts.

    Only lines with a date or an amount decide, so a digit need not be sought, and only lines whose
    slashes or points allow more of them than the lines below have.
    """
    pairs: list[list[str]] = []
    single: list[list[str]] = []
    for line in reversed(window):
        more_pairs, more = line.count("/") // 4 > len(pairs), line.count(".") > len(single)
        # Text in two cells: a pipe is left between the outer blanks and pipes.
        if (more_pairs or more) and "|" in line.strip(_EDGE):
            if more_pairs:
                dates = _DATES(line)
                pairs += [dates] * (len(dates) // 2 - len(pairs))
            if more:
                found = amounts(line)
                single += [found] * (len(found) - len(single))
    return pairs, single


def ledger_rows(window: list[str]) -> Table:
    """Rows of one ledger window, sorted by invoice number as text; see ``ledgers.ledger_rows``."""
    kinds: dict[str, str] = {}
    references: dict[str, str] = {}
    for line in window[1:]:
        line = line.strip()
        if line.startswith(_SECTION) or any([phrase in line for phrase in _STOP_PHRASES]):
            break
        number = invoice_number(line)
        if number is None or not has_data_shape(line):
            continue
        kinds.setdefault(number, "")
        for kind, inside, end in _TYPES:
            if inside in line or line.endswith(end):
                kinds[number] = kind
                break
        reference = _REFERENCE(line)
        if reference:
            references[number] = reference[0]
    if not kinds:
        return []
    pairs, single = _money(window)
    rows = []
    for j, (number, kind) in enumerate(kinds.items()):
        first, second = pairs[j][2 * j : 2 * j + 2] if j < len(pairs) else ("", "")
        debit = single[j][j] if j < len(single) else ""
        rows.append([number, kind, references.get(number, ""), first, second, debit, ""])
    rows.sort()
    return rows


def ledger_tables(lines: list[str]) -> list[Table]:
    """For each header line with invoices, the fixed columns and the rows."""
    one, *others = _LEDGER_HEADER_WORDS
    found = []
    for k, line in enumerate(lines):
        if one in line and all(word in line for word in others):
            rows = ledger_rows(lines[k : k + _LEDGER_WINDOW])
            if rows:
                found.append([[*_LEDGER_COLUMNS], *rows])
    return found


class _Shapes(dict):
    """Class of a character: ``9`` a digit, ``A`` a plain capital, ``a`` another word character."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char.isdecimal():
            found = "9"
        elif "A" <= char <= "Z":
            found = "A"
        else:
            found = "a" if char == "_" or char.isalnum() else char
        self[code] = found
        return found


#: Shapes that a task remembers at a time, and the longest of them.
SHAPES, LONGEST = 20_000, 40


class _ByShape(dict):
    """What is known of words by their shape.

    Patterns see no more of a character than its class, so what holds for the shape, which is a
    text of that shape too, holds for every word of it.
    """

    def __init__(self, of: Callable) -> None:
        self.of = of

    def __missing__(self, shape: str):
        known = self.of(shape)
        if len(shape) <= LONGEST:
            if len(self) >= SHAPES:
                self.clear()
            self[shape] = known
        return known


#: A word put between lines; no word has its shape, since letters become ``a`` or ``A``.
_LINE_END = " b "


def _spans_of(shape: str) -> list[tuple[int, slice]] | None:
    """Places of the typed values in a word, ``(type, slice)``; None at the end of a line."""
    if shape == "b":
        return None
    return [(i, slice(*m.span())) for i, find in _FINDERS for m in find(shape)]


def _is_cell(shape: str) -> bool:
    return len(shape) <= _MAX_CELL_LENGTH and _CELL(shape) is not None


_shapes, _spans, _cells = _Shapes(), _ByShape(_spans_of), _ByShape(_is_cell)


def typed_groups(text: str, lines: list[str]) -> list[list[list[str]]]:
    """Values of each group of two lines or more that hold some, one list per type.

    A group goes on while the gap to the line before is at most two lines. Headings and bold lines
    hold nothing. Values of one type are in order of appearance.
    """
    words = text.replace("\n", _LINE_END).split()
    forms = text.translate(_shapes).replace("\n", _LINE_END).split()
    words.append("")
    forms.append("b")
    starred = "*" in text
    groups: list[list[list[str]]] = []
    sizes: list[int] = []
    group: list[list[str]] = []
    number, before, entered, skipped = 0, -1 - _MAX_GAP, False, False

    def enter() -> bool:
        """Puts the line into its group unless it is a heading."""
        nonlocal group, before
        if lines[number].lstrip().startswith(_HEADINGS):
            return False
        if number - before > _MAX_GAP:
            group = [[] for _ in _TYPES_IN_ORDER]
            groups.append(group)
            sizes.append(0)
        sizes[-1] += 1
        before = number
        return True

    for word, spans in zip(words, map(_spans.__getitem__, forms), strict=True):
        if spans:
            if not entered:
                entered, skipped = True, not enter()
            if not skipped:
                for i, at in spans:
                    group[i].append(word[at])
        elif spans is None:
            if starred and "*" in lines[number]:
                values = _REFERENCES(lines[number])
                if values and (not skipped if entered else enter()):
                    group[_REFERENCES_AT] += values
            number += 1
            entered = skipped = False
    return [group for group, size in zip(groups, sizes, strict=True) if size >= 2]


def scattered_table(text: str, lines: list[str]) -> Table | None:
    """The table rebuilt from typed values, header first; None unless two groups have two lines."""
    rows = typed_groups(text, lines)
    if len(rows) < 2:
        return None
    places = {t: i for i, t in enumerate(_TYPES_IN_ORDER) if any([row[i] for row in rows])}
    columns = [(places[t], _ELEMENT_HEADERS[t]) for t in sorted(places)]
    if "amounts" in places and "negative_amounts" in places:
        ends = [(places["amounts"], "Debit"), (places["negative_amounts"], "Credit")]
        columns = [c for c in columns if c[0] not in (ends[0][0], ends[1][0])] + ends
    return [[name for _, name in columns], *([" | ".join(row[i]) for i, _ in columns] for row in rows)]


def is_meaningful(table: Table, noise: frozenset[str]) -> bool:
    """More than one row, or a cell that is neither blank nor a known noise text."""
    return len(table) > 1 or any(c and c not in noise for row in table for c in map(str.strip, row))


def tables_of(text: str | None, methods: tuple[str, ...], noise: frozenset[str]) -> list[tuple[str, Table]]:
    """Meaningful tables of a page text with their methods, in method order."""
    if text is None:
        return []
    lines = text.split("\n")
    found: list[tuple[str, Table]] = []
    for method in methods:
        if method == "markdown":
            tables = pipe_tables(lines) if "|" in text else []
        elif method == "invoice":
            tables = ledger_tables(lines) if all(w in text for w in _LEDGER_HEADER_WORDS) else []
        else:
            table = scattered_table(text, lines)
            tables = [table] if table else []
        found += [(method, t) for t in tables if is_meaningful(t, noise)]
    return found


def _csv_field(value: str) -> str:
    quoted = any(c in value for c in '",\r\n')
    return '"' + value.replace('"', '""') + '"' if quoted else value


def _csv_row(row: Row) -> str:
    text = ",".join(map(_csv_field, row))
    return '""' if text == "" and len(row) == 1 else text


def _csv_rows(table: Table) -> str:
    """Records of a table; fields are looked at one by one only where some may need quotes."""
    text = "\r\n".join([",".join(row) for row in table])
    ends = len(table) - 1
    plain = '"' not in text and text.count("\r") == ends == text.count("\n")
    if plain and text.count(",") == sum(map(len, table)) - len(table) and min(map(len, table)) > 1:
        return text
    return "\r\n".join(map(_csv_row, table))


def csv_text(tables: list[Table]) -> str:
    """CSV text of all tables of a page; from the second on, each is announced by its number."""
    parts = []
    for index, table in enumerate(tables, 1):
        if index > 1:
            parts.append(f"\r\n--- Table {index} ---")
        if table:
            parts.append(_csv_rows(table))
    return "\r\n".join([*parts, ""]) if parts else ""


def nested_tables(pages: list[list[tuple[str, Table]]]) -> pa.Array:
    """Tables of pages as an Arrow array of ``array<struct<method, rows>>``."""
    tables = [t for page in pages for t in page]
    rows = [row for _, table in tables for row in table]

    def lists(lengths: list[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(accumulate(lengths, initial=0), pa.int32()), values)

    cells = pa.array([cell for row in rows for cell in row], pa.string())
    by_table = lists([len(table) for _, table in tables], lists(list(map(len, rows)), cells))
    methods = pa.array([method for method, _ in tables], pa.string())
    fields = pa.StructArray.from_arrays([methods, by_table], ["method", "rows"])
    return lists(list(map(len, pages)), fields)


#: Cells of a row that decide which lines are related to it, and the fewest characters they have.
SIGNATURE_PARTS, SIGNATURE_LENGTH = 3, 4


def signature(cells: Row) -> Row:
    """The first cells, stripped as they are, longer than three characters."""
    return [c for c in cells if len(c) >= SIGNATURE_LENGTH][:SIGNATURE_PARTS]


class LineTokens:
    """Cell-like tokens of the lines of a page, made when a line is first asked for."""

    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        self.shapes: list[str] = []
        self.found: dict[int, list[str]] = {}

    def __getitem__(self, number: int) -> list[str]:
        tokens = self.found.get(number)
        if tokens is None:
            if not self.shapes:
                self.shapes = "\n".join(self.lines).translate(_shapes).split("\n")
            tokens = self.found[number] = line_tokens(self.lines[number], self.shapes[number])
        return tokens


def line_tokens(line: str, shape: str) -> list[str]:
    """Words of a line and its parts between tabs, pipes and commas, cell-like ones only."""
    parts, forms = line.split(), shape.split()
    for separator in "\t|,":
        if separator in line:
            parts += map(str.strip, line.split(separator))
            forms += map(str.strip, shape.split(separator))
    return list(compress(parts, map(_cells.__getitem__, forms)))
