"""Fixed pattern sets: what counts as a number, an amount, a date, a code."""

from __future__ import annotations

from pagegrid.functions.text import DIGIT, INLINE_SPACE, WORD, WORD_END, WORD_START

_GROUPED = rf"{DIGIT}{{1,3}}(?:,{DIGIT}{{3}})*"
# A word that starts with a digit or a capital; the cheap test comes before the lookbehind.
_AT_DIGIT = rf"(?={DIGIT}){WORD_START}"
_AT_CAPITAL = rf"(?=[A-Z]){WORD_START}"

# Fixed values, in evaluation order: element types of lines whose table layout is lost.
ELEMENT_PATTERNS = {
    "numbers": rf"{_AT_DIGIT}{DIGIT}{{3,}}+{WORD_END}",
    "amounts": rf"{_AT_DIGIT}{_GROUPED}\.{DIGIT}{{2}}{WORD_END}",
    "negative_amounts": rf"-{_GROUPED}\.{DIGIT}{{2}}{WORD_END}",
    "dates": rf"{_AT_DIGIT}{DIGIT}{{1,2}}/{DIGIT}{{1,2}}/{DIGIT}{{4}}{WORD_END}",
    "references": rf"\*[A-Z]+#:?[{INLINE_SPACE}]*[{WORD}#\-]+",
    "codes": rf"{_AT_CAPITAL}[A-Z]{{1,3}}{DIGIT}{{2,6}}[A-Z]?{WORD_END}",
}

# A character that every match of the type contains; lines without it skip the pattern.
ELEMENT_MARKS = {"amounts": ".", "negative_amounts": "-", "dates": "/", "references": "*"}

# Column name shown for each element type, in alphabetical type order.
ELEMENT_HEADERS = {
    "amounts": "Amount",
    "codes": "Code",
    "dates": "Date",
    "negative_amounts": "Credit",
    "numbers": "Number",
    "references": "Reference",
}



def element_header(element_type: str) -> str:
    """Column name of an element type; a type of one's own is shown in title case."""
    return ELEMENT_HEADERS.get(element_type, element_type.title())


# Column profile of a document.
PROFILE_PATTERNS = {
    "numeric": rf"{_AT_DIGIT}{DIGIT}+(?:\.{DIGIT}+)?{WORD_END}",
    "date": rf"{_AT_DIGIT}{DIGIT}{{1,2}}[-/]{DIGIT}{{1,2}}[-/]{DIGIT}{{2,4}}{WORD_END}",
    "currency": rf"\$?{_GROUPED}(?:\.{DIGIT}{{2}})?{WORD_END}",
    "identifier": rf"{_AT_CAPITAL}[A-Z]{{2,}}+{DIGIT}++{WORD_END}|{_AT_DIGIT}{DIGIT}{{5,}}+{WORD_END}",
}

# Shapes of a single table cell.
CELL_PATTERNS = {
    "integer": rf"{DIGIT}+",
    "decimal": rf"{DIGIT}+\.{DIGIT}{{1,2}}",
    "capitals": r"[A-Z]{1,5}",
    "date": rf"{DIGIT}{{1,2}}[-/]{DIGIT}{{1,2}}[-/]{DIGIT}{{2,4}}",
    "currency": rf"\$?{_GROUPED}(?:\.{DIGIT}{{2}})?",
    "letter_digits": rf"[A-Z]{DIGIT}+",
    "status": r"[PU]",
}
MAX_CELL_LENGTH = 50

# Ledger pages.
LEDGER_HEADER_WORDS = ["Invoice No", "Type", "Reference"]
LEDGER_COLUMNS = ["Invoice No", "Type", "Reference", "Invoice Date", "Due Date", "Debit", "Credit"]
LEDGER_LABELS = ["*PO#:", "*CK#:"]
LEDGER_TYPES = ["I", "P", "D"]
LEDGER_WINDOW = 50
STOP_PHRASES = ["STRIVING TO EARN"]
NOISE_CELLS = ["---", "2022 General Requirements Invoice Backup"]
FINANCIAL_KEYWORDS = [
    "INVOICE NO",
    "TYPE",
    "REFERENCE",
    "INVOICE DATE",
    "DUE DATE",
    "DEBIT",
    "CREDIT",
    "STATEMENT NO",
    "ACCOUNT NUMBER",
]

LEDGER_DATE = rf"{DIGIT}{{2}}/{DIGIT}{{2}}/{DIGIT}{{4}}"
# ``\G`` resumes inside a run right after a match; elsewhere only the start of a run of
# digits and commas is tried, which keeps long runs linear.
LEDGER_AMOUNT = rf"(?:\G|(?<![{DIGIT},]))[{DIGIT},]++\.{DIGIT}{{2}}"
LEDGER_REFERENCE = rf"{WORD_START}([{WORD}]+{DIGIT}+)"
