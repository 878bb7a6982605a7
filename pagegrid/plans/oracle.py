"""The registered queries once more, as DuckDB SQL over the same tables.

Written relationally (exploded lines, joins, windows) rather than with the arrays the Spark
side uses, so the two check each other. RE2 has no lookaround and its ``\\b`` is ASCII;
where a word character outside ASCII could touch a match the class is spelled out.
"""

from __future__ import annotations

import re

from pagegrid.functions import patterns as P
from pagegrid.functions.text import DIGIT_SIGNS, SPACE, WHITESPACE
from pagegrid.operators.search import BROAD, DEFAULTS, FOCUSED_LISTS, FOCUSED_SPREAD
from pagegrid.plans.derived import ATTEMPT_LOGS, COMBOS, FOLDS, PER_FOLD


def _re2(char_class: str) -> str:
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", char_class)


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _select(body: str, ints: str = "", doubles: str = "", texts: str = "", bools: str = "") -> str:
    """Wrap a query so that its columns have the plain types of the Spark side."""
    casts = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()]
    casts += [f'ROUND(CAST("{c}" AS DOUBLE), 9) AS "{c}"' for c in doubles.split()]
    casts += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in texts.split()]
    casts += [f'CAST("{c}" AS BOOLEAN) AS "{c}"' for c in bools.split()]
    return f"SELECT {', '.join(casts)} FROM ({body}) AS result_rows"


def _with(*parts: str) -> str:
    *ctes, last = parts
    return f"WITH {', '.join(ctes)} {last}"


NL = "chr(10)"
WS = _text(WHITESPACE)
NOT_SPACE = f"'[^{_re2(SPACE)}]+'"
DIGITS = _re2(DIGIT_SIGNS)
NO_WORD = r"[^\p{L}\p{N}_]"

PAGE_NO = "doc_id page_no"


def _strip(text: str) -> str:
    return f"trim({text}, {WS})"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, {NOT_SPACE})"


def _pack(values: str) -> str:
    return f"array_to_string({values}, chr(31))"


def _count(text: str, char_class: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '[{char_class}]', '', 'g')))"


def _special(text: str) -> str:
    return f"(length({text}) - length(translate({text}, '.,#*:/-()$', '')))"


# Derived tables ---------------------------------------------------------------------------

DOC_PAGES = "pg AS (SELECT doc_id, 1 AS page_no, text AS markdown FROM documents)"
WEB_PAGES = "pg AS (SELECT page_id AS doc_id, 1 AS page_no, html AS markdown FROM pages)"
CONV_PAGES = "pg AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, text AS markdown FROM conversations)"

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _plain_amount(cents: str) -> str:
    return f"(({cents}) // 100) || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0')"


def _grouped_amount(cents: str) -> str:
    units = f"(({cents}) // 100)"
    grouped = (
        f"CASE WHEN {units} >= 1000 THEN ({units} // 1000) || ',' || "
        f"lpad(CAST({units} % 1000 AS VARCHAR), 3, '0') ELSE CAST({units} AS VARCHAR) END"
    )
    return f"({grouped}) || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0')"


def _day(days: str) -> str:
    return f"strftime(CAST(o_orderdate AS DATE) + CAST({days} AS INTEGER), '%m/%d/%Y')"


_NUMBER = "(100000 + o_orderkey * 13 + (i * 7) % 11)"
_KIND = "(['I', 'P', 'D', 'X'])[1 + (o_orderkey + i) % 4]"
_REF = "'PO' || o_custkey || 'A' || i"
INVOICE_PAGES = f"""pg AS (
SELECT o_orderkey // 2 AS doc_id, o_orderkey % 2 + 1 AS page_no,
 '# Account Statement' || {NL} || 'Invoice No Type Reference' || {NL}
 || array_to_string(list_transform(range(0, o_custkey % 12 + 1), lambda i:
      CASE WHEN i = 2 AND o_orderkey % 9 = 0 THEN 'STRIVING TO EARN your trust' || {NL} ELSE '' END
      || CASE WHEN i % 3 = 1 THEN {_NUMBER} || ' ' || {_REF} || ' ' || {_KIND}
         ELSE {_NUMBER} || ' ' || {_KIND}
              || CASE WHEN i % 6 = 5 THEN ' *CK#: ' ELSE ' *PO#: ' END || {_REF} END), {NL})
 || {NL} || {NL} || '| Invoice Date | Due Date | Amount |' || {NL} || '|---|---|---|' || {NL}
 || array_to_string(list_transform(range(0, o_custkey % 12 + 1), lambda i:
      '| ' || {_day('i')} || ' | ' || {_day('i + 30')} || ' | '
      || {_plain_amount(_CENTS + ' + i * 1001')} || ' |'), {NL})
 || {NL} || '| ' || {_day('0')} || ' | ' || {_day('30')} || ' | ' || {_day('1')} || ' | ' || {_day('31')}
 || ' | ' || {_plain_amount(_CENTS)} || ' | ' || {_plain_amount(_CENTS + ' + 1001')}
 || ' | ' || {_plain_amount(_CENTS + ' + 2002')} || ' |' || {NL} || 'Thank you'
 || CASE WHEN o_orderkey % 5 = 0 THEN {NL} || 'Invoice No | Type | Reference' || {NL}
         || '77001 I' || {NL} || '88002 D late' ELSE '' END AS markdown
FROM orders)"""

SCATTERED_PAGES = f"""pg AS (
SELECT o_orderkey // 4 AS doc_id, o_orderkey % 4 + 1 AS page_no,
 '# Ledger' || {NL} || array_to_string(list_transform(range(0, o_custkey % 4 + 1), lambda g:
   'AB' || lpad(CAST((o_custkey + g) % 1000 AS VARCHAR), 3, '0') || ' ' || {_day('g')} || {NL}
   || 'paid ' || {_grouped_amount(_CENTS + ' + g * 1001')}
   || CASE WHEN (o_orderkey + g) % 3 = 0
      THEN ' -' || {_grouped_amount(_CENTS + ' + g * 1001')} ELSE '' END
   || CASE WHEN (o_orderkey + g) % 4 = 1 THEN {NL} || '  *REF#: R-' || o_orderkey ELSE '' END
   || {NL} || '**' || repeat({NL}, (o_orderkey + g) % 3)), {NL}) AS markdown
FROM orders)"""

DOCS = """docs AS (
SELECT c_custkey AS doc_id, c_name AS name, CAST(c_custkey * 37 % 1001 AS DOUBLE) AS size_mb,
  CAST(c_custkey * 53 % 1001 AS DOUBLE) AS enhanced_mb, c_custkey * 7 % 40 + 1 AS total_pages
FROM customer)"""
PLAN = """ppc AS (
SELECT *, greatest(1, total_pages // CASE WHEN size_mb > 800 THEN 6 WHEN size_mb > 400 THEN 4
  ELSE 2 END) AS ppc FROM docs),
plan AS (
SELECT doc_id, start // ppc + 1 AS chunk_no, start + 1 AS from_page,
  least(start + ppc, total_pages) AS to_page
FROM (SELECT *, unnest(range(0, total_pages, ppc)) AS start FROM ppc))"""
RESULTS = """res AS (
SELECT doc_id, chunk_no,
  CASE WHEN (doc_id * 31 + chunk_no * 7) % 9 = 0 THEN 'error' ELSE 'ok' END AS status,
  to_page - from_page + 1 AS pages, (doc_id + chunk_no) % 5 AS tables,
  list_filter(range(1, to_page - from_page + 2), lambda p: (p + doc_id) % 3 = 0) AS table_pages
FROM plan)"""
OFFSETS = """done AS (
SELECT *, coalesce(sum(pages) OVER (PARTITION BY doc_id ORDER BY chunk_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_offset
FROM res WHERE status = 'ok')"""
FEATURES = f"""feat AS (
SELECT o_orderkey AS doc_id, 1 AS page_no, CAST(o_orderkey % 60 AS DOUBLE) / CAST(1000 AS DOUBLE)
  AS edge, CAST(o_orderkey // 60 % 12 AS DOUBLE) / CAST(1000 AS DOUBLE) AS line,
  repeat('total' || {NL}, o_custkey % 8) || 'order ' || o_orderkey || ' is ' || o_orderstatus AS text
FROM orders)"""
_LOGS = ", ".join(
    "[" + ", ".join(f"CAST({_text(e)} AS VARCHAR)" for e in log) + "]" for log in ATTEMPT_LOGS
)
ATTEMPTS = f"""att AS (
SELECT request_id, unnest(range(0, len(log))) AS attempt, unnest(log) AS error
FROM (SELECT o_orderkey AS request_id, ([{_LOGS}])[1 + o_orderkey % 8] AS log FROM orders)),
cls AS (SELECT *, CASE WHEN error IS NULL THEN 'ok'
  WHEN contains(lower(error), 'too large') OR contains(error, '600') THEN 'too_large'
  WHEN regexp_matches(lower(error), '504|gateway|timeout|502|503|500') THEN 'retry'
  ELSE 'fatal' END AS class FROM att)"""
SAMPLES = """samp AS (
SELECT item_id AS sample_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source,
  CASE WHEN item_id % 13 = 5 THEN ' ' || chr(9) || ' ' WHEN item_id % 17 <> 3 THEN text END
    AS ground_truth, item_id % 10 <> 9 AS has_image
FROM benchmark)"""
VALID = f"""valid AS (
SELECT * FROM samp WHERE ground_truth IS NOT NULL AND {_strip('ground_truth')} <> '' AND has_image)"""


def _degraded(combo: str) -> str:
    return f"""CASE WHEN {combo} <= 1 THEN translate(text, 'aeiou', 'eioua')
 WHEN {combo} = 2 THEN translate(text, '.,', '') WHEN {combo} = 3 THEN replace(text, 'the ', '')
 WHEN {combo} = 4 AND item_id % 2 = 1 THEN text || ' end' END"""


PREDICTIONS = f"""pred AS (
SELECT combo_id, item_id AS sample_id, {_degraded('combo_id')} AS predicted,
  CAST(0.95 AS DOUBLE) AS confidence,
  CAST(item_id % 7 AS DOUBLE) + combo_id * CAST(0.5 AS DOUBLE) AS seconds
FROM benchmark, range(0, {COMBOS}) AS c(combo_id))"""
PAIRS = f"""pair AS (
SELECT combo_id, item_id AS sample_id, text AS truth, coalesce({_degraded('combo_id')}, '') AS predicted
FROM benchmark, range(0, {COMBOS - 1}) AS c(combo_id))"""
TURN_PAIRS = """pair AS (
SELECT conv_id, turn, text AS truth,
  translate(replace(text, 'en', ''), 'aeioué', 'eiouae') AS predicted FROM conversations)"""
BASELINES = """base AS (
SELECT p_partkey AS set_id,
  CASE WHEN p_size % 5 <> 0 THEN CAST(2 AS DOUBLE) + CAST(p_size AS DOUBLE) / 50 END AS table_contrast_factor,
  CASE WHEN p_size % 3 <> 0 THEN CAST(0.5 AS DOUBLE) + CAST(p_size AS DOUBLE) / 200 END AS table_brightness_factor,
  CASE WHEN p_size % 7 <> 0 THEN CAST(1.5 AS DOUBLE) + CAST(p_size AS DOUBLE) / 40 END AS table_sharpness_factor,
  CASE WHEN p_size % 2 = 0 THEN CAST(9 AS DOUBLE) END AS bilateral_d
FROM part)"""

# Building blocks --------------------------------------------------------------------------

LINES = f"""lines AS (
SELECT doc_id, page_no, unnest(range(0, len(l))) AS line_no, unnest(l) AS line
FROM (SELECT doc_id, page_no, string_split(markdown, {NL}) AS l FROM pg))"""


def _is_table(line: str) -> str:
    return f"length({line}) - length(replace({line}, '|', '')) >= 2"


def _is_separator(line: str) -> str:
    return f"translate({_strip(line)}, '|- ', '') = ''"


def _is_data(s: str) -> str:
    """On a stripped line."""
    return rf"""({s} <> '' AND (regexp_matches({s}, '\p{{Nd}}+/\p{{Nd}}+/\p{{Nd}}+')
 OR regexp_matches({s}, '\p{{Nd}}+\.\p{{Nd}}{{2}}')
 OR regexp_matches({s}, '(?:^|{NO_WORD})\p{{Nd}}{{3,}}(?:$|{NO_WORD})')
 OR (CAST({_count(s, DIGITS)} AS DOUBLE) / length({s}) > CAST(0.1 AS DOUBLE)
  AND CAST({_special(s)} AS DOUBLE) / length({s}) > CAST(0.05 AS DOUBLE))))"""


_CELL_SHAPES = "|".join(f"(?:{p})" for p in P.CELL_PATTERNS.values())


def _is_cell(text: str) -> str:
    return (
        f"({text} <> '' AND length({text}) <= {P.MAX_CELL_LENGTH} "
        f"AND regexp_full_match({text}, '{_CELL_SHAPES}'))"
    )


# Pipe tables: islands of table lines, as rows of lists.
MD_ROWS = f"""island AS (
SELECT *, sum(CASE WHEN {_is_table('line')} THEN 0 ELSE 1 END) OVER
  (PARTITION BY doc_id, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island_no FROM lines),
split AS (
SELECT doc_id, page_no, island_no, line_no,
  list_transform(string_split(line, '|'), lambda x: {_strip('x')}) AS c
FROM island WHERE {_is_table('line')} AND NOT {_is_separator('line')}),
trimmed AS (
SELECT doc_id, page_no, island_no, line_no,
  c[CASE WHEN c[1] = '' THEN 2 ELSE 1 END : CASE WHEN c[len(c)] = '' THEN len(c) - 1 ELSE len(c) END]
    AS cells FROM split),
md AS (
SELECT doc_id, page_no, line_no, cells,
  dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY island_no) AS table_no,
  row_number() OVER (PARTITION BY doc_id, page_no, island_no ORDER BY line_no) AS row_no,
  min(line_no) OVER (PARTITION BY doc_id, page_no, island_no) AS first_line,
  max(len(cells)) OVER (PARTITION BY doc_id, page_no, island_no) AS width
FROM trimmed),
mdp AS (
SELECT * REPLACE (list_concat(cells, list_transform(range(0, width - len(cells)), lambda x: '')) AS cells)
FROM md)"""

_HEADER_TEST = " AND ".join(f"contains(line, {_text(w)})" for w in P.LEDGER_HEADER_WORDS)
_STOPS = " OR ".join(f"contains(s, {_text(p)})" for p in P.STOP_PHRASES)
_TYPE = " ".join(
    f"WHEN contains(s, ' {t} ') OR ends_with(s, ' {t}') THEN '{t}'" for t in P.LEDGER_TYPES
)
HEADERS = f"hdr AS (SELECT doc_id, page_no, line_no AS h, line FROM lines WHERE {_HEADER_TEST})"
WINDOW = f"""win AS (
SELECT l.doc_id, l.page_no, h, l.line_no, l.line, {_strip('l.line')} AS s
FROM hdr JOIN lines l ON l.doc_id = hdr.doc_id AND l.page_no = hdr.page_no
  AND l.line_no BETWEEN h AND h + 49),
stops AS (
SELECT doc_id, page_no, h, min(line_no) AS stop FROM win
WHERE line_no > h AND (starts_with(s, '#') OR starts_with(s, '|') OR {_STOPS}) GROUP BY ALL),
data AS (
SELECT w.doc_id, w.page_no, w.h, w.line_no, w.s FROM win w
LEFT JOIN stops t ON t.doc_id = w.doc_id AND t.page_no = w.page_no AND t.h = w.h
WHERE w.line_no > w.h AND (t.stop IS NULL OR w.line_no < t.stop)
  AND regexp_matches(w.s, '[{DIGITS}]') AND {_is_data('w.s')})"""
MONEY = rf"""money AS (
SELECT doc_id, page_no, h, line_no,
  regexp_extract_all(line, '\p{{Nd}}{{2}}/\p{{Nd}}{{2}}/\p{{Nd}}{{4}}') AS d,
  regexp_extract_all(line, '[\p{{Nd}},]+\.\p{{Nd}}{{2}}') AS a
FROM win WHERE contains(line, '|') AND regexp_matches(line, '[{DIGITS}]')
  AND len(list_filter(string_split(line, '|'), lambda x: {_strip('x')} <> '')) >= 2)"""
LEDGER = rf"""hits AS (
SELECT doc_id, page_no, h, line_no,
  list_filter(w, lambda x: regexp_full_match(x, '[{DIGITS}]{{5,}}'))[1] AS no,
  CASE {_TYPE} END AS type,
  nullif(regexp_extract(s, '([\p{{L}}\p{{N}}_]+\p{{Nd}}+)', 1), '') AS ref
FROM (SELECT *, {_words("replace(replace(s, '*PO#:', ''), '*CK#:', '')")} AS w FROM data)
WHERE len(w) >= 2),
inv AS (
SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, h ORDER BY first_line) - 1 AS j FROM (
SELECT doc_id, page_no, h, no, min(line_no) AS first_line,
  arg_max(type, line_no) FILTER (WHERE type IS NOT NULL) AS type,
  arg_max(ref, line_no) FILTER (WHERE ref IS NOT NULL) AS ref
FROM hits WHERE no IS NOT NULL GROUP BY doc_id, page_no, h, no)),
paid AS (
SELECT inv.doc_id, inv.page_no, inv.h, inv.no,
  arg_max(d[2 * j + 1], line_no) FILTER (WHERE len(d) >= 2 AND j < len(d) // 2) AS invoice_date,
  arg_max(d[2 * j + 2], line_no) FILTER (WHERE len(d) >= 2 AND j < len(d) // 2) AS due_date,
  arg_max(a[j + 1], line_no) FILTER (WHERE j < len(a)) AS debit
FROM inv JOIN money m ON m.doc_id = inv.doc_id AND m.page_no = inv.page_no AND m.h = inv.h
GROUP BY ALL),
led AS (
SELECT inv.doc_id, inv.page_no, inv.h, inv.no AS invoice_no,
  row_number() OVER (PARTITION BY inv.doc_id, inv.page_no, inv.h ORDER BY inv.no) AS row_no,
  coalesce(type, '') AS type, coalesce(ref, '') AS reference,
  coalesce(invoice_date, '') AS invoice_date, coalesce(due_date, '') AS due_date,
  coalesce(debit, '') AS debit, '' AS credit
FROM inv LEFT JOIN paid p ON p.doc_id = inv.doc_id AND p.page_no = inv.page_no AND p.h = inv.h
  AND p.no = inv.no)"""

_ELEMENT_RE2 = {
    "numbers": r"\b\d{3,}\b",
    "amounts": r"\b\d{1,3}(?:,\d{3})*\.\d{2}\b",
    "negative_amounts": r"-\d{1,3}(?:,\d{3})*\.\d{2}\b",
    "dates": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "references": rf"\*[A-Z]+#:?[{_re2(SPACE)}]*[\p{{L}}\p{{N}}_#\-]+",
    "codes": r"\b[A-Z]{1,3}\d{2,6}[A-Z]?\b",
}
_PROFILE_RE2 = {
    "numeric": r"\b\d+(?:\.\d+)?\b",
    "date": r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    "currency": r"\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b",
    "identifier": r"\b[A-Z]{2,}\d+\b|\b\d{5,}\b",
}
_ELEMENTS = " UNION ALL ".join(
    f"""SELECT doc_id, page_no, line_no, s, '{name}' AS type, {rank} AS rank,
 unnest(regexp_extract_all(s, '{pattern}')) AS value,
 unnest(range(0, len(regexp_extract_all(s, '{pattern}')))) AS k FROM sl"""
    for rank, (name, pattern) in enumerate(_ELEMENT_RE2.items())
)
ELEMENTS = f"""sl AS (
SELECT * FROM (SELECT doc_id, page_no, line_no, {_strip('line')} AS s FROM lines)
WHERE s <> '' AND NOT starts_with(s, '#') AND NOT starts_with(s, '**')),
el AS ({_ELEMENTS})"""
GROUPS = """ln AS (SELECT DISTINCT doc_id, page_no, line_no FROM el),
brk AS (
SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) <= 2
  THEN 0 ELSE 1 END AS b FROM ln),
ses AS (
SELECT *, sum(b) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g
FROM brk),
big AS (
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, g) AS n FROM ses) WHERE n >= 2),
numbered AS (
SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY g) AS group_no FROM big),
grp AS (
SELECT * FROM (SELECT *, max(group_no) OVER (PARTITION BY doc_id, page_no) AS n_groups FROM numbered)
WHERE n_groups >= 2)"""
_PAGE_COLUMNS = " UNION ALL ".join(
    [
        f"""SELECT doc_id, page_no, {i} AS pos, '{t}' AS type, '{n}' AS name FROM pt
 WHERE list_contains(types, '{t}')"""
        + (" AND NOT both_signs" if t in ("amounts", "negative_amounts") else "")
        for i, (t, n) in enumerate(P.ELEMENT_HEADERS.items())
    ]
    + [
        f"SELECT doc_id, page_no, {i}, '{t}', '{n}' FROM pt WHERE both_signs"
        for i, t, n in ((90, "amounts", "Debit"), (91, "negative_amounts", "Credit"))
    ]
)
SCATTERED = f"""ge AS (
SELECT el.*, grp.group_no FROM el JOIN grp ON el.doc_id = grp.doc_id AND el.page_no = grp.page_no
  AND el.line_no = grp.line_no),
pt AS (
SELECT doc_id, page_no, types,
  list_contains(types, 'amounts') AND list_contains(types, 'negative_amounts') AS both_signs
FROM (SELECT doc_id, page_no, list(DISTINCT type) AS types FROM ge GROUP BY ALL)),
cols AS ({_PAGE_COLUMNS}),
heads AS (
SELECT doc_id, page_no, list(name ORDER BY pos) AS header FROM cols GROUP BY ALL),
vals AS (
SELECT doc_id, page_no, group_no, type, string_agg(value, ' | ' ORDER BY line_no, rank, k) AS v
FROM ge GROUP BY ALL),
pairs AS (SELECT DISTINCT doc_id, page_no, group_no FROM grp),
sct AS (
SELECT p.doc_id, p.page_no, p.group_no, list(coalesce(v.v, '') ORDER BY c.pos) AS cells
FROM pairs p JOIN cols c ON c.doc_id = p.doc_id AND c.page_no = p.page_no
LEFT JOIN vals v ON v.doc_id = p.doc_id AND v.page_no = p.page_no AND v.group_no = p.group_no
  AND v.type = c.type GROUP BY ALL)"""

_LEDGER_HEADER = "[" + ", ".join(_text(c) for c in P.LEDGER_COLUMNS) + "]"
_NOISE = ", ".join(_text(n) for n in ["", *P.NOISE_CELLS])
TABLES = f"""alltab AS (
SELECT doc_id, page_no, 'markdown' AS method, 0 AS mr, first_line AS fl, row_no AS r, cells FROM mdp
UNION ALL
SELECT DISTINCT doc_id, page_no, 'invoice', 1, h, 0, {_LEDGER_HEADER} FROM led
UNION ALL
SELECT doc_id, page_no, 'invoice', 1, h, row_no,
  [invoice_no, type, reference, invoice_date, due_date, debit, credit] FROM led
UNION ALL
SELECT doc_id, page_no, 'scattered', 2, 0, 0, header FROM heads
UNION ALL
SELECT doc_id, page_no, 'scattered', 2, 0, group_no, cells FROM sct),
judged AS (
SELECT *, count(*) OVER t > 1 OR bool_or(len(list_filter(cells, lambda x:
  {_strip('x')} NOT IN ({_NOISE}))) > 0) OVER t AS keep
FROM alltab WINDOW t AS (PARTITION BY doc_id, page_no, mr, fl)),
tabs AS (
SELECT doc_id, page_no, method, cells,
  dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY mr, fl) AS table_no,
  row_number() OVER (PARTITION BY doc_id, page_no, mr, fl ORDER BY r) AS row_no
FROM judged WHERE keep)"""
EXTRACT = (LINES, MD_ROWS, HEADERS, WINDOW, MONEY, LEDGER, ELEMENTS, GROUPS, SCATTERED, TABLES)

_FIELD = """CASE WHEN regexp_matches(x, '[",' || chr(13) || chr(10) || ']')
 THEN '"' || replace(x, '"', '""') || '"' ELSE x END"""
CSV = f"""recs AS (
SELECT doc_id, page_no, table_no, row_no,
  CASE WHEN len(cells) = 1 AND cells[1] = '' THEN '""'
  ELSE array_to_string(list_transform(cells, lambda x: {_FIELD}), ',') END || chr(13) || {NL} AS rec
FROM tabs),
csv AS (
SELECT doc_id, page_no, string_agg(CASE WHEN table_no > 1 AND row_no = 1
  THEN chr(13) || {NL} || '--- Table ' || table_no || ' ---' || chr(13) || {NL} ELSE '' END || rec, ''
  ORDER BY table_no, row_no) AS csv_text FROM recs GROUP BY ALL)"""

SIGNATURES = f"""sig AS (
SELECT *, list_filter(list_transform(cells, lambda x: {_strip('x')}), lambda x: length(x) > 3)[1:3]
  AS signature, array_to_string(cells, ' ') AS row_text
FROM mdp)"""
RELATED = f"""rel AS (
SELECT sig.doc_id, sig.page_no, table_no, row_no, row_text, l.line_no, l.line
FROM sig JOIN lines l ON l.doc_id = sig.doc_id AND l.page_no = sig.page_no
WHERE len(signature) > 0 AND {_strip('l.line')} <> ''
  AND len(list_filter(signature, lambda x: contains(l.line, x))) >= len(signature) // 2 + 1)"""
_SPLIT_ON = lambda sep: (
    f"CASE WHEN contains(line, {sep}) THEN list_transform(string_split(line, {sep}), "
    f"lambda x: {_strip('x')}) ELSE [] END"
)
CANDIDATES = f"""tok AS (
SELECT *, list_concat({_words('line')}, {_SPLIT_ON('chr(9)')}, {_SPLIT_ON(_text('|'))},
  {_SPLIT_ON(_text(','))}) AS t FROM rel),
cand AS (
SELECT doc_id, page_no, table_no, row_no, line_no, unnest(t) AS candidate, unnest(range(0, len(t))) AS k,
  row_text FROM tok),
good AS (
SELECT * FROM cand WHERE NOT contains(row_text, candidate) AND {_is_cell('candidate')})"""


def _symbols(parts: str) -> str:
    return f"array_to_string(list_transform({parts}, lambda x: chr(CAST(list_position(v, x) AS INTEGER))), '')"


def _distance(truth: str, predicted: str, rows: str) -> str:
    """Edit distance of two lists; exact while a pair has at most 127 distinct entries."""
    return f"""(SELECT *, levenshtein({_symbols('a')}, {_symbols('b')}) AS distance FROM (
SELECT *, list_distinct(list_concat(a, b)) AS v FROM (
SELECT *, {truth} AS a, {predicted} AS b FROM {rows})))"""


def _chars(text: str) -> str:
    return f"list_filter(string_split({text}, ''), lambda x: x <> '')"


_RATE = """CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0 WHEN len(a) = 0 THEN 1
 ELSE CAST(distance AS DOUBLE) / len(a) END"""
_SAME = "len(list_filter(list_zip(a, b), lambda x: x[1] = x[2]))"
_POSITIONAL = f"""CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0 WHEN len(a) = 0 THEN 1
 ELSE CAST(1 AS DOUBLE) - CAST({_SAME} AS DOUBLE) / len(a) END"""
SCORES = f"""scored AS (
SELECT pred.*, ground_truth, ground_truth IS NOT NULL AND {_strip('ground_truth')} <> ''
  AND has_image AND predicted IS NOT NULL AS ok
FROM pred JOIN samp ON samp.sample_id = pred.sample_id),
okrows AS (SELECT * FROM scored WHERE ok),
ch AS (SELECT combo_id, sample_id, {_RATE} AS cer FROM {_distance(_chars('ground_truth'), _chars('predicted'), 'okrows')}),
wo AS (SELECT combo_id, sample_id, {_RATE} AS wer FROM {_distance(_words('ground_truth'), _words('predicted'), 'okrows')}),
sc AS (
SELECT s.combo_id, s.sample_id, cer, wer, CASE WHEN ok THEN confidence END AS confidence,
  CASE WHEN ok THEN seconds END AS seconds
FROM scored s LEFT JOIN ch ON ch.combo_id = s.combo_id AND ch.sample_id = s.sample_id
LEFT JOIN wo ON wo.combo_id = s.combo_id AND wo.sample_id = s.sample_id)"""
SCORED = (SAMPLES, PREDICTIONS, SCORES)
_MEANS = """coalesce(avg(cer), 1) AS cer, coalesce(avg(wer), 1) AS wer,
 coalesce(avg(confidence), 0) AS confidence, coalesce(avg(seconds), CAST('Infinity' AS DOUBLE)) AS seconds,
 count(cer) AS n_success"""
KFOLD = f"""ass AS (
SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5(sample_id || ':42'), sample_id) - 1
  AS position FROM (
SELECT *, ntile({FOLDS}) OVER (ORDER BY md5(sample_id || ':42'), sample_id) AS fold FROM valid))"""
FOLD_SCORES = f"""fs AS (
SELECT sc.combo_id, fold, {_MEANS} FROM sc JOIN ass ON ass.sample_id = sc.sample_id GROUP BY ALL)"""
CV = """cv AS (
SELECT combo_id, avg(cer) AS mean_cer, stddev_pop(cer) AS std_cer, avg(wer) AS mean_wer,
  stddev_pop(wer) AS std_wer, avg(confidence) AS mean_confidence,
  stddev_pop(confidence) AS std_confidence, count(*) AS fold_count
FROM fs GROUP BY combo_id)"""
SILENT_FOLD_SCORES = f"""fs AS (
SELECT combo_id, fold, {_MEANS}
FROM (SELECT DISTINCT combo_id FROM pred) CROSS JOIN range(1, {FOLDS} + 1) AS r(fold)
LEFT JOIN (SELECT sc.*, fold FROM sc JOIN ass ON ass.sample_id = sc.sample_id
  WHERE cer IS NOT NULL AND fold <> combo_id + 1) USING (combo_id, fold) GROUP BY ALL)"""
CV_ALL = (SAMPLES, VALID, PREDICTIONS, SCORES, KFOLD, FOLD_SCORES, CV)
_CV_METRICS = "mean_cer std_cer mean_wer std_wer mean_confidence std_confidence"


# Parameter ranges -------------------------------------------------------------------------


def _linspace(low: str, high: str, count: int) -> str:
    inner = ", ".join(
        f"{low} + CAST({i} AS DOUBLE) * (({high} - {low}) / CAST({count - 1} AS DOUBLE))"
        for i in range(count - 1)
    )
    return f"[{inner}, {high}]"


def _listed(spec: list | tuple) -> str:
    if isinstance(spec, tuple):
        low, high, count = spec
        return _linspace(f"CAST({low} AS DOUBLE)", f"CAST({high} AS DOUBLE)", count)
    return "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in spec) + "]"


FOCUSED_SQL = {
    k: _linspace(f"({k} - CAST({half} AS DOUBLE))", f"({k} + CAST({half} AS DOUBLE))", n)
    for k, (half, n) in FOCUSED_SPREAD.items()
} | {k: _listed(v) for k, v in FOCUSED_LISTS.items()}
BROAD_SQL = {k: _listed(v) for k, v in BROAD.items()}
SMALL_SQL = {k: FOCUSED_SQL[k] for k in FOCUSED_SPREAD}
FILLED = "filled AS (SELECT set_id, {} FROM base)".format(
    ", ".join(
        f"coalesce({k}, CAST({v} AS DOUBLE)) AS {k}"
        if k in (*FOCUSED_SPREAD, "bilateral_d")
        else f"CAST({v} AS DOUBLE) AS {k}"
        for k, v in DEFAULTS.items()
    )
)


_MEAN_BASELINE = "(SELECT 0 AS set_id, {} FROM filled)".format(
    ", ".join(f"avg({k}) AS {k}" for k in FOCUSED_SPREAD)
)


def _ranges(ranges: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT set_id, '{k}' AS parameter, unnest(range(0, len({r}))) AS position, "
        f"unnest({r}) AS value FROM filled"
        for k, r in ranges.items()
    )


def _random(ranges: dict[str, str], count: int, rows: str) -> str:
    picks = ", ".join(
        f"({r})[1 + CAST('0x' || substr(md5(set_id || ':' || combo_id || ':{k}:42'), 1, 8) AS BIGINT)"
        f" % len({r})] AS {k}"
        for k, r in ranges.items()
    )
    return f"SELECT set_id, combo_id, {picks} FROM {rows}, range(0, {count}) AS c(combo_id)"


def _grid(ranges: dict[str, str], counts: list[int], count: int) -> str:
    stride, total = 1, 1
    picks = []
    for (k, r), n in reversed(list(zip(ranges.items(), counts, strict=True))):
        picks.append(f"({r})[1 + combo_id // {stride} % {n}] AS {k}")
        stride *= n
    total = stride
    return f"""SELECT set_id, combo_id, {', '.join(picks)} FROM (
SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY md5(set_id || ':' || combo_id || ':42')) AS rn
FROM filled, range(0, {total}) AS c(combo_id)) WHERE rn <= {count}"""


def oracle_sql() -> dict[str, str]:
    """SQL per registered query."""
    sql: dict[str, str] = {}
    page = PAGE_NO

    # Lines and predicates.
    for name, source in (("page_lines", DOC_PAGES), ("page_lines_turns", CONV_PAGES)):
        sql[name] = _select(
            _with(source, LINES, "SELECT * FROM lines"), f"{page} line_no", texts="line"
        )
    for name, source in (("table_line_stats", DOC_PAGES), ("table_line_stats_ledger", INVOICE_PAGES)):
        sql[name] = _select(
            _with(
                source,
                LINES,
                f"SELECT *, {_is_separator('line')} AS is_separator FROM lines WHERE {_is_table('line')}",
            ),
            f"{page} line_no",
            texts="line",
            bools="is_separator",
        )
    sql["data_lines"] = _select(
        _with(DOC_PAGES, LINES, f"SELECT * FROM lines WHERE {_is_data(_strip('line'))}"),
        f"{page} line_no",
        texts="line",
    )
    counts = f"""SELECT doc_id, page_no, length(markdown) AS total_chars,
 {_count('markdown', DIGITS)} AS digits, {_count('markdown', r'\p{L}')} AS letters,
 {_special('markdown')} AS specials FROM pg"""
    sql["char_ratios"] = _select(
        _with(
            DOC_PAGES,
            f"""SELECT *, coalesce(CAST(digits AS DOUBLE) / nullif(total_chars, 0), 0) AS digit_ratio,
 coalesce(CAST(specials AS DOUBLE) / nullif(total_chars, 0), 0) AS special_ratio FROM ({counts})""",
        ),
        f"{page} total_chars digits letters specials",
        "digit_ratio special_ratio",
    )
    sql["word_counts"] = _select(
        _with(DOC_PAGES, f"SELECT *, len({_words('markdown')}) AS n_words FROM pg"),
        f"{page} n_words",
    )
    sql["tabular_tokens"] = _select(
        _with(
            DOC_PAGES,
            f"""SELECT doc_id, page_no, len(w) AS n_tokens,
 len(list_filter(w, lambda x: {_is_cell('x')})) AS n_tabular
 FROM (SELECT *, {_words('markdown')} AS w FROM pg)""",
        ),
        f"{page} n_tokens n_tabular",
    )
    hits = ", ".join(
        f"sum(len(regexp_extract_all(line, '{p}'))) AS \"{n}\""
        for n, p in (
            _ELEMENT_RE2 | {f"profile_{k}": v for k, v in _PROFILE_RE2.items()}
        ).items()
    )
    for name, source in (("pattern_counts", DOC_PAGES), ("pattern_counts_ledger", SCATTERED_PAGES)):
        sql[name] = _select(
            _with(source, LINES, f"SELECT doc_id, page_no, {hits} FROM lines GROUP BY ALL"),
            f"{page} "
            + " ".join([*_ELEMENT_RE2, *(f"profile_{k}" for k in _PROFILE_RE2)]),
        )
    found = ", ".join(
        f"{_pack(f'flatten(list(regexp_extract_all(line, {_text(p)}) ORDER BY line_no))')} AS {n}_patterns"
        for n, p in _PROFILE_RE2.items()
    )
    sql["column_patterns"] = _select(
        _with(
            SCATTERED_PAGES,
            LINES,
            f"SELECT doc_id, page_no, {found}, '' AS text_patterns FROM lines GROUP BY ALL",
        ),
        page,
        texts=" ".join([*(f"{n}_patterns" for n in _PROFILE_RE2), "text_patterns"]),
    )
    found = ", ".join(
        f"sum(len(regexp_extract_all(line, '{p}'))) AS {n}_count" for n, p in _PROFILE_RE2.items()
    )
    sql["column_pattern_counts"] = _select(
        _with(DOC_PAGES, LINES, f"SELECT doc_id, {found}, 0 AS text_count FROM lines GROUP BY ALL"),
        "doc_id " + " ".join([*(f"{n}_count" for n in _PROFILE_RE2), "text_count"]),
    )
    layout = f"""SELECT doc_id, page_no, count(*) AS n_lines,
 count(*) FILTER (WHERE len({_words('line')}) >= 4) AS n_tabular_lines FROM lines GROUP BY ALL"""
    for name, source in (("tabular_layout", CONV_PAGES), ("tabular_layout_documents", DOC_PAGES)):
        sql[name] = _select(
            _with(
                source,
                LINES,
                f"""SELECT *, n_tabular_lines > n_lines * CAST(0.2 AS DOUBLE) AS is_tabular
 FROM ({layout})""",
            ),
            f"{page} n_lines n_tabular_lines",
            bools="is_tabular",
        )
    keywords = " OR ".join(f"contains(upper(markdown), '{k}')" for k in P.FINANCIAL_KEYWORDS)
    for name, source in (("financial_keywords", DOC_PAGES), ("financial_keywords_ledger", INVOICE_PAGES)):
        sql[name] = _select(
            _with(source, f"SELECT *, {keywords} AS is_financial FROM pg"),
            page,
            bools="is_financial",
        )
    wide = f"""len(list_filter(string_split(text, {NL}), lambda x: len({_words('x')}) >= 4))
 > len(string_split(text, {NL})) * CAST(0.2 AS DOUBLE)"""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    sql["flag_pages"] = _select(
        _with(
            FEATURES,
            f"""SELECT *, reason <> 'none' AS flagged FROM (SELECT *, CASE WHEN {wide}
 THEN 'tabular_layout' WHEN edge > {d(0.03)} AND line > {d(0.005)} THEN 'density'
 WHEN edge > {d(0.025)} AND edge < {d(0.04)} AND line > {d(0.005)} THEN 'moderate_density'
 ELSE 'none' END AS reason FROM feat)""",
        ),
        page,
        texts="reason",
        bools="flagged",
    )
    sql["first_pages"] = _select(
        _with(CONV_PAGES, "SELECT * FROM pg WHERE page_no <= 3"), page, texts="markdown"
    )

    # Pipe tables.
    for name, source in (("markdown_tables", DOC_PAGES), ("markdown_tables_ledger", INVOICE_PAGES)):
        sql[name] = _select(
            _with(source, LINES, MD_ROWS, f"SELECT * REPLACE ({_pack('cells')} AS cells) FROM md"),
            f"{page} table_no row_no",
            texts="cells",
        )
    sql["padded_tables"] = _select(
        _with(
            INVOICE_PAGES, LINES, MD_ROWS, f"SELECT * REPLACE ({_pack('cells')} AS cells) FROM mdp"
        ),
        f"{page} table_no row_no",
        texts="cells",
    )
    sql["markdown_cells"] = _select(
        _with(
            DOC_PAGES,
            LINES,
            MD_ROWS,
            """SELECT doc_id, page_no, table_no, row_no, unnest(range(1, len(cells) + 1)) AS col_no,
 unnest(cells) AS value FROM mdp""",
        ),
        f"{page} table_no row_no col_no",
        texts="value",
    )
    sql["meaningful_tables"] = _select(
        _with(
            DOC_PAGES,
            *EXTRACT,
            "SELECT doc_id, page_no, method, table_no, count(*) AS n_rows FROM tabs GROUP BY ALL",
        ),
        f"{page} table_no n_rows",
        texts="method",
    )

    # Ledgers.
    sql["invoice_headers"] = _select(
        _with(INVOICE_PAGES, LINES, HEADERS, "SELECT *, h AS header_line FROM hdr"),
        f"{page} header_line",
        texts="line",
    )
    sql["invoice_window"] = _select(
        _with(
            INVOICE_PAGES, LINES, HEADERS, WINDOW,
            "SELECT *, h AS header_line, s AS line FROM data",
        ),
        f"{page} header_line line_no",
        texts="line",
    )
    sql["invoice_money_lines"] = _select(
        _with(
            INVOICE_PAGES, LINES, HEADERS, WINDOW, MONEY,
            f"SELECT *, h AS header_line, {_pack('d')} AS dates, {_pack('a')} AS amounts FROM money",
        ),
        f"{page} header_line line_no",
        texts="dates amounts",
    )
    sql["invoice_rows"] = _select(
        _with(
            INVOICE_PAGES, LINES, HEADERS, WINDOW, MONEY, LEDGER,
            "SELECT *, h AS header_line FROM led",
        ),
        f"{page} header_line row_no",
        texts="invoice_no type reference invoice_date due_date debit credit",
    )

    # Scattered values.
    for name, source in (
        ("scattered_elements", SCATTERED_PAGES),
        ("scattered_elements_documents", DOC_PAGES),
    ):
        sql[name] = _select(
            _with(source, LINES, ELEMENTS, "SELECT *, instr(s, value) - 1 AS position FROM el"),
            f"{page} line_no position",
            texts="type value",
        )
    sql["scattered_groups"] = _select(
        _with(SCATTERED_PAGES, LINES, ELEMENTS, GROUPS, "SELECT * FROM grp"),
        f"{page} group_no line_no",
    )
    sql["scattered_headers"] = _select(
        _with(
            SCATTERED_PAGES, LINES, ELEMENTS, GROUPS, SCATTERED,
            f"SELECT * REPLACE ({_pack('header')} AS header) FROM heads",
        ),
        page,
        texts="header",
    )
    sql["scattered_rows"] = _select(
        _with(
            SCATTERED_PAGES, LINES, ELEMENTS, GROUPS, SCATTERED,
            f"""SELECT s.doc_id, s.page_no, group_no AS row_no, {_pack('header')} AS header,
 {_pack('cells')} AS cells FROM sct s JOIN heads h ON h.doc_id = s.doc_id AND h.page_no = s.page_no""",
        ),
        f"{page} row_no",
        texts="header cells",
    )
    names = "(['Number', 'Debit', 'AMOUNT', 'code', 'Missing'])"
    sql["find_column"] = _select(
        _with(
            SCATTERED_PAGES, LINES, ELEMENTS, GROUPS, SCATTERED,
            f"""SELECT doc_id, page_no, name, nullif(coalesce(list_position(
 list_transform(header, lambda x: lower(x)), lower(name)), 0), 0) - 1 AS position
 FROM heads, (SELECT unnest({names}) AS name)""",
        ),
        f"{page} position",
        texts="name",
    )

    # Everything together.
    for name, source in (
        ("extract_tables", INVOICE_PAGES),
        ("extract_tables_scattered", SCATTERED_PAGES),
        ("extract_tables_documents", DOC_PAGES),
        ("extract_tables_web", WEB_PAGES),
    ):
        sql[name] = _select(
            _with(source, *EXTRACT, f"SELECT * REPLACE ({_pack('cells')} AS cells) FROM tabs"),
            f"{page} table_no row_no",
            texts="method cells",
        )
    for name, source in (("page_csv", INVOICE_PAGES), ("page_csv_documents", DOC_PAGES)):
        sql[name] = _select(
            _with(
                source, *EXTRACT, CSV,
                "SELECT *, doc_id || '_page_' || page_no || '.csv' AS file_name FROM csv",
            ),
            page,
            texts="file_name csv_text",
        )
    sql["csv_names"] = _select(
        _with(
            CONV_PAGES,
            """SELECT doc_id, file_name, CAST(regexp_extract(file_name, '_page_([0-9]+)\\.csv$', 1)
 AS BIGINT) AS page_no FROM (SELECT *, 'conv ' || doc_id || '_page_' || page_no || '.csv' AS file_name
 FROM pg)""",
        ),
        page,
        texts="file_name",
    )
    sql["run_summary"] = _select(
        _with(
            INVOICE_PAGES,
            *EXTRACT,
            "n AS (SELECT doc_id, page_no, count(DISTINCT table_no) AS n FROM tabs GROUP BY ALL)",
            """SELECT pg.doc_id, count(*) AS pages_processed, coalesce(sum(n.n), 0) AS tables_found,
 count(n.n) AS pages_with_tables, count(n.n) AS csv_files, 1 AS chunks_processed
 FROM pg LEFT JOIN n ON n.doc_id = pg.doc_id AND n.page_no = pg.page_no GROUP BY pg.doc_id""",
        ),
        "doc_id pages_processed tables_found pages_with_tables csv_files chunks_processed",
    )
    sql["run_table_pages"] = _select(
        _with(
            DOC_PAGES,
            *EXTRACT,
            """SELECT doc_id, page_no, count(DISTINCT table_no) AS n_tables,
 doc_id || '_page_' || page_no || '.csv' AS file_name FROM tabs GROUP BY doc_id, page_no""",
        ),
        f"{page} n_tables",
        texts="file_name",
    )

    # Context of a row.
    row = f"{page} table_no row_no"
    context = (INVOICE_PAGES, LINES, MD_ROWS, SIGNATURES)
    sql["row_signatures"] = _select(
        _with(*context, f"SELECT * REPLACE ({_pack('signature')} AS signature) FROM sig"),
        row,
        texts="signature",
    )
    sql["related_lines"] = _select(
        _with(*context, RELATED, "SELECT * FROM rel"), f"{row} line_no", texts="line"
    )
    sql["line_candidates"] = _select(
        _with(*context, RELATED, CANDIDATES, "SELECT * FROM good"),
        f"{row} line_no",
        texts="candidate",
    )
    sql["missing_row_data"] = _select(
        _with(
            *context,
            RELATED,
            CANDIDATES,
            """firsts AS (SELECT doc_id, page_no, table_no, row_no, candidate,
 min(line_no * 1000000 + k) AS place FROM good GROUP BY ALL)""",
            """SELECT doc_id, page_no, table_no, row_no,
 string_agg(candidate, chr(31) ORDER BY place) AS missing FROM firsts GROUP BY ALL""",
        ),
        row,
        texts="missing",
    )

    # Sources and sinks.
    sql["ocr_json_pages"] = _select(
        """SELECT doc_id, unnest(range(1, len(p) + 1)) AS page_no, unnest(p) AS markdown
 FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents)""",
        page,
        texts="markdown",
    )
    sql["split_response_pages"] = _select(
        """SELECT page_no, markdown, count(*) AS n FROM (
 SELECT unnest(range(1, len(p) + 1)) AS page_no, unnest(p) AS markdown
 FROM (SELECT string_split(text, chr(10) || chr(10)) AS p FROM documents)
 UNION ALL SELECT NULL, NULL FROM documents WHERE text IS NULL) GROUP BY ALL""",
        "page_no n",
        texts="markdown",
    )
    word_list = "list_filter(string_split(l, ' '), lambda w: NOT ends_with(w, '.'))"
    sql["ground_truth_text"] = _select(
        f"""SELECT doc_id AS sample_id, {_strip(f'''array_to_string(list_transform(
 string_split(text, chr(10) || chr(10)), lambda b: array_to_string(list_transform(
 string_split(b, chr(10)), lambda l: array_to_string({word_list}, '') || ' '), '') || chr(10)), '')''')}
 AS ground_truth FROM documents""",
        "sample_id",
        texts="ground_truth",
    )
    section = f"'## Page ' || page_no || {NL} || {NL} || markdown || {NL} || {NL} || '---' || {NL} || {NL}"
    sql["document_markdown"] = _select(
        _with(
            CONV_PAGES,
            f"""SELECT doc_id, (page_no - 1) // 4 AS part_no,
 CASE WHEN (page_no - 1) // 4 = 0 THEN '# Enhanced OCR Results' || {NL} || {NL} ELSE '' END
 || string_agg({section}, '' ORDER BY page_no) AS markdown FROM pg GROUP BY doc_id, (page_no - 1) // 4""",
        ),
        "doc_id part_no",
        texts="markdown",
    )
    sql["document_text"] = _select(
        _with(
            CONV_PAGES,
            f"""SELECT doc_id, (page_no - 1) // 4 AS part_no, count(*) AS n_pages,
 string_agg(markdown, {NL} ORDER BY page_no) AS text, avg(CAST(0.95 AS DOUBLE)) AS confidence
 FROM pg GROUP BY doc_id, (page_no - 1) // 4""",
        ),
        "doc_id part_no n_pages",
        "confidence",
        "text",
    )

    # Routing and chunks.
    sql["route_docs"] = _select(
        _with(
            DOCS,
            """SELECT *, CASE WHEN size_mb > 400 OR enhanced_mb > 600 THEN 'chunked' ELSE 'single' END
 AS route FROM docs""",
        ),
        "doc_id",
        "size_mb enhanced_mb",
        "name route",
    )
    plan = "doc_id chunk_no from_page to_page"
    sql["plan_chunks"] = _select(_with(DOCS, PLAN, "SELECT * FROM plan"), plan)
    sql["chunk_pages"] = _select(
        _with(
            DOCS,
            PLAN,
            """SELECT *, page_no - from_page + 1 AS local_page FROM
 (SELECT *, unnest(range(from_page, to_page + 1)) AS page_no FROM plan)""",
        ),
        "doc_id page_no chunk_no local_page",
    )
    sql["failed_chunks"] = _select(
        _with(
            DOCS,
            PLAN,
            RESULTS,
            """SELECT * FROM plan WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.doc_id = plan.doc_id
 AND res.chunk_no = plan.chunk_no AND status = 'ok')""",
        ),
        plan,
    )
    sql["global_pages"] = _select(
        _with(
            DOCS,
            PLAN,
            RESULTS,
            OFFSETS,
            """SELECT *, page_offset + local_page AS page_no FROM
 (SELECT *, unnest(range(1, pages + 1)) AS local_page FROM done)""",
        ),
        "doc_id chunk_no local_page page_no",
    )
    sql["chunk_combine"] = _select(
        _with(
            DOCS,
            PLAN,
            RESULTS,
            """SELECT doc_id, coalesce(sum(pages) FILTER (WHERE status = 'ok'), 0) AS pages_processed,
 coalesce(sum(tables) FILTER (WHERE status = 'ok'), 0) AS tables_found,
 coalesce(sum(len(table_pages)) FILTER (WHERE status = 'ok'), 0) AS pages_with_tables,
 count(*) AS chunks_processed FROM res GROUP BY doc_id""",
        ),
        "doc_id pages_processed tables_found pages_with_tables chunks_processed",
    )
    sql["combined_table_pages"] = _select(
        _with(
            DOCS,
            PLAN,
            RESULTS,
            OFFSETS,
            "SELECT doc_id, page_offset + p AS page_no FROM (SELECT *, unnest(table_pages) AS p FROM done)",
        ),
        page,
    )
    sql["renumber_headers"] = _select(
        _with(
            f"""body AS (
SELECT conv_id AS doc_id, turn + 1 AS chunk_no, '## Page 1' || {NL} || {NL} || text
 || CASE WHEN turn % 3 = 1 THEN {NL} || '## Page 99 appendix' ELSE '' END
 || {NL} || {NL} || '---' || {NL} || {NL} AS markdown FROM conversations)""",
            f"""ls AS (
SELECT doc_id, chunk_no, unnest(range(0, len(l))) AS line_no, unnest(l) AS line
FROM (SELECT *, string_split(markdown, {NL}) AS l FROM body))""",
            """num AS (
SELECT *, regexp_matches(line, '^## Page \\p{Nd}+') AS is_header,
 count(*) FILTER (WHERE regexp_matches(line, '^## Page \\p{Nd}+')) OVER
 (PARTITION BY doc_id ORDER BY chunk_no, line_no ROWS UNBOUNDED PRECEDING) AS n,
 min(chunk_no) OVER (PARTITION BY doc_id) AS first_chunk FROM ls)""",
            f"""SELECT doc_id, chunk_no, CASE WHEN chunk_no = min(first_chunk)
 THEN '# Enhanced OCR Results' || {NL} || {NL} ELSE {NL} END || string_agg(CASE WHEN is_header
 THEN regexp_replace(line, '^## Page \\p{{Nd}}+', '## Page ' || n) ELSE line END, {NL} ORDER BY line_no)
 AS markdown FROM num GROUP BY doc_id, chunk_no""",
        ),
        "doc_id chunk_no",
        texts="markdown",
    )
    sql["resolution_tier"] = _select(
        _with(
            DOCS,
            """pgs AS (
SELECT doc_id, page_no, (doc_id * 131 + page_no * 17) % 40 * 1048576 AS size_bytes,
 (doc_id + page_no) % 6 = 0 AS flagged
FROM (SELECT *, unnest(range(1, total_pages + 1)) AS page_no FROM docs))""",
            """run AS (
SELECT *, coalesce(sum(size_bytes) OVER (PARTITION BY doc_id ORDER BY page_no
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 count(*) OVER (PARTITION BY doc_id) AS total FROM pgs)""",
            """sticky AS (
SELECT *, bool_or(page_no > 1 AND (page_no - 1) % 5 = 0
 AND before * total > (page_no - 1) * 500 * 1048576)
 OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AND NOT flagged AS low FROM run)""",
            """SELECT doc_id, page_no, flagged, CASE WHEN low THEN 2.5 ELSE 4.5 END AS scale,
 CASE WHEN low THEN 250 ELSE 500 END AS dpi FROM sticky""",
        ),
        f"{page} dpi",
        "scale",
        bools="flagged",
    )
    sql["attempt_classes"] = _select(
        _with(ATTEMPTS, "SELECT * FROM cls"), "request_id attempt", texts="error class"
    )
    sql["retry_outcomes"] = _select(
        _with(
            ATTEMPTS,
            """SELECT request_id, CASE WHEN last_class = 'retry' AND attempts >= 3 THEN 'exhausted'
 ELSE last_class END AS outcome, attempts, delay_seconds FROM (
SELECT request_id, arg_max(class, attempt) AS last_class, count(*) AS attempts,
 coalesce(sum(CASE WHEN class = 'retry' THEN CASE attempt WHEN 0 THEN 10 WHEN 1 THEN 25 ELSE 0 END END), 0)
 AS delay_seconds FROM cls GROUP BY request_id)""",
        ),
        "request_id attempts delay_seconds",
        texts="outcome",
    )

    # Scores.
    key = "combo_id sample_id"
    chars = _distance(_chars("truth"), _chars("predicted"), "pair")
    word = _distance(_words("truth"), _words("predicted"), "pair")
    sql["cer"] = _select(_with(PAIRS, f"SELECT *, {_RATE} AS cer FROM {chars}"), key, "cer")
    sql["wer"] = _select(_with(PAIRS, f"SELECT *, {_RATE} AS wer FROM {word}"), key, "wer")
    sql["cer_turns"] = _select(
        _with(TURN_PAIRS, f"SELECT *, {_RATE} AS cer FROM {chars}"), "conv_id turn", "cer"
    )
    both = lambda a, b: f"(SELECT *, {a} AS a, {b} AS b FROM pair)"
    sql["cer_positional"] = _select(
        _with(
            PAIRS,
            f"SELECT *, {_POSITIONAL} AS cer FROM {both(_chars('truth'), _chars('predicted'))}",
        ),
        key,
        "cer",
    )
    sql["wer_positional"] = _select(
        _with(
            TURN_PAIRS,
            f"SELECT *, {_POSITIONAL} AS wer FROM {both(_words('truth'), _words('predicted'))}",
        ),
        "conv_id turn",
        "wer",
    )
    sql["sample_scores"] = _select(
        _with(*SCORED, "SELECT * FROM sc"), key, "cer wer confidence seconds"
    )
    sql["combo_scores"] = _select(
        _with(*SCORED, f"SELECT combo_id, {_MEANS} FROM sc GROUP BY combo_id"),
        "combo_id n_success",
        "cer wer confidence seconds",
    )
    sql["fold_scores"] = _select(
        _with(*CV_ALL[:-1], "SELECT * FROM fs"),
        "combo_id fold n_success",
        "cer wer confidence seconds",
    )
    sql["cv_scores"] = _select(
        _with(*CV_ALL, "SELECT * FROM cv"), "combo_id fold_count", _CV_METRICS
    )
    silent = (*CV_ALL[:-2], SILENT_FOLD_SCORES, CV)
    sql["cv_scores_silent"] = _select(
        _with(*silent, "SELECT * FROM cv"), "combo_id fold_count", _CV_METRICS
    )
    best = "SELECT * FROM cv ORDER BY round(mean_cer, 12), combo_id LIMIT 1"
    sql["best_combo"] = _select(_with(*CV_ALL, best), "combo_id fold_count", _CV_METRICS)
    sql["best_progress"] = _select(
        _with(
            *CV_ALL,
            """SELECT combo_id, m AS mean_cer FROM (SELECT combo_id, m, min(m) OVER (ORDER BY combo_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM (SELECT combo_id, round(mean_cer, 12) AS m FROM cv)) WHERE before IS NULL OR m < before""",
        ),
        "combo_id",
        "mean_cer",
    )

    # Samples and folds.
    samples = (SAMPLES, VALID)
    sql["mixed_samples"] = _select(
        _with(
            SAMPLES,
            f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sample_id) AS rn
 FROM samp) WHERE rn <= 2500 AND ground_truth IS NOT NULL AND {_strip('ground_truth')} <> ''
 AND has_image""",
        ),
        "sample_id",
        texts="source ground_truth",
        bools="has_image",
    )
    sql["min_samples_check"] = _select(
        _with(
            *samples,
            f"""SELECT count(*) AS n_samples, {2 * FOLDS} AS n_required,
 count(*) >= {2 * FOLDS} AS is_enough FROM valid""",
        ),
        "n_samples n_required",
        bools="is_enough",
    )
    sql["kfold_assign"] = _select(
        _with(*samples, KFOLD, "SELECT * FROM ass"), "sample_id fold position"
    )
    docs_fold = f"""SELECT doc_id AS sample_id, fold, row_number() OVER (PARTITION BY fold
 ORDER BY md5(doc_id || ':7'), doc_id) - 1 AS position FROM (
SELECT doc_id, ntile(7) OVER (ORDER BY md5(doc_id || ':7'), doc_id) AS fold FROM documents)"""
    sql["kfold_assign_documents"] = _select(docs_fold, "sample_id fold position")
    sql["kfold_split"] = _select(
        _with(
            *samples,
            KFOLD,
            f"""SELECT split, sample_id, CASE WHEN fold = split THEN 'validation' ELSE 'train' END AS role
 FROM ass, range(1, {FOLDS + 1}) AS f(split)""",
        ),
        "split sample_id",
        texts="role",
    )
    sql["fold_samples"] = _select(
        _with(*samples, KFOLD, f"SELECT * FROM ass WHERE position < {PER_FOLD}"),
        "fold position sample_id",
    )
    sql["combo_sample_grid"] = _select(
        _with(
            *samples,
            KFOLD,
            f"""SELECT combo_id, fold, sample_id FROM ass, range(0, {COMBOS}) AS c(combo_id)
 WHERE position < {PER_FOLD}""",
        ),
        "combo_id fold sample_id",
    )
    sql["deal_samples"] = _select(
        _with(
            *samples,
            f"""SELECT sample_id, (rn - 1) // 4 AS combo_id FROM (
SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS rn FROM valid) WHERE rn <= {4 * COMBOS}""",
        ),
        "sample_id combo_id",
    )

    # Parameter space.
    base = (BASELINES, FILLED)
    sql["params_with_defaults"] = _select(
        _with(*base, "SELECT * FROM filled"), "set_id", " ".join(DEFAULTS)
    )
    for name, ranges in (("param_ranges", FOCUSED_SQL), ("param_ranges_broad", BROAD_SQL)):
        sql[name] = _select(
            _with(*base, _ranges(ranges)), "set_id position", "value", "parameter"
        )
        sizes = " * ".join(f"CAST(len({r}) AS BIGINT)" for r in ranges.values())
        sql[name.replace("ranges", "space_size")] = _select(
            _with(*base, f"SELECT set_id, {sizes} AS n_combinations FROM filled"),
            "set_id n_combinations",
        )
    counts = [n for _, n in FOCUSED_SPREAD.values()]
    sql["param_grid"] = _select(
        _with(*base, _grid(SMALL_SQL, counts, 50)), "set_id combo_id", " ".join(SMALL_SQL)
    )
    sql["param_random"] = _select(
        _with(*base, _random(FOCUSED_SQL, 15, "filled")),
        "set_id combo_id",
        " ".join(FOCUSED_SQL),
    )
    sql["evaluation_budget"] = _select(
        _with(
            *base,
            f"""SELECT count(*) AS n_combos, count(*) * {FOLDS * PER_FOLD} AS n_evaluations
 FROM filled, range(0, 15)""",
        ),
        "n_combos n_evaluations",
    )
    combos = f"""combos AS ({_random(FOCUSED_SQL, COMBOS, _MEAN_BASELINE)})"""
    keys = [*FOCUSED_SQL, *_CV_METRICS.split(), "fold_count"]
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS key, CAST({k} AS DOUBLE) AS value FROM best" for k in keys
    )
    sql["best_params_kv"] = _select(
        _with(
            *CV_ALL,
            *base,
            combos,
            f"""best AS (SELECT * FROM ({best}) AS b JOIN combos ON combos.combo_id = b.combo_id)""",
            rows,
        ),
        "",
        "value",
        "key",
    )
    return sql
