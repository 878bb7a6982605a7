"""Secret scan: fixed patterns, and a battery of randomness tests for tokens no pattern knows.

A candidate is a long token of letters and digits. Its encoding is inferred from its alphabet;
then chi-squared uniformity over equal parts of that alphabet, a runs test and a test of
serial correlation say how well it agrees with uniform symbols, and Fisher's method combines
them. To every candidate belongs a decoy of equal length and alphabet, taken from the letters
of the same text: what ordinary text scores. Per length class, a candidate counts as a secret
at the least score at which the decoys that pass are few against the candidates that pass.
Decoy and candidate counts cover the whole corpus; they are one small table.

Defined cases: null text is the empty text. Repeated rows get equal answers. A corpus without
candidates adds no spans. An empty table gives no rows. Other columns are ignored by
``secret_spans`` and returned unchanged by ``redact``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import checkpoint, text_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Tokens with a digit, and all that is no letter: not part of a text's ordinary words.
NO_WORD = re.compile(r"(?<!\S)[^\s0-9]*[0-9]\S*|[^A-Za-z]+")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SYMBOLS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}
SMALL = frozenset("abcdef")
#: Parts of an alphabet that chi-squared compares.
PARTS = 4
#: Classes of length: 20 to 23, 24 to 27, ...; one for all from 64 on.
CLASS_WIDTH, CLASSES = 4, 12
BINS = 100
#: Share of false discoveries allowed, and the score below which nothing is a secret.
FALSE_SHARE = 0.05
LEAST_SCORE = 0.02
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find."""
    found = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                found.append((m.start(), 1, m.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds all symbols of the token."""
    symbols = set(token)
    return next((name for name, own in SYMBOLS.items() if symbols <= own), None)


def _tail(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def agreement(values: np.ndarray, size: int) -> float:
    """How well symbol numbers below ``size`` agree with independent uniform draws: 0 to 1."""
    n = len(values)
    expected = n / PARTS
    counts = np.bincount(values * PARTS // size, minlength=PARTS)
    # An alphabet that PARTS does not divide has parts of nearly equal size.
    widths = np.bincount(np.arange(size) * PARTS // size, minlength=PARTS) / size * n
    chi = float(((counts - widths) ** 2 / widths).sum()) if expected else 0.0
    uniform = math.erfc(math.sqrt(chi / 2)) + math.sqrt(2 * chi / math.pi) * math.exp(-chi / 2)
    high = values >= size / 2
    ups = int(high.sum())
    downs = n - ups
    if not ups or not downs:
        return 0.0
    mean = 2 * ups * downs / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    even = _tail((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    centred = values - values.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    unrelated = _tail((serial + 1 / n) * math.sqrt(n))
    # Fisher: minus twice the sum of logs is chi-squared with six degrees of freedom.
    half = -sum(math.log(max(p, 1e-12)) for p in (uniform, even, unrelated))
    return math.exp(-half) * (1 + half + half * half / 2)


def _class(length: int) -> int:
    return min((length - 20) // CLASS_WIDTH, CLASSES - 1)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float, float]]:
    """(start, end, length class, score, score of the decoy) of tokens that no span touches."""
    found: list[tuple[int, int, int, float, float]] = []
    if not DIGIT.search(text):
        return found
    letters = ""
    at = 0
    for m in CANDIDATE.finditer(text):
        token = m[0].rstrip("=")
        if not DIGIT.search(token) or not LETTER.search(token):
            continue
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        if any(s < m.end() and e > m.start() for s, _, e in spans[at : at + 3]):
            continue
        name = encoding_of(token)
        if name is None:
            continue
        alphabet = ALPHABETS[name]
        score = agreement(np.array([alphabet.index(c) for c in token]), len(alphabet))
        letters = letters or NO_WORD.sub("", text)
        plain = letters if SYMBOLS[name] & SMALL else letters.upper()
        plain = [c for c in plain if c in SYMBOLS[name]]
        shift = m.start() % max(1, len(plain) - len(token))
        decoy = np.array([alphabet.index(c) for c in plain[shift : shift + len(token)]])
        against = agreement(decoy, len(alphabet)) if len(decoy) == len(token) else 0.0
        found.append((m.start(), m.end(), _class(len(token)), score, against))
    return found


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
FOUND = pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("score", pa.float64()), ("decoy", pa.float64())]
)
SCANNED = (
    "doc_id bigint, base array<struct<start:bigint,kind:int,end:bigint>>, "
    "found array<struct<start:bigint,end:bigint,class:int,score:double,decoy:double>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base = [base_spans(x) for x in batch.column("text").to_pylist()]
        found = [
            candidates(x, spans)
            for x, spans in zip(batch.column("text").to_pylist(), base, strict=True)
        ]
        keys = [f.name for f in SPAN], [f.name for f in FOUND]
        columns = [
            pa.array([[dict(zip(k, s, strict=True)) for s in row] for row in rows], pa.list_(kind))
            for rows, k, kind in ((base, keys[0], SPAN), (found, keys[1], FOUND))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], names=["doc_id", "base", "found"]
        )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans of the fixed patterns, and scored candidates, for every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(_scan, SCANNED)


def thresholds(scanned: DataFrame, false_share: float = FALSE_SHARE) -> list[float]:
    """Least score of a secret per length class: at most CLASSES times BINS counts decide it."""
    one = scanned.select(F.explode("found").alias("f")).select("f.*")

    def binned(column: str):
        return F.least(F.floor(F.col(column) * BINS), F.lit(BINS - 1))

    counts = one.select(
        "class",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("decoy"), binned("score").alias("bin")),
                F.struct(F.lit(1).alias("decoy"), binned("decoy").alias("bin")),
            )
        ).alias("x"),
    )
    table = np.zeros((CLASSES, 2, BINS), np.int64)
    for r in counts.groupBy("class", "x.decoy", "x.bin").count().collect():
        table[r["class"], r["decoy"], r["bin"]] = r["count"]
    least = []
    for own, decoys in table:
        passing, false = np.cumsum(own[::-1])[::-1], np.cumsum(decoys[::-1])[::-1]
        good = np.flatnonzero((passing > 0) & (false <= false_share * passing))
        least.append(max(LEAST_SCORE, good[0] / BINS) if len(good) else 2.0)
    return least


def secret_spans(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, base and all spans as arrays of (start, kind number, end), ordered.

    The texts are read once: what the scan finds is kept in the shared folder while the
    thresholds are drawn from it.
    """
    scanned = checkpoint(scan(docs))
    least = thresholds(scanned, false_share)
    limits = F.array(*[F.lit(float(x)) for x in least])
    added = F.transform(
        F.filter("found", lambda f: f["score"] >= limits[f["class"]]),
        lambda f: F.struct(f["start"].alias("start"), F.lit(3).alias("kind"), f["end"].alias("end")),
    )
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def spans_text(spans: str):
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the fixed patterns' spans, and all spans as text."""

    def count(name: str, k: int):
        return F.size(F.filter(name, lambda s: s["kind"] == k)).cast("bigint")

    spans = secret_spans(docs)
    return spans.select(
        "doc_id",
        *[count("base", k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(spans_text("base"), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
        count("spans", 3).alias("n_random"),
    )


def redact_text(text: str, least: list[float]) -> str:
    """The text with every secret replaced by a mask; overlapping spans are one."""
    spans = base_spans(text)
    spans += [(s, 3, e) for s, e, k, score, _ in candidates(text, spans) if score >= least[k]]
    parts, at = [], 0
    for start, _, end in sorted(spans):
        if end > at:
            if start >= at:
                parts += [text[at:start], MASK]
            at = end
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars``, if there, counted anew.

    No row is dropped; null texts stay null. Two passes over the texts: counts for the
    thresholds, then the masking, neither of which shuffles a text.
    """
    least = thresholds(scan(docs))
    counted = docs.withColumn("text", F.col("text").cast("string"))
    place = counted.schema.names.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else redact_text(x, least) for x in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    masked = counted.mapInArrow(mask, counted.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return masked
