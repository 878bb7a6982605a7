"""Personal data by fixed patterns and by bootstrapped contexts, in DataFrame functions only.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers: the seed
entities. The word before an entity and its kind form a lexical pattern; the tokens that look
like an identifier form its instances. Patterns and instances are a bipartite graph over the
whole corpus. Scores go back and forth a fixed number of times: a pattern is as good as the
share of its instances that are known, weighed down when few are; an instance of unknown kind
is as good as its patterns together. Tokens after patterns of high confidence are then
personal data too.

Words that precede all kinds of text make poor patterns, and score so: the instances of a
word are all words after it, not only those that look like identifiers.

Defined cases: null text is the empty text. Repeated rows get equal answers. A corpus without
seeds adds no spans. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.functions.text import let
from pagegrid.llm.common import checkpoint, spread_lookup, text_of

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, written so that Java neither tries a run of characters again from each
#: of its places nor recurses over its length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a search.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ROUNDS = 3
#: Least known instances of a pattern, and least score of patterns and of what they discover.
SUPPORT = 5
CONFIDENCE = 0.8
#: A word and, after blanks, a token with a digit and four or more characters of identifiers.
TOKEN = (
    r"(?<!\S)\S{1,64}+[ \t]++(?=\S{0,40}[0-9])[A-Za-z0-9+(@#][A-Za-z0-9@._%+()/#-]{2,62}[A-Za-z0-9)]"
    r"(?![A-Za-z0-9@._%+()/#-])"
)
CONTEXT = 64
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern as (start, end, value); starts and ends in code points.

    The pieces between matches give the places: splitting and extracting walk over the text
    in the same way.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def place(values: Column) -> Column:
        return let(
            F.split(text, pattern, -1),
            lambda gaps: F.aggregate(
                values,
                F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("n"), empty.alias("spans")),
                lambda state, value: let(
                    state["at"] + F.length(gaps[state["n"]]),
                    lambda start: F.struct(
                        (start + F.length(value)).alias("at"),
                        (state["n"] + 1).alias("n"),
                        F.concat(
                            state["spans"],
                            F.array(
                                F.struct(
                                    start.alias("start"),
                                    (start + F.length(value)).alias("end"),
                                    value.alias("value"),
                                )
                            ),
                        ).alias("spans"),
                    ),
                ),
                lambda state: state["spans"],
            ),
        )

    return let(found, lambda values: F.when(F.size(values) > 0, place(values)).otherwise(empty))


def _word_before(text: Column, start: Column) -> Column:
    """The lower-case word that ends, blanks aside, where an entity starts; empty if none."""
    ahead = F.substring(
        text,
        F.greatest(start - CONTEXT + 1, F.lit(1)).cast("int"),
        F.least(start, F.lit(CONTEXT)).cast("int"),
    )
    return F.lower(F.regexp_extract(ahead, r"(\S+)[ \t]+$", 1))


def _validator(kind: str):
    return lambda match: _valid(kind, match["value"])


def _numbered(found: Column, number: int) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(number).alias("kind"),
            m["end"].alias("end"),
            m["value"].alias("value"),
        ),
    )


def _base(text: Column) -> Column:
    """Valid matches of all fixed patterns: (start, kind, end, value), ordered."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    parts = []
    for number, kind in enumerate(KINDS):
        needed = NEEDED[kind]
        worth = text.rlike("[0-9]") if needed is None else text.contains(needed)
        if kind == "ip":
            worth = worth & text.rlike("[0-9][.][0-9]")
        found = _numbered(F.filter(_matches(text, PATTERNS[kind]), _validator(kind)), number)
        parts.append(F.when(worth, found).otherwise(empty))
    return F.array_sort(F.concat(*parts))


def _tokens(text: Column, base: Column) -> Column:
    """Identifier-like tokens outside the fixed patterns' spans: (context, value, start, end)."""

    def token(match: Column) -> Column:
        return let(
            F.regexp_extract(match["value"], r"(\S+)$", 1),
            lambda value: F.struct(
                F.lower(F.regexp_extract(match["value"], r"^(\S+)", 1)).alias("context"),
                value.alias("value"),
                (match["end"] - F.length(value)).alias("start"),
                match["end"].alias("end"),
            ),
        )

    def free(one: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < one["end"]) & (one["start"] < b["end"]))

    empty = F.array().cast("array<struct<context:string,value:string,start:bigint,end:bigint>>")
    found = F.filter(F.transform(_matches(text, TOKEN), token), free)
    return F.when(text.rlike("[0-9]"), found).otherwise(empty)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, tag, base matches with the word before each, and tokens, for every row."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("tag"),
        text_of(docs).alias("text"),
    )
    text = F.col("text")
    found = rows.withColumn("base", _base(text))
    return found.select(
        "doc_id",
        "tag",
        F.transform(
            "base", lambda b: b.withField("context", _word_before(text, b["start"]))
        ).alias("base"),
        _tokens(text, F.col("base")).alias("tokens"),
    )


def _graph(found: DataFrame) -> DataFrame:
    """Edges (context, value, n, seed): how often a value follows a context word."""
    seeds = found.select(F.explode("base").alias("e")).select(
        "e.context", F.lower("e.value").alias("value"), F.lit(1).alias("seed")
    )
    others = found.select(F.explode("tokens").alias("e")).select(
        "e.context", F.lower("e.value").alias("value"), F.lit(0).alias("seed")
    )
    return (
        seeds.unionByName(others)
        .where("context <> ''")
        .groupBy("context", "value")
        .agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    )


def _word_counts(docs: DataFrame) -> DataFrame:
    """(context, total): how often each word occurs before another one in the whole corpus."""
    words = F.split(F.lower(text_of(docs)), r"\s+")
    return (
        docs.select(F.explode(words).alias("context"))
        .groupBy("context")
        .agg(F.count("*").alias("total"))
    )


def confident_contexts(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Context words whose score reaches the confidence after some rounds on the graph."""
    edges = _graph(found)
    supported = (
        edges.groupBy("context")
        .agg(F.sum(F.col("n") * F.col("seed")).alias("known"))
        .where(F.col("known") >= SUPPORT)
    )
    totals = supported.join(_word_counts(docs), "context").select("context", "total")
    edges = checkpoint(edges.join(totals, "context"))
    scored = edges.withColumn("belief", F.col("seed").cast("double"))
    for _ in range(rounds):
        weight = F.sum(F.col("n") * F.col("belief"))
        patterns = scored.groupBy("context").agg(
            (weight / F.greatest(F.max("total"), F.sum("n")) * weight / (weight + 1)).alias("score")
        )
        # What patterns together say of a value; a seed stays known.
        spread = spread_lookup(edges, patterns, ["context"], F.col("value"))
        doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999))))
        values = spread.groupBy("value").agg(
            F.when(F.max("seed") == 1, 1.0).otherwise(1 - F.exp(doubt)).alias("belief")
        )
        scored = checkpoint(spread_lookup(edges, values, ["value"], F.col("context")))
    return patterns.where(F.round("score", 9) >= CONFIDENCE).select("context")


def spans_text(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans as arrays of (start, kind number, end), ordered."""
    found = checkpoint(scan(docs))
    good = confident_contexts(docs, found)
    tokens = found.select("tag", F.explode("tokens").alias("t")).select(
        "tag", "t.context", "t.start", F.lit(len(KINDS)).alias("kind"), "t.end"
    )
    added = (
        tokens.join(good, "context")
        .groupBy("tag")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    )
    plain = F.transform(
        "base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))
    )
    none = F.array().cast(SPAN)
    return found.join(added, "tag", "left").select(
        "doc_id",
        plain.alias("base"),
        F.array_sort(F.concat(plain, F.coalesce("added", none))).alias("spans"),
    )


def personal_report(docs: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the fixed patterns' spans, and all spans as text."""
    spans = personal_spans(docs)

    def count(name: str, k: int) -> Column:
        return F.size(F.filter(name, lambda s: s["kind"] == k)).cast("bigint")

    return spans.select(
        "doc_id",
        *[count("base", k).alias(f"n_{KINDS[k]}") for k in range(len(KINDS))],
        F.sha2(spans_text("base"), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
        count("spans", len(KINDS)).alias("n_context"),
    )
