"""Error rates between a ground truth and a predicted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrid.functions.text import let, words


def _rate(truth_size: Column, predicted_size: Column, rate: Column) -> Column:
    return (
        F.when(predicted_size.isNull() | truth_size.isNull(), F.lit(None))
        .when((truth_size == 0) & (predicted_size == 0), 0.0)
        .when(truth_size == 0, 1.0)
        .otherwise(rate)
    )


#: Lengths up to which the whole matrix is cheaper than what follows.
SHORT = 256
#: Distances tried before the unbounded one; each costs its size times the length.
BOUNDS = (64, 512)
#: Step sizes of the search for a common start, which is found up to their sum.
_STEPS = [1 << k for k in range(24, -1, -1)]


def _common_start(a: Column, b: Column) -> Column:
    """Number of leading characters that two strings share, by binary search."""
    most = F.least(F.length(a), F.length(b))

    def longer(found: Column, step: Column) -> Column:
        tried = found + step
        fits = (tried <= most) & (F.left(a, tried) == F.left(b, tried))
        return F.when(fits, tried).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), longer)


def _without_start(pair: Column) -> Column:
    """Both strings reversed and without their common start."""
    return let(
        _common_start(pair["a"], pair["b"]) + 1,
        lambda start: F.struct(
            *[F.reverse(F.substr(pair[k], start)).alias(k) for k in ("a", "b")]
        ),
    )


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of whole strings, exact.

    Of long strings the common start and end are cut off, and a bound grows until the distance
    is within it, so that nearly equal texts cost their length times their distance.
    """

    def long(pair: Column) -> Column:
        within = [F.levenshtein(pair["a"], pair["b"], bound) for bound in BOUNDS]
        tries = [let(d, lambda found: F.when(found >= 0, found)) for d in within]
        return F.coalesce(*tries, F.levenshtein(pair["a"], pair["b"]))

    bound = F.struct(a.alias("a"), b.alias("b"))
    cut = let(bound, lambda pair: let(_without_start(pair), _without_start))
    return F.when(
        F.greatest(F.length(a), F.length(b)) <= SHORT, F.levenshtein(a, b)
    ).otherwise(let(cut, long))


def cer(truth: Column, predicted: Column) -> Column:
    """Character edits per character of the ground truth; may exceed 1."""
    rate = edit_distance(truth, predicted) / F.nullif(F.length(truth), F.lit(0))
    return _rate(F.length(truth), F.length(predicted), rate)


#: Code points beyond U+FFFF, less the two that stand for one side's own words.
SYMBOLS = 0x10FFFF - 0x10001


def _as_symbols(tokens: Column, shared: Column, side: int) -> Column:
    """A word list as a string: a code point per shared word, one for all words of one side."""

    def code(word: Column) -> Column:
        place = let(
            F.array_position(shared, word),
            lambda k: F.when(k > 0, k + 1).otherwise(F.lit(side)),
        )
        return F.lpad(F.hex(place + 0x10000), 8, "0")

    return F.decode(F.unhex(F.array_join(F.transform(tokens, code), "")), "UTF-32")


def word_distance(truth_words: Column, predicted_words: Column) -> Column:
    """Levenshtein distance over words, by the built-in string distance.

    Only words that both texts share need a symbol of their own; all others are told apart by
    their side alone. More than ``SYMBOLS`` shared words are an error, not a wrong number.
    """
    return let(
        F.struct(truth_words.alias("t"), predicted_words.alias("p")),
        lambda pair: let(
            F.array_intersect(pair["t"], pair["p"]),
            lambda v: F.when(
                F.size(v) <= SYMBOLS,
                let(
                    F.struct(
                        _as_symbols(pair["t"], v, 0).alias("t"),
                        _as_symbols(pair["p"], v, 1).alias("p"),
                    ),
                    lambda x: edit_distance(x["t"], x["p"]),
                ),
            ).otherwise(F.raise_error(F.lit("too many distinct words in a pair of texts"))),
        ),
    )


def wer(truth: Column, predicted: Column) -> Column:
    """Word edits per word of the ground truth; may exceed 1."""
    return let(
        F.struct(words(truth).alias("t"), words(predicted).alias("p")),
        lambda pair: _rate(
            F.when(pair["t"].isNotNull(), F.size(pair["t"])),
            F.when(pair["p"].isNotNull(), F.size(pair["p"])),
            word_distance(pair["t"], pair["p"]) / F.nullif(F.size(pair["t"]), F.lit(0)),
        ),
    )


def _positional(truth_parts: Column, predicted_parts: Column) -> Column:
    def rate(pair: Column) -> Column:
        same = F.filter(F.zip_with(pair["t"], pair["p"], lambda a, b: a == b), lambda eq: eq)
        share = F.size(same) / F.nullif(F.size(pair["t"]), F.lit(0))
        return _rate(
            F.when(pair["t"].isNotNull(), F.size(pair["t"])),
            F.when(pair["p"].isNotNull(), F.size(pair["p"])),
            1.0 - share,
        )

    return let(F.struct(truth_parts.alias("t"), predicted_parts.alias("p")), rate)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def cer_positional(truth: Column, predicted: Column) -> Column:
    """Share of ground-truth characters that differ at their own position."""
    return _positional(_characters(truth), _characters(predicted))


def wer_positional(truth: Column, predicted: Column) -> Column:
    """Share of ground-truth words that differ at their own position."""
    return _positional(words(truth), words(predicted))
