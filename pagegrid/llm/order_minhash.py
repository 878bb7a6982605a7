"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's tokens (runs of up to 16 non-space characters) give overlapping k-mers; each is
numbered by how often it has occurred before, and the pair is hashed. The hash deals the
pairs to bins. In each bin the smallest pairs are taken, put in the order of the text and
hashed as a tuple. Moving parts of a text around keeps its k-mers but changes the tuples, so
the share of equal tuples follows edit distance rather than overlap of sets.

One hash dealt to bins stands for as many independent hashes (one permutation hashing): every
k-mer is hashed once, and a bin is empty only in short texts.

Defined cases: null text is the empty text, whose fingerprint is empty; two empty
fingerprints are alike (1), an empty and another one are not (0). A text with fewer than k
tokens is one k-mer. Ties in doc_id are ordered by the text's hash, null ids come last.
A table of one row is its own next document. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrid.functions.text import let
from pagegrid.llm.common import text_of

TOKEN = r"\S{1,16}+"
KMER = 3
TUPLE = 2
BINS = 64
#: Bits for a k-mer's place in the text, for its hash within a bin, and for a tuple's hash.
PLACE, HASH, ENTRY = 24, 32, 32
#: Documents per block of neighbours, and most blocks (the driver gets that many bounds).
BLOCK, BLOCKS = 2000, 256


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1).cast("bigint")


def _starts(values: Column, shift: int) -> Column:
    """Indexes at which a sorted array's values, shifted right, change; the first one too."""
    return F.filter(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda i: (i == 0)
        | (F.shiftright(values[i], shift) != F.shiftright(F.get(values, i - 1), shift)),
    )


def _kmers(words: Column) -> Column:
    """Hashes of overlapping k-mers of word hashes."""
    return (
        F.when(
            F.size(words) >= KMER,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(words) - KMER, F.lit(0))),
                lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(KMER)]),
            ),
        )
        .when(F.size(words) > 0, F.array(F.xxhash64(words)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _numbered(keys: Column) -> Column:
    """(bin, hash, place) of every (k-mer, occurrence), packed; keys are sorted (k-mer, place)."""

    def pack(key: Column, occurrence: Column) -> Column:
        return let(
            F.xxhash64(F.shiftright(key, PLACE), occurrence),
            lambda h: F.shiftleft(h.bitwiseAND(_mask(BINS.bit_length() - 1)), HASH + PLACE)
            .bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, 64 - HASH), PLACE))
            .bitwiseOR(key.bitwiseAND(_mask(PLACE))),
        )

    def run(starts: Column):
        def one(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(keys))
            return F.transform(
                F.slice(keys, start + 1, end - start), lambda key, n: pack(key, n)
            )

        return one

    return let(_starts(keys, PLACE), lambda starts: F.flatten(F.transform(starts, run(starts))))


def _tuple(packed: Column, start: Column) -> Column:
    """Bin number and hash of the bin's smallest pairs in the order of the text."""
    bin_of = F.shiftright(packed[start], HASH + PLACE)
    least = F.filter(
        F.slice(packed, start + 1, TUPLE),
        lambda x: F.shiftright(x, HASH + PLACE) == F.shiftright(packed[start], HASH + PLACE),
    )
    by_place = F.sort_array(
        F.transform(
            least,
            lambda x: F.shiftleft(x.bitwiseAND(_mask(PLACE)), HASH).bitwiseOR(
                F.shiftright(x, PLACE).bitwiseAND(_mask(HASH))
            ),
        )
    )
    hashes = F.transform(by_place, lambda x: x.bitwiseAND(_mask(HASH)))
    return F.shiftleft(bin_of, ENTRY).bitwiseOR(F.shiftrightunsigned(F.xxhash64(hashes), 64 - ENTRY))


def signature(text: Column) -> Column:
    """Array of (bin, tuple hash), packed in bigints; empty for a text without tokens."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))

    def entries(packed: Column) -> Column:
        return let(
            _starts(packed, HASH + PLACE),
            lambda starts: F.transform(starts, lambda start: _tuple(packed, start)),
        )

    def of_kmers(kmers: Column) -> Column:
        keys = F.transform(
            kmers,
            lambda h, i: h.bitwiseAND(F.lit(-(1 << PLACE)).cast("bigint")).bitwiseOR(
                F.least(i.cast("bigint"), _mask(PLACE))
            ),
        )
        return F.when(
            F.size(kmers) > 0,
            let(F.sort_array(keys), lambda s: let(F.sort_array(_numbered(s)), entries)),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(words, lambda w: let(_kmers(w), of_kmers))


def likeness(a: Column, b: Column) -> Column:
    """Share of bins with equal tuples among the bins that either signature fills."""

    def bins(entries: Column) -> Column:
        return F.transform(entries, lambda x: F.shiftright(x, ENTRY))

    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / filled
    )


def fingerprint(entries: Column) -> Column:
    """A signature as hexadecimal text, ten digits per filled bin."""
    return F.array_join(F.transform(entries, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def _bounds(docs: DataFrame) -> list[int]:
    """Document ids that part the table into blocks of about equal size."""
    count = docs.count()
    blocks = min(BLOCKS, count // BLOCK + 1)
    if blocks < 2:
        return []
    shares = [k / blocks for k in range(1, blocks)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), shares)).first()[0]
    return sorted(set(found or []))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses, for every row.

    The edited text has its last half replaced by the start of the next document, in
    descending order of ids; the last one's next is the first. Texts are shuffled once, to
    blocks of neighbouring ids; the head of the next block is a guest at each block's end.
    """
    bounds = _bounds(docs)
    doc_id = F.col("doc_id").cast("bigint")
    block = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b < doc_id))
    rows = docs.select(
        doc_id.alias("doc_id"),
        text_of(docs).alias("text"),
        F.when(F.col("doc_id").isNull(), -1).otherwise(block).alias("block"),
    )
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("guest", F.lit(False))
    heads = rows.groupBy("block").agg(F.max(F.struct("doc_id", "tie", "text")).alias("head"))
    chain = Window.orderBy("block")  # at most BLOCKS + 1 rows
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asks = F.coalesce(F.lead("block").over(chain), F.first("block").over(whole))
    guests = heads.select("head.doc_id", "head.text", asks.alias("block"), "head.tie", F.lit(True).alias("guest"))
    order = Window.partitionBy("block").orderBy("guest", F.desc("doc_id"), F.desc("tie"))
    signed = rows.unionByName(guests).withColumn("entries", signature(F.col("text")))
    following = signed.select(
        "*",
        F.lead("text").over(order).alias("next_text"),
        F.lead("entries").over(order).alias("next_entries"),
    ).where("not guest")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), size - half)
    edited = F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half))
    return (
        following.select("doc_id", size.cast("bigint").alias("n_chars"), edited.alias("edited"), "entries", "next_entries")
        .withColumn("edited_entries", signature(F.col("edited")))
        .select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("entries")).alias("fingerprint"),
            fingerprint(F.col("edited_entries")).alias("edited_fingerprint"),
            likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
            likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
        )
    )
