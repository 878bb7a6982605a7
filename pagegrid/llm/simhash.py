"""SimHash near-dedup: fingerprints linked at a small Hamming distance, found by vantage-point trees.

Two fingerprints that differ in at most 3 bits differ in at most one bit of their upper or of
their lower 32 bits. So there are two trees, one per half, searched with radius 1: a short
radius is what lets triangle bounds prune. The upper levels of each tree, fitted on a bounded
sample, cut the space into shards; a fingerprint lives in one shard per tree and also visits
the shards that its radius overlaps. Each shard is searched by a tree of its own, and pairs
are confirmed on all 64 bits. A shard returns links that connect its pairs, not all pairs.

Defined cases: null and empty texts have fingerprint zero and are linked like any other. Rows
repeated with the same id get the same answer. Null ids are never the smallest unless all ids
of a group are null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import checkpoint, keep_rows, spread_lookup, text_key, text_of
from pagegrid.llm.components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints from which the upper levels of the trees are fitted; every one is indexed.
SAMPLE = 16_384
#: Fingerprints that a shard should hold, visitors not counted.
SHARD = 16_384
LEAF = 192
HALVES = (32, 0)
BLOCK = 65_536
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str) -> int:
    """Unsigned 64-bit fingerprint of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    total = len(words) - SHINGLE + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, total)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        block = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [simhash(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))],
            names=[batch.schema.names[0], "mark"],
        )


def simhash_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, mark): the fingerprint of every row as a signed 64-bit number."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id bigint, mark bigint")


# Vantage-point trees ---------------------------------------------------------------------------


def _split(points: np.ndarray, shift: int, radius: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point, bound and distances that part the points best; None if none parts them.

    Of some candidates the one whose radius-wide border holds the fewest points wins, among
    bounds that leave at least an eighth of the points on either side.
    """
    mask = FULL if shift < 0 else np.uint64(0xFFFFFFFF) << np.uint64(shift)
    best = None
    for vantage in points[:: max(1, len(points) // 8)][:8]:
        far = np.bitwise_count((points ^ vantage) & mask).astype(np.int16)
        ends = np.cumsum(np.bincount(far, minlength=66))
        for bound in range(int(far.min()), int(far.max())):
            inside = ends[bound]
            if min(inside, len(points) - inside) * 8 < len(points):
                continue
            border = ends[bound + radius] - (ends[bound - radius] if bound >= radius else 0)
            if best is None or border < best[0]:
                best = (border, vantage, bound, far)
    return best and best[1:]


def _mask(shift: int) -> np.uint64:
    return FULL if shift < 0 else np.uint64(0xFFFFFFFF) << np.uint64(shift)


def fit_tree(points: np.ndarray, shift: int, depth: int, leaves: list[int]):
    """Upper levels: nested (vantage, bound, inside, outside), a leaf is its shard's number."""
    parts = _split(points, shift, 1) if depth and len(points) >= 16 else None
    if parts is None:
        leaves.append(len(leaves))
        return leaves[-1]
    vantage, bound, far = parts
    return (
        vantage,
        bound,
        fit_tree(points[far <= bound], shift, depth - 1, leaves),
        fit_tree(points[far > bound], shift, depth - 1, leaves),
    )


def _walk(tree, marks, places, home, shift, found) -> None:
    if not len(places):
        return
    if isinstance(tree, int):
        found.append((tree, places, home))
        return
    vantage, bound, inside, outside = tree
    far = np.bitwise_count((marks[places] ^ vantage) & _mask(shift)).astype(np.int16)
    near = far <= bound + 1
    _walk(inside, marks, places[near], (home & (far <= bound))[near], shift, found)
    away = far + 1 > bound
    _walk(outside, marks, places[away], (home & (far > bound))[away], shift, found)


def _router(trees):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
            for number, (shift, tree) in enumerate(trees):
                found: list = []
                everyone = np.arange(len(marks))
                _walk(tree, marks.view(np.uint64), everyone, np.ones(len(marks), bool), shift, found)
                for leaf, places, home in found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(places), leaf * len(trees) + number, np.int32)),
                            pa.array(marks[places]),
                            pa.array(home),
                        ],
                        names=["shard", "mark", "home"],
                    )

    return route


class Forest:
    """Links found so far, kept as stars: each node with the smallest one of its group."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append(np.stack([a, b]))
            self.size += len(a)
            if self.size > 1_000_000:
                self.shrink()

    def shrink(self) -> np.ndarray:
        """Replace the links by stars that connect the same nodes."""
        if not self.parts:
            return np.zeros((2, 0), np.uint64)
        nodes, place = np.unique(np.concatenate(self.parts, axis=1), return_inverse=True)
        a, b = place.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        star = np.flatnonzero(label != np.arange(len(nodes)))
        self.parts = [np.stack([nodes[star], nodes[label[star]]])]
        self.size = 0
        return self.parts[0]


def _compare(points: np.ndarray, asked: np.ndarray, forest: Forest) -> None:
    for p in range(0, len(points), 1024):
        some = points[p : p + 1024]
        for q in range(0, len(asked), 1024):
            few = asked[q : q + 1024]
            hit = np.bitwise_count(few[:, None] ^ some[None, :]) <= DISTANCE
            i, j = np.nonzero(hit)
            i, j = few[i], some[j]
            other = i != j
            forest.add(i[other], j[other])


def search(points: np.ndarray, asked: np.ndarray, shift: int, forest: Forest) -> None:
    """Link all pairs of a point and an asked fingerprint that are close.

    Once the half no longer parts the points (many share it), all 64 bits with the whole
    distance as radius do.
    """
    if not len(points) or not len(asked):
        return
    if len(points) <= LEAF:
        return _compare(points, asked, forest)
    radius = DISTANCE if shift < 0 else 1
    parts = _split(points, shift, radius)
    if parts is None:
        return search(points, asked, -1, forest) if shift >= 0 else _compare(points, asked, forest)
    vantage, bound, far = parts
    way = np.bitwise_count((asked ^ vantage) & _mask(shift)).astype(np.int16)
    search(points[far <= bound], asked[way <= bound + radius], shift, forest)
    search(points[far > bound], asked[way + radius > bound], shift, forest)
    return None


def _search_shard(rows: pa.Table) -> pa.Table:
    marks = rows["mark"].to_numpy().astype(np.int64).view(np.uint64)
    home = rows["home"].to_numpy(zero_copy_only=False).astype(bool)
    forest = Forest()
    search(marks[home], marks, HALVES[rows["shard"][0].as_py() % len(HALVES)], forest)
    links = forest.shrink()
    return pa.table({"a": links[0].view(np.int64), "b": links[1].view(np.int64)})


def near_links(marks: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct marks at distance 3 or less of each other."""
    count = marks.count()
    depth = max(0, math.ceil(math.log2(max(1, count / SHARD))))
    picked = marks.orderBy(F.xxhash64("mark")).limit(SAMPLE).toArrow()
    sample = picked["mark"].to_numpy().astype(np.int64).view(np.uint64)
    trees = [(shift, fit_tree(sample, shift, depth, [])) for shift in HALVES]
    routed = marks.mapInArrow(_router(trees), "shard int, mark bigint, home boolean")
    return routed.groupBy("shard").applyInArrow(_search_shard, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Groups may be as large as a third of all rows: equal fingerprints are collapsed before
    the search, and documents find their group through salted lookups.
    """
    marks = checkpoint(simhash_marks(docs))
    distinct = checkpoint(marks.groupBy("mark").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(near_links(distinct.select("mark")))
    linked = checkpoint(
        distinct.join(roots, F.col("mark") == F.col("node"), "left").select(
            "mark", F.coalesce("root", "mark").alias("root"), "first_id"
        )
    )
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = spread_lookup(linked.select("mark", "root"), smallest, ["root"], F.col("mark"))
    answered = spread_lookup(
        marks, groups.select("mark", "component_id"), ["mark"], F.col("doc_id")
    )
    return answered.select(
        "doc_id",
        F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id.

    Null ids come last, then the smallest SHA-256 of the text decides. Groups are of texts, so
    rows without an id, or of one id with several texts, stay apart unless their texts are near.
    """
    text = text_of(docs)
    texts = docs.select(text_key(text).alias("sha"), text.alias("text"))
    marks = checkpoint(texts.mapInArrow(_fingerprint_batches, "sha binary, mark bigint").distinct())
    distinct = checkpoint(marks.select("mark").distinct())
    roots = connected_components(near_links(distinct)).withColumnRenamed("node", "mark")
    groups = spread_lookup(marks, roots, ["mark"], F.col("sha"))
    groups = groups.select("sha", F.coalesce("root", "mark").alias("root"))
    ids = docs.select(text_key(text).alias("sha"), F.col("doc_id").cast("bigint").alias("id"))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "sha")
    first = (
        ids.groupBy("sha")
        .agg(F.min("id").alias("id"))
        .join(groups, "sha")
        .groupBy("root")
        .agg(F.min(rank).alias("first"))
    )
    kept = first.select(F.col("first.id").alias("id"), F.col("first.sha").alias("key"))
    return keep_rows(docs, text_key(text), kept)
