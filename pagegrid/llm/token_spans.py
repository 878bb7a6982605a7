"""Alignment of two tokenizers' tokens of the same text, and how often token pairs are linked.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model with byte
fallback. A's character offsets and the spans of B's piece messages give coarse cuts: places
where a whole character ends in both. Between them, where characters are split over tokens
(multibyte characters, byte-fallback pieces, the space that B adds), the tokens' decoded bytes
refine the cuts. A and B tokens between two cuts form a group, and all of them are linked.

Texts are aligned stretch by stretch where both tokenizers must end a token: before a space
that follows a non-space. A's pattern never matches over such a place, and no piece of B holds
one, so merges cannot cross it (``Aligner.splits`` is the test; other tokenizers align whole
texts). Stretches repeat, so their alignments are cached, which changes no result.

How many documents link a pair is counted over all rows. The pairs that most documents have
(``HOT`` of them, a few MB) go to every task; a pair may be in all documents, so joining these
would meet hot keys. The rest meet their counts in a join.

Defined cases: null and empty texts, and texts whose bytes either tokenizer does not give back,
have no tokens: zeros and an empty digest. Repeated rows and null ids are documents of their
own. Special tokens written in a text are plain text. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagegrid.llm.bpe import byte_letters
from pagegrid.llm.common import checkpoint, text_of, written

#: Pairs whose counts every task gets.
HOT = 1 << 18
CACHED, LONGEST_CACHED = 500_000, 48
#: Pairs gathered by a task before they are added up.
BLOCK = 1 << 20
#: Buckets per doubling of a count, to find the count from which on pairs are hot.
STEPS = 8
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")
#: Links of a group beyond which its ids are counted first.
WIDE = 4096
#: Texts whose stretches are looked up together, and characters aligned in one go.
TOGETHER, TEXT = 512, 1 << 16
TOKENS = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs binary"
)
SCORED = TOKENS.replace("pairs binary", "n_best bigint, count_sum bigint, keys array<bigint>, weights array<bigint>")
UNKNOWN = object()
NONE = np.zeros(0, np.int64)


class Cache:
    """Entries by stretch in two halves: when the newer is full, the older is forgotten."""

    def __init__(self, most: int) -> None:
        self.half, self.newer, self.older = most // 2, {}, {}

    def seen(self, text: str):
        if text in self.newer:
            return self.newer[text]
        entry = self.older.get(text, UNKNOWN)
        if entry is not UNKNOWN:
            self.keep(text, entry)
        return entry

    def keep(self, text: str, entry) -> None:
        if len(text) <= LONGEST_CACHED:
            if len(self.newer) >= self.half:
                self.older, self.newer = self.newer, {}
            self.newer[text] = entry


class Aligner:
    """Both tokenizers, from A's JSON text and B's model bytes."""

    def __init__(self, byte_bpe: str, pieces: bytes) -> None:
        rules = json.loads(byte_bpe)
        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        strings = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = {i: bytes([byte_of[c] for c in s]) for s, i in strings.items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [self._piece_bytes(name) for name in names]
        self.width = len(names)
        step = rules["pre_tokenizer"]
        plain = rules["normalizer"] is None and step["type"] == "ByteLevel" and step["use_regex"]
        inside = any(re.search("[^▁]▁", name) for name in names)
        as_is = self.b.normalize("a  b ") == "▁a▁▁b▁"
        self.splits = plain and as_is and not inside
        self.size_a = np.zeros(1 + max(self.bytes_a), np.int64)
        for i, code in self.bytes_a.items():
            self.size_a[i] = len(code)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        #: An id as text before the next one of its side, after A's last and after B's last.
        most = max(len(self.size_a), self.width)
        self.texts = [f"{i}{mark}" for mark in ",|;" for i in range(most)]
        self.most = most
        self.known = Cache(CACHED)

    @staticmethod
    def _piece_bytes(name: str) -> bytes:
        byte = BYTE_PIECE.match(name)
        return bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode()

    def cuts(self, text: str):
        """Ids of A and B, their byte ends in ``text``, and the ends that both have.

        ``text`` starts with a space, which B adds itself. None if a tokenizer's bytes are not
        the text's.
        """
        raw = text.encode()
        coded = self.a.encode(text, add_special_tokens=False)
        a, pieces = coded.ids, self.b.encode(text[1:], return_type="proto").pieces
        b = [p.id for p in pieces]
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        # Coarse cuts: A tokens that end with a whole character, by character offsets, and B
        # pieces with a surface (those without are a character's first bytes, or B's own space).
        place = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))
        spans = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        coarse_a = np.append(spans[1:, 0] >= spans[:-1, 1], True)
        stop_b = np.array([p.end for p in pieces], np.int64)
        coarse_b = stop_b > np.append(0, stop_b[:-1])
        whole = np.intersect1d(place[spans[coarse_a, 1]], stop_b[coarse_b] + 1, assume_unique=True)
        # What is left between them is cut where decoded bytes end together.
        a, b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        left_a, left_b = (x[~np.isin(x, whole, assume_unique=True)] for x in (ends_a, ends_b))
        return a, b, ends_a, ends_b, np.union1d(whole, np.intersect1d(left_a, left_b, assume_unique=True))

    def align_all(self, texts: list[str]) -> list[tuple | None]:
        """The entry of each stretch; none but the last may end with white space.

        An entry has the number of A tokens, B tokens, groups and links, the groups as text,
        and pair keys and their links as bytes (a key may come more than once). It is None if a
        tokenizer does not give the stretch's bytes back.
        """
        found = self.cuts("".join(texts)) if len(texts) == 1 or self.splits else None
        if found is None:
            return [None] if len(texts) == 1 else [self.align_all([x])[0] for x in texts]
        a, b, ends_a, ends_b, cuts = found
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        keys, weights, links = self.linked(a, b, group_a, group_b, len(cuts))
        # Tokens in the order of the groups' text: A's, then B's, and what follows each.
        group = np.append(group_a * 2, group_b * 2 + 1)
        order = np.argsort(group, kind="stable")
        group = group[order]
        last = np.append(group[1:] != group[:-1], True)
        mark = np.where(last, 1 + group % 2, 0)
        names = (mark * self.most + np.append(a, b)[order]).tolist()
        words = [self.texts[k] for k in names]
        ends = np.cumsum([len(x.encode()) for x in texts])
        groups = np.searchsorted(cuts, ends) + 1
        stops = [x.tolist() for x in (np.searchsorted(group_a, groups), np.searchsorted(group_b, groups), groups)]
        pairs = np.append(0, np.cumsum(links))[groups]
        size = np.append(0, np.cumsum(weights))[pairs].tolist()
        entries, i, j, g, p, w = [], 0, 0, 0, 0, 0
        keys, weights = keys.tobytes(), weights.tobytes()
        for x, y, h, q, v in zip(*stops, pairs.tolist(), size, strict=True):
            text = "".join(words[i + j : x + y])
            entries.append((x - i, y - j, h - g, v - w, text, keys[8 * p : 8 * q], weights[8 * p : 8 * q]))
            i, j, g, p, w = x, y, h, q, v
        return entries

    def linked(self, a, b, group_a, group_b, count: int):
        """Pair keys and links of all groups in order, and the number of keys of each group.

        Groups of many tokens are first reduced to their distinct ids.
        """
        times_a, times_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        sizes_a, sizes_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        if (sizes_a * sizes_b).max(initial=0) > WIDE:
            a, group_a, times_a = self._distinct(a, group_a)
            b, group_b, times_b = self._distinct(b, group_b)
            sizes_a, sizes_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        # Every A token, once for each B token of its group.
        own = sizes_b[group_a]
        left = np.repeat(np.arange(len(a)), own)
        step = np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        right = (np.cumsum(sizes_b) - sizes_b)[group_a[left]] + step
        return a[left] * self.width + b[right], times_a[left] * times_b[right], sizes_a * sizes_b

    @staticmethod
    def _distinct(ids, group):
        both, times = np.unique(np.stack([group, ids]), axis=1, return_counts=True)
        return both[1], both[0], times

    def stretches(self, text: str) -> list[str]:
        """``text``, which starts with a space, in stretches that align on their own."""
        if not self.splits:
            return [text]
        pieces = text[1:].split(" ")
        if all([x and not x[-1].isspace() for x in pieces]):
            return [" " + x for x in pieces]
        found, gap, last = [], " ", ""
        for x in pieces:
            if not x:
                gap += " "
                continue
            if found and last.isspace():
                found[-1] += [gap, x]
            else:
                found.append([gap, x])
            gap, last = " ", x[-1]
        if not found:
            return [text]
        found[-1].append(gap[1:])
        return ["".join(x) for x in found]

    def documents(self, texts: list[str | None]) -> Iterator[tuple[list[str], dict] | None]:
        """Per text its stretches and their entries; None if it has no tokens."""
        known = self.known
        for at in range(0, len(texts), TOGETHER):
            own = [self.stretches(" " + x) if x else [] for x in texts[at : at + TOGETHER]]
            found = {x: known.seen(x) for x in set().union(*own)}
            new, size, some = [x for x, entry in found.items() if entry is UNKNOWN], 0, []
            for k, x in enumerate(new, 1):
                some.append(x)
                size += len(x)
                # Only what follows a non-space can be aligned behind it.
                if size > TEXT or k == len(new) or x[-1].isspace():
                    found.update(zip(some, self.align_all(some), strict=True))
                    size, some = 0, []
            for x in new:
                known.keep(x, found[x])
            for stretches in own:
                parts = {x: found[x] for x in stretches}
                yield (stretches, parts) if parts and None not in parts.values() else None

    def summary(self, own: list[str], found: dict) -> tuple[int, int, int, int, str]:
        parts = [found[x] for x in own]
        sums = [sum([p[k] for p in parts]) for k in range(4)]
        digest = hashlib.sha256("".join([p[4] for p in parts])[:-1].encode()).hexdigest()
        return (*sums, digest)

    @staticmethod
    def pairs(own: list[str], found: dict) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pair keys of a text, ascending, and the number of links of each."""
        times = Counter(own)
        keys = np.frombuffer(b"".join([found[x][5] for x in times]), np.int64)
        weights = np.frombuffer(b"".join([found[x][6] for x in times]), np.int64)
        sizes = [len(found[x][5]) // 8 for x in times]
        weights = weights * np.repeat(np.fromiter(times.values(), np.int64, len(times)), sizes)
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(weights, first)


@functools.lru_cache(maxsize=2)
def aligner(byte_bpe: str, pieces: bytes) -> Aligner:
    """One per worker process and pair of tokenizer files."""
    return Aligner(byte_bpe, pieces)


def coded_pairs(keys: np.ndarray, weights: np.ndarray) -> bytes:
    """Ascending keys as differences, and weights, byte by byte of all numbers, compressed."""
    planes = np.stack([np.diff(keys, prepend=0), weights]).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def read_pairs(code: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(code), np.uint8).reshape(8, -1)
    keys, weights = np.ascontiguousarray(planes.T).view(np.int64).reshape(2, -1)
    return np.cumsum(keys), weights


NO_PAIRS = coded_pairs(NONE, NONE)


def _tokens(files):
    """Everything about a text but what depends on other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*files.value)
        for batch in batches:
            rows = [
                (*both.summary(*x), coded_pairs(*both.pairs(*x))) if x else (0, 0, 0, 0, "", NO_PAIRS)
                for x in both.documents(batch.column("text").to_pylist())
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            names = [x.split()[0] for x in TOKENS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        for code in batch.column("pairs").to_pylist():
            parts.append(read_pairs(code)[0])
            size += len(parts[-1])
            if size >= BLOCK:
                yield _added(parts)
                parts, size = [], 0
    yield _added(parts)


def _added(parts: list[np.ndarray]) -> pa.RecordBatch:
    keys, counts = np.unique(np.concatenate([NONE, *parts]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


def pair_counts(tokens: DataFrame, width: int) -> DataFrame:
    """(key, n, best): documents that link a pair, and whether no pair of its A id has more."""
    found = tokens.select("pairs").mapInArrow(_counter, "key bigint, n bigint")
    counts = checkpoint(found.groupBy("key").agg(F.sum("n").alias("n")))
    first = F.expr(f"key div {width}")
    highest = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("first", first).join(highest, "first")
    return checkpoint(joined.select("key", "n", (F.col("n") == F.col("most")).alias("best")))


def hot_from(counts: DataFrame, most: int) -> int:
    """The least bound for which at most ``most`` pairs have a count above it."""
    bucket = F.floor(F.log2("n") * STEPS).alias("bucket")
    sizes = counts.groupBy(bucket).agg(F.count("*").alias("pairs"), F.max("n").alias("top"))
    total, bound = 0, 0
    # As many rows as a count has bits, times STEPS.
    for row in sorted(sizes.collect(), reverse=True):
        total += row["pairs"]
        if total > most:
            bound = row["top"]
            break
    return bound


def _scorer(hot):
    """Sums over the hot pairs of a text, and its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = hot.value
        for batch in batches:
            rows = []
            for code in batch.column("pairs").to_pylist():
                keys, weights = read_pairs(code)
                place = np.searchsorted(known, keys)
                hit = np.zeros(len(keys), bool)
                inside = place < len(known)
                hit[inside] = known[place[inside]] == keys[inside]
                place = place[hit]
                n_best = int(weights[hit][best[place]].sum())
                rows.append((n_best, int((weights[hit] * counts[place]).sum()), keys[~hit], weights[~hit]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64()] * 2 + [pa.list_(pa.int64())] * 2
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            own = [batch.column(k) for k in range(batch.num_columns - 1)]
            names = [x.split()[0] for x in SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([*own, *arrays], names=names)

    return run


def linked_tokens(docs: DataFrame, byte_bpe: str, pieces: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    ``byte_bpe`` and ``pieces`` are the tokenizers' files, read by the driver and broadcast (a
    few MB each). A text's tokens are found once; its pairs are kept compressed in a table.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_bpe, encoding="utf-8") as a, open(pieces, "rb") as b:
        files = context.broadcast((a.read(), b.read()))
    width = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    tokens = written(texts.mapInArrow(_tokens(files), TOKENS), "tokens")
    counts = pair_counts(tokens, width)
    bound = hot_from(counts, hot)
    top = counts.where(F.col("n") > bound).orderBy("key").toArrow()
    table = context.broadcast(
        tuple(top[c].to_numpy() for c in ("key", "n")) + (np.array(top["best"].to_pylist(), bool),)
    )
    rows = written(tokens.mapInArrow(_scorer(table), SCORED), "scored")
    rows = rows.withColumn("tag", F.monotonically_increasing_id())
    rest = rows.select("tag", F.explode(F.arrays_zip("keys", "weights")).alias("x"))
    rare = rest.select("tag", "x.*").join(
        counts.where(F.col("n") <= bound), F.col("keys") == F.col("key")
    )
    sums = rare.groupBy("tag").agg(
        F.sum(F.when(F.col("best"), F.col("weights")).otherwise(0)).alias("more_best"),
        F.sum(F.col("weights") * F.col("n")).alias("more_sum"),
    )
    more = lambda c, extra: (F.col(c) + F.coalesce(F.col(extra), F.lit(0))).alias(c)
    return rows.join(sums, "tag", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        more("n_best", "more_best"),
        more("count_sum", "more_sum"),
        "groups_sha256",
    )
