"""Removal of every byte that lies in a string of ``LENGTH`` bytes which starts twice or more.

Anchors. Of all places in a window of ``LENGTH`` bytes one is the anchor: where the hash of the
next quarter of a window is least, the last one among equals. It depends on the window's bytes
alone, so equal windows have equal anchors at equal places, and a place is the anchor of some
window once in some 75 bytes. An anchor's context is what its windows can cover. Windows can
only be equal if their anchors' hashes are, so anchors whose hash occurs once are done with.

Shards. Equal contexts that occur twice are removed whole. Different contexts of one hash (the
edges of repeated passages) go to a shard of that hash: a suffix array by Larsson-Sadakane
refinement, Kasai common prefixes, and windows of one class (``LENGTH`` bytes in common, same
hash, same place by the anchor) are equal. A hash with more contexts than a shard should hold is
dealt out over several; these send the digests of their distinct windows, in order, to owners
of digest ranges, who sort the shards' runs together.

The answer for a text depends on the bytes around, not on its row: spans are found per distinct
text and given to all rows that have it. Anchors of equal texts are added up before they meet.
Contexts and texts are told apart by 128 bits of BLAKE2b and SHA-256.

Defined cases: null is the empty text. Texts shorter than ``LENGTH`` lose nothing. Repeated
rows count as repeats of their whole text. Null ids are ids like others. An empty table gives
no rows. Texts of any length are walked in blocks. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.common import SALTS, checkpoint, spread_lookup, text_of, written
from pagegrid.llm.suffixes import common_prefixes, joined, suffix_array

LENGTH = 200
#: Contexts that a shard should hold; a hash with more is dealt out.
SHARD = 2048
#: Window digests that an owner should merge.
OWNER = 1 << 20
#: Contexts that are handed on together.
CUTS = 1 << 14
#: Places judged at a time, and bits that number them in a hash.
BLOCK, PLACE = 1 << 16, np.uint64(17)
#: Bytes of texts that are walked in a row.
GROUP = 1 << 20
ONE = np.uint64(1)
SEED = 200

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, 258, dtype=np.uint64)
LETTERS, BASE, MIX = _DRAWN[:256], int(_DRAWN[256]) * 2 + 1, _DRAWN[257] * np.uint64(2) + ONE
CONTEXT = ["hash", "c1", "c2"]
TEXT = ["t1", "t2"]


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(count, base % (1 << 64), np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Anchors:
    """Anchors of byte strings for windows of a length."""

    def __init__(self, length: int) -> None:
        self.length, self.gram = length, max(1, length // 4)
        self.window = length - self.gram + 1
        most = BLOCK + 2 * length
        self.up, self.down = _powers(BASE, most), _powers(_inverse(BASE), most)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of every gram, by running sums of letters times powers modulo 2 ** 64."""
        size = len(data)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(LETTERS[data] * self.up[:size], out=sums[1:])
        found = (sums[self.gram :] - sums[: -self.gram]) * self.down[: size + 1 - self.gram]
        found ^= found >> np.uint64(32)
        found *= MIX
        return found ^ (found >> np.uint64(29))

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of all windows of ``data``."""
        _, places, marks = self.of_all([data])
        return places, marks

    def of_all(self, datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the string, place in it and hash of the anchors of all windows of many.

        Strings are walked in a row, which costs as little for many short ones as for a long
        one; windows over the end of a string are left out.
        """
        letters = np.frombuffer(b"".join(datas), np.uint8)
        sizes = np.array([len(d) for d in datas], np.int64)
        ends = np.cumsum(sizes)
        places, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at in range(0, max(0, len(letters) - self.length + 1), BLOCK):
            part = letters[at : at + BLOCK + self.length - 1]
            own = self.hashes(part)
            # Low bits number the places backwards: the least of equal hashes is the last one.
            number = np.arange(len(own), 0, -1, dtype=np.uint64)
            least = self._minima(own >> PLACE << PLACE | number)
            inside = np.ones(len(least), bool)
            for end in ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(part))].tolist():
                inside[max(0, end - self.length + 1 - at) : max(0, end - at)] = False
            least = least[inside]
            place = len(own) - (least & ((ONE << PLACE) - ONE)).astype(np.int64)
            # Anchors of windows in a row never go back: equal ones are neighbours.
            place = place[np.append(True, place[1:] != place[:-1])[: len(place)]]
            places.append(place + at)
            marks.append(own[place])
        place, mark = np.concatenate(places), np.concatenate(marks)
        new = np.append(True, place[1:] != place[:-1])[: len(place)]
        place, mark = place[new], mark[new]
        owner = np.searchsorted(ends, place, "right")
        return owner, place - (ends - sizes)[owner], mark

    def _minima(self, values: np.ndarray) -> np.ndarray:
        """The least of every ``window`` values in a row, by running minima of blocks."""
        size, width = len(values), self.window
        blocks = np.full(-(-size // width) * width, np.iinfo(np.uint64).max, np.uint64)
        blocks[:size] = values
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        return np.minimum(back[: size - width + 1], ahead[width - 1 : size])


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _groups(datas: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Strings in a row of some ``GROUP`` bytes together, and the number of the first one."""
    first, size = 0, 0
    for k, data in enumerate(datas):
        size += len(data)
        if size >= GROUP:
            yield first, datas[first : k + 1]
            first, size = k + 1, 0
    yield first, datas[first:]


def _hash_counter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, parts, size = Anchors(length), [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for _, datas in _groups(batch.column("text").cast(pa.large_binary()).to_pylist()):
                parts.append(anchors.of_all(datas)[2])
                size += len(parts[-1])
                if size >= OWNER:
                    yield _counted(parts)
                    parts, size = [np.zeros(0, np.uint64)], 0
        yield _counted(parts)

    return run


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    marks, counts = np.unique(np.concatenate(parts), return_counts=True)
    return _batch(["hash", "n"], [marks.view(np.int64), counts])


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, reach = Anchors(length), _reach(length)
        leads = [b"%d:" % k for k in range(reach + 1)]
        for batch in batches:
            t1, t2 = (batch.column(k).to_numpy() for k in range(2))
            for first, datas in _groups(batch.column("text").cast(pa.large_binary()).to_pylist()):
                owner, places, marks = anchors.of_all(datas)
                lows = np.maximum(places - reach, 0)
                digests = [
                    blake2b(leads[place - low] + datas[k][low : place + length], digest_size=16).digest()
                    for k, place, low in zip(owner.tolist(), places.tolist(), lows.tolist(), strict=True)
                ]
                both = _halves(digests)
                own = first + owner
                columns = [marks.view(np.int64), both[:, 0], both[:, 1], t1[own], t2[own], places]
                yield _batch([*CONTEXT, *TEXT, "at"], columns)

    return run


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed UTF-8, for the exchanges that must move them."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        keep = [k for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
        codes = [pack.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in keep], pa.array(codes, pa.binary())],
            names=[*[batch.schema.names[k] for k in keep], "code"],
        )


def _cutter(length: int):
    """From texts and the anchors asked for: each anchor's context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            asked = batch.column("asked")
            rows = pa.RecordBatch.from_struct_array(asked.flatten())
            at = rows.column("at").to_numpy()
            low = np.maximum(at - _reach(length), 0)
            lows, highs = low.tolist(), (at + length).tolist()
            contexts, done = [], 0
            ends = np.cumsum(asked.value_lengths().to_numpy()).tolist()
            for code, first, end in zip(batch.column("code"), [0, *ends], ends, strict=False):
                data = unpack.decompress(code.as_py())
                contexts += [data[lows[k] : highs[k]] for k in range(first, end)]
                if len(contexts) >= CUTS or end == len(at):
                    own = rows.slice(done, end - done)
                    more = {"low": pa.array(low[done:end]), "context": pa.array(contexts, pa.binary())}
                    yield pa.RecordBatch.from_arrays([more[c] if c in more else own.column(c) for c in CUT.names], schema=CUT)
                    contexts, done = [], end

    return run


CUT = pa.schema(
    [(c, pa.int64()) for c in (*CONTEXT, *TEXT, "n", "at", "shard")]
    + [("split", pa.bool_()), ("low", pa.int64()), ("context", pa.binary())]
)
CUT_DDL = (
    "hash bigint, c1 bigint, c2 bigint, t1 bigint, t2 bigint, n bigint, at bigint, shard bigint, "
    "split boolean, low bigint, context binary"
)
FOUND = "t1 bigint, t2 bigint, start bigint, stop bigint, shard bigint, d1 bigint, d2 bigint, asks boolean"


def _searcher(length: int):
    def search(rows: pa.Table) -> pa.Table:
        """Spans of a shard's contexts that occur once, and windows for other shards' sake."""
        parts = rows["context"].to_pylist()
        symbols, starts = joined(parts)
        sizes = np.array([len(p) for p in parts])
        shared = common_prefixes(symbols, order := suffix_array(symbols), starts, sizes, length)
        kinds = np.empty(len(symbols), np.int64)
        kinds[order] = np.cumsum(shared[order] < length)
        counts = np.maximum(sizes - length + 1, 0)
        part = np.repeat(np.arange(len(parts)), counts)
        step = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
        at, low, n = (rows[c].to_numpy() for c in ("at", "low", "n"))
        _, group = np.unique(rows["hash"].to_numpy(), return_inverse=True)
        # Windows by class, hash and place by the anchor: different contexts never hold one twice.
        place = step + (low - at)[part] + length
        key = (kinds[starts[part] + step] * (group.max() + 1) + group[part]) * (length + 1) + place
        _, first, where, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        again = times[where.reshape(-1)] > 1
        start = low[part] + step
        single = (n == 1)[part]
        hit = np.flatnonzero(again & single)
        # Runs of neighbouring windows are one span.
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (part[hit][1:] != part[hit][:-1]) | (start[hit][1:] > start[hit][:-1] + length)
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(hit)) - 1 if len(hit) else heads
        t1, t2 = rows["t1"].to_numpy(), rows["t2"].to_numpy()
        spans = [t1[part[hit[heads]]], t2[part[hit[heads]]], start[hit[heads]], start[hit[tails]] + length]
        split = np.array(rows["split"].to_pylist(), bool)
        sent = np.sort(first)
        sent = sent[split[part[sent]]]
        marks = [
            blake2b(b"%d:%d:%b" % (g, p, parts[k][s : s + length]), digest_size=16).digest()
            for g, p, k, s in zip(
                rows["hash"].to_numpy()[part[sent]].tolist(), place[sent].tolist(), part[sent].tolist(), step[sent].tolist(), strict=True
            )
        ]
        both = _halves(marks)
        asks = ~again[sent] & single[sent]
        windows = [t1[part[sent]], t2[part[sent]], start[sent], start[sent] + length]
        columns = [np.concatenate(pair) for pair in zip(spans, windows, strict=True)]
        shard = rows["shard"][0].as_py()
        none = pa.nulls(len(heads), pa.int64())
        ids = [pa.array(np.full(len(sent), shard)), pa.array(both[:, 0]), pa.array(both[:, 1])]
        more = [pa.concat_arrays([none, x.cast(pa.int64())]) for x in ids]
        flags = pa.concat_arrays([pa.nulls(len(heads), pa.bool_()), pa.array(asks)])
        names = [x.split()[0] for x in FOUND.split(", ")]
        return pa.table([*[pa.array(c) for c in columns], *more, flags], names=names)

    return search


def _merge(rows: pa.Table) -> pa.Table:
    """Windows that ask and that another shard has."""
    d1, d2, shard = (rows[c].to_numpy() for c in ("d1", "d2", "shard"))
    order = np.argsort(d1)
    near = d1[order][1:] == d1[order][:-1]
    if (near & (d2[order][1:] != d2[order][:-1])).any():
        order = np.lexsort((d2, d1))
        near = (d1[order][1:] == d1[order][:-1]) & (d2[order][1:] == d2[order][:-1])
    # A shard sends a window once, so that equal neighbours are of two shards.
    met = np.zeros(len(order), bool)
    met[order[1:][near]] = True
    met[order[:-1][near]] = True
    asks = rows["asks"].to_numpy()
    return rows.select([*TEXT, "start", "stop"]).filter(pa.array(asks & met))


def text_halves(text: Column) -> list[Column]:
    """The first 128 bits of a text's SHA-256 as two numbers."""
    sha = F.sha2(text, 256)
    return [
        F.conv(F.substring(sha, 1 + 16 * k, 16), 16, -10).cast("bigint").alias(name)
        for k, name in enumerate(TEXT)
    ]


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(t1, t2, spans): per text the byte spans (start, stop) that repeated windows cover.

    Texts are named by ``text_halves``. Spans may overlap; texts without any are left out.
    """
    text = text_of(docs)
    keyed = docs.select(*text_halves(text), text.alias("text"))
    counts = docs.select(text.alias("text")).mapInArrow(_hash_counter(length), "hash bigint, n bigint")
    repeated = counts.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    ddl = ", ".join(f"{c} bigint" for c in (*CONTEXT, *TEXT, "at"))
    rows = keyed.mapInArrow(_anchor_rows(length), ddl).join(repeated, "hash", "leftsemi")
    places = written(rows.groupBy(*CONTEXT, *TEXT, "at").agg(F.count("*").alias("n")), "places")
    contexts = places.groupBy(*CONTEXT).agg(
        F.sum("n").alias("n"), F.min(F.struct(*TEXT, "at")).alias("first")
    )
    contexts = written(contexts, "contexts")
    whole = contexts.where("n > 1").select(*CONTEXT, F.lit(True).alias("whole"))
    covered = spread_lookup(places, whole, CONTEXT, F.xxhash64(*TEXT, "at")).where("whole")
    covered = covered.select(
        *TEXT,
        F.greatest(F.col("at") - _reach(length), F.lit(0)).alias("start"),
        (F.col("at") + length).alias("stop"),
    )

    mixed = (
        contexts.groupBy("hash")
        .agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
        .where("kinds > 1 and least = 1")
        .select("hash", "kinds")
    )
    asked = spread_lookup(contexts, mixed, ["hash"], F.xxhash64("c1")).where("kinds is not null")
    asked = checkpoint(asked.select(*CONTEXT, "n", "first.*", "kinds"))
    shards = -(-asked.count() // shard) or 1
    share = F.pmod("c2", F.ceil(F.col("kinds") / shard))
    asked = asked.select(
        *CONTEXT,
        *TEXT,
        "n",
        "at",
        F.pmod(F.xxhash64("hash", share), F.lit(shards)).alias("shard"),
        (F.col("kinds") > shard).alias("split"),
    )
    lists = asked.groupBy(*TEXT).agg(F.collect_list(F.struct(*asked.columns)).alias("asked"))
    coded = keyed.mapInArrow(_packer, "t1 bigint, t2 bigint, code binary")
    coded = coded.groupBy(*TEXT).agg(F.first("code").alias("code"))
    cuts = coded.join(lists, TEXT).select("code", "asked").mapInArrow(_cutter(length), CUT_DDL)
    found = written(cuts.groupBy("shard").applyInArrow(_searcher(length), FOUND), "spans")
    spans = found.where("d1 is null").select(*TEXT, "start", "stop")
    windows = found.where("d1 is not null")
    owners = -(-windows.count() // OWNER) or 1
    owned = windows.withColumn("owner", F.pmod("d1", F.lit(owners))).groupBy("owner")
    merged = owned.applyInArrow(_merge, "t1 bigint, t2 bigint, start bigint, stop bigint")
    every = covered.unionByName(spans).unionByName(merged)
    return every.groupBy(*TEXT).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _reach(length: int) -> int:
    """Bytes before an anchor that its windows may cover."""
    return length - max(1, length // 4)


def _merged(spans: pa.ListArray) -> tuple[list[int], list[int], list[int]]:
    """Spans that overlap or touch as one, in order: starts, stops, and by list the end of its own."""
    counts = spans.value_lengths().fill_null(0).to_numpy()
    start, stop = (x.to_numpy() for x in spans.flatten().flatten())
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((start, row))
    start, stop = start[order], stop[order]
    # Stops so far, with lists apart from each other.
    apart = row * (stop.max(initial=0) + 1)
    ahead = np.maximum.accumulate(stop + apart)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] + apart[1:] > ahead[:-1])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(start))[: len(heads)] - 1
    ends = np.searchsorted(row[heads], np.arange(len(counts)), "right")
    return start[heads].tolist(), (ahead - apart)[tails].tolist(), ends.tolist()


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, counts = [], []
        starts, stops, ends = _merged(batch.column("spans"))
        for code, first, end in zip(batch.column("code"), [0, *ends], ends, strict=False):
            data = unpack.decompress(code.as_py())
            keeps = zip([0, *stops[first:end]], [*starts[first:end], len(data)], strict=True)
            texts.append(b"".join([data[x:y] for x, y in keeps]))
            counts.append((len(data), len(data) - len(texts[-1]), end - first))
        columns = list(zip(*counts, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(texts, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that stay, for every row."""
    spans = checkpoint(repeated_spans(docs, length, shard))
    text = text_of(docs)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    rows = docs.select(*text_halves(text), salt, F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    found = rows.select(*TEXT, "salt").distinct().join(spans, TEXT)
    coded = rows.mapInArrow(_packer, "t1 bigint, t2 bigint, salt bigint, doc_id bigint, code binary")
    joined_rows = coded.join(found, [*TEXT, "salt"], "left").select("doc_id", "code", "spans")
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return joined_rows.mapInArrow(_remover, ddl)


def removal_report(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    rows = remove_repeats(docs, length, shard)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
