"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every input partition sends its sorted 64-bit text hashes to the owners of the hash ranges,
compressed; an owner answers each partition with a bitmap of the hashes that occur more than
once; only texts whose bit is set (the suspects) are then compared byte by byte.

Defined cases: null text is the empty text. A null doc_id is below every other id. Of rows
repeated with the same id and text exactly one is kept. An empty table gives no rows. Other
columns are ignored by ``exact_duplicates`` and returned unchanged by ``drop_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrid.llm import golomb
from pagegrid.llm.common import checkpoint, keep_rows, shuffle_partitions, spread_lookup, text_of

MESSAGE = "source int, owner int, width int, code binary"
REPLY = "source int, owner int, duplicates binary"
FLAGGED = "doc_id bigint, source int, tag bigint, text_sha256 string, suspect boolean"


def _hashes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bounds(owners: int) -> np.ndarray:
    """The first hash of every owner's range but the first owner's."""
    return np.array([(k << 64) // owners for k in range(1, owners)], np.uint64)


def _sender(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, source = [], None
        for batch in batches:
            if batch.num_rows:
                source = batch.column("source")[0].as_py()
                parts.append(_hashes(batch.column("fingerprint")))
        if source is None:
            return
        values = np.unique(np.concatenate(parts))
        cuts = np.searchsorted(values, _bounds(owners))
        rows = [
            {"source": source, "owner": k, "width": width, "code": code}
            for k, own in enumerate(np.split(values, cuts))
            for width, code in [golomb.encode(own)]
            if code
        ]
        yield pa.RecordBatch.from_pylist(
            rows,
            pa.schema([("source", pa.int32()), ("owner", pa.int32()), ("width", pa.int32()), ("code", pa.binary())]),
        )

    return send


def _answer(messages: pa.Table) -> pa.Table:
    """An owner's bitmaps, one per message: which hashes came from more than one source."""
    lists = [
        golomb.decode(width, code)
        for width, code in zip(
            messages["width"].to_pylist(), messages["code"].to_pylist(), strict=True
        )
    ]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    repeated = values[counts > 1]
    bitmaps = [np.packbits(np.isin(x, repeated, assume_unique=True)).tobytes() for x in lists]
    return pa.table(
        {
            "source": messages["source"],
            "owner": messages["owner"],
            "duplicates": pa.array(bitmaps, pa.binary()),
        }
    )


def _receiver(owners: int):
    def receive(rows: pa.Table, replies: pa.Table) -> pa.Table:
        """Flag the rows of one source: repeated here, or elsewhere by the owners' bitmaps."""
        hashes = _hashes(rows["fingerprint"])
        values, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        suspect = counts > 1
        bitmaps = dict(
            zip(replies["owner"].to_pylist(), replies["duplicates"].to_pylist(), strict=True)
        )
        edges = [0, *np.searchsorted(values, _bounds(owners)).tolist(), len(values)]
        for owner, bitmap in bitmaps.items():
            a, b = edges[owner], edges[owner + 1]
            bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a)
            suspect[a:b] |= bits.astype(bool)
        flagged = rows.select(["doc_id", "source", "tag", "text_sha256"])
        return flagged.append_column("suspect", pa.array(suspect[place.reshape(-1)]))

    return receive


def exact_duplicates(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    The largest doc_id of equal texts stays. ``owners`` is the number of hash ranges
    (default: ``spark.sql.shuffle.partitions``). A task holds the hashes of one input
    partition, or of one owner's range. A hash that a third of all rows share is one entry
    per source; its rows later meet their class through (source, hash) pairs.
    """
    owners = owners or shuffle_partitions(docs.sparkSession)
    text = text_of(docs)
    table = checkpoint(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.spark_partition_id().alias("source"),
            F.monotonically_increasing_id().alias("tag"),
            F.xxhash64(text).alias("fingerprint"),
            F.sha2(text, 256).alias("text_sha256"),
        )
    )
    messages = table.select("source", "fingerprint").mapInArrow(_sender(owners), MESSAGE)
    replies = messages.groupBy("owner").applyInArrow(_answer, REPLY)
    flagged = checkpoint(
        table.groupBy("source")
        .cogroup(replies.groupBy("source"))
        .applyInArrow(_receiver(owners), FLAGGED)
    )
    suspects = flagged.where("suspect").drop("suspect")
    # Byte verification: suspect texts meet as whole strings, pre-aggregated in every task.
    ids = suspects.select(F.col("doc_id").alias("_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), text.alias("_text"))
    verified = (
        texts.join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "leftsemi")
        .groupBy("_text")
        .agg(F.count("*").alias("_same"))
        .select(F.sha2("_text", 256).alias("text_sha256"))
    )
    local = suspects.groupBy("source", "text_sha256").agg(
        F.max(F.struct("doc_id", "tag")).alias("best"), F.count("*").alias("n")
    )
    classes = (
        local.groupBy("text_sha256")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
        .join(verified, "text_sha256")
        .select(
            "text_sha256",
            F.col("best.doc_id").alias("keep_id"),
            F.col("best.tag").alias("_keep_tag"),
            "group_size",
        )
    )
    grouped = spread_lookup(suspects, classes, ["text_sha256"], F.col("source")).select(
        "doc_id", "keep_id", "group_size", (F.col("tag") == F.col("_keep_tag")).alias("kept"), "text_sha256"
    )
    single = flagged.where("not suspect").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(grouped)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies: one row per text, the one with the largest doc_id."""
    kept = exact_duplicates(docs).where("kept")
    kept = kept.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"))
    return keep_rows(docs, F.sha2(text_of(docs), 256), kept)
