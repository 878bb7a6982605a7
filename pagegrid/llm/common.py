"""Helpers shared by the operators of this package."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ways in which the rows of one key are dealt out by ``spread_lookup``.
SALTS = 64


@functools.cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="pagegrid-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session names none (local tests), a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _test_folder()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder and cut their lineage; lost executors lose nothing."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written as a Parquet table in the shared folder and read again.

    Like ``checkpoint``, for rows that are dear to compute: a checkpoint computes them twice.
    """
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_lookup(rows: DataFrame, table: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Left join to a table with unique keys when one key may hold a third of all rows.

    Keys are first reduced to their distinct (key, salt) pairs, at most ``SALTS`` rows per
    key, and looked up; the rows then join on key and salt, so that a hot key is dealt out
    over ``SALTS`` tasks. Rows with a null key find nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    found = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(found, [*keys, "_salt"], "left").drop("_salt")


def text_of(rows: DataFrame) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(rows["text"].cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256: half the bytes, and texts do not share them."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for every (id, key) of ``kept``; ids may be null.

    The caller's columns travel as one struct, so that none of their names can clash.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("id"),
        key.alias("key"),
    )
    kept = kept.select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key"))
    same = (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id"))
    return rows.join(kept, same, "leftsemi").dropDuplicates(["id", "key"]).select("row.*")
