"""Global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrid.functions.text import div


def seeded_key(*parts: Column | str | int) -> Column:
    """Portable hash text of the parts joined by ``:``."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def seeded_rank(rows: DataFrame, id_column: str, seed: int) -> DataFrame:
    """Add ``rank0`` (0-based position in a seeded shuffle) and ``n_total``.

    Rows are ranked inside 65,536 buckets of the hash, which are even whatever the ids
    look like. Bucket sizes come from a map-side combined count; their running total is a
    table of at most 65,536 rows, which bounds both its one-task window and its broadcast.
    """
    id_ = F.col(id_column)
    keyed = rows.withColumn("_key", seeded_key(id_, seed))
    bucket = F.conv(F.substring("_key", 1, 4), 16, 10).cast("int")
    keyed = keyed.withColumn("_bucket", bucket)
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy()).alias("n_total"),
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", id_))
    return (
        keyed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("rank0", F.col("_offset") + F.col("_inside") - 1)
        .drop("_key", "_bucket", "_offset", "_inside")
    )


def first_rows(rows: DataFrame, id_column: str, count: int) -> DataFrame:
    """The ``count`` rows with the smallest unique ids.

    Only ids take part in the top-n, which every partition cuts to ``count`` first; the
    full rows are then filtered by the largest id kept.
    """
    head = rows.select(id_column).orderBy(id_column).limit(count)
    return rows.filter(F.col(id_column) <= head.agg(F.max(id_column)).scalar())


def block_running_sum(
    rows: DataFrame, key: str, order: str, value: str, block: int = 1000
) -> DataFrame:
    """Add ``sum_before`` and ``rows_before``, over earlier rows of the key, and ``key_rows``.

    A key's rows are cut into blocks of consecutive ``order`` values (unique per key), so
    one huge key is summed by many tasks. ``block_no`` is kept for further work per block.
    Blocks are as many as keys or more, so they meet the rows by a merge join: on a size check
    alone they would be gathered on the driver and broadcast while they are just small enough.
    """
    rows = rows.withColumn("block_no", div(F.col(order), block))
    sums = rows.groupBy(key, "block_no").agg(
        F.sum(value).alias("_sum"), F.count("*").alias("_rows")
    )
    whole = Window.partitionBy(key)
    earlier = whole.orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select(
        key,
        "block_no",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_offset"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row_offset"),
        F.sum("_rows").over(whole).alias("key_rows"),
    )
    inside = Window.partitionBy(key, "block_no").orderBy(order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(blocks.hint("merge"), [key, "block_no"])
        .withColumns(
            {
                "sum_before": F.col("_sum_offset")
                + F.coalesce(F.sum(value).over(before), F.lit(0)),
                "rows_before": F.col("_row_offset") + F.row_number().over(inside) - 1,
            }
        )
        .drop("_sum_offset", "_row_offset")
    )


def explode_range(rows: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """One row per integer in ``[low, high]``; never builds an array above 10,000 entries."""
    step = 10_000
    kept = rows.columns
    blocks = rows.filter(low <= high).select(
        *kept,
        F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"), F.lit(step).cast("bigint")))
        .alias("_low"),
    )
    last = F.least(F.col("_low") + (step - 1), high.cast("bigint"))
    return blocks.select(*kept, F.explode(F.sequence(F.col("_low"), last)).alias(name))
