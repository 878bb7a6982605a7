"""Plans and values of steps that were mended to grow no faster than their input."""

from pyspark.sql import functions as F

from pagegrid.functions.text import linspace, linspace_at
from pagegrid.operators import routing, search


def final_plan(rows):
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_running_sums_are_not_gathered_on_the_driver(spark):
    pages = spark.range(3000).select(
        (F.col("id") % 1000).alias("doc_id"),
        (F.col("id") % 3 + 1).alias("page_no"),
        (F.col("id") * 1000).alias("size_bytes"),
        (F.col("id") % 2 == 0).alias("flagged"),
    )
    plan = final_plan(routing.resolution_tier(pages))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    chunks = pages.select("doc_id", F.col("page_no").alias("chunk_no"), F.lit("ok").alias("status"), F.lit(2).alias("pages"))
    assert "Broadcast" not in final_plan(routing.global_pages(chunks))


def test_a_range_value_at_a_position_is_the_entry_of_its_array(spark):
    rows = spark.range(40).select((F.col("id") / 7.0).alias("low"), (F.col("id") / 3.0 + 1).alias("high"))
    for count in (2, 4, 5, 8):
        every = rows.select(
            linspace(F.col("low"), F.col("high"), count).alias("values"),
            F.array(*[linspace_at(F.col("low"), F.col("high"), count, F.lit(i)) for i in range(count)]).alias("at"),
        )
        assert all(r["values"] == r["at"] for r in every.collect())


def test_combinations_build_no_array_per_value(spark):
    base = search.params_with_defaults(spark.range(3).select(F.col("id").alias("set_id")))
    picks = search.random_picks(base, search.focused_ranges(), 4)
    assert "transform(" not in picks._jdf.queryExecution().optimizedPlan().toString()
    ranges = search.focused_ranges()
    for r in picks.join(base.select("set_id"), "set_id").collect():
        assert 2.3 <= r.table_contrast_factor <= 3.3 and r.bilateral_d in (9, 11, 13)
    grid = search.full_grid(base, {k: ranges[k] for k in search.FOCUSED_SPREAD}, 125)
    assert grid.drop("combo_id").distinct().count() == 375
