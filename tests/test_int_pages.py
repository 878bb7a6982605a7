"""Int page numbers give the same tiers as bigint ones."""

from pagegrid.operators.routing import resolution_tier


def test_resolution_tier_takes_int_page_numbers(spark):
    rows = [(1, n, 30 << 20, n % 6 == 0) for n in range(1, 41)]
    results = [
        sorted(
            tuple(r)
            for r in resolution_tier(
                spark.createDataFrame(rows, f"doc_id bigint, page_no {kind}, size_bytes bigint, flagged boolean")
            ).collect()
        )
        for kind in ("int", "bigint")
    ]
    assert results[0] == results[1]
    assert len({r[3] for r in results[0]}) == 2
