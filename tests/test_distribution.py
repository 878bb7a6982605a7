"""Ranks, folds, running sums and ranges: exact on skewed and odd inputs; plan shapes."""

import random

import pytest
from pyspark.sql import functions as F

from pagegrid.operators import evaluation, extraction, ranking, routing, search
from pagegrid.plans import derived
from pagegrid.sources import writers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n", "k"), [(7, 5), (10, 5), (3, 5), (1, 2), (103, 10)])
def test_fold_sizes(spark, n, k):
    ids = spark.range(n).select(F.col("id").alias("sample_id"))
    rows = evaluation.kfold_assign(ids, k).collect()
    sizes = [sum(r.fold == f for r in rows) for f in range(1, k + 1)]
    assert sizes == [n // k + (f < n % k) for f in range(k)]
    for f in range(1, k + 1):
        assert sorted(r.position for r in rows if r.fold == f) == list(range(sizes[f - 1]))


def test_seeded_rank_is_a_permutation_and_depends_on_the_seed(spark):
    ids = spark.range(500).select(F.col("id").alias("sample_id"))
    order = {
        seed: [r.sample_id for r in ranking.seeded_rank(ids, "sample_id", seed).orderBy("rank0").collect()]
        for seed in (1, 2)
    }
    assert sorted(order[1]) == list(range(500)) and order[1] != order[2]


def test_running_sum_with_one_hot_key(spark):
    rng = random.Random(1)
    rows = [(1, i, rng.randint(0, 9)) for i in range(5000)]
    rows += [(k, i, rng.randint(0, 9)) for k in range(2, 40) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, o bigint, v bigint")
    got = ranking.block_running_sum(df, "k", "o", "v", block=64).collect()
    assert len(got) == len(rows)
    expected, seen, total = {}, {}, {}
    for k, o, v in rows:
        expected[k, o] = (total.get(k, 0), seen.get(k, 0))
        total[k], seen[k] = total.get(k, 0) + v, seen.get(k, 0) + 1
    for r in got:
        assert (r.sum_before, r.rows_before) == expected[r.k, r.o]
        assert r.key_rows == seen[r.k]


def test_first_rows(spark):
    ids = [(i * 37 % 1000, f"t{i}") for i in range(1000)]
    df = spark.createDataFrame(ids, "id bigint, text string").repartition(7)
    got = ranking.first_rows(df, "id", 13).collect()
    assert sorted(r.id for r in got) == list(range(13))
    assert ranking.first_rows(df, "id", 5000).count() == 1000


def test_explode_range_in_steps(spark):
    df = spark.createDataFrame([(1, 25_000), (5, 4), (3, 3)], "low bigint, high bigint")
    got = ranking.explode_range(df, F.col("low"), F.col("high"), "n")
    assert got.count() == 25_001 and got.select("low", "n").distinct().count() == 25_001


def test_chunk_plan(spark):
    rows = [(1, 500.0, 7), (2, 100.0, 7), (3, 900.0, 11), (4, 800.0, 12), (5, 1.0, 1), (6, 1.0, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, size_mb double, total_pages int")
    plan = {}
    for r in routing.plan_chunks(docs).orderBy("doc_id", "chunk_no").collect():
        plan.setdefault(r.doc_id, []).append((r.from_page, r.to_page))
    assert plan[1] == [(i, i) for i in range(1, 8)]
    assert plan[2] == [(1, 3), (4, 6), (7, 7)]
    assert len(plan[3]) == 11
    assert plan[4] == [(1, 3), (4, 6), (7, 9), (10, 12)]
    assert plan[5] == [(1, 1)] and 6 not in plan


def test_failed_chunk_shifts_later_pages(spark):
    rows = [(1, 1, "ok", 3), (1, 2, "error", 3), (1, 3, "ok", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_no int, status string, pages int")
    got = routing.global_pages(df).collect()
    assert sorted((r.chunk_no, r.page_no) for r in got) == [(1, 1), (1, 2), (1, 3), (3, 4), (3, 5)]


def test_renumber_headers(spark):
    title = "# Enhanced OCR Results\n\n"
    rows = [
        (1, 1, title + "## Page 1\n\na\n\n---\n\n## Page 2 b\n"),
        (1, 2, title + "## Page 1\nsay ## Page 5\n## Pages"),
        (1, 3, "# Enhanced OCR Results\nonly"),
        (1, 4, "no title\n## Page 9"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_no int, markdown string")
    got = [r.markdown for r in routing.renumber_headers(df).orderBy("chunk_no").collect()]
    assert "".join(got) == (
        title + "## Page 1\n\na\n\n---\n\n## Page 2 b\n\n## Page 3\nsay ## Page 5\n## Pages"
        "\nno title\n## Page 4"
    )


def test_resolution_drop_is_sticky(spark):
    mb = 1048576
    sizes = [60] * 5 + [1] * 10
    rows = [(1, i, s * mb, i == 9) for i, s in enumerate(sizes, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_no bigint, size_bytes bigint, flagged boolean")
    got = routing.resolution_tier(df).orderBy("page_no").collect()
    # Before page 6: 300 MB on 5 of 15 pages, 900 MB projected. Later projections are lower.
    assert [r.scale for r in got] == [4.5] * 5 + [2.5] * 3 + [4.5] + [2.5] * 6
    assert [r.dpi for r in got][5:9] == [250, 250, 250, 500]


def test_retry_outcomes(spark):
    rows = [(1, 0, "504"), (1, 1, "502"), (1, 2, None), (2, 0, "x"), (3, 0, "504"), (3, 1, "503"), (3, 2, "500")]
    df = spark.createDataFrame(rows, "request_id bigint, attempt int, error string")
    got = {r.request_id: tuple(r)[1:] for r in routing.retry_outcomes(df).collect()}
    assert got == {1: ("ok", 3, 35), 2: ("fatal", 1, 0), 3: ("exhausted", 3, 35)}


def test_scores_of_failures_and_ties(spark):
    samples = spark.createDataFrame(
        [(i, "s", "ab", True) for i in range(4)] + [(9, "s", " ", True)],
        "sample_id bigint, source string, ground_truth string, has_image boolean",
    )
    rows = [(c, i, "ax", 0.95, 1.0) for c in (2, 1) for i in range(4)]
    rows += [(3, i, None, 0.95, 1.0) for i in range(4)] + [(1, 9, "zz", 0.95, 1.0)]
    predictions = spark.createDataFrame(
        rows, "combo_id int, sample_id bigint, predicted string, confidence double, seconds double"
    )
    scores = evaluation.sample_scores(samples, predictions)
    means = {r.combo_id: r for r in evaluation.combo_scores(scores).collect()}
    assert (means[3].cer, means[3].wer, means[3].confidence, means[3].seconds) == (1, 1, 0, float("inf"))
    assert means[1].n_success == 4 and means[1].cer == 0.5
    folds = evaluation.fold_scores(
        scores, evaluation.kfold_assign(samples.filter("sample_id < 9"), 2), 2
    )
    cv = evaluation.cv_scores(folds)
    assert evaluation.best_combo(cv).first().combo_id == 1
    assert [r.combo_id for r in evaluation.best_progress(cv).collect()] == [1]
    params = spark.range(1, 4).select(F.col("id").cast("int").alias("combo_id"), F.lit(2.0).alias("p"))
    report = writers.tuning_report(evaluation.cv_results(folds), params).collect()
    assert sorted((r.section, r.combo_id) for r in report) == [
        ("result", 1),
        ("result", 2),
        ("result", 3),
        ("summary", 1),
    ]
    assert '"fold_results":[{"fold":1,' in next(r.report for r in report if r.section == "result")
    assert '"total_combinations_tested":3' in next(r.report for r in report if r.section == "summary")
    pairs = {r.key: r.value for r in writers.best_params_kv(cv, params).collect()}
    assert pairs["p"] == 2.0 and pairs["mean_cer"] == 0.5


def test_too_few_samples_fail(spark):
    ids = spark.range(9).select(F.col("id").alias("sample_id"))
    assert evaluation.assert_min_samples(ids, 4).count() == 1
    with pytest.raises(Exception, match="insufficient samples"):
        evaluation.assert_min_samples(ids, 5).collect()


def test_param_space(spark):
    base = search.params_with_defaults(spark.range(2).select(F.col("id").alias("set_id")))
    assert search.space_size(search.focused_ranges()) == 5_832_000
    assert search.space_size(search.broad_ranges()) == 2_073_600_000
    sizes = search.param_space_size(base, search.broad_ranges()).collect()
    assert {r.n_combinations for r in sizes} == {2_073_600_000}
    few = {k: search.focused_ranges()[k] for k in ("bilateral_d", "matrix_scale", "adaptive_c")}
    whole = search.param_combinations(base, few, 48)
    assert whole.count() == 96 and whole.drop("combo_id").distinct().count() == 96
    some = search.param_combinations(base, few, 10).collect()
    assert len({(r.set_id, r.combo_id) for r in some}) == 20
    picks = search.param_combinations(base, few, 100)  # more than the grid holds
    assert picks.count() == 200 and picks.filter("bilateral_d is null").count() == 0
    with pytest.raises(ValueError, match="too many"):
        search.full_grid(base, search.focused_ranges(), 10)


def test_extraction_is_map_only(spark):
    pages = spark.createDataFrame([(1, 1, "x")], "doc_id bigint, page_no int, markdown string")
    for operator in (extraction.extract_tables, extraction.page_csv, extraction.padded_tables):
        assert "Exchange" not in plan_of(operator(pages)), operator.__name__
    assert plan_of(extraction.run_summary(pages)).count("Exchange") == 1


def test_only_needed_columns_are_read(spark):
    docs = derived.doc_pages(spark, "/root/testdata/sf0.001")
    plan = plan_of(extraction.extract_tables(docs))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_attempt_logs_use_hash_aggregation(spark):
    plan = plan_of(routing.retry_outcomes(derived.attempts(spark, "/root/testdata/sf0.001")))
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
