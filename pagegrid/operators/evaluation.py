"""Samples, folds, scores and the choice of the best parameter combination.

Combinations are few (the caller sets how many are tried) and samples are many: every
aggregate is keyed by combination or combination and fold and combines map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrid.functions.metrics import cer, wer
from pagegrid.functions.text import div, strip
from pagegrid.operators.ranking import first_rows, seeded_rank

SEED = 42
# Sample caps, mean page confidence, scores of a combination that never worked.
SAMPLES_PER_SOURCE = 10_000
CV_SAMPLES = 5_000
PAGE_CONFIDENCE = 0.95
FAILED = {"cer": 1.0, "wer": 1.0, "confidence": 0.0, "seconds": float("inf")}


def is_valid_sample(truth: Column, has_image: Column) -> Column:
    return truth.isNotNull() & (strip(truth) != "") & has_image


def valid_samples(samples: DataFrame) -> DataFrame:
    return samples.filter(is_valid_sample(F.col("ground_truth"), F.col("has_image")))


def mixed_samples(sources: list[DataFrame], per_source: int = SAMPLES_PER_SOURCE) -> DataFrame:
    """The first ``per_source`` samples of each source by id; of these, the valid ones."""
    capped = [first_rows(source, "sample_id", per_source) for source in sources]
    return valid_samples(reduce(DataFrame.unionByName, capped))


def min_samples_check(samples: DataFrame, folds: int) -> DataFrame:
    """One row: how many samples there are, how many are needed, and whether that is enough."""
    need = F.lit(2 * folds).cast("bigint")
    return samples.agg(F.count("*").alias("n_samples")).select(
        "n_samples", need.alias("n_required"), (F.col("n_samples") >= need).alias("is_enough")
    )


def assert_min_samples(samples: DataFrame, folds: int) -> DataFrame:
    """The check as a guard: fails the query that reads it when samples are too few."""
    message = F.format_string(
        "insufficient samples (%d) for %d folds", F.col("n_samples"), F.lit(folds)
    )
    return min_samples_check(samples, folds).filter(
        F.assert_true(F.col("is_enough"), message).isNull()
    )


def kfold_assign(samples: DataFrame, folds: int, seed: int = SEED) -> DataFrame:
    """Fold 1..k of each sample after a seeded shuffle, with its position in the fold.

    Sizes differ by at most one; the first ``n % k`` folds are the larger ones.
    """
    ranked = seeded_rank(samples, "sample_id", seed)
    k = F.lit(folds)
    small = div(F.col("n_total"), k)
    wide = F.col("n_total") % k
    split = wide * (small + 1)
    rank = F.col("rank0")
    in_wide = rank < split
    fold = F.when(in_wide, div(rank, small + 1)).otherwise(
        wide + div(rank - split, F.nullif(small, F.lit(0)))
    )
    position = F.when(in_wide, rank % (small + 1)).otherwise(
        F.pmod(rank - split, F.nullif(small, F.lit(0)))
    )
    return ranked.withColumns(
        {"fold": (fold + 1).cast("int"), "position": position.cast("bigint")}
    ).drop("rank0", "n_total")


def kfold_split(assigned: DataFrame, folds: int) -> DataFrame:
    """Role of every sample in every fold: validation in its own, train in the others."""
    each = assigned.select(
        "sample_id",
        "fold",
        F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("split"),
    )
    role = F.when(F.col("fold") == F.col("split"), "validation").otherwise("train")
    return each.select("split", "sample_id", role.alias("role"))


def fold_samples(assigned: DataFrame, per_fold: int) -> DataFrame:
    """The first samples of each fold."""
    return assigned.filter(F.col("position") < per_fold)


def combo_sample_grid(samples: DataFrame, combos: int) -> DataFrame:
    """One evaluation per combination and sample."""
    return samples.select(
        F.explode(F.sequence(F.lit(0), F.lit(combos - 1))).alias("combo_id"), *samples.columns
    )


def evaluation_budget(params: DataFrame, folds: int, per_fold: int) -> DataFrame:
    """Combinations times folds times samples per fold."""
    return params.agg(F.count("*").alias("n_combos")).select(
        "n_combos", (F.col("n_combos") * folds * per_fold).alias("n_evaluations")
    )


def deal_samples(samples: DataFrame, combos: int, per_combo: int) -> DataFrame:
    """Hand the valid samples out in id order: each combination takes the next ``per_combo``."""
    dealt = first_rows(valid_samples(samples), "sample_id", combos * per_combo)
    # At most combos * per_combo rows reach this window.
    place = F.row_number().over(Window.orderBy("sample_id")) - 1
    return dealt.select(
        "sample_id", div(place, per_combo).cast("int").alias("combo_id")
    )


def sample_scores(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Error rates of each prediction; all null where the sample is invalid or failed.

    Both sides are keyed by sample, and a sample repeats once per combination.
    """
    truth = samples.select("sample_id", "ground_truth", "has_image")
    ok = is_valid_sample(F.col("ground_truth"), F.col("has_image")) & F.col(
        "predicted"
    ).isNotNull()
    only = lambda c: F.when(ok, c)
    return predictions.join(truth, "sample_id").select(
        "combo_id",
        "sample_id",
        only(cer(F.col("ground_truth"), F.col("predicted"))).alias("cer"),
        only(wer(F.col("ground_truth"), F.col("predicted"))).alias("wer"),
        only(F.col("confidence")).alias("confidence"),
        only(F.col("seconds")).alias("seconds"),
    )


def _means() -> list[Column]:
    return [
        F.coalesce(F.avg(F.when(F.col("cer").isNotNull(), F.col(m))), F.lit(worst)).alias(m)
        for m, worst in FAILED.items()
    ]


def combo_scores(scores: DataFrame) -> DataFrame:
    """Means per combination over successful samples."""
    return scores.groupBy("combo_id").agg(*_means(), F.count("cer").alias("n_success"))


def fold_scores(
    scores: DataFrame, assigned: DataFrame, folds: int, combos: DataFrame | None = None
) -> DataFrame:
    """Means per combination and fold over successful samples of the fold.

    Every combination gets all ``folds``: one without any prediction counts as failed, not as
    absent. ``combos`` names the combinations tried, by default those with a prediction.
    """
    found = (
        scores.join(assigned.select("sample_id", "fold"), "sample_id")
        .groupBy("combo_id", "fold")
        .agg(*_means(), F.count("cer").alias("n_success"))
    )
    tried = (scores if combos is None else combos).select("combo_id").distinct()
    every = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    worst = {m: F.coalesce(m, F.lit(value)) for m, value in FAILED.items()}
    return (
        tried.select("combo_id", every)
        .join(found, ["combo_id", "fold"], "left")
        .withColumns({**worst, "n_success": F.coalesce("n_success", F.lit(0).cast("bigint"))})
    )


def _cv_stats() -> list[Column]:
    stats = [
        f(m).alias(f"{label}_{m}")
        for m in ("cer", "wer", "confidence")
        for label, f in (("mean", F.avg), ("std", F.stddev_pop))
    ]
    return [*stats, F.count("*").alias("fold_count")]


def cv_scores(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold means of each combination."""
    return folds.groupBy("combo_id").agg(*_cv_stats())


def cv_results(folds: DataFrame) -> DataFrame:
    """``cv_scores`` with the list of fold results, which is as long as there are folds."""
    fields = [c for c in folds.columns if c != "combo_id"]
    listed = F.sort_array(F.collect_list(F.struct(*fields))).alias("fold_results")
    return folds.groupBy("combo_id").agg(*_cv_stats(), listed)


def best_combo(scores: DataFrame, metric: str = "mean_cer") -> DataFrame:
    """The combination with the lowest error, the earliest one on ties.

    Means are compared to 12 decimals, so the order of summation cannot break a tie.
    """
    row = F.struct(*scores.columns)
    rank = F.struct(F.round(metric, 12).alias("m"), F.col("combo_id"))
    return scores.agg(F.min_by(row, rank).alias("best")).select("best.*")


def best_progress(scores: DataFrame, metric: str = "mean_cer") -> DataFrame:
    """Combinations that beat all earlier ones. One row per combination, so one small task."""
    earlier = Window.orderBy("combo_id").rowsBetween(Window.unboundedPreceding, -1)
    value = F.round(metric, 12)
    return (
        scores.select("combo_id", value.alias(metric))
        .withColumn("_before", F.min(metric).over(earlier))
        .filter(F.col("_before").isNull() | (F.col(metric) < F.col("_before")))
        .drop("_before")
    )


def document_text(pages: DataFrame, pages_per_part: int = 64) -> DataFrame:
    """Page texts joined by newlines, with the mean confidence.

    Parts of up to 64 consecutive pages; the parts of a document in order, joined by a
    newline, are its whole text, and no document is gathered into one row.
    """
    part = div(F.col("page_no") - 1, pages_per_part).alias("part_no")
    joined = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("page_no", "markdown"))),
            lambda p: p["markdown"],
        ),
        "\n",
    )
    return pages.groupBy("doc_id", part).agg(
        joined.alias("text"),
        F.count("*").alias("n_pages"),
        F.avg(F.lit(PAGE_CONFIDENCE)).alias("confidence"),
    )
