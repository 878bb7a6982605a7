"""Parameter ranges and combinations drawn from them, per baseline row.

A baseline is a row ``(set_id, <parameters>)``; every operator is a projection or a bounded
generate on it.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.functions.text import div, linspace, linspace_at
from pagegrid.operators.ranking import seeded_key

SEED = 42
FULL_GRID_LIMIT = 1000

# Defaults of the searched parameters; the kernel is a square, given by its side.
DEFAULTS = {
    "table_contrast_factor": 2.8,
    "table_brightness_factor": 0.65,
    "table_sharpness_factor": 2.2,
    "bilateral_d": 11.0,
    "bilateral_sigma_color": 85.0,
    "bilateral_sigma_space": 85.0,
    "adaptive_block_size": 13.0,
    "adaptive_c": 1.5,
    "morph_kernel_size": 2.0,
    "table_morph_close_iterations": 1.0,
    "table_morph_dilate_iterations": 1.0,
    "matrix_scale": 4.5,
    "enhancement_dpi": 550.0,
}

# Half widths and counts of the ranges around a baseline, and listed ranges.
FOCUSED_SPREAD = {
    "table_contrast_factor": (0.5, 5),
    "table_brightness_factor": (0.15, 5),
    "table_sharpness_factor": (0.3, 5),
}
FOCUSED_LISTS = {
    "bilateral_d": [9, 11, 13],
    "bilateral_sigma_color": [75, 85, 95],
    "bilateral_sigma_space": [75, 85, 95],
    "adaptive_block_size": [11, 13, 15],
    "adaptive_c": (1.0, 2.0, 4),
    "morph_kernel_size": [1, 2, 3],
    "table_morph_close_iterations": [1, 2],
    "table_morph_dilate_iterations": [1, 2],
    "matrix_scale": [4.0, 4.5, 5.0, 5.5],
    "enhancement_dpi": [500, 550, 600],
}
BROAD = {
    "table_contrast_factor": (2.0, 3.5, 8),
    "table_brightness_factor": (0.5, 0.8, 8),
    "table_sharpness_factor": (1.5, 3.0, 8),
    "bilateral_d": [7, 9, 11, 13, 15],
    "bilateral_sigma_color": [50, 75, 85, 100, 125],
    "bilateral_sigma_space": [50, 75, 85, 100, 125],
    "adaptive_block_size": [9, 11, 13, 15, 17],
    "adaptive_c": (0.8, 2.5, 6),
    "morph_kernel_size": [1, 2, 3, 4],
    "table_morph_close_iterations": [1, 2, 3],
    "table_morph_dilate_iterations": [1, 2, 3],
    "matrix_scale": [3.5, 4.0, 4.5, 5.0, 5.5, 6.0],
    "enhancement_dpi": [400, 500, 550, 600, 650],
}


class Range(NamedTuple):
    """Values one parameter may take, as an array column, how many there are, and the value at a
    0-based position, which costs no array where the values are evenly spaced."""

    values: Column
    count: int
    at: Callable[[Column], Column]


def _even(low: Column, high: Column, count: int) -> Range:
    return Range(linspace(low, high, count), count, lambda i: linspace_at(low, high, count, i))


def _range(spec: list | tuple) -> Range:
    if isinstance(spec, tuple):
        low, high, count = spec
        return _even(F.lit(low), F.lit(high), count)
    values = F.array(*[F.lit(float(v)) for v in spec])
    return Range(values, len(spec), lambda i: F.get(values, i))


def params_with_defaults(params: DataFrame, defaults: dict[str, float] = DEFAULTS) -> DataFrame:
    """Fill missing keys, whether the column is absent or null."""
    others = [c for c in params.columns if c not in defaults]
    filled = [
        F.coalesce(F.col(k), F.lit(v)).alias(k) if k in params.columns else F.lit(v).alias(k)
        for k, v in defaults.items()
    ]
    return params.select(*others, *filled)


def focused_ranges() -> dict[str, Range]:
    """Ranges around the baseline's own values, plus the listed ones."""
    around = {
        k: _even(F.col(k) - half, F.col(k) + half, n)
        for k, (half, n) in FOCUSED_SPREAD.items()
    }
    return around | {k: _range(v) for k, v in FOCUSED_LISTS.items()}


def broad_ranges() -> dict[str, Range]:
    return {k: _range(v) for k, v in BROAD.items()}


def space_size(ranges: dict[str, Range]) -> int:
    return prod(r.count for r in ranges.values())


def param_ranges(baselines: DataFrame, ranges: dict[str, Range] | None = None) -> DataFrame:
    """Long form: ``(set_id, parameter, position, value)``."""
    ranges = ranges or focused_ranges()
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("parameter"), r.values.alias("values"))
            for k, r in ranges.items()
        ]
    )
    named = baselines.select("set_id", F.explode(entries).alias("r"))
    return named.select(
        "set_id", "r.parameter", F.posexplode("r.values").alias("position", "value")
    )


def param_space_size(baselines: DataFrame, ranges: dict[str, Range] | None = None) -> DataFrame:
    """Number of combinations of each baseline's ranges."""
    ranges = ranges or focused_ranges()
    size = F.lit(1).cast("bigint")
    for r in ranges.values():
        size = size * F.size(r.values)
    return baselines.select("set_id", size.alias("n_combinations"))


def full_grid(
    baselines: DataFrame, ranges: dict[str, Range], count: int, seed: int = SEED
) -> DataFrame:
    """``count`` combinations of the whole grid without replacement (all when fewer).

    The grid index is decoded digit by digit, last parameter fastest, so the product is
    never built; the at most 1,000 indexes of a baseline are ordered by a seeded hash.
    """
    total = space_size(ranges)
    if total > FULL_GRID_LIMIT:
        raise ValueError(f"{total} combinations are too many for a full grid")
    keyed = F.transform(
        F.sequence(F.lit(0), F.lit(total - 1)),
        lambda i: F.struct(seeded_key(F.col("set_id"), i, seed).alias("key"), i.alias("i")),
    )
    drawn = F.transform(F.slice(F.sort_array(keyed), 1, count), lambda k: k["i"])
    index = F.explode(drawn if count < total else F.sequence(F.lit(0), F.lit(total - 1)))
    picked, stride = [], total
    for name, r in ranges.items():
        stride //= r.count
        digit = div(F.col("combo_id"), stride).cast("int") % r.count
        picked.append(r.at(digit).alias(name))
    return baselines.select("*", index.alias("combo_id")).select("set_id", "combo_id", *picked)


def random_picks(
    baselines: DataFrame, ranges: dict[str, Range], count: int, seed: int = SEED
) -> DataFrame:
    """``count`` combinations, each parameter picked independently with replacement."""
    combos = baselines.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("combo_id")
    )

    def pick(name: str, r: Range) -> Column:
        key = seeded_key(F.col("set_id"), F.col("combo_id"), name, seed)
        number = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
        return r.at((number % r.count).cast("int")).alias(name)

    return combos.select("set_id", "combo_id", *[pick(k, r) for k, r in ranges.items()])


def param_combinations(
    baselines: DataFrame, ranges: dict[str, Range], count: int, seed: int = SEED
) -> DataFrame:
    """The whole grid or a sample of it when it is small, random picks otherwise."""
    total = space_size(ranges)
    draw = full_grid if total <= FULL_GRID_LIMIT and count <= total else random_picks
    return draw(baselines, ranges, count, seed)
