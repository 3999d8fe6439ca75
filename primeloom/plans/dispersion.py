"""Dispersion over saved runs: population deviations, error bars, per-language positions, and the splice of two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITIONS, DIVISOR = (0, 1, 2, 3, 7), 149


def deviations(rows: DataFrame, by: str, columns: Sequence[str], divisor: float = DIVISOR) -> DataFrame:
    """``by``, and for each column its population deviation and that over ``divisor``."""
    stds = [F.stddev_pop(c).alias(f"{c}_std") for c in columns]
    return rows.groupBy(by).agg(*stds).select(by, *[x for c in columns for x in (F.col(f"{c}_std"), (F.col(f"{c}_std") / divisor).alias(f"{c}_bar"))])


def position_values(rows: DataFrame, array: str, positions: Sequence[int] = POSITIONS) -> DataFrame:
    """The rows' other columns with ``position, value`` of the positions an array has."""
    return rows.select(*[c for c in rows.columns if c != array], F.posexplode(array).alias("position", "value")).where(F.col("position").isin(*positions))


def position_deviations(rows: DataFrame, by: str, arrays: dict[str, str], positions: Sequence[int] = POSITIONS, divisor: float = DIVISOR) -> DataFrame:
    """``by, metric, position, std, bar`` of the arrays of scores by language (metric name: column), in one pass over the rows."""
    measures = [F.stddev_pop(F.get(F.col(c), F.lit(p))).alias(f"{m}_{p}") for m, c in arrays.items() for p in positions]
    wide = rows.groupBy(by).agg(*measures)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(p).alias("position"), F.col(f"{m}_{p}").alias("std")) for m in arrays for p in positions]))
    return wide.select(by, each.alias("e")).where("e.std IS NOT NULL").select(by, "e.metric", "e.position", "e.std", (F.col("e.std") / divisor).alias("bar"))


def splice(main: DataFrame, other: DataFrame, keys: Sequence[str], array: str) -> DataFrame:
    """Keys and the first four values of the main run, three zeros, the first value of the other run.

    Runs are joined by key, not by place; entries that one run lacks are left out.
    """
    a, b = main.select(*keys, F.col(array).alias("a")), other.select(*keys, F.col(array).alias("b"))
    spliced = F.concat(F.slice("a", 1, 4), F.array(*[F.lit(0.0)] * 3), F.slice("b", 1, 1))
    return a.join(b, list(keys)).select(*keys, spliced.alias(array))
