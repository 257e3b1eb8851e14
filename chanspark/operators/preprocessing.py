"""Preprocessing as one fitted step: which channels stay and how they are scaled, learned from training vectors, applied to any."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chanspark.functions import arrays
from chanspark.operators import channels, ranking


@dataclass
class Fitted:
    """selected: the channels that stay, ascending; mean and std of each of them."""

    selected: list[int]
    mean: list[float]
    std: list[float]
    width: int


def fit(rows: DataFrame, array: str, width: int, threshold: float = 0.95, min_std: float = channels.MIN_STD) -> Fitted:
    """From vectors of `width` values: informative channels, less those correlated with an earlier one, and their scaler.

    Vectors that aren't valid or of another length don't count. A row a channel, and a row a pair of channels that are
    correlated, come to the driver; both are bounded by the width.
    """
    good = rows.where(arrays.is_valid(array) & (F.size(array) == width))
    scaler = {r["channel"]: r for r in channels.fit_zscore(ranking.channels_long(good, array), min_std).where("informative").collect()}
    kept = channels.prune(channels.correlations(good, array, width), sorted(scaler), threshold)
    return Fitted(kept, [scaler[c]["mean"] for c in kept], [scaler[c]["std"] for c in kept], width)


def transform(rows: DataFrame, array: str, fitted: Fitted, out: str = "z") -> DataFrame:
    """rows whose vectors are valid and as wide as those learned from, with the scaled values of the selected channels."""
    good = rows.where(arrays.is_valid(array) & (F.size(array) == fitted.width))
    scaled = [(F.col(array)[c].cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(fitted.selected, fitted.mean, fitted.std, strict=True)]
    return good.withColumn(out, F.array(*scaled) if scaled else F.array().cast("array<double>"))
