"""Column functions over channel vectors and probability vectors; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes in the order in which ties are broken.
CLASSES = ("empty", "static_presence", "movement")
EPS = 1e-8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def amplitude(imag: Column | str, real: Column | str) -> Column:
    """Magnitudes of a complex vector, as long as the shorter of its two parts; null if either is."""
    imag, real = _c(imag), _c(real)
    n = F.least(F.size(imag), F.size(real))
    return F.zip_with(F.slice(imag, 1, n), F.slice(real, 1, n), lambda i, r: F.sqrt(i.cast("double") * i + r.cast("double") * r))


def phase(imag: Column | str, real: Column | str) -> Column:
    """Angles of a complex vector, from minus pi to pi."""
    imag, real = _c(imag), _c(real)
    n = F.least(F.size(imag), F.size(real))
    return F.zip_with(F.slice(imag, 1, n), F.slice(real, 1, n), lambda i, r: F.atan2(i.cast("double"), r.cast("double")))


def every_second(raw: Column | str, first: int) -> Column:
    """Elements first, first + 2, ... (from 0) of as many pairs as are whole: 0 gives imaginary, 1 real parts."""
    raw = _c(raw)
    pairs = F.floor(F.size(raw) / 2).cast("int")
    places = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.element_at(raw, 2 * i + 1 + first))


def pick(values: Column | str, places: list[int]) -> Column:
    """The elements at these places (from 0); places beyond the end are left out."""
    values = _c(values)
    return F.filter(F.transform(F.array(*map(F.lit, places)), lambda i: F.try_element_at(values, i + 1)), lambda x: x.isNotNull())


def is_valid(values: Column | str) -> Column:
    """Whether a vector has elements, all finite, and not all zero; false for null."""
    values = _c(values)
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(values) > 0) & finite & F.exists(values, lambda x: x != 0), F.lit(False))


def zscore(value: Column | str, mean: Column | str, std: Column | str, eps: float = 0.0) -> Column:
    return (_c(value) - _c(mean)) / (_c(std) + F.lit(eps))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def normalised(probabilities: Column | str) -> Column:
    """Probabilities that add up to 1. A negative or non-finite one, or a sum of 0, is an error; null stays null."""
    p = _c(probabilities)
    good = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))) & (total(p) > 0)
    return F.when(p.isNotNull(), F.when(good, F.transform(p, lambda x: x / total(p))).otherwise(F.raise_error(F.lit("probabilities must be finite, not negative, and not all zero"))))


def softmax(scores: Column | str) -> Column:
    scores = _c(scores)
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / total(shifted))


def winner(probabilities: Column | str, classes: tuple[str, ...] = CLASSES) -> Column:
    """The class of the largest probability, the earliest of equal ones."""
    p = _c(probabilities)
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(p, F.array_max(p)).cast("int"))


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded as DuckDB's SQL does: the product with 10^digits, half away from zero; the sign of a zero stays.

    Spark's round() goes by the decimal digits of a number, and has no negative zero.
    """
    x, scale = _c(x), F.lit(10.0**digits)
    whole = F.signum(x) * F.round(F.abs(x * scale)) / scale
    return F.when(F.abs(x * scale) < float("inf"), whole).otherwise(x)


def block_of(channel: Column | str, channels: int, blocks: int = 4) -> Column:
    """Which of the equal blocks a channel is in, the last block taking the rest."""
    return F.least(F.floor(_c(channel) / (channels // blocks)), F.lit(blocks - 1)).cast("int")
