"""Ordered operators on streams of samples. Each takes the keys of a stream and its order explicitly.

Sorting within the partitions of the keys is the only shuffle; operators on the same keys and order share it. A stream
is one partition of its window, as its order demands: keys should be streams or files, not classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What makes the median absolute deviation a standard deviation; and the range of sequence numbers.
MAD_SCALE = 1.4826
SEQUENCES = 1 << 32
#: Rows that a task holds before it filters them.
MOST = 20_000


def _over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def first_difference(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "diff") -> DataFrame:
    """The difference to the row before; null in a stream's first row."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(_over(keys, order)))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 3, edges: str = "truncate", out: str = "smooth") -> DataFrame:
    """The centred mean. At the edges either fewer rows count (truncate) or the outermost value repeats (nearest)."""
    w, half = _over(keys, order), width // 2
    if width <= 1:
        return df.withColumn(out, F.col(value).cast("double"))
    if edges == "truncate":
        return df.withColumn(out, F.avg(value).over(w.rowsBetween(-half, half)))
    every = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(every), F.last(value).over(every)
    terms = [F.col(value)]
    for k in range(1, half + 1):
        terms += [F.coalesce(F.lag(value, k).over(w), first), F.coalesce(F.lead(value, k).over(w), last)]
    return df.withColumn(out, sum(terms[1:], terms[0]) / len(terms))


def _medians(x: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int, truncate: bool) -> tuple[np.ndarray, np.ndarray]:
    """The local median of each value, and the median distance from it; windows don't leave the stream, whose rows are first to last.

    Outside of it the outermost row repeats, or nothing counts (truncate). Missing values are NaN and don't count.
    """
    at = np.arange(len(x))[:, None] + np.arange(-radius, radius + 1)
    out = (at < first[:, None]) | (at > last[:, None])
    at = np.clip(at, first[:, None], last[:, None])
    whole = not np.isnan(x).any()

    def middle(near: np.ndarray) -> np.ndarray:
        if truncate:
            near = np.where(out, np.nan, near)
        elif whole:
            return np.median(near, axis=1)
        ordered = np.sort(near, axis=1)  # NaN goes last
        n, row = near.shape[1] - np.isnan(near).sum(axis=1), np.arange(len(near))
        return np.where(n > 0, (ordered[row, np.maximum(n - 1, 0) // 2] + ordered[row, np.minimum(n // 2, near.shape[1] - 1)]) / 2, np.nan)

    median = middle(x[at])
    return median, middle(np.abs(x[at] - median[:, None]) if truncate else np.abs(x - median)[at])


def hampel(df: DataFrame, keys: list[str], order: list[str], value: str, radius: int = 5, sigmas: float = 3.0, edges: str = "nearest", out: str = "clean") -> DataFrame:
    """Replaces outliers by the local median.

    edges nearest: the outermost rows repeat, and a row's deviation is from its own local median; the local median of
    those deviations is the scale. edges truncate: windows get shorter at the edges, and deviations within a window are
    from the window's median. A scale of 0 replaces nothing; in nearest, streams of fewer than 3 rows stay as they are.

    Rows are exchanged once by stream, sorted, and read as a stream: a task holds some batches, and of a stream that goes
    on the last rows that windows can still reach.
    """
    truncate, names = edges == "truncate", df.columns
    stream, reach = "_stream", 2 * radius
    marked = df.withColumn(out, F.col(value).cast("double")).withColumn(stream, F.xxhash64(*keys))
    kept = [c for c in marked.columns if c != stream]

    def judged(table: pa.Table, before: int, after: int) -> pa.Table:
        """table without the first `before` rows, which were given already, and the last `after` ones, which are to come."""
        x = table.column(out).to_numpy(zero_copy_only=False).astype(float)
        of = table.column(stream).to_numpy()
        begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        size = np.diff(np.append(begins, len(of)))
        first = np.repeat(begins, size)
        clean = x.copy()
        for low in range(0, len(x), MOST):  # windows of so many rows at once
            part = slice(max(0, low - reach), low + MOST + reach)
            base = part.start
            median, scale = _medians(x[part], np.maximum(first[part] - base, 0), np.minimum((first + np.repeat(size, size) - 1)[part] - base, len(x[part]) - 1), radius, truncate)
            with np.errstate(invalid="ignore"):
                off = (scale > 0) & (np.abs(x[part] - median) > sigmas * MAD_SCALE * scale)
            if not truncate:
                off &= np.repeat(size, size)[part] >= 3
            own = slice(low - base, low - base + MOST)
            clean[low : low + MOST] = np.where(off, median, x[part])[own]
        clean = pa.array(clean, mask=np.isnan(clean))
        return table.set_column(table.schema.get_field_index(out), out, clean).select(kept).slice(before, len(x) - before - after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < MOST:
                continue
            of = held.column(stream).to_numpy()
            goes_on = int(np.flatnonzero(of[1:] != of[:-1])[-1]) + 1 if (of[1:] != of[:-1]).any() else 0
            if goes_on:  # all streams but the last are whole
                yield from judged(held.slice(0, goes_on), before, 0).combine_chunks().to_batches()
                held, before = held.slice(goes_on), 0
            if held.num_rows >= MOST:  # the last one is longer than what is held at once
                yield from judged(held, before, reach).combine_chunks().to_batches()
                most = min(held.num_rows, 2 * reach)
                held, before = held.slice(held.num_rows - most), most - reach
        if held is not None and held.num_rows:
            yield from judged(held, before, 0).combine_chunks().to_batches()

    dealt = marked.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType([marked.schema[c] for c in kept])
    return dealt.mapInArrow(run, schema).select(*names, *([out] if out not in names else []))


def sequence_gaps(df: DataFrame, keys: list[str], order: list[str], sequence: str) -> DataFrame:
    """(keys, packets, gaps): missing sequence numbers, which wrap at 2^32; jumps of 2^31 and more are restarts."""
    d = F.pmod(F.col(sequence) - F.lag(sequence).over(_over(keys, order)), F.lit(SEQUENCES))
    missing = F.when((d > 1) & (d < SEQUENCES // 2), d - 1).otherwise(F.lit(0))
    return df.select(*keys, missing.alias("_m")).groupBy(*keys).agg(F.count("*").alias("packets"), F.sum("_m").alias("gaps"))


def sampling_rate(df: DataFrame, keys: list[str], order: list[str], seconds: str) -> DataFrame:
    """(keys, duration, rate) from the first and last positive time of a stream: (n - 1) / duration, 0 if that is undefined."""
    position = F.struct(*[F.col(c) for c in order])
    seen = df.where(F.col(seconds) > 0).groupBy(*keys).agg(F.count("*").alias("n"), (F.max_by(seconds, position) - F.min_by(seconds, position)).alias("d"))
    good = (F.col("n") >= 2) & (F.col("d") > 0)
    found = df.select(*keys).distinct().join(seen, keys, "left")
    return found.select(*keys, F.when(good, F.col("d")).otherwise(0.0).alias("duration"), F.when(good, (F.col("n") - 1) / F.col("d")).otherwise(0.0).alias("rate"))


def dataset_rate(rates: DataFrame, rate: str = "rate", fixed: float | None = None) -> DataFrame:
    """(rate): the fixed one, or the median of the streams' positive rates."""
    if fixed is not None:
        return rates.sparkSession.range(1).select(F.lit(fixed).alias("rate"))
    return rates.where(F.col(rate) > 0).agg(F.percentile(rate, F.lit(0.5)).alias("rate"))


def rolling_rate(df: DataFrame, keys: list[str], micros: str, span: int = 1_000_000, out: str = "rate") -> DataFrame:
    """Packets a second over the span that ends with each row; the number of rows where there is but one or no time passed."""
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-span, 0)
    n, passed = F.count(F.lit(1)).over(w), (F.col(micros) - F.min(micros).over(w)) / F.lit(1e6)
    return df.withColumn(out, F.when((n >= 2) & (passed > 0), (n - 1) / passed).otherwise(n.cast("double")))


def clock_epochs(df: DataFrame, keys: list[str], order: list[str], device_micros: str, host_seconds: str) -> DataFrame:
    """epoch and capture: a device clock that goes back starts an epoch; in each the first row ties device to host time."""
    w = _over(keys, order)
    back = F.when(F.col(device_micros) < F.lag(device_micros).over(w), 1).otherwise(0)
    step = df.withColumn("_back", back).withColumn("epoch", F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_back")
    offset = F.first(F.col(host_seconds) - F.col(device_micros) / F.lit(1e6)).over(Window.partitionBy(*keys, "epoch").orderBy(*order))
    return step.withColumn("capture", offset + F.col(device_micros) / F.lit(1e6))


def smoothing(df: DataFrame, keys: list[str], order: list[str], value: str, weights: list[float], out: str = "smooth") -> DataFrame:
    """The weighted mean of the last rows, oldest weight first; with fewer rows the newest weights share the whole."""
    w = _over(keys, order)
    top, bottom = F.lit(0.0), F.lit(0.0)
    for back, weight in enumerate(reversed(weights)):
        x = F.lag(value, back).over(w) if back else F.col(value)
        top, bottom = top + F.coalesce(x * weight, F.lit(0.0)), bottom + F.when(x.isNotNull(), F.lit(float(weight))).otherwise(0.0)
    return df.withColumn(out, top / bottom)


def in_collection(df: DataFrame, seconds: str, start: float, end: float) -> DataFrame:
    return df.where(F.col(seconds).between(start, end))
