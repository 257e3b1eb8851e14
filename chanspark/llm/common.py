"""What several of the training-data operators share: the shared folder, text buffers, words and range exchange."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that the numpy kernels hold at once; their temporaries take up to a hundred times as much.
SLICE_BYTES = 1 << 20

#: The white space that separates words.
WHITE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share: spark.checkpoint.dir, in Spark's default file system if it names none.

    Where it is unset, a local session (tests) gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="chanspark-")
        context.setCheckpointDir(found)
    if ":/" not in found:
        found = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + "/" + found.lstrip("/")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that no lost executor can take them back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of that name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose text takes about limit bytes; a longer text is a run of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _give_back() -> None:
    """Free memory of this process goes back to the system, where the C library can do that (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, before and after which free memory goes back to the system.

    Spark uses Python workers again for other stages; what an earlier one has freed is otherwise kept beside what the
    next one takes.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        yield from run(batches)
        _give_back()

    return held


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts after one another, and where each begins (and the last ends); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


WHITE = np.zeros(256, bool)
WHITE[list(WHITE_BYTES)] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (a run of other bytes than white space), and the number of the first word of each text."""
    white = WHITE[data]
    first, last = ~white, ~white
    first[1:] &= white[:-1]
    last[:-1] &= white[1:]
    own = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[own] = ~white[own]
    own = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[own] = ~white[own]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def splitters(df: DataFrame, key: Column, parts: int) -> list[int]:
    """Up to parts - 1 ascending long values that cut df into runs of about as many rows; null keys are left out."""
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    found = df.select(F.percentile_approx(key.cast("long"), cuts, 20 * parts).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def part_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at or below key: a search over coarse and then fine cuts, null keys first."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    table = F.array(*[F.array(*[F.lit(v).cast("long") for v in r]) for r in rows])
    below = lambda values: F.size(F.filter(values, lambda v: v <= key))
    coarse = below(heads)
    return F.when(key.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + below(F.element_at(table, F.greatest(coarse, F.lit(1)))))


def storage(uri: str):
    """The file system of a URI, as pyarrow opens it, and the path in it; a bare path is a local one."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared one, for one run of an operator."""
    from uuid import uuid4

    uri = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    fs, path = storage(uri)
    fs.create_dir(path, recursive=True)
    return uri


#: Bytes up to which a run is hashed and compared eight bytes at a time, all runs at once; longer ones go one by one.
LONG_RUN = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; past the end are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[s:e] of each run.

    Eight bytes at a time go through a bijection, so the hash has no algebra that texts could be made for, and runs of
    one length of 8 bytes or fewer have equal hashes only if they are equal. Longer ones can share a hash by chance.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    eights, some = _eights(data), np.flatnonzero(sizes <= LONG_RUN)
    for at in range(0, LONG_RUN, 8):
        some = some[sizes[some] > at]
        if not len(some):
            break
        out[some] = mix(out[some] ^ (eights[starts[some] + at] & _LOW[np.minimum(sizes[some] - at, 8)]))
    for i in np.flatnonzero(sizes > LONG_RUN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 1)
    return out


def equal_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether the bytes data[s:e] and other[b:t] are the same, for each pair of runs."""
    sizes = ends - starts
    out = sizes == stops - begins
    left, right, some = _eights(data), _eights(other), np.flatnonzero(out & (sizes <= LONG_RUN))
    for at in range(0, LONG_RUN, 8):
        some = some[sizes[some] > at]
        if not len(some):
            break
        out[some] &= (left[starts[some] + at] ^ right[begins[some] + at]) & _LOW[np.minimum(sizes[some] - at, 8)] == 0
    for i in np.flatnonzero(out & (sizes > LONG_RUN)).tolist():
        out[i] = np.array_equal(data[starts[i] : ends[i]], other[begins[i] : stops[i]])
    return out
