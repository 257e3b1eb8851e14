"""Substring dedup by suffix arrays: bytes go that are covered by a string of `window` bytes that starts anywhere else too.

1. Equal texts become one (a table, bucketed by the text's digest, that later joins read without an exchange).
2. Each window has an anchor, of its strings of ANCHOR bytes the one with the least hash, so equal windows have equal
   anchors. Consecutive windows with one anchor are a region; some two regions come per window - ANCHOR bytes. Regions
   of anchors that occur once can't repeat anything. Equal regions become one, which is marked if it occurs twice.
3. The other regions are dealt to shards by their anchor's owner (the least digest that has it), so that neighbours come
   together and are cut from their text as one passage; what is marked is put in twice. An owner with much text is
   dealt to several shards by anchor. Of each shard the suffix array is induced, and its permuted common prefixes tell
   which windows start elsewhere too.
4. The regions of an anchor that would fill a shard are halved by the anchor's place in the window: all windows of a
   half have so many bytes around the anchor in common, by whose hash they are dealt anew, until all fit. In halves of
   one window, equal keys are equal windows, so that ends.

Texts and regions are told apart by 128 bits; windows are compared byte by byte in the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.llm.common import buffer, cut, mix, partitions, shared_dir, slices
from chanspark.llm.suffixes import repeated

WINDOW = 400
#: Bytes of an anchor, at most the window's.
ANCHOR = 128
#: Bytes of regions that one shard takes, about.
SHARD = 1 << 19
#: Windows that are looked at together in a long text.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

REGION = "anchor long, r long, s long"
PASSAGE = "shard long, body binary, twice boolean, at array<int>, size array<int>, anchor array<long>, r array<long>, s array<long>"


def _key(text: str) -> Column:
    """128 bits of a text's SHA-256; null is empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


def _anchor_places(data: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window of data where its anchor begins; of equal hashes the first."""
    h, reach = _BYTE[data], 1
    while reach < anchor:
        step = min(reach, anchor - reach)
        h = mix(h[:-step] * np.uint64(0x9FB21C651E98DF25) + h[step:]) if reach == 4 else h[:-step] * np.uint64(0x9FB21C651E98DF25) + h[step:]
        reach += step
    h = mix(h)
    h &= ~_PLACE
    h |= np.arange(len(h), dtype=np.uint64)
    reach, goal = 1, window - anchor + 1
    while reach < goal:
        step = min(reach, goal - reach)
        h = np.minimum(h[:-step], h[step:])
        reach += step
    return (h & _PLACE).astype(np.int64)


def _cut_regions(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, windows, place of the anchor) of all regions, in runs; places count in data."""
    if len(data) > 2 * BLOCK:  # one long text
        for low in range(0, len(data) - window + 1, BLOCK):
            part = data[low : low + BLOCK + window - 1]
            for text, first, size, place in _cut_regions(part, np.array([0, len(part)]), window, anchor):
                yield text, first + low, size, place + low
        return
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    if not count.sum():
        return
    at = np.arange(count.sum()) + np.repeat(offsets[:-1] - np.cumsum(count) + count, count)
    place = _anchor_places(data, window, anchor)[at]
    begin = np.flatnonzero(np.append(True, (np.diff(place) != 0) | (np.diff(at) != 1)))
    text = np.repeat(np.arange(len(count)), count)[begin]
    yield text, at[begin], np.diff(np.append(begin, len(at))), place[begin]


def _regions(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, twice, anchor, r, s, first, size, at) of (key, twice, text): regions with the digests of anchor and whole, first window, windows, and the anchor's place from there."""
    names = ["key", "twice", "anchor", "r", "s", "first", "size", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            data, offsets = buffer(part.column(2))
            raw = data.tobytes()
            for text, first, size, place in _cut_regions(data, offsets, window, anchor):
                at = place - first
                anchors = [xxhash.xxh3_64_intdigest(raw[p : p + anchor]) for p in place.tolist()]
                whole = b"".join([xxhash.xxh3_128_digest(raw[a:b], seed) for a, b, seed in zip(first.tolist(), (first + size + window - 1).tolist(), at.tolist(), strict=True)])
                digests = np.frombuffer(whole, "<i8").reshape(-1, 2)
                columns = [part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), *[pa.array(c) for c in (np.array(anchors, np.uint64).view(np.int64), digests[:, 0], digests[:, 1])]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(c.astype(np.int32)) for c in (first - offsets[text], size, at)], names)

    return texts.mapInArrow(run, f"key binary, twice boolean, {REGION}, first int, size int, at int")


def _passages(marked: DataFrame, window: int) -> DataFrame:
    """PASSAGE of (text, wanted): runs of adjoining regions of one shard as one; regions of no shard (hot anchors) by themselves.

    A region that occurs twice is in a second passage too, which names no regions.
    """
    names = [c.split()[0] for c in PASSAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            data, offsets = buffer(part.column(0))
            raw = data.tobytes()
            lists = part.column(1)
            count = lists.value_lengths().to_numpy(zero_copy_only=False)
            fields = {f.name: lists.flatten().field(k) for k, f in enumerate(lists.type.value_type)}
            shard = fields["shard"].fill_null(-1).to_numpy(zero_copy_only=False)
            first, size, at, twice = (fields[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "size", "at", "twice"))
            text = np.repeat(np.arange(part.num_rows), count)
            order = np.lexsort((first, text))
            for again in (False, True):
                own = order[(twice[order] > 0) & (shard[order] >= 0)] if again else order
                if not len(own):
                    continue
                t, f, z, sh = text[own], first[own], size[own], shard[own]
                fresh = np.append(True, (np.diff(t) != 0) | (np.diff(sh) != 0) | (sh[1:] < 0) | (f[1:] != f[:-1] + z[:-1]))
                at_run = np.flatnonzero(fresh)
                upto = np.append(at_run, len(own))
                low = offsets[t[at_run]] + f[at_run]
                high = offsets[t[upto[1:] - 1]] + f[upto[1:] - 1] + z[upto[1:] - 1] + window - 1
                body = pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
                ends = pa.array(np.zeros(len(upto), np.int32) if again else upto.astype(np.int32))
                listed = own[:0] if again else own
                arrays = [pa.ListArray.from_arrays(ends, pa.array(c[listed].astype(np.int32))) for c in (at, size)]
                arrays += [pa.ListArray.from_arrays(ends, fields[c].take(pa.array(listed))) for c in ("anchor", "r", "s")]
                mark = pa.array((twice[own[at_run]] > 0) & (sh[at_run] < 0))
                yield pa.RecordBatch.from_arrays([pa.array(sh[at_run]), body, mark, *arrays], names)

    return marked.select("text", "wanted").mapInArrow(run, PASSAGE)


def _found(passages: DataFrame, window: int, shards: int) -> DataFrame:
    """(anchor, r, s, low, high): of each region the runs of windows that start elsewhere in the shard too."""
    spark = passages.sparkSession
    names = ["anchor", "r", "s", "low", "high"]

    def judged(bodies: list, sizes: list, regions: list) -> pa.RecordBatch:
        """bodies: bytes; sizes: of each body its regions' windows; regions: of each body its regions' names, by column."""
        lengths = np.array([len(b) for b in bodies])
        text = np.frombuffer(b"\x00".join(bodies) + b"\x00\x00", np.uint8).copy()
        text[:-1] += 2
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text[begins + lengths] = 1  # between bodies, in which no window is; less than all bytes
        text[-1] = 0
        again = repeated(text, window)
        own = [k for k, z in enumerate(sizes) if len(z)]
        n = np.concatenate([sizes[k] for k in own]).astype(np.int64) if own else np.zeros(0, np.int64)
        start = np.concatenate([begins[k] + np.cumsum(sizes[k]) - sizes[k] for k in own]).astype(np.int64) if own else n
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(again[start[of] + at])
        of, at = of[hit], at[hit]
        fresh = np.append(True, (np.diff(of) != 0) | (np.diff(at) != 1))[: len(of)]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(of)) - 1 if len(first) else first
        columns = [np.concatenate([regions[k][c] for k in own]) if own else n for c in range(3)]
        return pa.RecordBatch.from_arrays([*[pa.array(c[of[first]]) for c in columns], pa.array(at[first].astype(np.int32)), pa.array(at[last].astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bodies, sizes, regions = None, [], [], []
        for batch in batches:
            flat = [batch.column(i) for i in range(2, 6)]
            upto = [np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in flat[:1]][0]
            values = [c.flatten().to_numpy(zero_copy_only=False) for c in flat]
            for k, (of, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if of != shard:
                    if bodies:
                        yield judged(bodies, sizes, regions)
                    shard, bodies, sizes, regions = of, [], [], []
                a, b = upto[k], upto[k + 1]
                bodies.append(body)
                sizes.append(values[0][a:b].copy())
                regions.append([v[a:b].copy() for v in values[1:]])
        if bodies:
            yield judged(bodies, sizes, regions)

    parts = max(1, min(shards, 4 * partitions(spark)))
    dealt = passages.select("shard", "body", "size", "anchor", "r", "s").repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("shard").mapInArrow(run, f"{REGION}, low int, high int")


def _halves(pieces: DataFrame, window: int, width: int) -> DataFrame:
    """pieces with the half that they are of: columns key, hr, hs (its name), shift, hbody, hat, hsize.

    The anchor's place in a window is from 0 to window - 1; pieces have places in a run of `width`, from a multiple of it.
    """
    half = width // 2
    names = ["anchor", "r", "s", "twice", "key", "hr", "hs", "shift", "hbody", "hat", "hsize"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for anchor, r, s, twice, body, at, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                middle = at // width * width + half  # windows whose anchor is there or later come first
                for low, high, base in ((0, min(size, at - middle + 1), middle), (max(0, at - middle + 1), size, middle - half)):
                    if low >= high:
                        continue
                    own, place = body[low : high + window - 1], at - low
                    core = body[max(0, at - base) : at - base - half + 1 + window]
                    digest = np.frombuffer(xxhash.xxh3_128_digest(own, place), "<i8").tolist()
                    key = xxhash.xxh3_64_intdigest(core, (anchor ^ base) & 0xFFFFFFFFFFFFFFFF)
                    for column, v in zip(out, (anchor, r, s, twice, key - (1 << 64) if key >> 63 else key, *digest, low, own, place, high - low), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.int32(), pa.int32()], strict=True)], names)

    schema = f"{REGION}, twice boolean, key long, hr long, hs long, shift int, hbody binary, hat int, hsize int"
    return pieces.select("anchor", "r", "s", "twice", "body", "at", "size").mapInArrow(run, schema)


def _settled(pieces: DataFrame, window: int, width: int, shard: int, keep) -> DataFrame:
    """_found of pieces (anchor, r, s, twice, body, at, size) of hot anchors: those that fit are sorted, the others halved."""
    spark = pieces.sparkSession
    sizes = keep(pieces.groupBy(F.col("anchor").alias("a")).agg(F.sum(F.length("body")).alias("bytes")))
    big = F.col("bytes") > shard if width > 1 else F.lit(False)
    total, hot = sizes.agg(F.sum(F.when(~big, F.col("bytes"))), F.count_if(big)).first()
    placed = pieces.join(sizes, F.col("anchor") == F.col("a"))
    out = spark.createDataFrame([], f"{REGION}, low int, high int")
    if total:
        shards = max(1, -(-2 * total // shard))
        own = placed.where(~big).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        once = own.select("shard", "body", *[F.array(c).alias(c) for c in ("size", "anchor", "r", "s")])
        more = own.where("twice").select("shard", "body", F.array().cast("array<int>").alias("size"), *[F.array().cast("array<long>").alias(c) for c in ("anchor", "r", "s")])
        out = out.union(keep(_found(once.union(more), window, shards)))
    if hot:
        halves = keep(_halves(placed.where(big), window, width))
        name = [F.col("key").alias("anchor"), F.col("hr").alias("r"), F.col("hs").alias("s")]
        same = halves.groupBy(*name).agg((F.sum(F.col("twice").cast("int") + 1) > 1).alias("twice"), F.first("hbody").alias("body"), F.first("hat").alias("at"), F.first("hsize").alias("size"))
        inner = keep(_settled(keep(same), window, width // 2, shard, keep).toDF("key_", "r_", "s_", "low", "high"))
        back = halves.join(inner, (F.col("key") == F.col("key_")) & (F.col("hr") == F.col("r_")) & (F.col("hs") == F.col("s_")))
        out = out.union(back.select("anchor", "r", "s", F.col("low") + F.col("shift"), F.col("high") + F.col("shift")))
    return out


def _judged(texts: DataFrame, window: int, with_bytes: bool) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of (key, text, spans)."""
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_bytes else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            data, offsets = buffer(part.column(1))
            keep = np.ones(len(data), bool)
            for i, spans in enumerate(part.column(2).to_pylist()):
                for s in spans or ():
                    keep[offsets[i] + s["start"] : offsets[i] + s["stop"]] = False
            gone = np.concatenate([[0], np.cumsum(~keep)])
            begins = ~keep
            begins[1:] &= keep[:-1]
            own = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[own] = ~keep[own]
            runs = np.concatenate([[0], np.cumsum(begins)])
            kept = data[keep].tobytes()
            ends = (np.arange(len(data) + 1) - gone)[offsets].tolist()
            bodies = [kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [part.column(0), *[pa.array(c.astype(np.int64)) for c in (np.diff(offsets), np.diff(gone[offsets]), np.diff(runs[offsets]))], pa.array([sha256(b).hexdigest() for b in bodies])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(bodies, pa.binary())] if with_bytes else []), names)

    return texts.mapInArrow(run, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


class Scratch:
    """Tables in a database of their own in the shared folder, for one run; drop() removes them with their files."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.name, self.count = spark, f"scratch_{uuid4().hex}", 0
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_dir(spark)}/{self.name}'")

    def keep(self, df: DataFrame, bucket: str | None = None) -> DataFrame:
        self.count += 1
        table = f"{self.name}.t{self.count}"
        writer = df.write.format("parquet")
        (writer.bucketBy(partitions(self.spark), bucket) if bucket else writer).saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")


def dedup(docs: DataFrame, window: int = WINDOW, with_bytes: bool = False, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row; kept has the bytes that stay.

    A byte goes if a string of `window` bytes covers it that also starts anywhere else in a text, the same one included;
    strings don't cross texts, and are judged on the input. Null texts are empty; texts shorter than the window stay
    whole, however often they occur; doc_id may be null or repeated, as only texts count, and a repeated row repeats its
    text. n_spans counts maximal runs of removed bytes. kept is binary, as a removed run may begin within a character.
    """
    anchor = min(anchor, window)
    scratch = Scratch(docs.sparkSession)
    keep = scratch.keep
    try:
        equal = docs.select(_key("text").alias("key"), F.coalesce("text", F.lit("")).alias("text")).groupBy("key").agg(F.count("*").alias("n"), F.first("text").alias("text"))
        texts = keep(equal.select("key", (F.col("n") > 1).alias("twice"), "text"), "key")

        every = keep(_regions(texts, window, anchor))
        copies = F.sum(F.col("twice").cast("int") + 1)
        shared = keep(every.groupBy(F.col("anchor").alias("a")).agg(copies.alias("n")).where("n > 1").select("a"))
        met = keep(every.join(shared, F.col("anchor") == F.col("a")).drop("a"))
        regions = keep(met.groupBy("anchor", "r", "s").agg((copies > 1).alias("twice"), F.min(F.struct("key", "first", "size", "at")).alias("own")))
        weight = (F.col("own.size") + window - 1) * (F.col("twice").cast("int") + 1)
        groups = keep(regions.groupBy(F.col("anchor").alias("a")).agg(F.sum(weight).alias("bytes"), F.min("own.key").alias("owner")))
        hot = F.col("bytes") > shard
        owners = groups.where(~hot).groupBy(F.col("owner").alias("o")).agg(F.ceil(F.sum("bytes") / shard).alias("blocks"))
        total, many = groups.agg(F.sum(F.when(~hot, F.col("bytes"))), F.count_if(hot)).first()
        shards = max(1, -(-(total or 0) // (2 * shard)))  # adjoining regions share most of their bytes
        placed = keep(groups.join(owners, (F.col("owner") == F.col("o")) & ~hot, "left").select("a", F.when(~hot, F.pmod(F.xxhash64("owner", F.pmod("a", "blocks")), F.lit(shards))).alias("shard")))
        wanted = regions.join(placed, F.col("anchor") == F.col("a")).select("own.*", "anchor", "r", "s", "twice", "shard")
        lists = wanted.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("first", "size", "at", "twice", "shard", "anchor", "r", "s")).alias("wanted"))
        passages = keep(_passages(texts.join(lists, F.col("key") == F.col("k")), window))

        found = _found(passages.where("shard >= 0"), window, shards)
        if many:
            pieces = passages.where("shard < 0").select("twice", "body", *[F.col(c)[0].alias(c) for c in ("at", "size", "anchor", "r", "s")])
            found = found.union(_settled(pieces, window, 1 << (window - 1).bit_length(), shard, keep))
        found = keep(found.toDF("a", "ra", "sa", "low", "high"))
        spans = met.join(found, (F.col("anchor") == F.col("a")) & (F.col("r") == F.col("ra")) & (F.col("s") == F.col("sa"))).select(F.col("key").alias("k"), (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + window).alias("stop"))
        listed = spans.groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
        judged = cut(_judged(texts.join(listed, F.col("key") == F.col("k"), "left").select("key", "text", "spans"), window, with_bytes))
    finally:
        scratch.drop()
    return docs.select("doc_id", _key("text").alias("k")).join(judged, F.col("k") == F.col("key")).drop("k", "key")
