"""Near copies by similarity: links of SimHash, and all pairs of texts whose sets of shingles are similar enough, exactly.

Candidates come from prefixes. All shingles have one order; a set of n is similar to another (Jaccard t or more) only
if both share one of their first n - ceil(t n) + 1. So texts that meet in no shingle of their prefixes need not be
compared, and no similar pair is lost, whatever the order is. Shingles that a sample of the documents often has come
last in it: then texts that only share a passage don't meet.

What meets is first held against bitmaps of parities, which differ in no more bits than the sets differ in shingles, and
then compared in full.

Groups don't need all their pairs. Of the texts that share a shingle of their prefixes, those next to each other in a
mixed order are compared first, so a group of copies comes together at a cost in proportion to its size; a pair is
compared in full only if it would join two groups. Then every two texts that share such a shingle and are still in
different groups are compared. So each similar pair ends up within one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chanspark.llm import simhash
from chanspark.llm.common import cut, frugal, mix, partitions, slices, unused
from chanspark.llm.components import components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: For the order only: documents of the sample, how often a shingle that comes last is in it, and the number of those.
SAMPLE, OFTEN, LAST = 10_000, 3, 200_000
#: Candidate texts up to this number are found by a broadcast of their ids; more by exchange.
BROADCAST_IDS = 500_000

#: Least longs of a bitmap of parities, which has two bits a shingle at least; what rounding may take from a size.
BITMAP, EPS = 16, 1e-9
#: Text bytes whose shingles a task holds at once.
SLICE = 1 << 19
#: Pairs for each group, on average, up to which all are compared at once; beyond, each group's best pair goes first, then
#: so many times as many in each round, so that rounds grow with the logarithm of a group's pairs.
AT_ONCE, MORE = 4, 64
#: Keys of a text, its first of so many kinds, by which it is seen that a text and a group have met before.
SLOTS = 6


def _sets(column: pa.Array, shingle: int, last: np.ndarray):
    """Fingerprint, digest and size of each text's set, the text of each of its shingles, and these in order."""
    hashes, upto = simhash.shingle_hashes(column, shingle)
    n = len(upto) - 1
    text, own = np.repeat(np.arange(n), np.diff(upto)), mix(hashes)
    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own if len(last) else np.zeros(len(own), bool)
    order = np.lexsort((own, late, text))
    text, own = text[order], own[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (own[1:] != own[:-1])
    text, own = text[fresh], own[fresh]
    size = np.bincount(text, minlength=n)
    ends = np.concatenate([[0], np.cumsum(size)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(own), dtype=np.uint64)])
    return simhash.majority(hashes, upto).view(np.int64), (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64), size, text, own


def _lists(values: np.ndarray, sizes: np.ndarray, some: np.ndarray | None = None) -> pa.Array:
    """Lists of these sizes; null where some is false."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values), mask=None if some is None else pa.array(~some))


def _last(docs: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that a sample of the documents often has, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(_sets(part.column(0), shingle, np.zeros(0, np.uint64))[-1].view(np.int64))], ["s"])

    share = int(min(1.0, SAMPLE / max(1, docs.count())) * (1 << 30))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("text").mapInArrow(run, "s long")
    often = drawn.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "s").limit(LAST)
    return np.sort(often.select("s").toArrow().column("s").to_numpy().view(np.uint64))


def _sketched(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, digest, fp, n, prefix, bitmap): the digest tells whether two texts have the same n shingles.

    prefix and bitmap are null where the task has had a text with that digest, so that copies don't repeat them.
    """
    last = docs.sparkSession.sparkContext.broadcast(_last(docs, shingle))
    names = ["doc_id", "digest", "fp", "n", "prefix", "bitmap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, 1, SLICE):
            fp, digest, size, text, own = _sets(part.column(1), shingle, last.value)
            fresh = np.zeros(len(size), bool)
            for i, d in enumerate(digest.tolist()):
                if d not in seen:
                    seen.add(d)
                    fresh[i] = True
            heads = np.where(fresh & (size > 0), size - np.ceil(similarity * size - EPS).astype(np.int64) + 1, 0)
            place = np.arange(len(own)) - (np.cumsum(size) - size)[text]
            prefix = own[place < heads[text]].view(np.int64)
            longs = np.where(fresh, BITMAP << np.ceil(np.log2(np.maximum(size / (32 * BITMAP), 1))).astype(np.int64), 0)
            bitmap, begin, kept = np.zeros(longs.sum(), np.uint64), np.cumsum(longs) - longs, fresh[text]
            bit, of = mix(own[kept] ^ np.uint64(0x9E3779B97F4A7C15)), text[kept]
            place = begin[of] + ((bit >> np.uint64(32)).astype(np.int64) & (longs[of] - 1))
            np.bitwise_xor.at(bitmap, place, np.uint64(1) << (bit & np.uint64(63)))
            columns = [pa.array(digest), pa.array(fp), pa.array(size.astype(np.int32)), _lists(prefix, heads, fresh), _lists(bitmap.view(np.int64), longs, fresh)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(frugal(run), "doc_id long, digest long, fp long, n int, prefix array<long>, bitmap array<long>")


def _neighbours(rows: DataFrame) -> DataFrame:
    """Of the distinct rows (key, digest, n, at), in order of key and then mixed, every two neighbours that share a key.

    (key, digest, n, at, before: those of the row before, leads: whether that is the first of its key). Rows are cut into
    ranges and read as a stream, so a key that many texts have may be cut too: the first and the last row of a range come
    alone as well, with before null.
    """
    names = ["key", "digest", "n", "at"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    whole = pa.struct(list(zip(names[1:], kinds[1:], strict=True)))

    def alone(row: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], k) for x, k in zip(row, kinds, strict=True)], pa.nulls(1, whole), pa.array([False])], [*names, "before", "leads"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead = None, True  # the row before this batch, and whether it was the first of its key
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = [c.to_numpy() for c in batch.columns]
            if last is None:
                yield alone([c[0] for c in values])
            else:
                values = [np.append(np.array([x], c.dtype), c) for x, c in zip(last, values, strict=True)]
            same = values[0][1:] == values[0][:-1]
            fresh = np.append(True, ~same | (values[1][1:] != values[1][:-1]))
            values = [c[fresh] for c in values]
            same = values[0][1:] == values[0][:-1]
            leads = np.append(lead, ~same)
            at = np.flatnonzero(same)
            if len(at):
                before = pa.StructArray.from_arrays([pa.array(c[at]) for c in values[1:]], fields=list(whole))
                yield pa.RecordBatch.from_arrays([*[pa.array(c[at + 1]) for c in values], before, pa.array(leads[at])], [*names, "before", "leads"])
            last, lead = [c[-1] for c in values], bool(leads[-1])
        if last is not None:
            yield alone(last)

    ranged = rows.withColumn("mixed", F.xxhash64("digest", "key")).repartitionByRange(partitions(rows.sparkSession), "key", "mixed")
    ordered = ranged.sortWithinPartitions("key", "mixed", "digest").select(*names)
    return ordered.mapInArrow(run, "key long, digest long, n int, at int, before struct<digest:long,n:int,at:int>, leads boolean")


def _entries(neighbours: DataFrame) -> DataFrame:
    """The rows (key, digest, n, at) that neighbours has."""
    return neighbours.select("key", "digest", "n", "at").union(neighbours.where("leads").select("key", "before.*"))


def _enough(common: Column, x: Column, y: Column, similarity: float) -> Column:
    """Whether sets of x and y shingles that have so many in common are similar."""
    return common * (1 + similarity) >= F.lit(similarity) * (x + y) - EPS


def _allowed(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of (a, n_a, at_a, b, n_b, at_b), which share a shingle, those whose sizes and places allow the similarity, once."""
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # from their first common shingle on
    fits = met.where((F.col("a") != F.col("b")) & _enough(rest, F.col("n_a"), F.col("n_b"), similarity))
    return fits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sides(entries: DataFrame, *more: str) -> list[DataFrame]:
    return [entries.select("key", F.col("digest").alias(k), F.col("n").alias(f"n_{k}"), F.col("at").alias(f"at_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in more]) for k in "ab"]


def _marked(entries: DataFrame) -> DataFrame:
    """The distinct rows (key, digest, n, at, ...), with met_0 and so on: the first key of each slot that the text has, if it comes before this one."""
    slot, slots = F.pmod("key", F.lit(SLOTS)), range(SLOTS)
    firsts = entries.groupBy(F.col("digest").alias("of")).agg(*[F.min(F.when(slot == k, F.struct("at", "key"))).alias(f"first_{k}") for k in slots])
    before = [F.when(F.col(f"first_{k}.at") < F.col("at"), F.col(f"first_{k}.key")).alias(f"met_{k}") for k in slots]
    return entries.join(firsts, F.col("digest") == F.col("of")).select(*entries.columns, *before)


def _across(entries: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all texts that meet in a prefix and are in different groups; group by group, so none within one is made.

    Texts that have much in common meet at many keys. A text and a group are passed over at a key if an earlier one is
    known that the text and all of the group's texts here have: there all these pairs are met, with wider bounds.
    """
    grouped = entries.join(roots, F.col("digest") == F.col("node"), "left").select("key", "digest", "n", "at", F.coalesce("root", "digest").alias("group"))
    several = grouped.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x < y").select(F.col("key").alias("k"))
    left = cut(_marked(cut(grouped.join(several, F.col("key") == F.col("k"), "left_semi"))))
    met = [f"met_{k}" for k in range(SLOTS)]
    # Of a group's texts at a key the fewest shingles, and the most that come from there on: what bounds all of them.
    of_all = [F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(f"all_{c}") for c in met]
    others = left.groupBy(F.col("key").alias("k"), F.col("group").alias("other")).agg(F.min("n").alias("fewest"), F.max(F.col("n") - F.col("at")).alias("rest"), *of_all)
    a, b = _sides(left, "group", *met)[0], _sides(left, "group")[1]
    fits = _enough(F.least(F.col("n_a") - F.col("at_a"), F.col("rest")), F.col("n_a"), F.col("fewest"), similarity)
    fresh = ~reduce(Column.__or__, [F.coalesce(F.col(f"{c}_a") == F.col(f"all_{c}"), F.lit(False)) for c in met])
    asked = a.join(others, (F.col("key") == F.col("k")) & (F.col("group_a") < F.col("other")) & fits & fresh).select("key", "a", "n_a", "at_a", "other")
    return _allowed(asked.join(b.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("other") == F.col("group_b"))), similarity)


def _with_sides(pairs: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b, ...) with the columns of both digests' texts, as column_a and column_b."""
    for k in "ab":
        pairs = pairs.join(texts.select(F.col("digest").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns]), k)
    return pairs


def _close(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """(a, b, unlike): the pairs whose bitmaps allow the similarity, and in how many bits they differ.

    A bitmap's size is a power of two; the halves of the larger one, put together, have the parities of the smaller size.
    """
    texts = sketched.where("bitmap IS NOT NULL").select("digest", "n", "bitmap").dropDuplicates(["digest"])
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), F.shiftright(F.size(c), 1)), F.slice(c, F.shiftright(F.size(c), 1) + 1, F.shiftright(F.size(c), 1)), lambda x, y: x.bitwiseXOR(y))
    least = lambda c, other: F.when(F.size(c) > F.size(other), half(c)).otherwise(F.col(c))  # noqa: E731  sizes that fit are at most one doubling apart
    bits = F.zip_with(least("bitmap_a", "bitmap_b"), least("bitmap_b", "bitmap_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    unlike = F.aggregate(bits, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    judged = _with_sides(pairs, texts, "n", "bitmap").withColumn("unlike", unlike)
    return judged.where(_enough((F.col("n_a") + F.col("n_b") - F.col("unlike")) / 2, F.col("n_a"), F.col("n_b"), similarity)).select("a", "b", "unlike")


def _verified(docs: DataFrame, sketched: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets, compared in full, are similar enough."""
    some = pairs.select(F.col("a").alias("of")).union(pairs.select("b")).distinct()
    ids = cut(sketched.join(some, F.col("digest") == F.col("of"), "left_semi").groupBy("digest").agg(F.min("doc_id").alias("id")).select("id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, SLICE):
            _, digest, size, _, own = _sets(part.column(0), shingle, np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(digest), _lists(own.view(np.int64), size)], ["digest", "shingles"])

    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("long").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = cut(texts.mapInArrow(frugal(run), "digest long, shingles array<long>").dropDuplicates(["digest"]))
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return _with_sides(pairs.select("a", "b"), sets, "shingles").where(_enough(common, F.size("shingles_a"), F.size("shingles_b"), similarity)).select("a", "b")


def links(docs: DataFrame, sketched: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): the digests of all two different sets that are as similar as that, once; from docs and their _sketched."""
    entries = _entries(cut(_neighbours(_prefixes(sketched))))
    a, b = _sides(entries)
    return _verified(docs, sketched, cut(_close(_allowed(a.join(b, "key"), similarity), sketched, similarity)), shingle, similarity)


def _prefixes(sketched: DataFrame) -> DataFrame:
    return sketched.select("digest", "n", F.posexplode("prefix").alias("at", "key")).select("key", "digest", "n", "at")


def _settled(docs: DataFrame, sketched: DataFrame, pairs: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """roots (node, root), with those groups as one that similar texts among pairs join; the smallest node names a group.

    A round looks for components of the groups that it joins, and not of all texts anew.
    """
    left, quota = cut(_close(pairs, sketched, similarity)), 1
    while True:
        for k in "ab":
            left = left.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left").withColumn(f"root_{k}", F.coalesce(f"root_{k}", k))
        left = cut(left.where("root_a <> root_b"))
        group = F.greatest("root_a", "root_b").alias("group")
        best = cut(left.groupBy(group, F.pmod(F.xxhash64("a", "b"), F.lit(quota)).alias("_of")).agg(F.min(F.struct("unlike", "a", "b", "root_a", "root_b")).alias("p")).select("group", "p.*"))
        n, groups = left.count(), best.select("group").distinct().count()
        if not n:
            return roots
        tried = (left if n <= AT_ONCE * groups else best).select("a", "b", "root_a", "root_b")
        met = _verified(docs, sketched, tried, shingle, similarity).join(tried, ["a", "b"])
        joined = cut(components(met.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
        moved = joined.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        after = roots.join(moved, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))
        roots = cut(after.union(joined.select("node", "root")).distinct())
        if n <= AT_ONCE * groups:
            return roots
        left, quota = left.select("a", "b", "unlike").join(tried.select("a", "b"), ["a", "b"], "left_anti"), quota * MORE


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of documents whose doc_id is the smallest of their group; of rows that repeat that doc_id all stay.

    Groups are the components of texts with the same shingles, of SimHash fingerprints that differ in 4 bits or fewer,
    and of sets of shingles of that Jaccard similarity or more. Words, shingles, nulls and texts without words are as in
    simhash.near_duplicates; rows of null doc_id stay; an empty table gives none.
    """
    each = cut(_sketched(docs, shingle, similarity))
    distinct = cut(each.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("fp").alias("fp")))
    prints = cut(distinct.groupBy("fp").agg(F.min("digest").alias("of")))
    near = simhash.links(prints)
    left, right = (prints.select(F.col("fp").alias(k), F.col("of").alias(f"of_{k}")) for k in "ab")
    of_bits = near.join(left, "a").join(right, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    same = distinct.join(prints, "fp").where("digest <> of").select(F.col("of").alias("a"), F.col("digest").alias("b"))
    known = cut(of_bits.union(same))
    beside = cut(_neighbours(_prefixes(each)))
    pairs = beside.where("before IS NOT NULL").select(F.col("digest").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), *[F.col(f"before.{c}").alias(k) for c, k in (("digest", "b"), ("n", "n_b"), ("at", "at_b"))])
    roots = _settled(docs, each, _allowed(pairs, similarity), cut(components(known)), shingle, similarity)
    roots = _settled(docs, each, _across(_entries(beside), roots, similarity), roots, shingle, similarity)
    grouped = distinct.join(roots, F.col("digest") == F.col("node"), "left").groupBy(F.coalesce("root", "digest").alias("group"))
    first = grouped.agg(F.min("least_id").alias("_first")).select("_first").distinct()
    kept = unused(docs, "_first")
    return docs.join(first.withColumnRenamed("_first", kept), F.col("doc_id") == F.col(kept), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
