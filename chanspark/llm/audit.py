"""Filter interaction audit on a packed bitmap index: what filters remove in each order, by part.

Each batch of a partition has a bitset for every filter's failures and every label, of 64-bit words; the rows of a part
are a run of whole words, with the part's own bitset (what pads the last word is not in it). For each subset of the
filters the failures of all of it are taken from the part by AND-NOT, and what is left is counted by popcount, in all
and of each label. Counts of batches and partitions are added up; all orders of the filters follow from the subsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chanspark.llm.common import buffer, cut, equal_runs, run_hashes, slices, word_bounds

FILTERS = "ABCDE"
#: What the filters ask for: words; distinct words and capitals in a hundred; signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"
#: Parts whose counts a task holds before it passes them on.
PARTS = 4096
NULL_ID = -(1 << 63)

ORACLE_AUDIT = r"""
WITH d AS (SELECT coalesce(doc_id, -9223372036854775808) AS id, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN id > min(id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
    FROM w LEFT JOIN l USING (doc_id)
),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) AS k),
r AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
    FROM m, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """How many different words each text has; words of one hash are compared."""
    n = np.diff(firsts)
    text = np.repeat(np.arange(len(n)), n)
    hashes = run_hashes(data, starts, ends)
    order = np.lexsort((hashes, text))
    same = (text[order[1:]] == text[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    pair = np.flatnonzero(same)
    a, b = order[pair + 1], order[pair]
    equal = equal_runs(data, starts[a], ends[a], data, starts[b], ends[b])
    out = n - np.bincount(text[order[1:]][same], minlength=len(n))
    for i in set(text[a[~equal]].tolist()):  # two words of one hash: such a text is counted word by word
        out[i] = len({data[s:e].tobytes() for s, e in zip(starts[firsts[i] : firsts[i + 1]], ends[firsts[i] : firsts[i + 1]], strict=True)})
    return out


def failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text which of the filters A to D it fails, as bits 0 to 3."""
    starts, ends, firsts = word_bounds(data, offsets)
    count = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), offsets))
    words, distinct = np.diff(firsts), _distinct(data, starts, ends, firsts)
    capitals, points = count((data >= ord("A")) & (data <= ord("Z"))), np.diff(offsets) - count(data & 0xC0 == 0x80)
    signs = np.zeros(256, bool)
    signs[list(SIGNS)] = True
    return (words < LEAST_WORDS) + 2 * (100 * distinct < LEAST_DISTINCT * words) + 4 * (100 * capitals > MOST_CAPITALS * points) + 8 * (count(signs[data]) > 0)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every row of docs: fails has a bit for each filter; rows without a label have neither.

    A null text is empty, a null lang the empty string. A null doc_id is smaller than all others and has no label; labels
    that a doc_id has more than once count if any does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            fails = failures(*buffer(batch.column(3))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fails)], ["id", "key", "part", "fails"])

    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id")
    own = cut(docs.select(id_, digest, F.coalesce("lang", F.lit("")).alias("part"), "text").mapInArrow(run, "id long, key binary, part string, fails int"))
    least = cut(own.groupBy(F.col("key").alias("of")).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("of", "least"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_of"))
    known = cut(known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    both = own.join(least, F.col("key") == F.col("of"), "left").select("id", "part", (F.col("fails") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("fails"))
    return both.join(known, F.col("id") == F.col("label_of"), "left").select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _counted(batch: pa.RecordBatch, filters: int) -> tuple[list[str], np.ndarray]:
    """The parts of a batch, and for each part and subset of the filters what the subset leaves: rows, good ones, toxic ones."""
    encoded = pc.dictionary_encode(batch.column(0))
    names, code = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
    fails, good, toxic = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
    rows = np.bincount(code, minlength=len(names))
    words = -(-rows // 64)
    first = np.cumsum(words) - words
    order = np.argsort(code, kind="stable")
    place = np.empty(len(code), np.int64)
    place[order] = np.arange(len(code)) + np.repeat(64 * first - np.cumsum(rows) + rows, rows)

    def packed(mask: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * words.sum(), bool)
        bits[place[mask]] = True
        return np.packbits(bits).view(np.uint64)

    part, labels = packed(np.ones(len(code), bool)), (packed(good), packed(toxic))
    failed = [packed(fails >> k & 1 == 1) for k in range(filters)]
    out = np.zeros((len(names), 1 << filters, 3), np.int64)
    gone = [np.zeros_like(part)]
    for subset in range(1 << filters):
        if subset:
            high = subset.bit_length() - 1
            gone.append(gone[subset ^ 1 << high] | failed[high])
        left = part & ~gone[subset]
        for k, bits in enumerate((left, left & labels[0], left & labels[1])):
            out[:, subset, k] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)
    return names, out


def subsets(rows: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, subset, kept, good, toxic) of (part, fails, good, toxic): what each subset of the filters leaves of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def passed_on() -> pa.RecordBatch:
            counts = np.concatenate(list(sums.values())) if sums else np.zeros((0, 3), np.int64)
            parts = [p for p in sums for _ in range(1 << filters)]
            columns = [pa.array(parts, pa.string()), pa.array(np.tile(np.arange(1 << filters, dtype=np.int32), len(sums))), *[pa.array(counts[:, k]) for k in range(3)]]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "subset", "kept", "good", "toxic"])

        for batch in batches:
            if batch.num_rows:
                for part, n in zip(*_counted(batch, filters), strict=True):
                    sums[part] = sums[part] + n if part in sums else n
                if len(sums) > PARTS:
                    yield passed_on()
        yield passed_on()

    counted = rows.mapInArrow(run, "part string, subset int, kept long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Of subsets() one row for each part, order of the filters and step (from 1):

    kept after the step, removed in it, redundant (failing its filter, removed before), unique_fails (failing its filter
    only), good_lost and toxic_lost in it, and shapley: what its filter removes, summed over all orders.
    """
    n, bit = len(filters), {c: 1 << k for k, c in enumerate(filters)}
    every, names = (1 << n) - 1, "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, listed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                left = np.zeros((1 << n, 3), np.int64)
                for s in listed:
                    left[s["subset"]] = s["kept"], s["good"], s["toxic"]
                gone = {(s, c): left[s] - left[s | b] for s in range(1 << n) for c, b in bit.items() if not s & b}
                times = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in range(every)]
                value = {c: sum(times[s] * int(gone[s, c][0]) for s in range(every) if not s & b) for c, b in bit.items()}
                rows = []
                for order in permutations(filters):
                    before = 0
                    for step, c in enumerate(order, 1):
                        removed, good, toxic = gone[before, c].tolist()
                        rows.append((part, "".join(order), step, int(left[before | bit[c]][0]), removed, int(gone[0, c][0]) - removed, int(gone[every ^ bit[c], c][0]), good, toxic, value[c]))
                        before |= bit[c]
                kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    listed = counts.groupBy("part").agg(F.collect_list(F.struct("subset", "kept", "good", "toxic")).alias("all"))
    return listed.mapInArrow(run, "part string, filter_order string, step int" + "".join(f", {c} long" for c in names[3:]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """orders() of the five filters over docs, by lang; an empty table has no parts and gives no rows."""
    return orders(subsets(judged(docs, labels)))
