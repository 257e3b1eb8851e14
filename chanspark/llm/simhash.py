"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code puts each 23-bit word within 3
bits of one codeword, so words that differ a little share a codeword near both. When two fingerprints differ in 4 bits
at most, then by the pigeonhole principle

* two segments differ by at most one bit each, or
* the differences are 2, 2 and 0: one segment is equal and the next one differs by 2 bits at most.

Every fingerprint goes into the index under its nearest codewords, and probes all codewords at a distance at which the
nearest codeword of a partner can be. What meets under a key is verified, so links are exact: none is lost or made up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chanspark.llm.common import WHITE, buffer, cut, slices, word_bounds
from chanspark.llm.components import components

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
#: Shingles that the kernels hold at once.
BLOCK = 1 << 16

#: The generator polynomial of the binary Golay code of 23 bits, and where a fingerprint is cut.
GOLAY = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_hashes(column: pa.Array, shingle: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned hashes of all shingles, text after text, and where each text's begin (and the last end).

    Shingles are made in blocks, so a very long text takes some ten times its bytes.
    """
    data, offsets = buffer(column)
    starts, ends, firsts = word_bounds(data, offsets)
    words = np.diff(firsts)
    upto = np.concatenate([[0], np.cumsum(np.where(words > 0, np.maximum(words - shingle + 1, 1), 0))])
    out, digest = np.empty(upto[-1], np.uint64), xxhash.xxh64_intdigest
    for at in range(0, len(out), BLOCK):
        number = np.arange(at, min(at + BLOCK, len(out)))
        text = np.searchsorted(upto, number, "right") - 1
        first = number - upto[text] + firsts[text]
        last = np.minimum(first + shingle - 1, firsts[text + 1] - 1)
        low = starts[first[0]]
        own = data[low : ends[last[-1]]]
        solid = ~WHITE[own]
        keep = solid.copy()
        keep[1:] |= solid[:-1]  # each word, and one byte of white space after it
        raw = np.where(solid, LOWER[own], np.uint8(0x20))[keep].tobytes()
        place = np.cumsum(keep) - 1
        bounds = zip(place[starts[first] - low].tolist(), (place[ends[last] - 1 - low] + 1).tolist(), strict=True)
        out[number] = np.fromiter((digest(raw[a:b], HASH_SEED) for a, b in bounds), np.uint64, len(number))
    return out, upto


def majority(hashes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The unsigned fingerprint of every text from its shingles' hashes."""
    count = np.diff(upto)
    ones = np.zeros((len(count), 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        first, last = np.searchsorted(upto, [at, at + len(part) - 1], "right") - 1
        texts = np.arange(first, last + 1)
        texts = texts[count[texts] > 0]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[texts] += np.add.reduceat(bits, np.maximum(upto[texts] - at, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(column: pa.Array, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The unsigned fingerprint of every text."""
    return majority(*shingle_hashes(column, shingle))


def simhash(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts and texts without words have 0; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, dict[int, list[np.ndarray]]]:
    """Syndromes of the lower 12 and upper 11 bits; the weight of each syndrome's leader; error patterns by reach.

    patterns[r][s] has every error of weight r + 3 or less with syndrome s, the leader first, then -1.
    """
    of_bit = []
    for k in range(23):
        x = 1 << k
        for j in range(22, 10, -1):
            if x >> j & 1:
                x ^= GOLAY << (j - 11)
        of_bit.append(x)
    tables = [np.zeros(1 << n, np.int64) for n in (12, 11)]
    for table, low in zip(tables, (0, 12), strict=True):
        for k in range(len(table).bit_length() - 1):
            table[1 << k : 2 << k] = table[: 1 << k] ^ of_bit[low + k]
    by: list[list[list[int]]] = [[[] for _ in range(6)] for _ in range(2048)]
    for weight in range(6):
        for chosen in combinations(range(23), weight):
            s = 0
            for k in chosen:
                s ^= of_bit[k]
            by[s][weight].append(sum(1 << k for k in chosen))
    patterns = {}
    for reach in (0, 1, 2):
        rows = [[x for w in range(6) for x in by[s][w] if w <= (next(v for v in range(4) if by[s][v]) if reach == 0 else reach + 3)] for s in range(2048)]
        patterns[reach] = np.full((2048, max(map(len, rows))), -1, np.int64)
        for s, row in enumerate(rows):
            patterns[reach][s, : len(row)] = row
    return tables[0], tables[1], patterns


def codewords(words: np.ndarray, reach: int) -> np.ndarray:
    """For each 23-bit word, the message bits (upper 12) of the codewords within 3 + reach bits (reach 0: of the nearest), then -1."""
    low, high, patterns = _golay()
    errors = patterns[reach][low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints: those they are indexed under, or those that they probe."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [codewords(p, 1 if probe else 0) for p in parts]
    far = [codewords(p, 2 if probe else 0) for p in parts]
    rows, found = [], []

    def add(kind: int, left: np.ndarray, right: np.ndarray) -> None:
        both = (left[:, :, None] >= 0) & (right[:, None, :] >= 0)
        row, i, j = np.nonzero(both)
        rows.append(row)
        found.append((kind << 40) | (left[row, i] << 12) | right[row, j])

    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        add(kind, near[i], near[j])
    for i in range(3):
        add(3 + i, parts[i][:, None], far[(i + 1) % 3])
    return np.concatenate(rows), np.concatenate(found)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): every two different values of the distinct column fp that differ in at most max_bits (4 or fewer) bits, once."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys meet for at most {MAX_BITS} differing bits")

    def keyed(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    own = batch.column(0).slice(at, 4096).to_numpy()
                    row, key = keys(own.view(np.uint64), probe)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], ["key", "fp"])

        return run

    index = fps.select("fp").mapInArrow(keyed(False), "key long, fp long").withColumnRenamed("fp", "b")
    probes = fps.select("fp").mapInArrow(keyed(True), "key long, fp long").withColumnRenamed("fp", "a")
    met = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return probes.join(index, "key").where(met).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) for every row of documents (doc_id, text, ...).

    component_id is the smallest doc_id that is reached over links; n_links counts the other fingerprints within
    max_bits. Null texts and texts without words have fingerprint zero and are linked like any other; repeated rows
    give repeated results; an empty table gives none; a null doc_id counts as no id and can't be smallest.
    Texts are shuffled nowhere: copies collapse to one fingerprint before links are sought.
    """
    hashed = cut(simhash(docs, shingle))
    distinct = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    pairs = cut(links(distinct, max_bits))
    # A node is ordered by its smallest doc_id, none last, so the root of a component has the smallest of all.
    node = distinct.select("fp", F.struct(F.col("least_id").isNull().alias("none"), "least_id", "fp").alias("node"))
    sides = [node.select(F.col("fp").alias(k), F.col("node").alias(f"node_{k}")) for k in "ab"]
    named = pairs.join(sides[0], "a").join(sides[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    roots = components(named).select(F.col("node.fp").alias("own"), F.col("root.least_id").alias("root_id"))
    degree = pairs.select(F.col("a").alias("one")).union(pairs.select("b")).groupBy("one").agg(F.count("*").alias("n_links"))
    known = distinct.join(roots, F.col("fp") == F.col("own"), "left").join(degree, F.col("fp") == F.col("one"), "left").select(
        F.col("fp").alias("of"), F.coalesce("root_id", "least_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return hashed.join(known, F.col("fp") == F.col("of")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of documents whose doc_id is the smallest of their component; of rows that repeat that doc_id all stay."""
    found = near_duplicates(docs, shingle, max_bits)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
