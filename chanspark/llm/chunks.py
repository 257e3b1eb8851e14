"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; its value depends on the last 32 bytes only. A chunk ends where the hash has a
run of zero bits: a long run up to the normal size, a short run beyond it, and the largest size ends a chunk anyhow.
Since no chunk is shorter than the hash's reach, cuts depend on what is in the chunk and not on where it is, so text
that moves keeps its chunks. A fingerprint is the set of chunk digests, each with its chunk's length.
"""

from __future__ import annotations

from base64 import b64encode
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from chanspark.llm.common import buffer, mix, slices
from chanspark.llm.ordered import with_next

#: Bytes: reach of the rolling hash and least size of a chunk, size from which cuts are easier, largest size.
LEAST, NORMAL, MOST = 32, 96, 256
#: Bits of the hash that must be zero at a cut before and after the normal size.
STRICT_BITS, EASY_BITS = 7, 5

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _cuts(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions after which a chunk may end: strictly, and easily. The hash of 32 bytes is summed by doubling its reach."""
    h = GEAR[data]
    reach = 1
    while reach < LEAST:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = longer, 2 * reach
    easy = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
    return easy[h[easy] >> np.uint32(32 - STRICT_BITS) == 0].tolist(), easy.tolist()


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its ascending, distinct chunks: the upper 48 bits of the digest and the length in the lower 16."""
    whole = b"".join(texts)
    strict, easy = _cuts(np.frombuffer(whole, np.uint8))
    strict.append(len(whole) + MOST)
    easy.append(len(whole) + MOST)
    digest, out, at = xxhash.xxh3_64_intdigest, [], 0
    for text in texts:
        end, found = at + len(text), []
        while at < end:
            stop = strict[bisect_left(strict, at + LEAST - 1)] + 1
            if stop > at + NORMAL:
                stop = min(easy[bisect_left(easy, at + NORMAL)] + 1, at + MOST)
            stop = min(stop, end)
            found.append(digest(whole[at:stop]) >> 16 << 16 | stop - at)
            at = stop
        out.append(np.unique(np.array(found, np.uint64)))
    return out


def contained(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's bytes in distinct chunks that b has too; what is empty is contained in empty fingerprints only."""
    if not len(a):
        return float(not len(b))
    sizes = (a & np.uint64(0xFFFF)).astype(np.int64)
    return float(sizes[np.isin(a, b, assume_unique=True)].sum() / sizes.sum())


def shown(a: np.ndarray) -> str:
    """A fingerprint as text: base64 of its chunks as big-endian 64-bit numbers."""
    return b64encode(a.astype(">u8").tobytes()).decode("ascii")


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text, without any exchange; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            texts = [x or "" for x in part.column(1).to_pylist()]
            prints = [shown(x) for x in fingerprints([x.encode() for x in texts])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def edited(text: str, after: str) -> str:
    """text with its last floor(n / 2) characters replaced by as many of the beginning of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the one with the next smaller doc_id; after the smallest comes the largest. Rows that share
    a doc_id follow each other by text, null doc_ids come after all others, and a table of one row is next to itself.
    Null texts count as empty. near_edited and near_next: how much of the fingerprint is contained in the edited
    text's and in the next document's. Texts are exchanged once, by ranges of doc_id.
    """
    placed = with_next(docs.select("doc_id", "text")).select("doc_id", "text", "_halo")
    ordered = placed.sortWithinPartitions(placed.doc_id.desc_nulls_last(), placed.text.asc_nulls_first())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = around = waiting = None  # the first row; the first copy of what comes after the lowest; the row whose next is to come
        begun = False

        def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Rows of (doc_id, text, fingerprint, halo), each but the last followed by its next."""
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[3]]
            if not pairs:
                return
            changed = [edited(x[1], y[1]).encode() for x, y in pairs]
            prints = fingerprints(changed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                    pa.array([sha256(c).hexdigest() for c in changed]),
                    pa.array([shown(x[2]) for x, _ in pairs]),
                    pa.array([shown(p) for p in prints]),
                    pa.array([contained(x[2], p) for (x, _), p in zip(pairs, prints, strict=True)]),
                    pa.array([contained(x[2], y[2]) for x, y in pairs]),
                ],
                names,
            )

        for part in slices(batches, 1):
            texts = [x or "" for x in part.column(1).to_pylist()]
            rows = list(zip(part.column(0).to_pylist(), texts, fingerprints([x.encode() for x in texts]), part.column(2).to_pylist(), strict=True))
            while rows and not begun and rows[0][3]:  # copies that sort before the part's own rows come round from the largest
                around = around or rows[0]
                rows.pop(0)
            if rows:
                begun = True
                head = head or rows[0]
                yield from finish([waiting, *rows] if waiting else rows)
                waiting = rows[-1]
        if waiting and not waiting[3]:
            yield from finish([waiting, around or head])

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
