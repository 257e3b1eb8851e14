"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

A shard file is a row of zstandard frames, each with whole documents, and two skippable frames: the list of documents,
and the seek table in the public seekable format (sizes and the lower 32 bits of the XXH64 of each frame's content,
then the number of frames, a descriptor and the magic number). A reader takes the footer, the table and the list with
three range reads from the end of the file, and then just the frames of the documents it wants.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from chanspark.llm.common import buffer, cut, equal_runs, fresh_folder, run_hashes, slices, storage
from chanspark.llm.ordered import by_doc_id
from chanspark.llm.pieces import ragged

FRAME_BYTES = 1 << 20
LEVEL = 1
END_ID = 0
#: Words that a worker remembers, at some 150 bytes each; when full it forgets them.
REMEMBERED = 600_000

#: Magic numbers of skippable frames (the list of documents, the seek table) and of the seek table's footer.
LIST_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library that remembers the words it has met.

    Words are found by a hash, and their bytes are compared with those of the word remembered; where two words share a
    hash, the texts with the second one go to the library whole.

    The library splits a text by a pattern and merges within each part alone, so a text of words and single white
    space can be cut before each space and around each line break without a change to its ids. Other texts, and
    tokenizers with another pattern or a normalizer, go to the library whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(spec)
        self.own.encode_special_tokens = True
        before = str(self.own.pre_tokenizer)
        self.splits = self.own.normalizer is None and before.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in before
        breaks = self._whole(["\n", "a\nb"])
        self.line = breaks[0][0]
        self.splits = self.splits and len(breaks[0]) == 1 and breaks[1].count(self.line) == 1
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}  # of a word's hash among the words met
        self.flat, self.at = array("I"), array("q", [0])
        self.raw, self.raw_at = bytearray(), array("q", [0])

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: list[int], raw: list[bytes]) -> None:
        """New words go to the library as the lines of one text, whose ids are cut at those of its line breaks; a line break itself is a word too."""
        breaks = [i for i, w in enumerate(raw) if w == b"\n"]  # one at most, of different words
        lines = [w for w in raw if w != b"\n"]
        ids = np.array(self._whole([(b"\n".join([*lines, b""])).decode()])[0], np.uint32)
        ends = np.flatnonzero(ids == self.line)
        sizes = np.diff(ends, prepend=-1) - 1
        if len(sizes) != len(lines):
            raise ValueError("the tokenizer joins line breaks to words")
        kept = ids[ids != self.line]
        if breaks:
            kept, sizes = np.insert(kept, sizes[: breaks[0]].sum(), np.uint32(self.line)), np.insert(sizes, breaks[0], 1)
        self.place.update(zip(hashes, range(len(self.at) - 1, len(self.at) - 1 + len(hashes)), strict=True))
        self.at.frombytes((self.at[-1] + np.cumsum(sizes)).tobytes())
        self.flat.frombytes(kept.astype(np.uint32).tobytes())
        self.raw_at.extend(list(accumulate(map(len, raw), initial=self.raw_at[-1]))[1:])
        self.raw += b"".join(raw)

    def _others(self, data: np.ndarray, led: np.ndarray, ends: np.ndarray, code: np.ndarray, where: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The numbers of words that aren't those remembered under their hash; where: the first word of each code."""
        first = where[code]
        sizes = ends - led
        wrong = sizes != sizes[first]
        longer = np.flatnonzero((sizes > 8) & ~wrong & (first != np.arange(len(first))))  # of shorter ones, hash and size tell all
        wrong[longer] = ~equal_runs(data, led[longer], ends[longer], data, led[first[longer]], ends[first[longer]])
        at = np.frombuffer(self.raw_at, np.int64)
        unlike = ~equal_runs(data, led[where], ends[where], np.frombuffer(self.raw, np.uint8), at[known], at[known + 1])
        return np.flatnonzero(wrong | unlike[code])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, and where each begins (and the last ends); null is empty."""
        data, offsets = buffer(column)
        kinds = np.take(KINDS, data)
        gap, line = (kinds & GAP) != 0, data == 0x0A
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # where a text begins or ends
        odd = (kinds & ODD) != 0
        odd[1:] |= gap[1:] & gap[:-1] & ~edge[1:-1] if len(data) else False
        odd |= gap & (edge[:-1] | edge[1:])
        whole = np.zeros(len(column), bool)
        whole[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        if not self.splits:
            whole[:] = True
        # A letter ends its part where a sign follows, which is not so of all signs before letters.
        sign = np.flatnonzero((kinds[1:] & SIGN) != 0) + 1
        before = data[sign - 1]
        ahead = data[np.maximum(sign - 2, 0)]
        letter = ((kinds[sign - 1] & LETTER) != 0) | ((ahead == 0xC3) & (sign > 1) & (before != 0x97) & (before != 0xB7) & (before >= 0x80))
        cut_at = sign[letter & ~edge[sign]]
        first, last = ~gap, ~gap
        first[1:] &= gap[:-1] | edge[1:-1]
        last[:-1] &= gap[1:] | edge[1:-1]
        first[cut_at] = True
        last[cut_at - 1] = True
        starts = np.flatnonzero(first | line)
        ends = np.flatnonzero(last | line) + 1
        counts = np.searchsorted(starts, offsets)
        used = np.repeat(~whole, np.diff(counts))
        starts, ends = starts[used], ends[used]
        counts = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(counts)))])
        led = starts - ((starts > 0) & (data[starts - 1] == 0x20) & ~edge[starts])  # with the space before the word
        code, distinct = pd.factorize(run_hashes(data, led, ends))
        if len(self.place) > REMEMBERED:
            self.forget()
        found = list(map(self.place.get, distinct.tolist()))
        fresh = [i for i, x in enumerate(found) if x is None]
        where = np.empty(len(distinct), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        if fresh:
            raw, at = data.tobytes(), where[fresh]
            self._learn(distinct[fresh].tolist(), [raw[s:e] for s, e in zip(led[at].tolist(), ends[at].tolist(), strict=True)])
            found = list(map(self.place.get, distinct.tolist()))
        known = np.array(found, np.int64)
        other = self._others(data, led, ends, code, where, known)
        whole[np.searchsorted(counts, other, "right") - 1] = True
        ids, upto = ragged(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.at, np.int64), known[code])
        offsets = upto[counts]
        if whole.any():
            runs = [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
            odd_texts = np.flatnonzero(whole)
            for i, own in zip(odd_texts, self._whole([column[int(i)].as_py() or "" for i in odd_texts]), strict=True):
                runs[i] = np.array(own, np.uint32)
            ids, offsets = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        return ids, offsets


#: What a byte is: a gap, a letter, a sign, or odd (white space other than space and line break, and first bytes of characters that may be such).
GAP, LETTER, SIGN, ODD = 1, 2, 4, 8
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x0A]] = GAP
KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
KINDS[list(b",.;:!?")] = SIGN
KINDS[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = ODD


_loaded: dict[str, ByteLevel] = {}


def _tokenizer(spec: str) -> ByteLevel:
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = ByteLevel(spec)
    return _loaded[spec]


class Writer:
    """Writes the documents of one shard, in the order given, to an open binary file."""

    def __init__(self, file):
        self.file, self.zstd = file, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, frame, ids
        self.waiting: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(self.frames), len(ids)))
        self.waiting.append(ids)
        self.bytes += 4 * len(ids)
        if self.bytes >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        raw = np.concatenate(self.waiting).astype("<u4").tobytes()
        packed = self.zstd.compress(raw)
        self.file.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.bytes = [], 0

    def close(self) -> None:
        if self.waiting:
            self._frame()
        listed = np.zeros(len(self.docs), LISTED)
        if self.docs:
            listed["null"] = [d[0] is None for d in self.docs]
            listed["doc_id"] = [d[0] or 0 for d in self.docs]
            listed["frame"] = [d[1] for d in self.docs]
            listed["ids"] = [d[2] for d in self.docs]
        packed = self.zstd.compress(listed.tobytes())
        self.file.write(struct.pack("<II", LIST_MAGIC, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *f) for f in [*self.frames])
        footer = struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC)
        self.file.write(struct.pack("<II", TABLE_MAGIC, len(table) + len(footer)) + table + footer)


LISTED = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("frame", "<u4"), ("ids", "<u4")])


class Reader:
    """Reads a shard file that pyarrow has opened for random access."""

    def __init__(self, file):
        self.file, size = file, file.size()
        self.zstd = zstandard.ZstdDecompressor()
        count, descriptor, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("not a token-id file")
        start = size - 9 - 12 * count - 8
        table = np.frombuffer(file.read_at(8 + 12 * count, start), "<u4")
        if table[0] != TABLE_MAGIC:
            raise ValueError("the seek table is damaged")
        self.frames = table[2:].reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        after = int(self.starts[-1])  # the list follows the last frame
        head = struct.unpack("<II", file.read_at(8, after))
        if head[0] != LIST_MAGIC:
            raise ValueError("the list of documents is damaged")
        self.listed = np.frombuffer(self.zstd.decompress(file.read_at(head[1], after + 8)), LISTED)

    def frame(self, k: int) -> np.ndarray:
        packed, raw, check = self.frames[k]
        out = self.zstd.decompress(self.file.read_at(int(packed), int(self.starts[k])), max_output_size=int(raw))
        if len(out) != raw or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(out, "<u4")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(place, doc_id, ids) of all documents or those wanted; only frames that hold one of them are read."""
        hit = np.ones(len(self.listed), bool) if wanted is None else np.isin(self.listed["doc_id"], list(wanted)) & (self.listed["null"] == 0)
        bounds = np.searchsorted(self.listed["frame"], np.arange(len(self.frames) + 1))
        for k in np.unique(self.listed["frame"][hit]):
            ids, at = self.frame(k), 0
            for i in range(bounds[k], bounds[k + 1]):
                row = self.listed[i]
                if hit[i]:
                    yield i, None if row["null"] else int(row["doc_id"]), ids[at : at + int(row["ids"])]
                at += int(row["ids"])


def write(docs: DataFrame, tokenizer_file: str, folder: str, parts: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes (doc_id, text) and writes shards in ascending doc_id order; (shard, file, n_docs, n_ids), one row a shard.

    Null texts count as empty; each document ends with end_id; rows that share a doc_id follow each other by text, and
    null doc_ids come first. Every attempt of a task writes a file of its own name, and the manifest that is returned
    (read from the shared folder) names one whole file for each shard, so lost executors and repeated attempts do no harm.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary, some MB
    placed = by_doc_id(docs.select("doc_id", "text"), parts).select("doc_id", "text", "_part")
    ordered = placed.sortWithinPartitions(placed.doc_id.asc_nulls_first(), placed.text.asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, shard, ids_written = _tokenizer(spec.value), None, None, 0
        fs, path = storage(folder)
        name = f"ids-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.zst"
        with fs.open_output_stream(f"{path}/{name}", compression=None) as file:
            writer = Writer(file)
            for part in slices(batches, 1, 2 << 20):
                shard = part.column(2)[0].as_py()
                ids, upto = own.encode(part.column(1))
                for doc_id, a, b in zip(part.column(0).to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    writer.add(doc_id, np.append(ids[a:b], np.uint32(end_id)))
                    ids_written += b - a + 1
            writer.close()
        if shard is None:
            fs.delete_file(f"{path}/{name}")
        else:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([ids_written], pa.int64())})

    return cut(ordered.mapInArrow(run, "shard int, file string, n_docs long, n_ids long"))


Shown = Callable[[list, list, list], pa.RecordBatch]


def _scan(spark: SparkSession, manifest: DataFrame, schema: str, show: Shown, wanted: set[int] | None = None) -> DataFrame:
    """What show makes of runs of doc_ids, starts and ids, shard by shard; of the manifest only one row a shard reaches the driver."""
    base, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((r["file"], base))
        base += r["n_ids"]
    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "file string, base long").repartition(len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, path = storage(uri)
                with fs.open_input_file(path) as file:
                    shard = Reader(file)
                    starts = start + np.concatenate([[0], np.cumsum(shard.listed["ids"].astype(np.int64))])
                    held: list[tuple] = []
                    size = 0
                    for place, doc_id, ids in shard.documents(wanted):
                        held.append((doc_id, int(starts[place]), ids))
                        size += len(ids)
                        if 4 * size >= FRAME_BYTES:
                            yield show(*map(list, zip(*held, strict=True)))
                            held, size = [], 0
                    if held:
                        yield show(*map(list, zip(*held, strict=True)))

    return files.mapInArrow(run, schema)


def read(spark: SparkSession, manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) of the documents of the manifest's shards, or of the few asked for, whose frames alone are read.

    start is the number of ids of all documents before.
    """

    def show(names: list, starts: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return _scan(spark, manifest, "doc_id long, start long, ids array<long>", show, None if doc_ids is None else set(doc_ids))


def summary(docs: DataFrame, tokenizer_file: str, parts: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): writes all documents, reads the files back whole and sums them up where they are read."""

    def show(names: list, starts: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = docs.sparkSession
    manifest = write(docs, tokenizer_file, fresh_folder(spark, "token-ids"), parts)
    return _scan(spark, manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", show)
