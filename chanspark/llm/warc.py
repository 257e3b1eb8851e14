"""WARC archives with a two-level capture index.

Pages are put in the order of their reversed-host URL keys and written as gzipped WARC records, a file a part, with an
index beside it: lines (key, page_id, file, offset, length) in the same order, cut into compressed blocks. The index
file ends with its sparse directory, the first key of each block and where the block is; the manifest has the first and
last key of each file. A lookup is a binary search of the manifest, one of the directory, one block and then a range
read for each record. Records with equal payloads are written once; the others are revisits of it.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from base64 import b32encode
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.llm.common import cut, fresh_folder, partitions, slices, storage

BLOCK_LINES = 512
LEVEL = 1
LEAST_BYTES = 0
#: The profile of revisits, the date of records (pages have none), and the magic number of index files.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"CAPINDX1"
MANIFEST = "part int, file string, index string, n_records long, n_blocks long, first string, last string"
FOUND = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def sort_key(column: Column) -> Column:
    """The key of a URL: the host's labels from the last to the first, then path and query; no scheme, `www.` or fragment. Null is empty."""
    url = F.coalesce(column, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^www[0-9]*\\.", "")
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


def _record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head of the whole payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    safe = re.sub(r"[\r\n]", " ", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """What a WARC record says: its header fields by lower-case name, the length its HTTP head gives, and its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    stated = re.search(rb"(?i)^content-length: (\d+)", http, re.M)
    return fields | {"stated": int(stated[1]), "payload": payload}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def write_index(lines: list[tuple], file) -> int:
    """Writes sorted lines (key, page_id, file, offset, length) in blocks, the directory, and a footer; the number of blocks."""
    directory, at = [], 0
    for i in range(0, len(lines), BLOCK_LINES):
        packed = zlib.compress("\n".join(json.dumps(x) for x in lines[i : i + BLOCK_LINES]).encode(), LEVEL)
        directory.append([lines[i][0], at, len(packed), xxhash.xxh64_intdigest(packed)])
        file.write(packed)
        at += len(packed)
    packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
    file.write(packed + struct.pack("<QQ", at, len(packed)) + MAGIC)
    return len(directory)


class Index:
    """Reads an index file that pyarrow has opened for random access: the directory at once, blocks as they are needed."""

    def __init__(self, file):
        self.file, size = file, file.size()
        start, packed, magic = struct.unpack("<QQ8s", file.read_at(24, size - 24))
        if magic != MAGIC:
            raise ValueError("not a capture index")
        self.directory = json.loads(zlib.decompress(file.read_at(packed, start)))
        self.firsts = [d[0] for d in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def block(self, k: int) -> list[list]:
        if self.held[0] != k:
            _, at, packed, check = self.directory[k]
            raw = self.file.read_at(packed, at)
            if xxhash.xxh64_intdigest(raw) != check:
                raise ValueError(f"block {k} is damaged")
            self.held = (k, [json.loads(x) for x in zlib.decompress(raw).decode().split("\n")])
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        """The lines of a key: it begins in the last block whose first key is smaller, or in the next."""
        k = max(0, bisect_left(self.firsts, key) - 1)
        while k < len(self.firsts) and self.firsts[k] <= key:
            lines = self.block(k)
            begin = bisect_left(lines, key, key=lambda x: x[0])
            yield from lines[begin : bisect_right(lines, key, lo=begin, key=lambda x: x[0])]
            k += 1


def write(pages: DataFrame, folder: str, parts: int | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the manifest, one row a part, read from the shared folder.

    Of pages with equal payloads of at least least_bytes bytes, those with the largest page_id are responses and the others
    revisits of it; all smaller payloads are responses. A null html is an empty payload, a null url an empty one.
    Pages whose page_id is null are responses if all their equals are, else revisits; rows that repeat a page_id are
    written as often. Each attempt of a task writes files of its own name and the manifest names one whole set.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    large = F.octet_length("html") >= least_bytes
    own = own.withColumn("key", sort_key(F.col("url")))
    # Narrow rows, combined on the map side, say which digests repeat and what they refer to.
    narrow = own.select("key", "page_id", "digest", large.alias("large"))
    repeated = narrow.where("large").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "last")
    later = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    revisits = narrow.where("large").join(repeated, F.col("digest") == F.col("_digest")).where(later).select("key", "page_id", "digest", "last").distinct()
    # They go through the exchange of the pages, each just before the pages that it is about, so payloads move once.
    rows = own.select("key", "page_id", "digest", "url", "html", F.lit(None).cast("long").alias("last")).unionByName(revisits, allowMissingColumns=True)
    ordered = rows.repartitionByRange(parts or partitions(spark), "key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest", rows.html.asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = storage(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        file, index = f"pages-{part:06d}-{attempt}.warc.gz", f"pages-{part:06d}-{attempt}.idx"
        lines, at = [], 0
        with fs.open_output_stream(f"{path}/{file}", compression=None) as out:
            about, last = None, None
            for batch in slices(batches, 4):
                for key, page_id, digest, url, html, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if html is None:  # a revisit to come
                        about, last = (key, page_id, digest), refers
                        continue
                    refers_to = last if about == (key, page_id, digest) else None
                    packed = gzip.compress(_record("response" if refers_to is None else "revisit", page_id, url, html.encode(), b32encode(bytes.fromhex(digest)).decode(), refers_to), LEVEL, mtime=0)
                    out.write(packed)
                    lines.append((key, page_id, file, at, len(packed)))
                    at += len(packed)
        if not lines:
            fs.delete_file(f"{path}/{file}")
            return
        with fs.open_output_stream(f"{path}/{index}", compression=None) as out:
            blocks = write_index(lines, out)
        row = {"part": part, "file": f"{folder}/{file}", "index": f"{folder}/{index}", "n_records": len(lines), "n_blocks": blocks, "first": lines[0][0], "last": lines[-1][0]}
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32() if k == "part" else None) for k, v in row.items()})

    return cut(ordered.mapInArrow(run, MANIFEST))


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The captures of the URLs of wanted (url): FOUND's columns, a row for each capture and each distinct URL key of wanted.

    The wanted keys are exchanged to the part or parts whose range they fall in and sorted, so each index block is read
    once a part and the archive is read forwards. Records are checked against their digests.
    """
    spark = manifest.sparkSession
    rows = sorted((r["part"], r["first"], r["last"], r["file"], r["index"]) for r in manifest.collect())  # one row a part
    if not rows:
        return spark.createDataFrame([], FOUND)
    shared = spark.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [r[1] for r in shared.value], [r[2] for r in shared.value]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            goals = [(k, i) for k in keys for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_pydict({"key": pa.array([g[0] for g in goals], pa.string()), "place": pa.array([g[1] for g in goals], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, index, archive, fs = -1, None, None, None
        names = [x.split()[0] for x in FOUND.split(", ")]
        held, size = [], 0
        for batch in batches:
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != opened:
                    fs, path = storage(shared.value[i][3])
                    archive = fs.open_input_file(path)
                    index = Index(fs.open_input_file(storage(shared.value[i][4])[1]))
                    opened = i
                for _, _, _, at, length in index.find(key):
                    got = parse(gzip.decompress(archive.read_at(length, at)))
                    digest = got["warc-payload-digest"].removeprefix("sha1:")
                    kind = got["warc-type"]
                    if kind == "response" and b32encode(sha1(got["payload"]).digest()).decode() != digest:
                        raise ValueError(f"the record at {at} of {shared.value[i][3]} is damaged")
                    held.append((_page(got["warc-record-id"]), got["warc-target-uri"], kind, got["stated"], digest, _page(got.get("warc-refers-to")), got["payload"] if kind == "response" else None))
                    size += len(got["payload"]) + 200
                    if size >= 1 << 20:
                        yield _batch(held, names)
                        held, size = [], 0
        if held:
            yield _batch(held, names)

    keys = wanted.select(sort_key(F.col("url")).alias("key")).distinct()
    placed = keys.mapInArrow(place, "key string, place int").repartitionById(len(rows), F.col("place")).sortWithinPartitions("key")
    return placed.mapInArrow(run, FOUND)


KINDS = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names)


def summary(spark: SparkSession, pages: DataFrame, parts: int | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): writes all pages, then looks every URL up again."""
    manifest = write(pages, fresh_folder(spark, "warc"), parts, least_bytes)
    return lookup(manifest, pages.select("url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
