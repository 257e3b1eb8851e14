"""Packet files as a data source of Spark: `spark.read.format("packets")` and `df.write.format("packets")`.

A file is split at packet boundaries, which a first pass over its headers finds, so a long recording is read by many
tasks, each a block at a time. Filters on what the path says (session, quadrant, path_label) are applied to the listing.
A task writes to a file of its own attempt; what is committed is renamed, all else is removed.

Files are opened through pyarrow, so a folder has to be in a store that pyarrow reaches; packets.read() goes through Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import basename
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from chanspark.functions.naming import ALIASES
from chanspark.sources.packets import FIELDS, FILE_HEADER, HEADERS, MAGIC, SCHEMA

#: Bytes of a file that a task reads, about, and of a block that it holds at a time.
SPLIT, BLOCK = 128 << 20, 4 << 20
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<smallint>": pa.list_(pa.int16())}
ARROW = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])
PATH = ("path_label", "session", "quadrant")
_CODES = {"H": "<u2", "d": "<f8", "Q": "<u8", "I": "<u4", "i": "<i4"}


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def path_facts(path: str) -> dict[str, str | None]:
    """What a path says of its packets, as the column functions of naming do."""
    parts = [p for p in re.split(r"[/\\]+", path) if p]
    first = lambda start: next((p.lower() for p in parts if p.lower().startswith(start)), None)
    named = ALIASES.get(parts[-2].strip().lower()) if len(parts) > 1 else None
    start = re.match("static_presence|movement|presence|static|empty", parts[-1].lower()) if parts else None
    return {"path_label": named or (ALIASES[start[0]] if start else None), "session": first("session"), "quadrant": first("quad")}


def _layout(version: int, label: int, n: int) -> np.dtype:
    """A packet of one label length and width."""
    codes = HEADERS[version].format[1:]
    fields = [("size", _CODES[codes[0]]), *[(f, _CODES[c]) for f, c in zip(FIELDS[version], codes[1:], strict=True)]]
    return np.dtype([*fields, ("label", f"S{label}" if label else "V0"), ("imag", "<i2", (n,)), ("real", "<i2", (n,))])


def _runs(data: bytes, version: int) -> Iterator[tuple[np.ndarray, int]]:
    """The packets that data holds whole, as runs of one layout, and where each run ends."""
    header, at = HEADERS[version], 0
    while at + header.size <= len(data):
        values = header.unpack_from(data, at)
        label, n = values[0], values[1 + FIELDS[version].index("n")]
        kind = _layout(version, label, n)
        most = (len(data) - at) // kind.itemsize
        if not most:
            return
        rows = np.frombuffer(data, kind, most, at)
        other = np.flatnonzero((rows["size"] != label) | (rows["n"] != n))
        rows = rows[: other[0] if len(other) else most]
        at += len(rows) * kind.itemsize
        yield rows, at


def _batch(rows: np.ndarray, path: str, version: int, pos: int) -> pa.RecordBatch:
    count, n = len(rows), rows["imag"].shape[1] if rows.ndim == 1 else 0
    place = np.arange(pos, pos + count)
    zero = np.zeros(count, np.int64)
    own = {f: rows[f] for f in FIELDS[version]}
    texts = [bytes(x).decode() for x in rows["label"].tolist()] if rows.dtype["label"].itemsize else [""] * count
    texts = [x.ljust(rows.dtype["label"].itemsize, "\0") if len(x.encode()) < rows.dtype["label"].itemsize else x for x in texts]  # NumPy drops zeros at the end
    columns = {"path": [path] * count, "pos": place, "label": texts, "file_version": np.full(count, version), "capture_timestamp": rows["pc_timestamp"], "esp_timestamp_us": zero, "sequence": zero, "packet_index": place + 1, "flags": zero} | own
    for part in ("imag", "real"):
        columns[part] = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * n), pa.array(np.ascontiguousarray(rows[part]).reshape(-1)))
    kinds = {f.name: f.type for f in ARROW}
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f], pa.Array) else pa.array(np.asarray(c).astype(k.to_pandas_dtype()) if k not in (pa.string(),) else c, k) for f, k in kinds.items()], schema=ARROW)


@dataclass
class Part(InputPartition):
    """The bytes from start to stop of a file, whose first packet is number pos."""

    path: str
    start: int
    stop: int
    pos: int
    version: int

    def __init__(self, path: str, start: int, stop: int, pos: int, version: int) -> None:
        self.path, self.start, self.stop, self.pos, self.version = path, start, stop, pos, version


def _version(head: bytes, path: str) -> int:
    if len(head) < FILE_HEADER.size:
        raise ValueError(f"{path}: file header is cut short")
    magic, version = FILE_HEADER.unpack(head)
    if magic != MAGIC:
        raise ValueError(f"{path}: no packet file")
    if version not in HEADERS:
        raise ValueError(f"{path}: version {version} is not supported")
    return version


def splits(store: fs.FileSystem, path: str, size: int, most: int = SPLIT) -> list[Part]:
    """A file cut at packets into parts of about `most` bytes. Only headers are read, and none of a file that is one part."""
    with store.open_input_file(path) as f:
        version = _version(f.read_at(FILE_HEADER.size, 0), path)
        header, at, pos, out = HEADERS[version], FILE_HEADER.size, 0, []
        start, first = at, 0
        width = 1 + FIELDS[version].index("n")
        while size - start > most and at < size:
            raw = f.read_at(header.size, at)
            if len(raw) < header.size:
                raise ValueError(f"{path}: packet header is cut short")
            values = header.unpack(raw)
            at, pos = at + header.size + values[0] + 4 * values[width], pos + 1
            if at - start >= most:
                out.append(Part(path, start, min(at, size + 1), first, version))
                start, first = at, pos
        if start < size or not out:
            out.append(Part(path, start, size, first, version))
        return out


class PacketReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.most, self.wanted = options["path"], int(options.get("splitBytes", SPLIT)), {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over = and IN on what the path says."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in PATH:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, root = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        out = []
        for info in sorted(found, key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.endswith(".bin") or re.search(r"(^|/)[_.]", info.path.removeprefix(root)):
                continue
            facts = path_facts(info.path)
            if all(facts[c] in values for c, values in self.wanted.items()):
                out += splits(store, info.path, info.size, self.most)
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = _store(self.folder)
        facts = path_facts(partition.path)
        schema = pa.schema([*ARROW, *[(c, pa.string()) for c in PATH]])
        with store.open_input_file(partition.path) as f:
            at, pos, held, block = partition.start, partition.pos, b"", BLOCK
            while at < partition.stop or held:
                fresh = f.read_at(min(block, partition.stop - at), at) if at < partition.stop else b""
                at += len(fresh)
                held, used = held + fresh, 0
                for rows, used in _runs(held, partition.version):
                    made = _batch(rows, partition.path, partition.version, pos)
                    pos += len(rows)
                    yield pa.RecordBatch.from_arrays([*made.columns, *[pa.array([facts[c]] * len(rows), pa.string()) for c in PATH]], schema=schema)
                held = held[used:]
                if not fresh and held:
                    raise ValueError(f"{partition.path}: packet is cut short")
                block = BLOCK if used else 2 * block  # a packet larger than a block


@dataclass
class Written(WriterCommitMessage):
    """The file of a task's attempt; empty if it had no rows."""

    file: str
    rows: int


class PacketWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = options["path"], overwrite, uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file of version 2 with the task's packets, in a folder that no reader looks into."""
        from pyspark import TaskContext

        store, root = _store(self.folder)
        context = TaskContext.get()
        store.create_dir(f"{root}/_writing-{self.job}", recursive=True)
        file, count = f"{root}/_writing-{self.job}/part-{context.partitionId():05d}-{context.taskAttemptId()}.bin", 0
        with store.open_output_stream(file) as out:
            out.write(FILE_HEADER.pack(MAGIC, 2))
            for batch in iterator:
                for row in batch.to_pylist():
                    count += 1
                    label, imag, real = (row.get("label") or "").encode(), row["imag"] or [], row["real"] or []
                    n = min(len(imag), len(real))
                    known = {"capture_timestamp": row.get("pc_timestamp"), "packet_index": count} | {k: v for k, v in row.items() if v is not None} | {"n": n}
                    out.write(HEADERS[2].pack(len(label), *[known.get(f) or 0 for f in FIELDS[2]]) + label + np.asarray(imag[:n], "<i2").tobytes() + np.asarray(real[:n], "<i2").tobytes())
        return Written(file, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
                if info.type == fs.FileType.File and info.path.endswith(".bin") and "/_writing-" not in info.path:
                    store.delete_file(info.path)
        for m in messages:
            if m is not None and m.rows:
                store.move(m.file, f"{root}/{re.sub(r'-[0-9]+[.]bin$', '', basename(m.file))}-{self.job}.bin")
        self._clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_store(self.folder))

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        """With it goes what attempts left that were repeated."""
        if store.get_file_info(f"{root}/_writing-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_writing-{self.job}")


class PacketSource(DataSource):
    """Packets of all *.bin files below a path; what their path says of them is in path_label, session and quadrant."""

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return SCHEMA + "".join(f", {c} string" for c in PATH)

    def reader(self, schema: object) -> PacketReader:
        return PacketReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> PacketWriter:
        return PacketWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PacketSource)
