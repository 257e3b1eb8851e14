"""Binary packet files: read as one task a file, and written.

A file is magic and version, then packets: a header, the label in UTF-8, imaginary and real parts as 16-bit integers,
all little-endian. Version 1 has fewer fields; what it lacks gets the defaults of packet_rows().
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chanspark.functions import naming

#: The file format.
MAGIC = b"CSIBIN1"
FILE_HEADER = struct.Struct("<7sI")
HEADERS = {1: struct.Struct("<HdiiiiI"), 2: struct.Struct("<HddQIIiiiIII")}
FIELDS = {
    1: ("pc_timestamp", "rssi", "rate", "channel", "csi_len", "n"),
    2: ("pc_timestamp", "capture_timestamp", "esp_timestamp_us", "sequence", "packet_index", "rssi", "rate", "channel", "csi_len", "n", "flags"),
}

SCHEMA = (
    "path string, pos int, label string, pc_timestamp double, capture_timestamp double, esp_timestamp_us long, sequence long, packet_index long, "
    "rssi int, rate int, channel int, csi_len long, flags long, imag array<smallint>, real array<smallint>, file_version int"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _places(content: bytes) -> Iterator[tuple[int, int, tuple]]:
    """(version, where its body begins, header) of each packet. ValueError on a wrong magic, another version, or bytes that end too early."""
    if len(content) < FILE_HEADER.size:
        raise ValueError("file header is cut short")
    magic, version = FILE_HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("no packet file")
    if version not in HEADERS:
        raise ValueError(f"version {version} is not supported")
    header, at = HEADERS[version], FILE_HEADER.size
    width = 1 + FIELDS[version].index("n")
    while at < len(content):
        if at + header.size > len(content):
            raise ValueError("packet header is cut short")
        values = header.unpack_from(content, at)
        at += header.size
        size = values[0] + 4 * values[width]
        if at + size > len(content):
            raise ValueError("packet is cut short")
        yield version, at, values
        at += size


def packet_rows(content: bytes) -> Iterator[dict]:
    """The packets of a file, in order. ValueError on a wrong magic, another version, or bytes that end too early."""
    for pos, (version, at, (size, *values)) in enumerate(_places(content)):
        row = dict(zip(FIELDS[version], values, strict=True))
        n = row.pop("n")
        row["label"] = content[at : at + size].decode()
        parts = np.frombuffer(content, "<i2", 2 * n, at + size)
        row |= {"imag": parts[:n], "real": parts[n:], "file_version": version, "pos": pos}
        yield {"capture_timestamp": row["pc_timestamp"], "esp_timestamp_us": 0, "sequence": 0, "packet_index": pos + 1, "flags": 0} | row


def fault(content: bytes) -> str | None:
    """Why a file can't be read out whole, by its headers; null if it can."""
    try:
        for _ in _places(content):
            pass
    except ValueError as e:
        return str(e)
    return None


def packet_bytes(rows: list[dict]) -> bytes:
    """A file of version 2. Vectors are cut to the shorter part; a missing packet_index is the place from 1."""
    out = [FILE_HEADER.pack(MAGIC, 2)]
    for place, row in enumerate(rows, 1):
        label, n = (row["label"] or "").encode(), min(len(row["imag"]), len(row["real"]))
        row = {"n": n, **row, "capture_timestamp": row.get("capture_timestamp") or row["pc_timestamp"], "packet_index": row.get("packet_index") or place}
        out += [HEADERS[2].pack(len(label), *[row.get(f) or 0 for f in FIELDS[2]]), label]
        out += [np.asarray(row[part][:n], "<i2").tobytes() for part in ("imag", "real")]
    return b"".join(out)


def decode(files: DataFrame, malformed: str = "fail") -> DataFrame:
    """Packets of (path, content). malformed: fail; drop, which leaves the files that can't be read out whole; report, which has a row (path, error) for each of them."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                error = fault(content) if malformed != "fail" else None  # known at a file's end only; its packets are not held until then
                if error is None:
                    try:
                        for row in packet_rows(content):
                            yield row | {"path": path, "error": None}
                    except ValueError as e:
                        raise ValueError(f"{path}: {e}") from e
                elif malformed == "report":
                    yield dict.fromkeys(COLUMNS) | {"path": path, "error": error}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, names = rows(frames), [*COLUMNS, *["error"] * (malformed == "report")]
        while part := list(islice(every, 4096)):  # packets of as many files as there are
            yield pd.DataFrame({c: pd.Series([r[c] for r in part], dtype=object) for c in names})

    return files.select("path", "content").mapInPandas(run, SCHEMA + ", error string" * (malformed == "report"))


def read(spark: SparkSession, folder: str, labels: list[str] | None = None, quadrants: list[str] | None = None, malformed: str = "fail") -> DataFrame:
    """Packets of all *.bin files below a folder with path_label, session and quadrant; files whose path lacks label or quadrant are left out.

    The filters are on the path, so files that don't count are not read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(folder)
    path, kept = F.col("path"), found.where(on_path(labels, quadrants))
    return decode(kept, malformed).withColumns({"path_label": naming.label_of_path(path), "session": naming.part_starting(path, "session"), "quadrant": naming.part_starting(path, "quad")})


def on_path(labels: list[str] | None = None, quadrants: list[str] | None = None, path: str = "path") -> Column:
    """Whether a path names a class and a quadrant, of those that are wanted."""
    own, place = naming.label_of_path(F.col(path)), naming.part_starting(F.col(path), "quad")
    kept = own.isNotNull() & place.isNotNull()
    if labels:
        kept = kept & own.isin(labels)
    return kept & place.isin(quadrants) if quadrants else kept


#: Files whose first places are broadcast.
BROADCAST_FILES = 100_000


def concatenated(packets: DataFrame, out: str = "place") -> DataFrame:
    """packets with their place in one sequence of all files, in order of path and place in it, from 0.

    Where a file begins follows from counts, a row a file; packets aren't brought into one order for it.
    """
    files = packets.groupBy("path").agg(F.count("*").alias("_n"), F.min("pos").alias("_first"))
    begins = files.select(F.col("path").alias("_path"), "_first", (F.sum("_n").over(Window.orderBy("path")) - F.col("_n")).alias("_begin"))
    few = files.count() <= BROADCAST_FILES
    return packets.join(F.broadcast(begins) if few else begins, F.col("path") == F.col("_path")).withColumn(out, F.col("_begin") + F.col("pos") - F.col("_first")).drop("_path", "_begin", "_first")


def exploded(packets: DataFrame) -> DataFrame:
    """One row a packet and subcarrier, as for a CSV file: packets are counted from 0."""
    n = F.least(F.size("imag"), F.size("real"))
    pairs = F.arrays_zip(F.slice("imag", 1, n).alias("imag"), F.slice("real", 1, n).alias("real"))
    step = packets.select("label", "pc_timestamp", F.col("pos").alias("packet_index"), F.posexplode(pairs).alias("subcarrier", "c"), "rssi", "rate", "channel", "csi_len")
    return step.select("label", "pc_timestamp", "packet_index", "subcarrier", "c.imag", "c.real", "rssi", "rate", "channel", "csi_len")


def lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """Packets of text lines CSI,time,rssi,rate,channel,length,values...; malformed lines are left out.

    (esp_timestamp_us, rssi, rate, channel, csi_len, imag, real, amplitude, phase); an odd last value is dropped.
    """
    from chanspark.functions import arrays

    parts = F.split(column, ",")
    numbers = F.transform(F.slice("p", 2, 1 << 30), lambda x: F.trim(x).try_cast("long"))
    step = texts.select(parts.alias("p")).where((F.size("p") >= 7) & (F.col("p")[0] == "CSI")).select(numbers.alias("v"))
    raw = F.slice("v", 6, 1 << 30)
    good = step.where(F.forall("v", lambda x: x.isNotNull()) & (F.size(raw) == F.col("v")[4])).withColumn("raw", raw)
    both = good.select(*[F.col("v")[k].alias(c) for k, c in enumerate(("esp_timestamp_us", "rssi", "rate", "channel", "csi_len"))], arrays.every_second("raw", 0).alias("imag"), arrays.every_second("raw", 1).alias("real"))
    return both.withColumn("amplitude", arrays.amplitude("imag", "real")).withColumn("phase", arrays.phase("imag", "real"))
