"""Wire frames: a byte stream in chunks of any size, to samples and statistics.

A frame is a magic word, version, type, size, payload and a checksum. After anything that is no frame the parser looks
for the next magic word one byte later, so it finds its way back after losses.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The frame format and the polynomial of its checksum (CRC-16/CCITT-FALSE).
MAGIC, VERSION, SAMPLE, STATS, MOST_BYTES = b"CSI2", 1, 1, 2, 2048
HEAD, POLYNOMIAL, STATS_BYTES = 8, 0x1021, 46
SAMPLE_FIELDS = struct.Struct("<IQbBBBH")
STATS_FIELDS = struct.Struct("<Q6I2H")
STATS_NAMES = ("timestamp_us", "csi_received", "csi_queued", "csi_serialized", "queue_drops", "invalid", "oversize", "queue_pending", "reserved")


def _table() -> list[int]:
    out = []
    for byte in range(256):
        x = byte << 8
        for _ in range(8):
            x = (x << 1 ^ POLYNOMIAL if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


TABLE = _table()


def crc16(data: bytes) -> int:
    x = 0xFFFF
    for byte in data:
        x = (x << 8 & 0xFFFF) ^ TABLE[x >> 8 ^ byte]
    return x


def frame(kind: int, payload: bytes) -> bytes:
    """A frame with its checksum, as a device sends it."""
    body = struct.pack("<BBH", VERSION, kind, HEAD + len(payload) + 2) + payload
    return MAGIC + body + struct.pack("<H", crc16(body))


@dataclass
class Parser:
    """Takes chunks, gives events; its fields are all its state, so that it can be kept and taken up again."""

    pending: bytes = b""
    last_sequence: int = -1
    sample_frames: int = 0
    stats_frames: int = 0
    unsupported_frames: int = 0
    invalid_frames: int = 0
    crc_errors: int = 0
    bytes_discarded: int = 0
    sequence_gaps: int = 0
    events: list = field(default_factory=list, repr=False)

    def feed(self, chunk: bytes) -> list[dict]:
        data, at, self.events = self.pending + chunk, 0, []
        while len(data) - at >= len(MAGIC):
            found = data.find(MAGIC, at)
            # What could still become a magic word with the next chunk is kept.
            start = found if found >= 0 else len(data) - len(MAGIC) + 1
            self.bytes_discarded += start - at
            at = start
            if found < 0 or len(data) - at < HEAD:
                break
            size = int.from_bytes(data[at + 6 : at + 8], "little")
            if data[at + 4] != VERSION or not HEAD + 2 <= size <= MOST_BYTES:
                self.invalid_frames += 1
                at += 1
                continue
            if len(data) - at < size:
                break
            body = data[at + len(MAGIC) : at + size - 2]
            if crc16(body) != int.from_bytes(data[at + size - 2 : at + size], "little"):
                self.crc_errors += 1
                at += 1
                continue
            self._take(body[1], body[4:], size)
            at += size
        self.pending = data[at:]
        return self.events

    def _take(self, kind: int, payload: bytes, size: int) -> None:
        if kind == SAMPLE:
            if len(payload) < SAMPLE_FIELDS.size or len(payload) != SAMPLE_FIELDS.size + int.from_bytes(payload[16:18], "little"):
                self.invalid_frames += 1
                return
            sequence, micros, rssi, rate, channel, flags, n = SAMPLE_FIELDS.unpack_from(payload)
            raw = np.frombuffer(payload, np.int8, n - n % 2, SAMPLE_FIELDS.size).astype(np.float32)
            if self.last_sequence >= 0 and (gap := (sequence - self.last_sequence - 1) & 0xFFFFFFFF) < 1 << 31:
                self.sequence_gaps += gap
            self.last_sequence = sequence
            self.sample_frames += 1
            self.events.append({"type": "sample", "sequence": sequence, "timestamp_us": micros, "rssi": rssi, "rate": rate, "channel": channel, "flags": flags, "csi_len": n, "imag": raw[0::2], "real": raw[1::2]})
        elif kind == STATS:
            if size != STATS_BYTES:
                self.invalid_frames += 1
                return
            values = dict(zip(STATS_NAMES, STATS_FIELDS.unpack(payload), strict=True))
            self.stats_frames += 1
            self.events.append({"type": "stats", "timestamp_us": values.pop("timestamp_us"), "stats": values})
        else:
            self.unsupported_frames += 1

    def counters(self) -> dict[str, int]:
        return {k: v for k, v in asdict(self).items() if k not in ("pending", "last_sequence", "events")}


EVENTS = "device string, type string, sequence long, timestamp_us long, rssi int, rate int, channel int, flags int, csi_len int, imag array<float>, real array<float>, stats map<string,long>, counters map<string,long>"
EVENT_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


def _frame_of(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows).reindex(columns=EVENT_COLUMNS).astype(object)
    return out.where(out.notna(), None)


def parse(chunks: DataFrame) -> DataFrame:
    """Events of (device, chunk_index, data), and for each device a last row of type counters.

    A device's chunks must be in order: they are exchanged once by device and sorted within partitions, then read as a
    stream, so that a task holds one parser and one batch whatever the length of a recording.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, parser = None, Parser()
        for piece in frames:
            rows = []
            for name, data in zip(piece["device"], piece["data"], strict=True):
                if name != device:
                    if device is not None:
                        rows.append({"device": device, "type": "counters", "counters": parser.counters()})
                    device, parser = name, Parser()
                rows += [{"device": device} | e for e in parser.feed(bytes(data))]
            if rows:
                yield _frame_of(rows)
        if device is not None:
            yield _frame_of([{"device": device, "type": "counters", "counters": parser.counters()}])

    ordered = chunks.where(F.col("device").isNotNull()).select("device", "chunk_index", F.coalesce("data", F.lit(b"")).alias("data"))
    return ordered.repartition("device").sortWithinPartitions("device", "chunk_index").mapInPandas(run, EVENTS)
