"""The inference engine on Spark's state API: the ring as list state, late packets counted, timers for streams that fall silent.

Each stream has three variables of state, in RocksDB on the executors and in the checkpoint of the query: the ring of the
last packets, the counters and state machine, and what is late. Packets up to the last sequence that was taken are late:
they are counted and change no decision, so a stream's decisions are those of a batch without them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chanspark.streaming import engine

EVENT = "event string, late long, " + engine.OUT
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Inference(StatefulProcessor):
    """Decisions of each stream as its packets come. silent_ms: after so long without a packet a stream is told as silent and forgotten."""

    def __init__(self, settings: engine.Settings, key: str, silent_ms: int | None) -> None:
        self.settings, self.key, self.silent_ms = settings, key, silent_ms
        self.names = [key, *[c.split()[0] for c in EVENT.split(", ")]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "seconds double, amplitude array<double>")
        self.counts = handle.getValueState("counts", "state string, last long, late long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, last, late = engine.start(), None, 0
        if self.counts.exists():
            kept, last, late = self.counts.get()
            held = list(self.ring.get())
            now |= json.loads(kept) | {"times": [t for t, _ in held], "ring": np.array([a for _, a in held], float).reshape(-1, self.settings.channels)}
        frame, out = pd.concat(list(rows)).sort_values("sequence", kind="stable"), []
        for sequence, seconds, amplitude in zip(frame["sequence"], frame["seconds"], frame["amplitude"], strict=True):
            if last is not None and sequence <= last:
                late += 1
                continue
            last = int(sequence)
            if found := engine.push(now, amplitude, seconds, self.settings):
                out.append({self.key: key[0], "event": "decision", "late": late} | found)
        self.ring.put([(float(t), row.tolist()) for t, row in zip(now["times"], now["ring"], strict=True)])
        self.counts.update((json.dumps({k: v for k, v in now.items() if k not in ("ring", "times")}), last, late))
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, _, late = self.counts.get()
        now = json.loads(kept)
        self.ring.clear()
        self.counts.clear()
        told = dict.fromkeys(self.names) | {self.key: key[0], "event": "silent", "late": late, "accepted": now["accepted"], "rejected": now["rejected"]}
        yield pd.DataFrame([told], columns=self.names)

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """The state API needs a store that holds each variable by itself, and, on batch data too, what coordinates stores, which the query manager starts."""
    spark.streams.active  # noqa: B018  makes the manager
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def run(packets: DataFrame, settings: engine.Settings, silent_ms: int | None = None) -> DataFrame:
    """(stream_id, event, late, decision...) of packets (stream_id, sequence, seconds, amplitude), streaming or not.

    event is decision, or silent for a stream that is forgotten: if it goes on, it starts anew. Packets of one micro-batch
    are taken in order of sequence; one that repeats a sequence is late. Streams of null stream_id are left out.
    """
    prepare(packets.sparkSession)
    own = packets.where(F.col("stream_id").isNotNull()).select("stream_id", "sequence", "seconds", "amplitude")
    kind = dict(own.dtypes)["stream_id"]
    mode = "None" if silent_ms is None else "ProcessingTime"
    return own.groupBy("stream_id").transformWithStateInPandas(Inference(settings, "stream_id", silent_ms), f"stream_id {kind}, {EVENT}", "append", mode)
