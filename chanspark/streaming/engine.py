"""Incremental inference: packets of a stream to filtered windows, descriptors, class probabilities and stable states.

A stream's state is a ring of the last amplitudes, its counters and the state machine; its size does not grow. A window
is judged when the ring is full and then after every `step` accepted packets, on the middle of the ring, so that filters
see `context` packets on both sides.
"""

from __future__ import annotations

import json
from base64 import b64decode, b64encode
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chanspark.operators.signal import MAD_SCALE
from chanspark.streaming import machine

OUT = "accepted long, rejected long, window_start long, window_end long, delay double, " + machine.DECISION


@dataclass
class Settings:
    """What a model was trained with: window, filters, scaler of the selected channels, features, and classify: features to probabilities."""

    channels: int
    mean: list[float]
    std: list[float]
    selected: list[int]
    features: list[int]
    classify: Callable[[np.ndarray], list[float]]
    size: int = 100
    step: int = 25
    radius: int = 5
    sigmas: float = 3.0
    width: int = 3
    context: int | None = None
    rules: dict = field(default_factory=machine.config)

    def __post_init__(self) -> None:
        if self.context is None:
            self.context = self.radius + self.width // 2
        if not len(self.mean) == len(self.std) == len(self.selected) or min(self.std, default=1) <= 0:
            raise ValueError("mean, std and selected are as long as each other, and std is above 0")
        if not all(0 <= c < self.channels for c in self.selected) or self.size < 2 or self.step < 1:
            raise ValueError("selected channels are from 0 to channels - 1, a window has two packets and a step one at least")


def _around(x: np.ndarray, radius: int) -> np.ndarray:
    """Each row with radius rows before and after it, the outermost repeated: (rows, channels, 2 radius + 1)."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((radius, radius), (0, 0)), "edge"), 2 * radius + 1, axis=0)


def filtered(x: np.ndarray, radius: int, sigmas: float, width: int) -> np.ndarray:
    """Hampel with edges repeated, then the centred mean; columns are channels."""
    if radius > 0 and len(x) >= 3:
        median = np.median(_around(x, radius), axis=2)
        off = np.abs(x - median)
        scale = MAD_SCALE * np.median(_around(off, radius), axis=2)
        x = np.where((scale > 0) & (off > sigmas * scale), median, x)
    return _around(x, width // 2).mean(axis=2) if width > 1 else x


def describe(x: np.ndarray) -> np.ndarray:
    """The eleven descriptors of every column, channel after channel."""
    d, t = np.diff(x, axis=0), np.arange(len(x)) - (len(x) - 1) / 2
    rows = [x.mean(0), x.std(0), x.min(0), x.max(0), np.ptp(x, axis=0), (x * x).sum(0), np.abs(d).mean(0), np.abs(d).max(0), (d * d).sum(0), d.std(0), (t[:, None] * x).sum(0) / (t * t).sum()]
    return np.stack(rows, axis=1).ravel()


def start() -> dict:
    return {"ring": np.zeros((0, 0)), "times": [], "accepted": 0, "rejected": 0, "machine": machine.start()}


def push(now: dict, amplitude: list[float] | None, seconds: float, s: Settings) -> dict | None:
    """Takes a packet; the decision, if a window is due. Packets of another width or with a value that isn't finite are only counted."""
    row = np.asarray([] if amplitude is None else amplitude, float)
    if len(row) != s.channels or not np.isfinite(row).all():
        now["rejected"] += 1
        return None
    most = s.size + 2 * s.context
    now["ring"] = np.vstack([now["ring"].reshape(-1, s.channels), row])[-most:]
    now["times"] = [*now["times"], seconds][-most:]
    now["accepted"] += 1
    if now["accepted"] < most or (now["accepted"] - most) % s.step:
        return None
    middle = filtered(now["ring"], s.radius, s.sigmas, s.width)[s.context : s.context + s.size]
    vector = describe((middle[:, s.selected] - np.asarray(s.mean)) / np.asarray(s.std))
    begin = now["accepted"] - most + s.context
    found = {"accepted": now["accepted"], "rejected": now["rejected"], "window_start": begin, "window_end": begin + s.size, "delay": now["times"][-1] - now["times"][s.context + s.size - 1]}
    return found | machine.step(now["machine"], list(s.classify(vector[s.features])), s.rules)


def _pack(now: dict) -> str:
    return json.dumps(now | {"ring": [now["ring"].shape, b64encode(now["ring"].tobytes()).decode()]})


def _unpack(text: str) -> dict:
    now = json.loads(text)
    shape, raw = now["ring"]
    return now | {"ring": np.frombuffer(b64decode(raw)).reshape(shape)}


def run(packets: DataFrame, settings: Settings) -> DataFrame:
    """Decisions about the packets (stream_id, sequence, seconds, amplitude) of a streaming or a batch DataFrame.

    A micro-batch's packets are taken in order of sequence. On batch data packets are exchanged once by stream, sorted
    within partitions and read as a stream, so a long recording takes no more memory than a short one.
    """
    own = packets.where(F.col("stream_id").isNotNull()).select("stream_id", "sequence", "seconds", "amplitude")
    kind = dict(own.dtypes)["stream_id"]
    names = ["stream_id", *[c.split()[0] for c in OUT.split(", ")]]

    def decide(now: dict, name: object, frame: pd.DataFrame) -> pd.DataFrame:
        found = [push(now, a, t, settings) for a, t in zip(frame["amplitude"], frame["seconds"], strict=True)]
        return pd.DataFrame([{"stream_id": name} | d for d in found if d], columns=names)

    def keyed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = _unpack(state.get[0]) if state.exists else start()
        yield decide(now, key[0], pd.concat(list(frames)).sort_values("sequence"))
        state.update((_pack(now),))

    def ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, start()
        for frame in frames:
            for name, part in frame.groupby("stream_id", sort=False):
                if name != last:
                    last, now = name, start()
                yield decide(now, name, part)

    if own.isStreaming:
        return own.groupBy("stream_id").applyInPandasWithState(keyed, f"stream_id {kind}, {OUT}", "state string", "append", GroupStateTimeout.NoTimeout)
    return own.repartition("stream_id").sortWithinPartitions("stream_id", "sequence").mapInPandas(ordered, f"stream_id {kind}, {OUT}")
