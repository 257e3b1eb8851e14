"""A temporal state machine over class probabilities: smooths them, and confirms changes before it accepts them.

One kernel, plain numbers for its state; batch replay and Structured Streaming both run it, with equal decisions.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chanspark.functions.arrays import CLASSES

#: The default rules, (confirmations, least probability) by source and target; direct ones pass no movement.
NORMAL = {("empty", "movement"): (1, 0.5), ("movement", "static_presence"): (1, 0.5), ("movement", "empty"): (1, 0.5), ("static_presence", "movement"): (1, 0.5)}
DIRECT = {("empty", "static_presence"): (2, 0.55), ("static_presence", "empty"): (2, 0.55)}

DECISION = (
    "window_index long, warmup boolean, raw_state string, smoothed_state string, stable_state_before string, stable_state string, movement_origin string, "
    "movement_age_windows long, candidate_state string, candidate_count long, transition_accepted boolean, transition_reason string, inferred_transition boolean, "
    "probability_empty double, probability_static_presence double, probability_movement double, probability_presence double, confidence double"
)
COLUMNS = [c.split()[0] for c in DECISION.split(", ")]
PROBABILITIES = [f"probability_{c}" for c in CLASSES]


def config(weights: list[float] | None = None, warmup: int = 0, normal: dict | None = None, direct: dict | None = None, blocked: tuple = ()) -> dict:
    """Rules by "source>target": [confirmations, least probability, enabled], checked."""
    rules = {f"{a}>{b}": [*r, (a, b) not in blocked] for (a, b), r in (NORMAL | (normal or {}) | DIRECT | (direct or {})).items()}
    weights = weights or [1.0]
    if any(w < 0 for w in weights) or sum(weights) <= 0 or warmup < 0:
        raise ValueError("weights must not be negative nor all zero, nor the warm-up negative")
    if any(n < 1 or not 0 <= p <= 1 for n, p, _ in rules.values()):
        raise ValueError("a rule needs a confirmation at least, and a probability from 0 to 1")
    return {"weights": weights, "warmup": warmup, "rules": rules}


def start() -> dict:
    return {"state": CLASSES[0], "index": -1, "origin": None, "age": 0, "candidate": None, "count": 0, "history": []}


def turn(before: str, candidate: str | None, count: int, target: str, chance: float, rules: dict) -> tuple[str, int]:
    """What becomes of a state that a window's smoothed winner speaks for or against, and the confirmations that its candidate has then."""
    if target == before:
        return "confirmed", 0
    confirmations, least, enabled = rules[f"{before}>{target}"]
    if not enabled:
        return "blocked", 0
    if chance < least:
        return "below", 0
    count = count + 1 if candidate == target else 1
    return "accepted" if count >= confirmations else "waiting", count


def step(now: dict, probabilities: list[float], rules: dict) -> dict:
    """The decision about one window; `now` is changed to the state after it."""
    if len(probabilities) != len(CLASSES) or not all(math.isfinite(p) and p >= 0 for p in probabilities) or sum(probabilities) <= 0:
        raise ValueError("probabilities must be finite, not negative, and not all zero")
    own = [p / sum(probabilities) for p in probabilities]
    best = lambda p: max(range(len(CLASSES)), key=lambda k: (p[k], -k))
    now["history"] = (now["history"] + [own])[-len(rules["weights"]) :]
    weights = rules["weights"][-len(now["history"]) :]
    # Weights of zero leave nothing to smooth with while the history is short: then the newest counts.
    weights = weights if sum(weights) > 0 else [0.0] * (len(weights) - 1) + [1.0]
    smooth = [sum(w * p[k] for w, p in zip(weights, now["history"], strict=True)) / sum(weights) for k in range(len(CLASSES))]
    target, before, origin = CLASSES[best(smooth)], now["state"], now["origin"]
    now["index"] += 1
    now["age"] += before == "movement"
    warmup, direct = now["index"] < rules["warmup"], (before, target) in DIRECT
    outcome, count = ("warmup", 0) if warmup else turn(before, now["candidate"], now["count"], target, smooth[best(smooth)], rules["rules"])
    accepted = outcome == "accepted"
    now["candidate"], now["count"] = (target, count) if outcome == "waiting" else (None, 0)
    if accepted:
        if target == "movement":
            now["origin"], now["age"] = before, 0
        elif before == "movement":
            now["origin"], now["age"] = None, 0
        now["state"] = target
    kind, name = "direct" if direct else "normal", f"{before}_to_{target}"
    reason = {
        "warmup": "startup_warmup_state_locked_empty",
        "confirmed": "stable_state_confirmed",
        "blocked": f"direct_transition_blocked:{name}" if direct else f"normal_transition_disabled:{name}",
        "below": f"{kind}_transition_below_threshold:{name}",
        "waiting": f"{kind}_transition_waiting_confirmation:{name}",
        "accepted": f"normal_transition:{name}" if not direct else "inferred_entry_movement_not_observed" if before == "empty" else "inferred_exit_movement_not_observed",
    }[outcome]
    shown = now["origin"] if now["state"] == "movement" else origin if before == "movement" else None
    values = (now["index"], warmup, CLASSES[best(own)], target, before, now["state"], shown, now["age"], now["candidate"], now["count"], accepted, reason, accepted and direct, *smooth, 1 - smooth[0], smooth[best(smooth)])
    return dict(zip(COLUMNS, values, strict=True))


def _schema(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep) + ", " + DECISION


def _kept(df: DataFrame, key: str, order: list[str], keep: list[str] | None) -> list[str]:
    wanted = [key, *order, *(keep or [])]
    return [c for c in df.columns if c in wanted]  # in the order of the table


def replay(df: DataFrame, key: str, order: list[str], rules: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """Decisions about ordered rows with probability_* columns, of each key from the initial state on.

    Rows are exchanged once by key, sorted within partitions and read as a stream: a task holds one state and one batch,
    so a key with a third of all rows costs time but no memory. Rows of null key are left out.
    """
    rules, kept = rules or config(), _kept(df, key, order, keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, start()
        for frame in frames:
            out = []
            for name, *p in frame[[key, *PROBABILITIES]].itertuples(index=False):
                if name != last:
                    last, now = name, start()
                out.append(step(now, p, rules))
            yield pd.concat([frame[kept].reset_index(drop=True), pd.DataFrame(out, columns=COLUMNS)], axis=1)

    ordered = df.where(F.col(key).isNotNull()).select(*dict.fromkeys([*kept, *PROBABILITIES])).repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInPandas(run, _schema(df, kept))


def stream(df: DataFrame, key: str, order: list[str], rules: dict | None = None) -> DataFrame:
    """The same on a streaming DataFrame: state is kept by key from batch to batch, and sorted by order within one."""
    rules, kept = rules or config(), _kept(df, key, order, None)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else start()
        frame = pd.concat(list(frames)).sort_values(order)  # the rows of one micro-batch
        out = [step(now, list(p), rules) for p in frame[PROBABILITIES].itertuples(index=False)]
        state.update((json.dumps(now),))
        yield pd.concat([frame[kept].reset_index(drop=True), pd.DataFrame(out, columns=COLUMNS)], axis=1)

    return df.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(run, _schema(df, kept), "state string", "append", GroupStateTimeout.NoTimeout)


def judge(decisions: DataFrame, expected: str, *keys: str) -> DataFrame:
    """(keys, windows, raw_accuracy, stable_accuracy, delta, false_empty, false_presence, accepted, inferred, final_state)."""
    right = lambda c: F.avg((F.col(c) == F.col(expected)).cast("double"))
    agg = decisions.groupBy(*keys).agg(
        F.count("*").alias("windows"), right("raw_state").alias("raw_accuracy"), right("stable_state").alias("stable_accuracy"),
        F.count_if((F.col("stable_state") == "empty") & (F.col(expected) != "empty")).alias("false_empty"),
        F.count_if((F.col("stable_state") != "empty") & (F.col(expected) == "empty")).alias("false_presence"),
        F.count_if("transition_accepted").alias("accepted"), F.count_if("inferred_transition").alias("inferred"), F.max_by("stable_state", "window_index").alias("final_state"),
    )
    return agg.withColumn("delta", F.col("stable_accuracy") - F.col("raw_accuracy"))


#: States that a task of tune() holds at a time: one for each row of a block and candidate.
HELD = 1 << 24


class _Grid:
    """All candidates of tune() as one table of integers, and their states over blocks of rows.

    A state is the stable state with its candidate and count. A symbol is a smoothed winner with how many of all least
    probabilities it reaches, or the warm-up's; the table has what each symbol makes of each state, by turn(). A step takes
    one row of every stream in a block, with the states of all candidates.
    """

    def __init__(self, candidates: dict[int, dict]) -> None:
        each = list(candidates.values())
        self.ids, ways = list(candidates), [(tuple(r["weights"]), r["warmup"]) for r in each]
        self.ways = list(dict.fromkeys(ways))  # of smoothing and warming up
        self.way = np.array([self.ways.index(w) for w in ways], np.intp)
        limits = [rule for r in each for rule in r["rules"].values()]
        self.least = np.array(sorted({p for _, p, _ in limits}), float)
        most = max((n for n, _, _ in limits), default=1)
        self.states = [(s, None, 0) for s in CLASSES] + [(s, c, n) for s in CLASSES for c in CLASSES if c != s for n in range(1, most)]
        self.symbols = [(c, reached) for c in CLASSES for reached in [-1.0, *self.least.tolist()]] + [None]
        place = {s: k for k, s in enumerate(self.states)}
        self.table = np.zeros((len(each), len(self.symbols), len(self.states)), np.intp)
        self.accepted = np.zeros(self.table.shape, bool)
        for c, r in enumerate(each):
            for k, symbol in enumerate(self.symbols):
                for i, (before, candidate, count) in enumerate(self.states):
                    outcome, n = turn(before, candidate, count, *symbol, r["rules"]) if symbol else ("warmup", 0)
                    self.accepted[c, k, i] = outcome == "accepted"
                    self.table[c, k, i] = place[(symbol[0], None, 0) if outcome == "accepted" else (before, symbol[0], n) if outcome == "waiting" else (before, None, 0)]

    def block(self) -> int:
        return max(1, HELD // max(1, len(self.ids)))

    def start(self) -> dict:
        """last: the name of the stream that a block ended in, its place, its newest probabilities, and its state by candidate."""
        seen = np.zeros((len(self.ids), len(self.symbols), len(CLASSES) + 1, len(self.states)), np.int64)
        return {"last": None, "place": 0, "history": np.zeros((0, len(CLASSES))), "state": None, "windows": 0, "raw_right": 0, "seen": seen}

    def _symbols(self, own: np.ndarray, history: np.ndarray, place: np.ndarray, weights: tuple, warmup: int) -> np.ndarray:
        """Of each row, from its probabilities and those before it in its stream; sums are rounded as step() rounds them."""
        smooth, every = np.empty_like(own), np.concatenate([history, own])
        for length in range(1, len(weights) + 1):
            at = np.flatnonzero(place >= length - 1 if length == len(weights) else place == length - 1)
            newest = list(weights[-length:])
            newest = newest if sum(newest) > 0 else [0.0] * (length - 1) + [1.0]
            smooth[at] = _sum([w * every[len(history) + at - (length - 1 - k)] for k, w in enumerate(newest)]) / sum(newest)
        target = smooth.argmax(axis=1)
        found = target * (len(self.least) + 1) + np.searchsorted(self.least, smooth.max(axis=1), "right")
        return np.where(place < warmup, len(self.symbols) - 1, found)

    def add(self, now: dict, names: np.ndarray, truth: np.ndarray, p: np.ndarray) -> None:
        """Rows that follow on those before, by stream and order. truth: 0, or the class's place from 1."""
        if not (np.isfinite(p) & (p >= 0)).all() or not (p.sum(axis=1) > 0).all():
            raise ValueError("probabilities must be finite, not negative, and not all zero")
        n, states = len(names), len(self.states)
        own = p / _sum(list(p.T))[:, None]
        fresh = np.ones(n, bool)
        fresh[1:] = names[1:] != names[:-1]
        goes_on = now["state"] is not None and bool(names[0] == now["last"])
        begin = np.flatnonzero(fresh)
        size = np.diff(begin, append=n)
        place = np.arange(n) - np.repeat(begin, size)
        if goes_on:
            place[: size[0]] += now["place"]
        symbols = np.stack([self._symbols(own, now["history"], place, *way) for way in self.ways], axis=1)
        # Longest streams first, so those that still have a row are the first ones.
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state = np.zeros((len(order), len(self.ids)), np.intp)
        if goes_on:
            state[np.flatnonzero(order == 0)[0]] = now["state"]
        path = np.empty((n, len(self.ids)), np.min_scalar_type(states))
        table, base, by_row = self.table.ravel(), np.arange(len(self.ids)) * (len(self.symbols) * states), symbols * states
        left = np.searchsorted(-size, -np.arange(size[0]))  # streams with more rows than 0, 1, ...
        for k, count in enumerate(left.tolist()):
            rows, at = begin[:count] + k, state[:count]
            path[rows] = at
            where = by_row[rows].take(self.way, axis=1)
            where += base
            where += at
            table.take(where, out=at, mode="clip")
        kinds = (symbols * (len(CLASSES) + 1) + truth[:, None]) * states
        for c, before in enumerate(np.ascontiguousarray(path.T)):
            now["seen"][c] += np.bincount(kinds[:, self.way[c]] + before, minlength=now["seen"][c].size).reshape(now["seen"][c].shape)
        now["windows"] += n
        now["raw_right"] += int((own.argmax(axis=1) + 1 == truth).sum())
        final = np.flatnonzero(order == len(order) - 1)[0]
        longest = max(len(w) for w, _ in self.ways)
        before = now["history"] if goes_on and len(order) == 1 else own[:0]
        now["history"] = np.concatenate([before, own[n - size[final] :]])[-longest:]
        now["last"], now["place"], now["state"] = names[-1], int(place[-1]) + 1, state[final].copy()

    def sums(self, now: dict) -> list[tuple]:
        """(candidate, windows, raw_right, stable_right, false_empty, false_presence, accepted, inferred)."""
        stable = np.array([CLASSES.index(s) for s, _, _ in self.states])[self.table][:, :, None, :]
        truth = np.arange(-1, len(CLASSES))[None, None, :, None]
        direct = np.array([[bool(k) and (s, k[0]) in DIRECT for s, _, _ in self.states] for k in self.symbols])
        facts = [stable == truth, (stable == 0) & (truth != 0), (stable != 0) & (truth == 0), self.accepted[:, :, None, :], (self.accepted & direct)[:, :, None, :]]
        each = [(now["seen"] * f).sum(axis=(1, 2, 3)).tolist() for f in facts]
        return [(c, now["windows"], now["raw_right"], *counts) for c, *counts in zip(self.ids, *each, strict=True)]


def _sum(terms: list[np.ndarray]) -> np.ndarray:
    """sum() of floats, element by element, with equal rounding: from Python 3.12 on it adds up what is lost as well."""
    total, lost = terms[0].copy(), np.zeros_like(terms[0])
    for x in terms[1:]:
        both = total + x
        lost += np.where(np.abs(total) >= np.abs(x), (total - both) + x, (x - both) + total)
        total = both
    return total + lost if sys.version_info >= (3, 12) else total


def tune(df: DataFrame, key: str, order: list[str], expected: str, candidates: dict[int, dict]) -> DataFrame:
    """(candidate_id, judge()'s columns) of every candidate configuration over all keys, best first.

    Rows are exchanged once; each task runs all candidates, some hundred states, over its rows a block at a time, and counts
    by candidate.
    """
    counted = "candidate_id int, windows long, raw_right long, stable_right long, false_empty long, false_presence long, accepted long, inferred long"
    names, grid = [x.split()[0] for x in counted.split(", ")], _Grid(candidates)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, rows = grid.start(), [], 0
        for frame in chain(frames, [None]):
            if frame is not None and len(frame):
                held.append(frame)
                rows += len(frame)
            while rows and (rows >= grid.block() or frame is None):
                every = pd.concat(held, ignore_index=True)
                part, rest = every[: grid.block()], every[grid.block() :]
                grid.add(now, part[key].to_numpy(), part["_truth"].to_numpy(), part[PROBABILITIES].to_numpy(float))
                held, rows = [rest], len(rest)
        yield pd.DataFrame(grid.sums(now), columns=names)

    truth = F.coalesce(F.array_position(F.array(*map(F.lit, CLASSES)), F.col(expected).cast("string")), F.lit(0)).cast("int")
    ordered = df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, *order, *PROBABILITIES]), truth.alias("_truth")).repartition(key).sortWithinPartitions(key, *order)
    total = ordered.mapInPandas(run, counted).groupBy("candidate_id").agg(*[F.sum(n).alias(n) for n in names[1:]])
    share = lambda c: F.try_divide(F.col(c), F.col("windows"))
    rated = total.select("candidate_id", "windows", share("raw_right").alias("raw_accuracy"), share("stable_right").alias("stable_accuracy"), "false_empty", "false_presence", "accepted", "inferred")
    return rated.orderBy(F.desc("stable_accuracy"), "false_empty", "false_presence", "accepted", "candidate_id")
