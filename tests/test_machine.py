import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chanspark.plans import evaluation
from chanspark.streaming import machine

DATA = "/root/testdata/sf0.001"
E, S, M = "empty", "static_presence", "movement"


def _run(rows, **config):
    rules, now = machine.config(**config), machine.start()
    return [machine.step(now, p, rules) for p in rows]


def test_demo_scenarios():
    rows = [(0.85, 0.10, 0.05)] * 3 + [(0.30, 0.60, 0.10)] + [(0.82, 0.12, 0.06)] * 2 + [(0.05, 0.10, 0.85)] * 2 + [(0.08, 0.84, 0.08)] * 2 + [(0.08, 0.10, 0.82)] * 2 + [(0.84, 0.10, 0.06)] * 2
    rows += [(0.10, 0.82, 0.08)] * 2 + [(0.82, 0.12, 0.06)] * 2
    got = _run(rows)
    assert [d["stable_state"] for d in got] == [E] * 6 + [M] * 2 + [S] * 2 + [M] * 2 + [E] * 3 + [S] * 2 + [E]
    assert got[3]["transition_reason"] == "direct_transition_waiting_confirmation:empty_to_static_presence" and got[3]["candidate_count"] == 1
    assert got[4]["candidate_state"] is None
    assert got[6]["movement_origin"] == E and got[8]["movement_origin"] == E and got[9]["movement_origin"] is None
    assert (got[7]["movement_age_windows"], got[10]["movement_origin"]) == (1, S)
    assert got[15]["transition_reason"] == "inferred_entry_movement_not_observed" and got[15]["inferred_transition"]
    assert got[17]["transition_reason"] == "inferred_exit_movement_not_observed"


def test_rules():
    assert [d["stable_state"] for d in _run([(0.1, 0.1, 0.8)] * 3, warmup=2)] == [E, E, M]
    below = _run([(0.3, 0.5, 0.2), (0.0, 1.0, 0.0), (0.3, 0.5, 0.2), (0.0, 1.0, 0.0)])
    assert [d["candidate_count"] for d in below] == [0, 1, 0, 1]  # below the threshold a candidate is forgotten
    blocked = _run([(0.0, 1.0, 0.0)] * 3, blocked=((E, S),))
    assert blocked[-1]["transition_reason"] == "direct_transition_blocked:empty_to_static_presence"
    assert _run([(1, 1, 1)])[0]["raw_state"] == E  # ties go to the first class
    smooth = _run([(1, 0, 0), (0, 0, 1)], weights=[0.75, 0.25])
    assert smooth[1]["smoothed_state"] == E and smooth[1]["probability_movement"] == 0.25
    for bad in ((1, 2), (0, 0, 0), (-1, 1, 1), (float("nan"), 1, 1)):
        with pytest.raises(ValueError):
            machine.step(machine.start(), bad, machine.config())
    with pytest.raises(ValueError):
        machine.config(normal={(E, M): (0, 0.5)})


def test_replay_and_scores(spark):
    rows = evaluation.probabilities(spark, DATA).orderBy("user_id", "ts", "event_id").collect()
    rules, want, last, now = machine.config([0.2, 0.3, 0.5]), {}, None, None
    for r in rows:
        if r["user_id"] != last:
            last, now = r["user_id"], machine.start()
        want[r["event_id"]] = machine.step(now, [r[c] for c in machine.PROBABILITIES], rules)
    got = evaluation.state_machine(spark, DATA).collect()
    assert {r["event_id"]: (r["window_index"], r["stable_state"], r["transition_reason"]) for r in got} == {k: (d["window_index"], d["stable_state"], d["transition_reason"]) for k, d in want.items()}
    score = evaluation.state_machine_score(spark, DATA).agg(F.sum("windows"), F.sum("accepted")).first()
    assert tuple(score) == (len(rows), sum(d["transition_accepted"] for d in want.values()))
    best = machine.tune(evaluation.probabilities(spark, DATA), "user_id", ["ts", "event_id"], "expected", {0: rules, 1: machine.config()}).collect()
    assert {r["candidate_id"] for r in best} == {0, 1} and {r["candidate_id"]: r["accepted"] for r in best}[0] == score[1]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_tuning_counts_as_steps_do(monkeypatch, block):
    rng = np.random.default_rng(block)
    names = np.repeat(np.array(["a", "b", "c", "d", "e"], object), [1, 2, 150, 3, 40])
    p = rng.choice([0.0, 0.1, 0.25, 0.5, 0.55, 1.0], (len(names), 3)) + rng.choice([0, 1e-3], (len(names), 1))
    p[:, 0] += p.sum(axis=1) == 0
    truth = rng.integers(0, 4, len(names))  # 0: none of the classes
    grid = [(w, warm, n, d, q) for w in ([1.0], [0.3, 0.7], [0.2, 0.3, 0.5], [1.0, 0.0]) for warm in (0, 2) for n in (1, 3) for d in (1, 2, 4) for q in (0.0, 0.5, 0.55)]
    candidates = {k: machine.config(w, warm, normal={t: (n, 0.5) for t in machine.NORMAL}, direct={t: (d, q) for t in machine.DIRECT}, blocked=((S, E),) * (k % 5 == 0)) for k, (w, warm, n, d, q) in enumerate(grid)}
    monkeypatch.setattr(machine, "HELD", block * len(candidates))
    tables = machine._Grid(candidates)
    now = tables.start()
    for k in range(0, len(names), tables.block()):
        tables.add(now, names[k : k + block], truth[k : k + block], p[k : k + block])
    want, words = [], [None, *machine.CLASSES]
    for c, rules in candidates.items():
        last, state, sums = None, None, np.zeros(7, int)
        for name, t, own in zip(names, truth, p.tolist(), strict=True):
            if name != last:
                last, state = name, machine.start()
            d = machine.step(state, own, rules)
            stable = d["stable_state"]
            sums += [1, d["raw_state"] == words[t], stable == words[t], stable == E and words[t] != E, stable != E and words[t] == E, d["transition_accepted"], d["inferred_transition"]]
        want.append((c, *sums.tolist()))
    assert tables.sums(now) == want
    with pytest.raises(ValueError):
        tables.add(now, names[:1], truth[:1], np.array([[np.nan, 1, 1]]))


def test_tuning_of_no_rows_and_of_other_labels(spark):
    rows = evaluation.probabilities(spark, DATA)
    none = machine.tune(rows.where("false"), "user_id", ["ts", "event_id"], "expected", {3: machine.config()}).collect()
    assert all(r["windows"] == 0 and r["stable_accuracy"] is None for r in none)
    other = machine.tune(rows.withColumn("expected", F.lit(None).cast("string")), "user_id", ["ts", "event_id"], "expected", {3: machine.config()}).first()
    assert other["raw_accuracy"] == other["stable_accuracy"] == 0 == other["false_presence"] and other["false_empty"] > 0


def test_stream_decides_as_batch_does(spark, tmp_path):
    df = evaluation.probabilities(spark, DATA).withColumn("p", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("ts", "event_id")))
    for k in (1, 2, 3):  # files come one after another, each a micro-batch
        df.where(F.col("p") == k).drop("p").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = spark.readStream.schema(df.drop("p").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    decided = machine.stream(source, "user_id", ["ts", "event_id"], machine.config([0.2, 0.3, 0.5]))
    query = decided.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    columns = ["event_id", "window_index", "stable_state", "transition_reason", "movement_origin"]
    batch = evaluation.state_machine(spark, DATA).select(*columns)
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    assert batch.exceptAll(got).count() == got.exceptAll(batch).count() == 0
