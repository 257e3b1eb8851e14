"""The filter audit against counting each document under each order."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chanspark.llm import audit

ROWS = [
    (1, "en", " ".join(f"w{i}" for i in range(120))), (2, "en", " ".join(f"w{i}" for i in range(120))), (2, "fr", " ".join(f"w{i}" for i in range(120))), (3, "fr", "A B C"), (4, None, None), (5, None, ""),
    (None, "fr", "A B C"), (None, "", "A B C"), (6, "de", "x # y"), (7, "de", "same same " * 80), (8, "de", "é" * 9 + "A"), (9, "de", "é" * 8 + "AB"), (10, "de", "word " * 60 + " ".join(map(str, range(60)))), (11, "en", "a\x0bb\x0cc d"), (12, "en", "SHOUT | " * 200),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (6, None, None), (None, 1, 1), (99, 1, 1)]


def fails(rows):
    out = []
    for doc_id, lang, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = [t for d, _, t in rows if (t or "") == text and (d is None) < (doc_id is None) or (t or "") == text and (d is None) and doc_id is not None or (t or "") == text and d is not None and doc_id is not None and d < doc_id]
        earlier = [] if doc_id is None else earlier
        out.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": bool(earlier),
        })
    return out


def slow(rows, labels):
    judged = fails(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, parts = {}, {lang or "" for _, lang, _ in rows}
    for part in parts:
        own = [(r[0], f) for r, f in zip(rows, judged, strict=True) if (r[1] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                before = order[: step - 1]
                gone = [d for d, f in own if f[c] and not any(f[b] for b in before)]
                total[c] += len(gone)
                out[part, "".join(order), step] = [
                    sum(not any(f[b] for b in order[:step]) for _, f in own), len(gone), sum(f[c] and any(f[b] for b in before) for _, f in own), sum(f[c] and sum(f.values()) == 1 for _, f in own),
                    sum(d in good for d in gone), sum(d in toxic for d in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def frames(spark, rows=ROWS, labels=LABELS):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("part", F.lit("x")).withColumn("fails", F.lit(1)).withColumn("key", F.lit("k"))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(7))


def test_audit(spark):
    found = audit.audit(*frames(spark))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == slow(ROWS, LABELS)


def test_no_rows(spark):
    assert audit.audit(*frames(spark, [], [])).count() == 0
    assert audit.audit(*frames(spark, ROWS, [])).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_many_parts(spark, monkeypatch):
    """More parts than a task holds, and batches whose parts fill several words."""
    monkeypatch.setattr(audit, "PARTS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, f"l{int(rng.integers(0, 9))}" if i % 3 else "big", " ".join(rng.choice(["a", "B", "c#", "d"], int(rng.integers(1, 6))))) for i in range(700)]
    assert sorted(map(tuple, audit.audit(*frames(spark, rows, [(i, i % 2, int(i % 5 == 0)) for i in range(700)])).collect())) == slow(rows, [(i, i % 2, int(i % 5 == 0)) for i in range(700)])


@pytest.mark.parametrize("clash", [False, True])
def test_distinct_words(monkeypatch, clash):
    if clash:
        monkeypatch.setattr(audit, "run_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = [b"a b a c", b"", b"word " * 30, b"long" * 40 + b" " + b"long" * 40 + b"x"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, firsts = audit.word_bounds(data, offsets)
    assert audit._distinct(data, starts, ends, firsts).tolist() == [len(set(t.split())) for t in texts]


def test_other_filters(spark):
    """The index and the orders for another number of filters."""
    rows = spark.createDataFrame([("p", 0, True, False), ("p", 1, False, True), ("p", 3, True, True), ("q", 2, False, False)], "part string, fails int, good boolean, toxic boolean")
    found = {tuple(r)[:3]: tuple(r)[3:] for r in audit.orders(audit.subsets(rows, 2), "XY").collect()}
    assert len(found) == 8
    assert found["p", "XY", 1] == (1, 2, 0, 1, 1, 2, 3) and found["p", "XY", 2] == (1, 0, 1, 0, 0, 0, 1)
    assert found["q", "YX", 1] == (0, 1, 0, 1, 0, 0, 2)
