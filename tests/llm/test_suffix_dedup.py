"""Suffix arrays against sorting all suffixes, and the dedup over them against counting all windows."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from chanspark.llm import suffix_dedup, suffixes


def slow_array(text):
    return sorted(range(len(text)), key=lambda i: bytes(text[i:]))


@pytest.mark.parametrize("seed", range(60))
def test_arrays(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    text = rng.integers(1, int(rng.integers(2, 7)), n).astype(np.uint8)
    if seed % 3 == 0 and n > 20:
        text[: n // 2] = text[n // 2 : n // 2 * 2]
    text = np.append(text, 0).astype(np.uint8)
    order = suffixes.suffix_array(text)
    assert order.tolist() == slow_array(text)
    shared = suffixes.common_prefixes(text, order)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        k = 0
        while text[a + k] == text[b + k]:
            k += 1
        assert shared[b] == k


@pytest.mark.parametrize("text", [np.full(30000, 7), np.tile([5, 5, 5, 9, 2], 6000), np.repeat(np.arange(2, 200), 100), np.repeat(np.arange(200, 2, -1), 100)])
def test_arrays_of_runs(text):
    text = np.append(text, 0).astype(np.uint8)
    order = suffixes.suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    raw = text.tobytes()
    assert all(raw[a:] < raw[b:] for a, b in zip(order[:-1:97].tolist(), order[1::97].tolist(), strict=True))


def test_repeated_strings():
    text = np.append(np.frombuffer(b"abcabdXabc", np.uint8), 0).astype(np.uint8)
    assert np.flatnonzero(suffixes.repeated(text, 3)).tolist() == [0, 7]
    assert np.flatnonzero(suffixes.repeated(text, 2)).tolist() == [0, 1, 3, 7, 8]


def brute(rows, window):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + window] for _, b in texts for i in range(len(b) - window + 1))
    out = []
    for doc_id, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((doc_id, len(b), int(gone.sum()), int(np.count_nonzero(gone[:-1] & ~gone[1:])), sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_with_repeats(seed):
    rng = np.random.default_rng(seed)
    base, rows = "".join(rng.choice(list("abcdeé 漢"), 600)), []
    for i in range(60):
        text = "".join(rng.choice(list("abcdefgh é"), int(rng.integers(0, 200))))
        if rng.random() < 0.6:
            at = int(rng.integers(0, 500))
            text = text[:50] + base[at : at + int(rng.integers(5, 100))] + text[50:]
        if rng.random() < 0.4:  # one passage with many surroundings
            text += base[100:125] + "".join(rng.choice(list("xyz"), 3))
        rows.append((i if rng.random() < 0.9 else None, text))
    return [*rows, (100, rows[3][1]), (100, rows[3][1]), (101, None), (None, None), (102, ""), (3, rows[3][1]), (103, "a" * 150), (104, "ab" * 60), (105, "short"), (106, "short")]


@pytest.mark.parametrize(("seed", "shard"), [(1, suffix_dedup.SHARD), (2, 300), (3, 60)])
def test_dedup(spark, seed, shard):
    """One shard for all, several, and shards that common passages overflow, so that their regions are halved."""
    rows = rows_with_repeats(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n_bytes int")
    found = sorted(map(tuple, suffix_dedup.dedup(docs, window=20, anchor=8, shard=shard).collect()), key=repr)
    assert found == brute(rows, 20)
    assert sum(r[2] for r in found) > 1000


def test_one_place_for_the_anchor(spark):
    rows = rows_with_repeats(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.dedup(docs, window=8, anchor=200, shard=40, with_bytes=True).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute(rows, 8)
    assert all(sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)


def test_no_rows(spark):
    found = suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and found.count() == 0


def test_production_window_over_blocks(spark, monkeypatch):
    """Texts that are looked at in several blocks, with the window of the registered query."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("etaoin shrdlu"), n))
    long, shared = text(20000), text(401)
    rows = [(1, long), (2, text(500) + long[7000:9500] + text(300)), (3, text(100) + shared), (4, shared + text(50)), (5, shared[:399] + "!"), (6, long[:399])]
    for part in (rows, rows[:3]):
        docs = spark.createDataFrame(part, "doc_id long, text string")
        assert sorted(map(tuple, suffix_dedup.dedup(docs).collect()), key=repr) == brute(part, 400)


def test_regions_over_blocks():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    for block in (suffix_dedup.BLOCK, 1000):
        suffix_dedup.BLOCK, before = block, suffix_dedup.BLOCK
        try:
            parts = list(suffix_dedup._cut_regions(data, np.array([0, 9000]), 50, 16))
        finally:
            suffix_dedup.BLOCK = before
        windows = np.concatenate([np.arange(f, f + n) for p in parts for f, n in zip(p[1].tolist(), p[2].tolist(), strict=True)])
        assert windows.tolist() == list(range(9000 - 49))
        assert all((p[3] >= p[1]).all() and (p[3] + 16 <= p[1] + p[2] + 49).all() for p in parts)
