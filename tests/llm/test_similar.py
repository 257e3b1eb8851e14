"""Near copies by similarity against brute force over all pairs of texts."""

import random
import re

import pytest

from chanspark.llm import similar, simhash
from test_operators import WORDS, _fingerprint


def _shingles(text, words=5):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = [w for w in re.split("[ \t\n\v\f\r]+", own) if w]
    return {" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def _near(a, b):
    return a == b or bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def _rows(seed=3):
    draw = random.Random(seed)
    word = lambda: draw.choice(WORDS[:13]).lower() + str(draw.randrange(40))
    passage, rows = " ".join(word() for _ in range(30)), ["", None, "one", "one", "one two three four five six seven eight", "one two three four five six seven eight nine"]
    for n in [9, 25, 60, 120, 400] * 7:
        own = [word() for _ in range(n)]
        rows.append(" ".join(own))
        for changes in (1, 2, 3, 6):
            own = list(own)
            for k in draw.sample(range(n), min(changes * n // 60 + 1, n)):
                own[k] = word()
            rows.append(" ".join(own))  # a chain: each is near the one before
        rows += [passage + " " + " ".join(word() for _ in range(n)) for _ in range(4)]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("few", [0, 1000])
def test_groups_of_similar_texts(spark, few, monkeypatch):
    monkeypatch.setattr(similar, "BROADCAST_IDS", few)
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets, prints = {i: _shingles(t) for i, t in rows}, {i: _fingerprint(t, 5) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    loose = 0
    for a, _ in rows:
        for b in range(a):
            bits = (prints[a] ^ prints[b]).bit_count()
            loose += _near(sets[a], sets[b]) and bits > simhash.MAX_BITS
            if bits <= simhash.MAX_BITS or _near(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert loose > 10  # what fingerprints alone would miss
    assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == sorted({find(i) for i, _ in rows})
    sketched = similar._sketched(docs, 5, 0.8)
    want = {frozenset((frozenset(sets[a]), frozenset(sets[b]))) for a, _ in rows for b in range(a) if sets[a] != sets[b] and _near(sets[a], sets[b])}
    assert similar.links(docs, sketched).count() == len(want)
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_rounds_grow_slowly(spark, monkeypatch):
    """A text that meets many others just below the similarity is held against them all in few rounds."""
    monkeypatch.setattr(similar, "AT_ONCE", 0)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [" ".join(base)]
    for k in range(120):  # each shares its first half with the base, so all meet in prefixes, and none is similar
        rows.append(" ".join(base[:50] + [f"v{k}x{i}" for i in range(50)]))
    for k in range(10):
        own = list(base)
        own[draw.randrange(100)] = f"u{k}"
        rows.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    each = similar.cut(similar._sketched(docs, 5, 0.3))
    pairs = each.where("prefix IS NOT NULL").select("digest").distinct()
    every = similar.cut(pairs.toDF("a").join(pairs.toDF("b"), similar.F.col("a") < similar.F.col("b")))
    calls, verified = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda *a: calls.append(1) or verified(*a))
    monkeypatch.setattr(similar, "_close", lambda p, *_: p.withColumn("unlike", similar.F.lit(0)))
    roots = similar._settled(docs, each, every, similar.components(every.limit(0)), 5, 0.8)
    sets = {r["doc_id"]: _shingles(r["text"]) for r in docs.collect()}
    alike = [a for a in sets if any(a != b and _near(sets[a], sets[b]) for b in sets)]
    assert roots.count() == len(alike) and len(calls) <= 8 < every.count() / 100


def test_texts_that_meet_often_are_met_seldom(spark, monkeypatch):
    """Unlike texts that share many shingles of their prefixes make few rows more than pairs, and no pair is lost."""
    monkeypatch.setattr(similar, "OFTEN", 1000)  # as if the sample showed none of them
    draw = random.Random(7)
    base, rows = [f"w{i}" for i in range(500)], []
    for k in range(40):  # alike in stretches, with a word of its own every 40 words
        at = draw.randrange(40)
        rows.append(" ".join(f"v{k}x{i}" if i % 40 == at else w for i, w in enumerate(base)))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    each = similar.cut(similar._sketched(docs, 5, 0.8))
    entries = similar.cut(similar._entries(similar._neighbours(similar._prefixes(each))))
    digests = sorted(r["digest"] for r in each.select("digest").distinct().collect())
    root = {d: digests[i - i % 2] for i, d in enumerate(digests)}  # groups of two
    roots = spark.createDataFrame(list(root.items()), "node long, root long")
    by_key = {}
    for r in entries.collect():
        by_key.setdefault(r["key"], set()).add((r["digest"], r["n"], r["at"]))
    enough = lambda x, y: 9 * min(x[1] - x[2], y[1] - y[2]) >= 4 * (x[1] + y[1])
    met = [(x[0], y[0]) for found in by_key.values() for x in found for y in found if x < y and root[x[0]] != root[y[0]] and enough(x, y)]
    counts, allowed = [], similar._allowed
    monkeypatch.setattr(similar, "_allowed", lambda m, t: counts.append(m.count()) or allowed(m, t))
    assert {tuple(r) for r in similar._across(entries, roots, 0.8).collect()} == set(met)
    assert len(met) > 5 * len(set(met)) > 1000 and counts[0] < 2.5 * len(set(met))


def test_pipeline_stage_keeps_one_of_similar_texts(spark):
    """Over the given documents no two that stay are similar, and what goes has a chain to the one that stays."""
    import corpus_pipeline

    from test_operators import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets, prints = {i: _shingles(t) for i, t in texts.items()}, {i: _fingerprint(t, corpus_pipeline.SHINGLE_WORDS) for i, t in texts.items()}
    near = lambda a, b: _near(sets[a], sets[b]) or (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS
    left, want = set(texts), set()
    while left:
        todo = [min(left)]
        want.add(todo[0])
        left.discard(todo[0])
        while todo:
            a = todo.pop()
            new = {b for b in left if near(a, b)}
            left -= new
            todo += new
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()} == want
