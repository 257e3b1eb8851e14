"""The pipeline, stage by stage, against what its stages promise and brute-force versions of two of them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chanspark.llm import simhash
from test_operators import DATA, _fingerprint, _lines_left
from test_similar import _near, _shingles


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Name to (input rows, output rows) by doc_id, and the columns of each stage's result."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out, columns = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        rows = {r["doc_id"]: r for r in docs.collect()}
        out[name], columns[name] = (rows, {r["doc_id"]: r for r in after.collect()}), after.columns
        docs = after
    return out, columns


def test_stages_only_take_rows_away(spark, steps):
    out, columns = steps
    documents = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert [columns[n] for n in list(columns)[:-1]] == [documents] * 4
    assert columns["tokens"][: len(documents)] == documents
    for before, after in out.values():
        assert set(after) <= set(before)


def test_unlettered_documents_go_and_others_stay(steps):
    before, after = steps[0]["language_id"]
    for i, r in before.items():
        if not any(map(str.isalpha, r["text"] or "")):
            assert i not in after
    assert len(after) >= 0.95 * len(before)


def test_lines(steps):
    from hashlib import sha256

    before, after = steps[0]["line_dedup"]
    want = _lines_left([(i, r["text"], r["source"]) for i, r in before.items()], 0.05, 5)
    assert {i: None if r["text"] is None else sha256(r["text"].encode()).hexdigest() for i, r in after.items()} == {i: w[2] for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if want[i][1])


def test_one_of_each_group_stays(steps):
    """Groups are of texts that SimHash links or whose sets of shingles have a similarity of 0.8 or more."""
    before, after = steps[0]["near_dedup"]
    prints = {i: _fingerprint(r["text"], corpus_pipeline.SHINGLE_WORDS) for i, r in before.items()}
    sets = {i: _shingles(r["text"]) for i, r in before.items()}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS or _near(sets[a], sets[b])
    kept = sorted(after)
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    for i in set(before) - set(after):  # what went has a chain to a smaller document
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            new = [b for b in before if b not in seen and near(a, b)]
            seen.update(new)
            todo += new
        assert min(seen) in after and len(seen & set(after)) == 1


def test_benchmark_passages_go(spark, steps):
    _, after = steps[0]["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(t in r["text"] for r in after.values() for t in items if t)


def test_tokens_and_run(spark, steps):
    _, after = steps[0]["tokens"]
    assert all(r["n_pieces"] == len(r["piece_ids"]) and r["round_trip"] is not None for r in after.values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == set(after)
    assert corpus_pipeline.run(spark, DATA).agg(F.sum("n_pieces")).first()[0] == sum(r["n_pieces"] for r in after.values())
