"""Words that polynomial hashes modulo a power of two take for one: their texts keep the ids and the words that they have."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chanspark.llm import common, simhash, substrings, tokenfiles
from test_operators import _fingerprint, _map, _removed


def _thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


A, B = _thue_morse(2048), _thue_morse(2048, "ba")


def test_ids_of_words_alike(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(file)
    texts = {1: f"go {A} {B}", 2: f"go {B}", 3: f"{A[:60]} {B[:60]} {A[:8]} {B[:8]} {A[:9]} {B[:9]}", 4: "a\nb\n c", 5: "\n", 6: "x\ny"}
    got = _map(tokenfiles.summary(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), file, 1))
    for i, text in texts.items():
        ids = own.encode(text, add_special_tokens=False).ids + [0]
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))


def test_ids_when_all_hashes_are_equal(monkeypatch):
    """Even then bytes are compared, and the texts go to the library."""
    monkeypatch.setattr(tokenfiles, "run_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    file = public_tokenizers.path("byte_bpe_50k.json")
    with open(file, encoding="utf-8") as f:
        made = tokenfiles.ByteLevel(f.read())
    monkeypatch.setattr(tokenfiles.ByteLevel, "_others", lambda self, data, led, ends, code, where, known: np.flatnonzero(~common.equal_runs(data, led, ends, np.frombuffer(self.raw, np.uint8), *(np.frombuffer(self.raw_at, np.int64)[known[code] + k] for k in (0, 1)))))
    own = Tokenizer.from_file(file)
    texts = ["one two six ten cat", "abcdefghij klmnopqrst", None, "", "cat"]
    ids, upto = made.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)] == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_alike_stay(spark):
    lead = " ".join(f"w{i}" for i in range(12))
    by_id = {1: f"{lead} {A}", 2: f"{lead} {B}", 3: f"{lead} {A}", 4: f"{lead} {A[:40]}", 5: f"{lead} {B[:40]} more", 6: f"x {lead} {B[:40]}"}
    got = _map(substrings.dedup(spark.createDataFrame(list(by_id.items()), "doc_id long, text string")))
    want = _removed(by_id)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    assert want[2][1] == 0 and want[3][1] == 13 and want[6][1] == 13


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_long_owners_and_blocks(spark, monkeypatch, block):
    """Shards of a few anchors, copies for a few documents and kernels of a few shingles change no result."""
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "SERVED", block)
    monkeypatch.setattr(simhash, "BLOCK", block)
    words = [f"w{(i * i) % 97}" for i in range(300)]
    by_id = {i: " ".join(words[i * 7 : i * 7 + 60] + ["end"] * (i % 3)) for i in range(20)} | {100: None, 101: ""}
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    got = _map(substrings.dedup(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == _removed(by_id)
    assert simhash.fingerprints(pa.array(list(by_id.values()))).tolist() == [_fingerprint(t) for t in by_id.values()]


def test_runs_are_told_apart():
    raw = np.frombuffer((A + B + A).encode(), np.uint8)
    for n in (1, 7, 8, 9, 16, 63, 64, 65, 1024, 2048):
        starts = np.array([0, 2048, 4096])
        h = common.run_hashes(raw, starts, starts + n)
        assert h[0] == h[2] != h[1]
        assert common.equal_runs(raw, starts, starts + n, raw, starts[::-1].copy(), starts[::-1] + n).tolist() == [True] * 3
        assert not common.equal_runs(raw, starts[:1], starts[:1] + n, raw, starts[1:2], starts[1:2] + n).any()
