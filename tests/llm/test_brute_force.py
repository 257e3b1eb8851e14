"""Code lengths, chunks and the Viterbi branch against slow versions written from their definitions."""

import math
import struct
from base64 import b64decode
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from chanspark.llm import chunks, pieces, ppm, queries
from test_operators import DATA, TEXTS, _map


def _symbols(text, model):
    out = []
    for b in (text or "").lower().encode():
        kept = b if ord("a") <= b <= ord("z") or b >= 0x80 else 0
        if kept or not out or out[-1]:
            out.append(kept)
    return [int(model.symbol[b]) for b in out]


def _slow_bits(text, counts, model):
    """Method C with exclusion: from the longest context down, until one has seen the symbol."""
    own, total = [0] * ppm.ORDER + _symbols(text, model), 0.0
    for at in range(ppm.ORDER, len(own)):
        excluded = set()
        for order in range(ppm.ORDER, -1, -1):
            seen = {s: n for s, n in counts[tuple(own[at - order : at])].items() if s not in excluded}
            if not seen:
                continue
            mass = sum(seen.values()) + len(seen)
            if own[at] in seen:
                total -= math.log2(seen[own[at]] / mass)
                break
            total -= math.log2(len(seen) / mass)
            excluded |= set(seen)
        else:
            total += math.log2(max(1, ppm.SYMBOLS - len(excluded)))
    return total


def test_code_lengths(spark):
    table = queries.documents(spark, DATA).where("lang IS NOT NULL AND text IS NOT NULL")
    model = ppm.fit(table, 10**9)
    counts = {x: defaultdict(Counter) for x in model.languages}
    for r in table.collect():
        own = [0] * ppm.ORDER + _symbols(r["text"], model)
        for at in range(ppm.ORDER, len(own)):
            for order in range(ppm.ORDER + 1):
                counts[r["lang"]][tuple(own[at - order : at])][own[at]] += 1
    texts = ["", None, "the rest of the", "Größe über alles", "日本語 text", "xqzj vvv", "a", *[t for t in TEXTS if t and len(t) < 300][:12]]
    bits, n = model.lengths(pa.array(texts))
    for i, text in enumerate(texts):
        assert n[i] == len(_symbols(text, model))
        for k, name in enumerate(model.languages):
            assert bits[i, k] == pytest.approx(_slow_bits(text, counts[name], model), rel=1e-4, abs=1e-3)
    found = {r["text"]: r for r in ppm.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            assert found[text]["lang_pred"] == model.languages[bits[i].argmin()]


def test_accuracy_of_each_language(spark):
    table = queries.documents(spark, DATA)
    judged = ppm.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    by = judged.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert len(by) > 1 and all(r["right"] >= 0.9 for r in by)


def test_many_languages_and_scripts(spark):
    """More languages than a fixed number could hold, each with letters of its own, and bytes of all scripts."""
    rows = []
    for k in range(80):
        letters = [chr(0x4E00 + 37 * k + j) if k % 3 == 0 else chr(0x400 + (5 * k + j) % 200) if k % 3 == 1 else chr(97 + (7 * j * (k + 1) + k) % 26) for j in range(7)]
        rows += [(100 * k + i, " ".join("".join(letters[(i * j + m) % 7] for m in range(4)) for j in range(1, 12)), f"l{k:02d}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm.fit(docs)
    assert len(model.languages) == 80
    found = ppm.predict(docs, model)
    assert found.where("lang <> lang_pred").count() <= 0.05 * len(rows)


def test_model_beyond_its_bound(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError, match="MODEL_BYTES"):
        ppm.fit(queries.documents(spark, DATA))


def _slow_chunks(raw):
    out, at = set(), 0
    while at < len(raw):
        stop = len(raw)
        for i in range(at + chunks.LEAST - 1, len(raw)):
            h = sum(int(chunks.GEAR[raw[i - j]]) << j for j in range(chunks.LEAST)) & 0xFFFFFFFF
            n = i - at + 1
            bits = chunks.STRICT_BITS if n <= chunks.NORMAL else chunks.EASY_BITS
            if h >> (32 - bits) == 0 or n == chunks.MOST:
                stop = i + 1
                break
        out.add((xxhash.xxh3_64_intdigest(raw[at:stop]) >> 16, stop - at))
        at = stop
    return out


def _shown(text):
    raw = b64decode(text)
    return {(x >> 16, x & 0xFFFF) for x in struct.unpack(f">{len(raw) // 8}Q", raw)}


def _slow_share(a, b):
    return sum(n for _, n in a & b) / sum(n for _, n in a) if a else float(not b)


def test_chunks_and_likeness(spark):
    by_id = {i: t for i, t in enumerate(TEXTS) if t is None or len(t) < 3000} | {100: "x" * 1000, 101: "a longer text without any change " * 30}
    got = _map(chunks.edits(spark.createDataFrame(list(by_id.items()), "doc_id long, text string")))
    ids = sorted(by_id, reverse=True)
    slow = {i: _slow_chunks((t or "").encode()) for i, t in by_id.items()}
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, follows = by_id[i] or "", by_id[after] or ""
        edited = _slow_chunks((text[: len(text) - len(text) // 2] + follows[: len(text) // 2]).encode())
        assert _shown(got[i]["fingerprint"]) == slow[i] and _shown(got[i]["edited_fingerprint"]) == edited
        assert got[i]["near_edited"] == pytest.approx(_slow_share(slow[i], edited)) and got[i]["near_next"] == pytest.approx(_slow_share(slow[i], slow[after]))


def _field(number, kind, value):
    if kind == 2:
        return bytes([number << 3 | 2]) + _varint(len(value)) + value
    return bytes([number << 3 | kind]) + (struct.pack("<f", value) if kind == 5 else _varint(value))


def _varint(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def _unigram_model(kind=1):
    """A vocabulary with scores written down by hand; nothing is trained."""
    scored = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    words = "▁ ▁the ▁a th he er in ing ▁in r i v e s t o n g ▁r iver ▁river ▁st one ▁stone ▁l ight l h b c d f w m u y p light ▁light ght ▁lightning lightn or ▁mor ning ▁morning".split(" ")
    scored += [(w, -1.0 - 0.37 * (k * 7 % 23) - 0.5 / len(w), 1) for k, w in enumerate(words)]
    body = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, s) + _field(3, 0, t)) for p, s, t in scored)
    return body + _field(2, 2, _field(3, 0, kind)) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, 0) + _field(5, 0, 1))


def test_viterbi_over_shared_prefixes(spark, tmp_path):
    file = tmp_path / "unigram.model"
    file.write_bytes(_unigram_model())
    own = sentencepiece.SentencePieceProcessor(model_file=str(file))
    texts = ["the river in the morning", "lightning light lights", "stone", "", None, "a  the", "ing lightning\nmorning", "zzz the", "therein" * 40, "über light"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _map(pieces.encode(rows, str(file)))
    score = lambda ids: sum(own.get_score(i) for i in ids)
    for i, text in enumerate(texts):
        want = own.encode(text or "")
        assert own.decode(got[i]["piece_ids"]) == own.decode(want) or "ü" in (text or "") or "z" in (text or "")
        assert got[i]["piece_ids"] == want or score(got[i]["piece_ids"]) == pytest.approx(score(want), abs=1e-4)


@pytest.mark.parametrize("kind", [1, 2])
def test_runs_of_unknown_characters(spark, tmp_path, kind):
    """A vocabulary without bytes gives one unknown id for each run of a text, within words and over them, as the library does."""
    file = tmp_path / "small.model"
    file.write_bytes(_unigram_model(kind))
    own = sentencepiece.SentencePieceProcessor(model_file=str(file))
    texts = ["a 12345 b", "the ЖЖЖ river", "Ж", "ЖЖ", "ЖaЖЖ", "", None, "ЖЖЖ ЖЖЖ", "river ЖЖ", "12 stone 3456 ЖЖ a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = _map(pieces.encode(rows, str(file)))
    assert [got[i]["piece_ids"] for i in range(len(texts))] == [own.encode(t or "") for t in texts]
