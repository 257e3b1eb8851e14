"""SentencePiece encoding and decoding with shared prefixes.

Texts are split into marked words (the mark U+2581 stands for the space before a word). The distinct words of a run of
documents are sorted, which lays out their trie: going from one word to the next, only what is past their common prefix
is new. The forward scores of the prefix stay on a stack, so each trie node is scored once, depth first.

What is kept for a prefix depends on the type of the model:

* unigram: the best sum of piece scores that ends there, and the last piece (Viterbi);
* BPE: the last piece. In BPE every prefix has one encoding, and a piece can follow the encoding of a shorter prefix
  just if merging the two pieces alone leaves both as they are. Scores then decide merges, so the best sum would give
  other pieces than the model's own.

Either way the result is that of the sentencepiece library. Encoding is local to each run of documents; nothing is
shuffled, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from chanspark.llm.common import buffer, slices

MARK = "▁"
#: Words whose pieces a worker gathers before it forgets those that it has not met since it last did.
REMEMBERED = 100_000
RUN_BYTES = 2 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialized protocol buffer."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """A SentencePiece model, of type unigram or BPE, as its vocabulary file describes it."""

    def __init__(self, model: bytes):
        self.model = model
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = {2: {}, 3: {}}
        for number, value in _fields(model):
            if number in spec:
                spec[number] = dict(_fields(value))
        kind = spec[2].get(3, 1)
        if kind not in (1, 2):
            raise ValueError("only models of type unigram and BPE have scores of pieces")
        self.unigram = kind == 1
        self.plain = not spec[3].get(2) and spec[3].get(4, 1) == 0 and spec[3].get(3, 1) == 1
        n = self.own.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        shown: list[bytes] = []
        for i in range(n):
            piece = self.own.id_to_piece(i)
            if self.own.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                shown.append(bytes([int(piece[3:5], 16)]))
            elif self.own.is_control(i) or self.own.is_unknown(i) or self.own.is_unused(i):
                shown.append(b" \xe2\x81\x87 " if self.own.is_unknown(i) else b"")
            else:
                self.ids[piece], self.scores[piece] = i, self.own.get_score(i)
                shown.append(piece.replace(MARK, " ").encode())
        self.unknown = (min(self.scores.values()) if self.scores else 0.0) - 10.0
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        self.sizes = {k: sorted(v, reverse=True) for k, v in ends.items()}  # of the pieces with these last two characters
        self.breaks = not any("\n" in p and len(p) > 1 for p in self.ids) and not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: again and again the adjacent pair whose piece has the highest score, the leftmost first."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (both := parts[i] + parts[j]) in self.scores:
                heapq.heappush(queue, (-self.scores[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if not parts[i] or not parts[j] or parts[i] + parts[j] != both or after[i] != j:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def _may_end(self, piece: str, before: str) -> bool:
        """Whether the encoding that ends with piece before (none: empty) can go on with this piece of the vocabulary."""
        if len(self.pairs) > 2 * REMEMBERED:
            self.pairs.clear()
        found = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of the ascending, distinct words."""
        ids, scores, sizes, pairs, unigram = self.ids, self.scores, self.sizes, self.pairs, self.unigram
        last: list[str] = [""]  # by length of prefix: the last piece of its encoding
        best: list[float] = [0.0]
        past, none = "", ()
        for word in words:
            common = 0
            for x, y in zip(past, word, strict=False):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], best[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                piece = word[end - 1]
                if unigram:
                    score = best[end - 1] + scores.get(piece, self.unknown)
                    for size in sizes.get(word[max(0, end - 2) : end], none):
                        if size <= end and (own := scores.get(one := word[end - size : end])) is not None and best[end - size] + own > score:
                            piece, score = one, best[end - size] + own
                    best.append(score)
                else:
                    for size in sizes.get(word[end - 2 : end], none) if end > 1 else none:
                        if size <= end and (one := word[end - size : end]) in ids:
                            fits = pairs.get((before := last[end - size], one))
                            if fits or fits is None and self._may_end(one, before):
                                piece = one
                                break
                    best.append(0.0)
                last.append(piece)
            past = word
            out, end = [], len(word)
            while end:
                piece = last[end]
                end -= len(piece)
                own = ids.get(piece)
                if own is None:
                    raw = [self.bytes.get(b) for b in piece.encode()]
                    out.extend(raw[::-1] if None not in raw else [self.own.unk_id()])
                else:
                    out.append(own)
            out.reverse()
            yield out

    def words(self, text: str) -> list[str]:
        """The marked words of a text, in order."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK) if self.plain else self.own.normalize(text)
        if not self.breaks:
            return [marked]
        out, start = [], 0
        for part in marked.replace("\n", " \n ").split(" "):
            start = 0
            for at in range(1, len(part)):
                if part[at] == MARK and part[at - 1] != MARK:
                    out.append(part[start:at])
                    start = at
            if part:
                out.append(part[start:])
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, and where each text begins (and the last ends)."""
        each, counts = [], []
        for text in texts:
            if self.plain and self.breaks and "  " not in text and text and text[-1] != " " and text[0] != " ":
                found = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ") if MARK not in text else self.words(text)
            else:
                found = self.words(text)
            each.extend(found)
            counts.append(len(found))
        if not each:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        code, distinct = pd.factorize(np.array(each, dtype=object))
        del each
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = []
        for word in distinct:
            if word not in known:
                if word in older:
                    known[word] = older[word]
                else:
                    fresh.append(word)
        fresh.sort()
        known.update(zip(fresh, self.encode_sorted(fresh), strict=True))
        own = [known[w] for w in distinct]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        flat, at = np.fromiter(chain.from_iterable(own), np.int32, sizes.sum()), np.concatenate([[0], np.cumsum(sizes)])
        ids, upto = ragged(flat, at, code)
        return self._joined(ids, upto[np.concatenate([[0], np.cumsum(counts)])])

    def _joined(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with one unknown id for each run of unknown characters of a text, as the library has it."""
        if len(self.bytes) == 256:
            return ids, offsets
        unknown = ids == self.own.unk_id()
        again = unknown.copy()
        again[1:] &= unknown[:-1]
        again[offsets[:-1][offsets[:-1] < len(ids)]] = False
        return ids[~again], offsets - np.concatenate([[0], np.cumsum(again)])[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all texts, and where each begins; the space that stands for the first mark is left out."""
        data, upto = ragged(self.shown, self.shown_at, ids)
        ends = upto[offsets]
        starts = ends[:-1][ends[:-1] < ends[1:]]
        dropped = starts[data[starts] == 0x20]
        keep = np.ones(len(data), bool)
        keep[dropped] = False
        return data[keep], ends - np.searchsorted(dropped, ends)


def ragged(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[at[r] : at[r + 1]] for each of rows, after one another, and where each begins (and the last ends)."""
    sizes = (at[1:] - at[:-1])[rows]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(upto[-1]) + np.repeat(at[rows] - upto[:-1], sizes)], upto


_loaded: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """The worker's own copy, made once."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Pieces(model)
    return _loaded[model]


def encode(docs: DataFrame, model_file: str, check: bool = False) -> DataFrame:
    """docs with column piece_ids, array<int>; a null or empty text has none. A column of that name is replaced.

    With check, the ids are decoded at once, in the same worker, and column round_trip tells whether that gives the
    bytes of the text (of null: none). model_file is read on the driver and sent to the executors (a vocabulary, at
    most some MB); any row count, order and further columns are kept as they are.
    """
    added = ["piece_ids", *["round_trip"] * check]
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["piece_ids array<int>", *["round_trip boolean"] * check])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(model.value)
        for part in slices(batches, at, RUN_BYTES):
            ids, upto = own.encode([x or "" for x in part.column(at).to_pylist()])
            found = [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))]
            if check:
                (decoded, ends), (source, starts) = own.decode(ids, upto), buffer(part.column(at))
                left, right = decoded.tobytes(), source.tobytes()
                found.append(pa.array([left[ends[i] : ends[i + 1]] == right[starts[i] : starts[i + 1]] for i in range(part.num_rows)]))
            yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*part.schema.names, *added])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """encoded (with column piece_ids) with column decoded, string; null or no ids give the empty text."""
    with open(model_file, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())
    encoded = encoded.drop(*[c for c in encoded.columns if c.lower() == "decoded"])
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + ["decoded string"])
    at = encoded.columns.index("piece_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(model.value)
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                lists = part.column(at)
                sizes = [0 if x is None else x for x in lists.value_lengths().to_pylist()]
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                data, upto = own.decode(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                raw = data.tobytes()
                texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def summary(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip): encodes every whole text and decodes the ids again.

    ids_crc32 is unsigned, over the ids as little-endian unsigned 32-bit integers; decoded_sha256 is lowercase hex over
    the decoded UTF-8 bytes; round_trip tells whether those are the bytes of the text (of null: none).
    """
    encoded = encode(docs.select("doc_id", "text"), model_file)
    kind = dict(docs.dtypes)["doc_id"]
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(model.value)
        for batch in batches:
            for row in range(0, batch.num_rows, 250):
                part = batch.slice(row, 250)
                lists = part.column(2)
                upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                data, ends = own.decode(ids, upto)
                raw, (text, starts) = data.tobytes(), buffer(part.column(1))
                source, n = text.tobytes(), part.num_rows
                packed = ids.astype("<u4")
                crc = [zlib.crc32(packed[upto[i] : upto[i + 1]]) for i in range(n)]
                digest = [sha256(raw[ends[i] : ends[i + 1]]).hexdigest() for i in range(n)]
                same = [raw[ends[i] : ends[i + 1]] == source[starts[i] : starts[i + 1]] for i in range(n)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(upto)), pa.array(crc, pa.int64()), pa.array(digest), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"])

    return encoded.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
