"""Substring dedup by suffix automata of reference shards.

A word goes if a window of 13 consecutive words covers it that also starts in a document with a smaller doc_id.

1. Each window has an anchor, the least hash of its runs of 6 words, so equal windows have equal anchors. Anchors are
   counted over all documents; those of two different texts or more are shared, and the smallest doc_id is their owner.
2. Copies of a whole text follow from the text's digest alone. Of the other documents, the windows with shared anchors
   are put together to passages, by owner: the owner's own passages are its reference shard.
3. Each reference shard becomes a suffix automaton of words, in every task that has documents for it: an owner with
   much to be compared is given to several tasks, and a very long owner is cut into blocks by its anchors. The
   documents' passages are streamed through it for matching statistics; where the match is 13 words or longer, the
   window is in the owner's text.
4. A window that its owner does not have is in no smaller document but those that miss it there too, so the rest is
   settled among such windows alone, by the smallest doc_id of equal ones.

The automata hold words as 64-bit hashes, so two windows are taken for one only if they are equal but for words that
share a hash, at the same places: a chance of 2^-64 for each pair of windows that are that close. Windows of step 4 are
told apart by 128 bits. The automata go to the tasks with documents for them, and not to all tasks: with all of a
growing corpus as reference, all documents against all shards would be quadratic.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chanspark.llm.common import WHITE, buffer, cut, mix, partitions, run_hashes, slices, word_bounds

WINDOW = 13
#: Words of the runs whose least hash is a window's anchor.
ANCHOR = 6
#: Anchors met in documents that one copy of a reference shard is to serve, or COPIES times its own anchors, so that copies are little of the work.
SERVED, COPIES = 4000, 4
#: Anchors of a reference shard: an owner with more is cut into blocks.
BLOCK = 8192
NULL_ID = -(1 << 63)


class Automaton:
    """The suffix automaton of a reference shard: states with transitions, suffix links and lengths of longest words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.last = [-1], [0], 0

    def add(self, words: list[int]) -> None:
        """One passage more; no match goes over its beginning."""
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for c in words:
            p = last
            q = nxt[p].get(c)
            if q is not None and size[q] == size[p] + 1:  # passages that begin alike share states
                last = q
                continue
            cur = len(size)
            clone_only = q is not None
            if not clone_only:
                nxt.append({})
                size.append(size[p] + 1)
                link.append(0)
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p == -1:
                    last = cur
                    continue
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            clone = len(size)
            nxt.append(dict(nxt[q]))
            size.append(size[p] + 1)
            link.append(link[q])
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if clone_only:
                last = clone
            else:
                link[cur] = clone
                last = cur

    def matches(self, words: list[int]) -> list[int]:
        """For each word the length of the longest run that ends with it and is in the shard."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for c in words:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = nxt[state].get(c)
            if to is not None:
                state = to
                length += 1
            out.append(length)
        return out


def _hashed(column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, number of the first word of each text, and of all windows the first word and the anchor."""
    data, offsets = buffer(column)
    starts, ends, firsts = word_bounds(data, offsets)
    words = run_hashes(data, starts, ends)
    count = len(words)
    if count < window:
        return words, firsts, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = min(ANCHOR, window)
    runs = np.zeros(count - short + 1, np.uint64)
    for k in range(short):
        runs = runs * np.uint64(0x9FB21C651E98DF25) + words[k : k + len(runs)]
    least, reach, goal = mix(runs), 1, window - short + 1
    while reach < goal:  # the minimum over `reach` runs, doubled while it fits
        step = min(reach, goal - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    inside = np.ones(len(least), bool)
    for k in range(1, window):
        ends_in = firsts[1:-1] - k  # windows over the end of a text
        inside[ends_in[(ends_in >= 0) & (ends_in < len(inside))]] = False
    first = np.flatnonzero(inside)
    return words, firsts, first, least[first]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _window_hashes(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of word hashes that begins at one of first, in two signed longs."""
    halves = []
    for seed in (1, 2):
        h = np.full(len(first), seed, np.uint64)
        for k in range(window):
            h = mix(h + words[first + k])
        halves.append(h.view(np.int64))
    return halves[0], halves[1]


def _digests(column: pa.Array) -> np.ndarray:
    data, offsets = buffer(column)
    raw = data.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _anchors(texts: DataFrame, window: int, digests: bool) -> DataFrame:
    """(anchor, id[, digest]): the anchors of each text's windows, repeats in a row once, with its id and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            _, firsts, first, anchor = _hashed(part.column(1), window)
            text = np.searchsorted(firsts, first, "right") - 1
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            anchor, text = anchor[fresh].view(np.int64), text[fresh]
            columns = [pa.array(anchor), pa.array(_ids(part.column(0))[text])]
            if digests:
                columns.append(pa.array(_digests(part.column(1))[text]))
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "id", "digest"][: len(columns)])

    return texts.mapInArrow(run, "anchor long, id long" + ", digest long" * digests)


def _passages(marked: DataFrame, window: int) -> DataFrame:
    """(owner, block, salt, reference, id, digest, start, words) from (id, text, shared): passages with shared anchors, by owner and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            words, firsts, first, anchor = _hashed(part.column(1), window)
            ids, digests = _ids(part.column(0)), _digests(part.column(1))
            text = np.searchsorted(firsts, first, "right") - 1
            lists = part.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            of = np.repeat(np.arange(part.num_rows), sizes).astype(np.uint64)
            known = mix(flat.field(0).to_numpy().view(np.uint64) + mix(of + np.uint64(1)))
            order = np.argsort(known)
            known, owners, blocks, salts = known[order], *(flat.field(k).to_numpy()[order] for k in (1, 2, 3))
            asked = mix(anchor + mix(text.astype(np.uint64) + np.uint64(1)))
            place = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
            hit = known[place] == asked if len(known) else np.zeros(len(asked), bool)
            first, text, place = first[hit], text[hit], place[hit]
            if not len(first):
                continue
            owner, block, salt = owners[place], blocks[place], salts[place]
            begin = np.ones(len(first), bool)
            begin[1:] = (first[1:] != first[:-1] + 1) | (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(begin)
            end = np.append(at[1:], len(first)) - 1
            own, lead, stop = text[at], first[at], first[end] + window
            reference = owner[at] == ids[own]
            copies = np.where(reference, salt[at], 1)  # a reference goes to each salt of its owner, a passage to one
            row = np.repeat(np.arange(len(at)), copies)
            number = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            which = np.where(reference[row], number, mix(ids[own[row]].view(np.uint64)) % np.maximum(salt[at][row], 1).astype(np.uint64))
            lengths = (stop - lead)[row]
            upto = np.concatenate([[0], np.cumsum(lengths)])
            taken = words[np.arange(upto[-1]) + np.repeat(lead[row] - upto[:-1], lengths)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[at][row]), pa.array(block[at][row].astype(np.int32)), pa.array(which.astype(np.int32)), pa.array(reference[row]), pa.array(ids[own[row]]), pa.array(digests[own[row]]), pa.array((lead - firsts[own])[row].astype(np.int64)), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(taken))],
                ["owner", "block", "salt", "reference", "id", "digest", "start", "words"],
            )

    return marked.mapInArrow(run, "owner long, block int, salt int, reference boolean, id long, digest long, start long, words array<long>")


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last number of each run of consecutive ascending numbers."""
    begin = np.flatnonzero(np.append(True, np.diff(found) != 1)) if len(found) else np.zeros(0, np.int64)
    return found[begin], found[np.append(begin[1:], len(found)) - 1] if len(found) else found


def _streamed(passages: DataFrame, window: int, parts: int) -> DataFrame:
    """(id, digest, start, stop, h, h2): spans of words that are in the owner's text (h null), and windows that aren't (with their hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, names = None, None, ["id", "digest", "start", "stop", "h", "h2"]
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            lists = batch.column(7)
            upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            flat = lists.flatten().to_numpy()
            words = flat.tolist()
            out: list[list] = [[], [], [], []]
            missing: list[tuple] = []  # id, digest, start, place of the passage, and its windows that the owner lacks
            for k, (*own, reference, doc, digest, start) in enumerate(zip(*[c.tolist() for c in columns], strict=True)):
                a, b = int(upto[k]), int(upto[k + 1])
                if own != shard:
                    shard, automaton = own, Automaton()
                if reference:
                    automaton.add(words[a:b])
                    continue
                full = np.array(automaton.matches(words[a:b])[window - 1 :]) >= window
                for first, last in zip(*[x.tolist() for x in _runs(np.flatnonzero(full))], strict=True):
                    for c, v in zip(out, (doc, digest, start + first, start + last + window), strict=True):
                        c.append(v)
                if not full.all():
                    missing.append((doc, digest, start, a, np.flatnonzero(~full)))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out], *[pa.nulls(len(out[0]), pa.int64())] * 2], names)
            if missing:
                windows = np.concatenate([m[4] for m in missing])
                doc, digest, start, place = (np.repeat(np.array([m[k] for m in missing], np.int64), [len(m[4]) for m in missing]) for k in range(4))
                hashes = _window_hashes(flat.view(np.uint64), place + windows, window)  # of all passages at once
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, digest, start + windows, start + windows + window, *hashes)], names)

    dealt = passages.repartition(parts, "owner", "block", "salt").sortWithinPartitions("owner", "block", "salt", F.col("reference").desc())
    return dealt.mapInArrow(run, "id long, digest long, start long, stop long, h long, h2 long")


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that nothing refers to any more, which it does when the driver collects garbage.

    Twice, as the JVM's objects are let go just after Python's.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, copied, spans): what goes from the rows of docs with a doc_id (null: the smallest long), if anything.

    copied has the MD5 of texts that a smaller doc_id has whole; spans has the digest of the text, first and last word (past it).
    """
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")
    heads = cut(texts.select("id", F.unhex(F.md5("text")).alias("md5")))
    least = heads.groupBy("md5").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    copied = heads.join(least.where("least < most").select(F.col("md5").alias("of"), "least"), (F.col("md5") == F.col("of")) & (F.col("id") > F.col("least")))
    copies = cut(copied.groupBy("id").agg(F.collect_set("md5").alias("copied")))
    own = heads.join(copied.select(F.col("id").alias("copy"), F.col("of").alias("copy_of")), (F.col("id") == F.col("copy")) & (F.col("md5") == F.col("copy_of")), "left_anti").select(F.col("id").alias("own")).distinct()

    counted = _anchors(texts, window, digests=True).groupBy("anchor").agg(F.min("digest").alias("one"), F.max("digest").alias("other"), F.min("id").alias("owner"), F.count("*").alias("n"))
    several = cut(counted.where("one <> other").select(F.col("anchor").alias("a"), "owner", "n"))
    del counted
    release(spark)
    sizes = several.groupBy(F.col("owner").alias("_owner")).agg(F.sum("n").alias("met"), F.count("*").alias("anchors"))
    blocks = sizes.select("_owner", F.ceil(F.col("anchors") / BLOCK).alias("blocks"), F.col("met") / F.greatest(F.lit(SERVED), COPIES * F.col("anchors")))
    blocks = blocks.toDF("_owner", "blocks", "copies").select("_owner", "blocks", F.ceil("copies").cast("int").alias("salts"))
    placed = several.join(blocks, F.col("owner") == F.col("_owner"))
    shared = placed.select("a", "owner", F.pmod(F.col("a"), F.col("blocks")).cast("int").alias("block"), "salts")
    marks = _anchors(texts, window, digests=False).join(shared, F.col("anchor") == F.col("a")).select("id", "anchor", "owner", "block", "salts")
    lists = cut(marks.join(own, F.col("id") == F.col("own"), "left_semi").groupBy("id").agg(F.collect_set(F.struct("anchor", "owner", "block", "salts")).alias("shared")))
    del shared, marks
    release(spark)

    marked = texts.join(lists.withColumnRenamed("id", "marked"), F.col("id") == F.col("marked")).select("id", "text", "shared")
    streamed = cut(_streamed(_passages(marked, window), window, parts))
    del marked
    release(spark)
    missed = streamed.where("h IS NOT NULL")
    first = missed.groupBy("h", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("h").alias("same"), F.col("h2").alias("same2"), "least")
    later = missed.join(first, (F.col("h") == F.col("same")) & (F.col("h2") == F.col("same2")) & (F.col("id") > F.col("least"))).select("id", "digest", "start", "stop")
    found = streamed.where("h IS NULL").select("id", "digest", "start", "stop").union(later)
    return copies.join(found.groupBy("id").agg(F.collect_set(F.struct("digest", "start", "stop")).alias("spans")), "id", "full_outer")


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row; kept has the words that stay, joined by one space.

    Words are runs of other bytes than white space, unchanged. Null texts have none, as empty ones. A null doc_id is
    smaller than all others; windows of rows that share a doc_id are not held against each other; repeated rows have
    the same result. Windows are judged on the input.
    """
    gone = spans(docs, window)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = texts.join(gone, F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("id"), "left").select("doc_id", "text", "copied", "spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if with_text else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            data, offsets = buffer(part.column(1))
            starts, ends, firsts = word_bounds(data, offsets)
            raw, n = data.tobytes(), np.diff(firsts)
            keep = np.ones(len(starts), bool)
            copied, listed = part.column(2).to_pylist(), part.column(3)
            some = np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False))
            digests = _digests(part.column(1)) if len(some) else None
            for i in some.tolist():
                for s in listed[i].as_py():
                    if s["digest"] == digests[i]:
                        keep[firsts[i] + s["start"] : firsts[i] + s["stop"]] = False
            for i, digest in enumerate(copied):
                if digest and n[i] >= window and md5(raw[offsets[i] : offsets[i + 1]]).digest() in digest:
                    keep[firsts[i] : firsts[i + 1]] = False
            word = np.repeat(keep, ends - starts)
            kept = ~WHITE[data]
            kept[kept] = word  # bytes of words, in order
            solid = kept.copy()
            gap = np.zeros(len(data), bool)
            gap[ends[keep & (ends < offsets[np.searchsorted(firsts, np.arange(len(starts)), "right")])]] = True  # the byte after a kept word
            gap &= ~solid
            shown = np.where(gap, np.uint8(0x20), data)[solid | gap]
            upto = np.concatenate([[0], np.cumsum(solid | gap)])[offsets]
            joined = shown.tobytes()
            texts = [joined[a:b].rstrip(b" ") for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
            removed = n - np.add.reduceat(np.append(keep, False).astype(np.int64), firsts[:-1]) * (n > 0) if len(keep) else n
            columns = [part.column(0), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([sha256(t).hexdigest() for t in texts])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([t.decode() for t in texts])] if with_text else []), names)

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
