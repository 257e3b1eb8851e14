"""Suffix arrays by induced sorting, and permuted common prefixes.

A suffix is smaller-type (S) if it is less than the one after it, else larger-type (L); a leftmost S is an S after an L.
The substrings from one leftmost S to the next are sorted by inducing: from them all L suffixes, scanning up, and from
those all S suffixes, scanning down. Equal substrings get equal names; if names repeat, the text of the names is sorted
in the same way. Then the leftmost-S suffixes are in order, and one more inducing gives all.

Bytes are induced a bucket (first byte) at a time, in NumPy; the text of names, a third as long, has too many buckets
for that and is induced one by one.
"""

from __future__ import annotations

import numpy as np

from chanspark.llm.common import equal_runs

#: Buckets' worth of suffixes up to which they are placed one by one.
FEW = 40
#: Names up to which a leftmost-S substring of names is compared in step with all others.
LONG = 64


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of S type. The last one, the least of all, is."""
    n = len(text)
    rises = np.zeros(n, bool)
    rises[-1] = True
    differs = np.flatnonzero(text[:-1] != text[1:])
    rises[differs] = text[differs] < text[differs + 1]
    # equal neighbours have the type of the run's end
    ends = np.append(differs, n - 1)
    return rises[ends[np.searchsorted(ends, np.arange(n))]]


def leftmost(small: np.ndarray) -> np.ndarray:
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _induce_bytes(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """All suffixes as induced from the leftmost S ones in the order of seeds; symbols are below width."""
    counts = np.bincount(text, minlength=width)
    larges = np.bincount(text[~small], minlength=width)
    begins = np.concatenate([[0], np.cumsum(counts)])
    order = np.full(len(text), -1, np.int64)
    firsts = text[seeds]
    grouped = seeds[np.argsort(firsts, kind="stable")]
    upto = np.concatenate([[0], np.cumsum(np.bincount(firsts, minlength=width))])

    heads = begins[:-1].copy()

    def put_up(batch: np.ndarray) -> None:
        if len(batch) <= FEW:
            for j in batch.tolist():
                if j and not small[j - 1]:
                    c = text[j - 1]
                    order[heads[c]] = j - 1
                    heads[c] += 1
            return
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        keys = text[before]
        placed = np.argsort(keys, kind="stable")
        keys = keys[placed]
        n = np.bincount(keys, minlength=width)
        order[np.arange(len(keys)) + np.repeat(heads - np.cumsum(n) + n, n)] = before[placed]
        heads[:] += n

    for c in np.flatnonzero(counts).tolist():
        done = begins[c]
        while done < heads[c]:  # a round puts suffixes that begin with c once more behind those of c
            now = heads[c]
            put_up(order[done:now])
            done = now
        if upto[c] < upto[c + 1]:
            put_up(grouped[upto[c] : upto[c + 1]])

    tails = begins[1:].copy()

    def put_down(batch: np.ndarray) -> None:
        """batch from the largest to the smallest."""
        if len(batch) <= FEW:
            for j in batch.tolist():
                if j and small[j - 1]:
                    c = text[j - 1]
                    tails[c] -= 1
                    order[tails[c]] = j - 1
            return
        before = batch[batch > 0] - 1
        before = before[small[before]]
        keys = text[before]
        placed = np.argsort(keys, kind="stable")
        keys = keys[placed]
        n = np.bincount(keys, minlength=width)
        rank = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
        order[tails[keys] - 1 - rank] = before[placed]
        tails[:] -= n

    tails[text[-1]] -= 1  # the last suffix has none after it
    order[tails[text[-1]]] = len(text) - 1
    for c in np.flatnonzero(counts)[::-1].tolist():
        done = begins[c + 1]
        while done > tails[c]:
            now = tails[c]
            put_down(order[now:done][::-1])
            done = now
        if larges[c]:
            put_down(order[begins[c] : begins[c] + larges[c]][::-1])
    return order


def _induce_names(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """The same over a text of names, one by one."""
    n = len(text)
    counts = np.bincount(text, minlength=width)
    ends = np.cumsum(counts)
    firsts = text[seeds]
    own = np.bincount(firsts, minlength=width)
    grouped = seeds[np.argsort(firsts, kind="stable")]
    placed = np.full(n, n, np.int64)  # n stands for an empty place
    placed[np.arange(len(seeds)) + np.repeat(ends - np.cumsum(own), own)] = grouped
    order = placed.tolist()
    up, down = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)  # the name before a suffix, if it makes an L or an S suffix
    up[1:n] = np.where(small[:-1], -1, text[:-1])
    down[1:n] = np.where(small[:-1], text[:-1], -1)
    heads = (ends - counts).tolist()
    before = up.tolist()
    for j in order:  # which grows ahead of the scan
        c = before[j]
        if c >= 0:
            order[heads[c]] = j - 1
            heads[c] += 1
    tails = ends.tolist()
    tails[text[-1]] -= 1
    order[tails[text[-1]]] = n - 1
    before = down.tolist()
    for j in reversed(order):
        c = before[j]
        if c >= 0:
            tails[c] -= 1
            order[tails[c]] = j - 1
    return np.array(order, np.int64)


def _names(text: np.ndarray, small: np.ndarray, found: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """The name of each leftmost-S substring, by place in the text, and how many names there are; order has all suffixes."""
    stops = np.append(found[1:] + 1, len(text))
    which = np.full(len(text), -1, np.int64)
    which[found] = np.arange(len(found))
    ranked = which[order]
    ranked = ranked[ranked >= 0]
    starts, ends = found[ranked], stops[ranked]
    if text.dtype == np.uint8:
        same = equal_runs(text, starts[1:], ends[1:], text, starts[:-1], ends[:-1])
    else:
        sizes = ends - starts
        same = sizes[1:] == sizes[:-1]
        open_ = np.flatnonzero(same & (sizes[1:] <= LONG))
        for k in range(LONG):
            open_ = open_[sizes[open_ + 1] > k]
            if not len(open_):
                break
            equal = text[starts[open_ + 1] + k] == text[starts[open_] + k]
            same[open_[~equal]] = False
            open_ = open_[equal]
        for i in np.flatnonzero(same & (sizes[1:] > LONG)).tolist():
            same[i] = np.array_equal(text[starts[i + 1] : ends[i + 1]], text[starts[i] : ends[i]])
    names = np.zeros(len(found), np.int64)
    names[ranked] = np.concatenate([[0], np.cumsum(~same)])
    return names, int(names.max()) + 1


def suffix_array(text: np.ndarray, width: int | None = None) -> np.ndarray:
    """The starts of all suffixes of text in order. Its last symbol must be less than all others; all are from 0 to width - 1."""
    width = width or int(text.max()) + 1
    if len(text) == 1:
        return np.zeros(1, np.int64)
    wide = text.dtype == np.uint8
    small = types(text)
    found = leftmost(small)

    def induce(seeds: np.ndarray) -> np.ndarray:
        return (_induce_bytes if wide else _induce_names)(text, small, seeds, width)

    names, n = _names(text, small, found, induce(found))
    if n < len(found):
        sorted_ = suffix_array(names, n)
    else:
        sorted_ = np.empty(n, np.int64)
        sorted_[names] = np.arange(n)
    return induce(found[sorted_])


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the text how long a prefix its suffix shares with the one before it in order; 0 for the least suffix.

    Permuted to the order of the text they fall by one from place to place, but where the symbols before the two suffixes
    differ; only those are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    inner = np.flatnonzero((before[1:] > 0)) + 1
    fresh[inner] = text[inner - 1] != text[before[inner] - 1]
    at = np.flatnonzero(fresh & (before >= 0))
    left, right = at.copy(), before[at]
    eights = np.ndarray(n + 1, "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
    size, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(open_):
        a, b = left[open_] + size[open_], right[open_] + size[open_]
        differ = eights[np.minimum(a, n)] ^ eights[np.minimum(b, n)]
        zero = differ == 0
        done = open_[~zero]
        lowest = differ[~zero] & (~differ[~zero] + np.uint64(1))
        size[done] += (np.log2(lowest.astype(np.float64)).astype(np.int64)) >> 3
        open_ = open_[zero]
        size[open_] += 8
    known = np.zeros(n, np.int64)
    known[at] = size + at  # a place's own prefix ends where that of the last fresh place before it does
    last = np.where(fresh, np.arange(n), 0)
    np.maximum.accumulate(last, out=last)
    return np.maximum(known[last] - np.arange(n), 0)


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` symbols from each place on also start at another place; text as for suffix_array."""
    order = suffix_array(text)
    enough = common_prefixes(text, order)[order] >= length
    out = np.zeros(len(text), bool)
    out[order] = enough | np.append(enough[1:], False)
    return out
