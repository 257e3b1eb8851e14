"""Fill-in-the-middle: texts cut into prefix, middle and suffix at two ranks of their units, and put together in another order.

A text is gone through twice and never held as a list of units: the first pass only counts the matches of the unit's
pattern, the second moves a lazy iterator of matches on to the lower rank and from there to the higher.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from chanspark.llm.common import slices

#: One code point.
UNIT = r"(?s:.)"
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of a hundred that stay plain, and those of a hundred others that begin with the suffix.
PLAIN, SPM = 10, 20

ORACLE_SUMMARY = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
),
p AS (SELECT *, substring(t, 1, low) AS prefix, substring(t, low + 1, high - low) AS middle, substring(t, high + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""


def units(text: str, unit: re.Pattern) -> int:
    """How many units a text has."""
    ticks = count()
    deque(zip(unit.finditer(text), ticks), maxlen=0)
    return next(ticks)


def places(text: str, unit: re.Pattern, low: int, high: int) -> tuple[int, int]:
    """Where the low-th and the high-th unit of text end (0: its beginning); low <= high <= the number of units."""
    matches = unit.finditer(text)

    def on(steps: int, at: int) -> int:
        return next(islice(matches, steps - 1, None)).end() if steps else at

    first = on(low, 0)
    return first, on(high - low, first)


def ranks(doc_id: int | None, n: int) -> tuple[int, int, int, int]:
    """The two ranks of the cuts, in order, and the draws for the form; all follow from doc_id."""
    digest = sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    return min(a % (n + 1), b % (n + 1)), max(a % (n + 1), b % (n + 1)), c % 100, d % 100


def transform(text: str, doc_id: int | None, unit: re.Pattern) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, units, units of the prefix, units of the middle)."""
    n = units(text, unit)
    low, high, plain, spm = ranks(doc_id, n)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or plain >= 100 - PLAIN:
        return text, "plain", n, None, None
    a, b = places(text, unit, low, high)
    first, second = PREFIX + text[:a], SUFFIX + text[b:]
    form = "spm" if spm < SPM else "psm"
    return (second + first if form == "spm" else first + second) + MIDDLE + text[a:b], form, n, low, high - low


def restore(output: str, form: str) -> str:
    """The text that transform() made output of. Marks are unambiguous, as no text that has one is cut."""
    if form == "plain":
        return output
    rest, _, middle = output.partition(MIDDLE)
    if form == "spm":
        suffix, _, prefix = rest.removeprefix(SUFFIX).partition(PREFIX)
    else:
        prefix, _, suffix = rest.removeprefix(PREFIX).partition(SUFFIX)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, unit: str = UNIT, with_text: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]) of every row.

    Units are the matches of a pattern, from left to right (by default code points); what lies between two of them goes
    with the later one, and what follows the last with the suffix. A null text is empty, and stays plain as an empty one;
    a null doc_id draws as one that is written `null`; repeated rows have the same result.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    keep = len(names) - (not with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for part in slices(batches, 1):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                output, form, n, low, middle = transform(text or "", doc_id, pattern)
                hashes = (sha256(x.encode()).hexdigest() for x in (output, restore(output, form)))
                rows.append((n, form, low, middle, *hashes, *([output] if with_text else [])))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[: keep - 1], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names[:keep])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_text
    return docs.select("doc_id", "text").mapInArrow(run, schema)
