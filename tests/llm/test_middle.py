"""Fill-in-the-middle against lists of units, with exact round trips."""

import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from chanspark.llm import middle

ROWS = [(1, "abc"), (2, None), (3, ""), (None, "no id"), (None, "no id"), (4, "has <P> in it"), (5, "<S"), (6, "<"), (7, "é is two, 😀 one\n\r\n"), (8, "漢字 " * 300), *((k, f"text {k} " * (k % 7 + 1)) for k in range(10, 200))]


def slow(doc_id, text, listed):
    text = text or ""
    own = listed(text)
    h = sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (len(own) + 1), h2 % (len(own) + 1)))
    if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= 90:
        return doc_id, len(own), "plain", None, None, text
    a, b = (own[k - 1][1] if k else 0 for k in (low, high))
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return doc_id, len(own), *(("spm", low, high - low, s + p + m) if h4 % 100 < 20 else ("psm", low, high - low, p + s + m))


@pytest.mark.parametrize("unit", [middle.UNIT, r"\S+\s*", r"[^\n]*\n?"])
def test_fill_in_middle(spark, unit):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("form", F.lit(1))
    found = middle.fill_in_middle(docs, unit).collect()
    listed = lambda text: [m.span() for m in re.finditer(unit, text)]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=repr) == sorted((slow(*r, listed) for r in ROWS), key=repr)
    texts = {r.restored_sha256 for r in found}
    assert texts == {sha256((t or "").encode()).hexdigest() for _, t in ROWS}
    assert all(sha256(r.output.encode()).hexdigest() == r.output_sha256 for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("form", ["psm", "spm"])
@pytest.mark.parametrize("text", ["<<S>"[:2] + "x", "<P", "S><M", "<<<", "P>S>M>"])
def test_marks_over_joints(form, text):
    """What stands next to a mark can't be taken for a part of one."""
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
            assert middle.restore((s + p if form == "spm" else p + s) + m, form) == text


def test_no_rows(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], "doc_id int, text string")).dtypes[0] == ("doc_id", "int")


def test_a_long_text():
    """Two passes over 20 million code points hold little more than the text."""
    import tracemalloc

    text = "abé\n" * 5_000_000
    tracemalloc.start()
    unit = re.compile(middle.UNIT)
    assert middle.units(text, unit) == len(text)
    assert middle.places(text, unit, 7_000_000, 19_999_999) == (7_000_000, 19_999_999)
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
