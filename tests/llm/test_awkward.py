"""Every operator and stage with columns of all names used within, repeated rows, null ids, null and empty texts, and without rows."""

import re
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from chanspark.llm import audit, chunks, linededup, middle, pieces, ppm, sharding, similar, simhash, substrings, suffix_dedup, templates, tokenfiles, warc
from test_operators import DATA

LLM = Path(linededup.__file__).parent
#: All quoted names in the operators' code that could be columns, less those that they are given.
NAMES = sorted({x.lower() for p in LLM.glob("*.py") for x in re.findall(r'"(_?[a-z][a-z0-9_]{0,15})"', p.read_text())} - {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html"})
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ONE = "river stone morning quiet garden letter of the window seven light paper music river stone morning quiet garden"
ROWS = [(1, ONE, "en", "a"), (1, ONE, "en", "a"), (None, ONE, "en", "a"), (None, None, None, None), (2, "", None, "a"), (3, None, "en", None), (3, "other text here\nnav", "en", "a"), (4, "nav\nthe end of it all", "de", "a"), (5, "nav", "de", "b"), (6, " \t\n", "de", "b"), (7, ONE + " more", "en", "b"), (None, "nav\nx", None, "b")]
SCHEMA = "doc_id long, text string, lang string, source string"

ITEMS = "item_id long, text string"


def _benchmark(df):
    return df.sparkSession.createDataFrame([(1, "seven light paper music river stone morning quiet"), (None, None), (2, "")], ITEMS)


OPERATORS = {
    "pieces.encode": lambda d: pieces.encode(d, PIECES, check=True),
    "pieces.decode": lambda d: pieces.decode(pieces.encode(d, PIECES), PIECES),
    "pieces.summary": lambda d: pieces.summary(d, PIECES),
    "ppm.predict": lambda d: ppm.predict(d, ppm.fit(d)),
    "ppm.identify": ppm.identify,
    "ppm.keep_known": ppm.keep_known,
    "warc.summary": lambda d: warc.summary(d.sparkSession, d.withColumnsRenamed({"url": "_u", "html": "_h", "page_id": "_p"}).withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})),
    "chunks.fingerprint": chunks.fingerprint,
    "chunks.edits": chunks.edits,
    "templates.matches": lambda d: templates.matches(d, _benchmark(d)),
    "templates.decontaminate": lambda d: templates.decontaminate(d, _benchmark(d)),
    "tokenfiles.summary": lambda d: tokenfiles.summary(d, BYTES),
    "linededup.drop_lines": lambda d: linededup.drop_lines(d, least_pages=2),
    "linededup.without_boilerplate": lambda d: linededup.without_boilerplate(d, least_pages=2),
    "simhash.near_duplicates": simhash.near_duplicates,
    "simhash.keep_one": simhash.keep_one,
    "similar.keep_one": similar.keep_one,
    "substrings.dedup": substrings.dedup,
    "sharding.bytes": lambda d: sharding.assign(d, 4, "bytes"),
    "sharding.rows": lambda d: sharding.assign(d, 4, "rows"),
    "sharding.key": lambda d: sharding.assign(d, 4, "key"),
    "audit.audit": lambda d: audit.audit(d, d.sparkSession.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")),
    "middle.fill_in_middle": middle.fill_in_middle,
    "suffix_dedup.dedup": lambda d: suffix_dedup.dedup(d, window=20, anchor=8),
} | {f"stage {name}": lambda d, f=f: f(d.sparkSession, d, DATA) for name, f in corpus_pipeline.STAGES}
#: Operators that keep the columns that they are given.
WIDE = [n for n in OPERATORS if re.match("pieces.[ed]|ppm.[pk]|templates.d|linededup|sharding|stage|.*keep_one", n)]
#: Results of repeated rows that may change places: which of them has which slot.
LOOSE = {"slot"}


def _rows(df, names):
    return sorted((tuple(str(r[c]) for c in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", OPERATORS)
def test_names_and_rows(spark, docs, name):
    """Columns of any name change no result, and stay if the operator keeps columns."""
    plain = OPERATORS[name](docs)
    own = [c for c in plain.columns if c not in LOOSE]
    extra = [n for n in NAMES if n not in plain.columns]
    wide = OPERATORS[name](docs.selectExpr("*", *[f"'kept' AS `{n}`" for n in extra]))
    assert _rows(wide, own) == _rows(plain, own)
    if name in WIDE:
        assert set(wide.columns) == {*plain.columns, *extra}
        assert all(r[n] == "kept" for r in wide.limit(3).collect() for n in extra)
    else:
        assert wide.columns == plain.columns
    if name in ("pieces.encode", "pieces.decode", "pieces.summary", "ppm.predict", "ppm.identify", "warc.summary", "chunks.fingerprint", "chunks.edits", "tokenfiles.summary", "linededup.drop_lines", "simhash.near_duplicates", "substrings.dedup", "sharding.bytes", "stage line_dedup", "stage tokens"):
        assert plain.count() == len(ROWS)
    none = OPERATORS[name](docs.limit(0))
    assert none.columns == plain.columns and none.count() == 0
