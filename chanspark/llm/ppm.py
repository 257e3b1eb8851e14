"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over folded bytes: how often each symbol followed each context of 3, 2,
1 and 0 symbols in a labelled sample. The statistics are frozen, so the cost in bits of a symbol after a context is a
fixed number: method C escapes from a context that has not seen the symbol, and shorter contexts leave out what the
longer one has seen. The costs of all contexts are tabulated once on the driver; scoring a text adds up its table rows.

Bounds: the trees are fitted on at most about ROWS_PER_LANGUAGE labelled rows of each language. All languages that occur
are learned; a table of costs beyond MODEL_BYTES is an error before it is made. Every row of every size is then scored
over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chanspark.llm.common import buffer, cut, frugal, slices, unused

ROWS_PER_LANGUAGE = 1500
#: Bytes that the table of costs, which each worker has, may take.
MODEL_BYTES = 1 << 30
UNDETERMINED = "und"

#: Symbols: 0 is any run of ASCII bytes that aren't letters, the last one stands for bytes that no language often has.
SYMBOL_BITS = 7
SYMBOLS = 1 << SYMBOL_BITS
ORDER = 3

LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with runs of other ASCII than letters made one 0, and the offsets of the texts."""
    data, offsets = buffer(pc.utf8_lower(pc.fill_null(column, "")))
    kept = np.where(LETTER[data], data, np.uint8(0))
    stays = kept != 0
    stays[1:] |= kept[:-1] != 0
    upto = np.concatenate([[0], np.cumsum(stays)])
    return kept[stays], upto[offsets]


def _grams(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each symbol the code of its context of ORDER symbols and itself; what is before a text is separators."""
    lengths = np.diff(offsets)
    padded = np.zeros(len(symbols) + ORDER * len(lengths), np.int32)
    place = np.arange(len(symbols)) + np.repeat(ORDER * np.arange(1, len(lengths) + 1), lengths)
    padded[place] = symbols
    code = padded.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= padded[:-k] << (SYMBOL_BITS * k)
    return code[place]


@dataclass
class Model:
    """languages; symbol of each byte; row of each context of ORDER symbols; bits[row, symbol, language]."""

    languages: list[str]
    symbol: np.ndarray
    row: np.ndarray
    bits: np.ndarray

    def lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text in bits under each language, and the number of symbols."""
        data, offsets = _folded(column)
        code = _grams(self.symbol[data], offsets)
        flat = self.bits.reshape(-1, len(self.languages))
        total = np.zeros((len(column), len(self.languages)))
        counts = np.diff(offsets)
        for at in range(0, len(code), 1 << 20):
            part = code[at : at + (1 << 20)]
            cost = flat[(self.row[part >> SYMBOL_BITS].astype(np.int64) << SYMBOL_BITS) | (part & (SYMBOLS - 1))]
            first, last = np.searchsorted(offsets, [at, at + len(part) - 1], "right") - 1
            texts = np.arange(first, last + 1)
            texts = texts[counts[texts] > 0]
            total[texts] += np.add.reduceat(cost, np.maximum(offsets[texts] - at, 0), axis=0, dtype=np.float64)
        return total, counts


def tabulate(languages: list[str], symbol: np.ndarray, of: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The model for language numbers of, gram codes and their counts n."""
    contexts = np.unique(gram >> SYMBOL_BITS)
    row = np.zeros(SYMBOLS**ORDER, np.int32)
    shorter = SYMBOLS ** (ORDER - 1)
    row[:] = np.arange(SYMBOLS**ORDER) % shorter
    row[contexts] = shorter + np.arange(len(contexts))
    bits = np.zeros((shorter + len(contexts), SYMBOLS, len(languages)), np.float32)
    for k in range(len(languages)):
        own = of == k
        bits[:, :, k] = _language_bits(gram[own], n[own].astype(np.float64), contexts)
    return Model(languages, symbol, row, bits)


def _language_bits(gram: np.ndarray, n: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Bits of every symbol after each context of ORDER - 1 symbols, then after each of the given longer contexts."""
    tables = []
    for order in range(ORDER):
        table = np.zeros((SYMBOLS**order, SYMBOLS))
        np.add.at(table.reshape(-1), gram & (SYMBOLS ** (order + 1) - 1), n)
        tables.append(table)
    longest = np.zeros((len(contexts), SYMBOLS))
    np.add.at(longest, (np.searchsorted(contexts, gram >> SYMBOL_BITS), gram & (SYMBOLS - 1)), n)

    def after(order: int, suffix: np.ndarray, excluded: np.ndarray) -> np.ndarray:
        """Bits of each symbol that isn't excluded, from contexts of this order down."""
        if order < 0:
            return np.repeat(np.log2(np.maximum(1, (~excluded).sum(axis=1)))[:, None], SYMBOLS, axis=1)
        table = np.where(excluded, 0, tables[order][suffix])
        return coded(table, excluded, order, suffix)

    def coded(table: np.ndarray, excluded: np.ndarray, order: int, suffix: np.ndarray) -> np.ndarray:
        total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        empty = total == 0
        mass = np.where(empty, 1, total + kinds)
        escape = np.where(empty, 0, -np.log2(np.where(empty, 1, kinds) / mass))
        # Every symbol can still come if nothing is left to escape to.
        lower = after(order - 1, suffix % SYMBOLS ** max(order - 1, 0), excluded | (table > 0))
        return np.where(table > 0, -np.log2(np.where(table > 0, table, 1) / mass), escape + lower)

    none = lambda m: np.zeros((m, SYMBOLS), bool)
    short = after(ORDER - 1, np.arange(SYMBOLS ** (ORDER - 1)), none(SYMBOLS ** (ORDER - 1)))
    parts = [coded(longest[i : i + 4096], none(len(longest[i : i + 4096])), ORDER, contexts[i : i + 4096]) for i in range(0, len(contexts), 4096)]
    return np.concatenate([short, *parts]).astype(np.float32)


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """The model from (doc_id, text, lang); rows with a null text or lang are left out. None if nothing is left.

    The sample is taken by a hash of doc_id; the counts are summed by Spark and their sums, bounded by the sample and
    by the number of grams, come to the driver. Bytes that make up most of some language's text have symbols of their own.
    """
    labelled = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return None
    names = sorted(r["lang"] for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, rows_per_language / r["count"]) * (1 << 30)))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang"))
    sample = cut(labelled.where(F.col("lang").isin(names) & drawn).select("text", "lang"))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            data, offsets = _folded(part.column(0))
            of = np.repeat([number[x] for x in part.column(1).to_pylist()], np.diff(offsets)).astype(np.int64)
            both, n = np.unique((of << 8) | data, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], ["both", "n"])

    number = {x: k for k, x in enumerate(names)}
    found = sample.mapInArrow(histogram, "both long, n long").groupBy("both").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(names), 256))
    for r in found:
        counts[r["both"] >> 8, r["both"] & 255] = r["n"]
    share = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).max(axis=0)
    share[0] = 0
    often = np.argsort(-share, kind="stable")[: min(SYMBOLS - 2, int((share > 0).sum()))]
    if not len(often):
        return None
    symbol = np.full(256, SYMBOLS - 1, np.uint8)
    symbol[0] = 0
    symbol[often] = np.arange(1, len(often) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            data, offsets = _folded(part.column(0))
            code = _grams(symbol[data], offsets)
            of = np.repeat([number[x] for x in part.column(1).to_pylist()], np.diff(offsets)).astype(np.int64)
            both, n = np.unique((of << (SYMBOL_BITS * (ORDER + 1))) | code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], ["both", "n"])

    grams = sample.mapInArrow(count, "both long, n long").groupBy("both").agg(F.sum("n").alias("n")).toArrow()
    both, n = grams.column("both").to_numpy(), grams.column("n").to_numpy()
    order = np.argsort(both)
    both, n = both[order], n[order]
    contexts = len(np.unique(both >> SYMBOL_BITS & SYMBOLS**ORDER - 1))
    if (wanted := 4 * (SYMBOLS ** (ORDER - 1) + contexts) * SYMBOLS * len(names)) > MODEL_BYTES:
        raise ValueError(f"{len(names)} languages and {contexts} contexts take {wanted} bytes of costs, more than MODEL_BYTES; learn fewer rows of a language")
    return tabulate(names, symbol, both >> (SYMBOL_BITS * (ORDER + 1)), both & ((1 << SYMBOL_BITS * (ORDER + 1)) - 1), n)


def _lettered(texts: pa.Array) -> np.ndarray:
    """Which texts have a letter of any script."""
    found = pc.match_substring_regex(texts, "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, texts[i].as_py() or ""))
    return found


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and bits_per_symbol, in columns of those names (clashing ones are replaced).

    score is the best language's share of the likelihood. A null text, or one without a letter, has lang_pred `und`,
    score 0 and null bits; so has every text if model is None. Only the text is read; every text is read whole.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "bits_per_symbol")])
    extra = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_symbol", pa.float64())])
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["lang_pred string, score double, bits_per_symbol double"])
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, at):
            names = [UNDETERMINED] * part.num_rows
            score, per = np.zeros(part.num_rows), np.full(part.num_rows, np.nan)
            if own is not None:
                bits, counts = own.lengths(part.column(at))
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                known = _lettered(part.column(at))
                score = np.where(known, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0)
                per = np.where(known, least / np.maximum(counts, 1), np.nan)
                names = [own.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            added = [pa.array(names, pa.string()), pa.array(score), pa.array(per, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], schema=pa.schema([*part.schema, *extra]))

    return docs.mapInArrow(frugal(run), schema)


def held_out(docs: DataFrame):
    """The column that is true for rows that no model may learn from: crc32 of the doc_id as text leaves 2 on division by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_symbol) for every row: fits on the rows not held out, predicts all."""
    model = fit(docs.where(~held_out(docs)), rows_per_language)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score", "bits_per_symbol")


def keep_known(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The rows of documents, less those rejected: `und`, and texts that no language's statistics shorten.

    The second kind costs more bits a symbol than a code of equal lengths for all symbols would.
    """
    model = fit(docs.where(~held_out(docs)), rows_per_language)
    renamed = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in ("lang_pred", "score", "bits_per_symbol")}
    found = predict(docs.withColumnsRenamed(renamed), model)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_symbol") <= SYMBOL_BITS))
    return kept.drop("lang_pred", "score", "bits_per_symbol").withColumnsRenamed({v: k for k, v in renamed.items()})
