"""Line dedup by site-relative frequency, with DataFrame functions only.

The pages of a host that contain a line, divided by the pages of the host: lines above a boilerplate ratio are dropped
from that host's pages. A line's key is its MD5, so what is counted and exchanged is narrow; counting combines on the
map side, so a host with a third of all pages is no hot group. A host has at most (lines a page / ratio) such lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chanspark.llm.common import cut, quoted, unused

RATIO = 0.05
LEAST_PAGES = 5
#: Boilerplate lines (of all hosts) that are broadcast, some 60 bytes each; more are joined by exchange.
BROADCAST_LINES = 250_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(source, key, pages, of_pages): lines that more than ratio of the host's pages contain, and least_pages of them at least.

    A line counts once a page (row); blank lines and null texts have no lines, but null texts count as pages. Rows of
    null source are pages of one more host.
    """
    pages = docs.select(F.col("source").alias("source"), F.col("text").alias("text"))
    totals = pages.groupBy("source").agg(F.count("*").alias("of_pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("source", F.explode(keys).alias("key")).groupBy("source", "key").agg(F.count("*").alias("pages"))
    often = counts.where(F.col("pages") >= least_pages)
    joined = often.join(totals.withColumnRenamed("source", "_host"), F.col("source").eqNullSafe(F.col("_host")))
    return joined.where(F.col("pages") > F.lit(ratio) * F.col("of_pages")).select("source", "key", "pages", "of_pages")


def _with_gone(docs: DataFrame, found: DataFrame, few: bool, gone: str) -> DataFrame:
    """docs with column gone, the keys of the lines to drop from a page or its host.

    A few lines go to all pages by host. Of many, only keys and ids move until it is known which go from which page,
    and the join that finds it may be split at hot lines.
    """
    host, row, line = (unused(docs, c) for c in ("_source", "_id", "_key"))
    own = F.col("source").eqNullSafe(F.col(host))
    if few:
        by_host = found.groupBy(F.col("source").alias(host)).agg(F.collect_set("key").alias(gone))
        return docs.join(F.broadcast(by_host), own, "left").drop(host)
    keyed = docs.select(F.col("source").alias(host), F.col("doc_id").alias(row), F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias(line))
    hit = keyed.join(found, F.col(host).eqNullSafe(F.col("source")) & (F.col(line) == F.col("key")))
    by_page = hit.groupBy(host, row).agg(F.collect_set(line).alias(gone))
    return docs.join(by_page, F.col("doc_id").eqNullSafe(F.col(row)) & own, "left").drop(host, row)


def drop_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Every row of docs with its text less the boilerplate lines, and columns n_lines and n_dropped (replaced if there).

    The kept lines stay in order, with blank ones, joined by line breaks. A page all of whose lines that aren't blank
    are boilerplate repeats as a whole, which is for document dedup to judge: it keeps its text. Null texts stay null,
    with no lines; an empty text is one blank line. Rows that repeat are pages of their own, and an empty table gives
    none. Other columns stay as they are, whatever their names.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    found = cut(boilerplate(docs, ratio, least_pages).select("source", "key"))
    text, gone, left = F.col("text"), unused(docs, "_gone"), unused(docs, "_kept")
    both = _with_gone(docs, found, found.count() <= BROADCAST_LINES, gone)
    lines = _lines(text)
    kept = F.when(F.col(gone).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(gone), _key(x))))
    whole = F.exists(kept, lambda x: F.trim(x) != "")
    out = both.withColumn(left, F.when(whole, kept).otherwise(lines))
    n = lambda c: F.when(text.isNull(), F.lit(0)).otherwise(F.size(c))
    sized = out.withColumn("n_lines", n(lines).cast("long")).withColumn("n_dropped", (n(lines) - n(F.col(left))).cast("long"))
    return sized.withColumn("text", F.when(F.col("n_lines") > 0, F.concat_ws("\n", left))).drop(left, gone)


def without_boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """docs with the same columns and rows, boilerplate lines gone from text; n_chars, if there, follows the text."""
    own = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    back = {v: k for k, v in own.items()}
    names = [own.get(c, c) for c in docs.columns]
    out = drop_lines(docs.withColumnsRenamed(own), ratio, least_pages)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")))
    return out.select(*map(quoted, names)).withColumnsRenamed(back)


def summary(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): kept_sha256 is lowercase hex over the UTF-8 of the text that is left (null: null)."""
    return drop_lines(docs.select("doc_id", "source", "text"), ratio, least_pages).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same in DuckDB's SQL.
ORACLE = f"""
WITH pages AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
each AS (SELECT DISTINCT doc_id, source, trim(unnest(lines)) AS line FROM pages),
often AS (SELECT e.source, e.line FROM each e JOIN totals t ON e.source IS NOT DISTINCT FROM t.source WHERE line <> ''
  GROUP BY e.source, e.line, t.n HAVING count(*) >= {LEAST_PAGES} AND count(*) > {RATIO} * t.n),
gone AS (SELECT p.doc_id, list(o.line) AS gone FROM pages p JOIN often o ON o.source IS NOT DISTINCT FROM p.source AND list_contains(list_transform(p.lines, lambda x: trim(x)), o.line) GROUP BY p.doc_id),
kept AS (SELECT p.*, list_filter(p.lines, lambda x: NOT coalesce(list_contains(g.gone, trim(x)), false)) AS kept FROM pages p LEFT JOIN gone g USING (doc_id)),
whole AS (SELECT *, CASE WHEN len(list_filter(kept, lambda x: trim(x) <> '')) > 0 THEN kept ELSE lines END AS own FROM kept)
"""
ORACLE_SUMMARY = ORACLE + """
SELECT doc_id, len(lines) AS n_lines, len(lines) - len(own) AS n_dropped, CASE WHEN text IS NOT NULL THEN sha256(array_to_string(own, chr(10))) END AS kept_sha256 FROM whole
"""
