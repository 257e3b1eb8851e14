"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units become typed placeholders, the rest lower-case words. Numbers are digits and number words; names
are capitalised words that aren't common ones, at the start of a sentence too; units follow a number. The windows of the
templates of documents and benchmark items are hash-joined. Windows with the same values, or without any, match
as they are. Where others match on one diagonal (the same shift between document and item), it must fill the item's
slots consistently: each value in the item stands for one value in the document, as it does where a question was given
other parameters. Only hashes of windows are compared; texts are not exchanged at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chanspark.llm.common import cut, unused

#: Words of a window, the least number of them that aren't placeholders (with fewer its values must be equal), and windows of an item that must be found.
WINDOW, LITERALS, FOUND = 8, 5, 6
#: Windows of items up to this number are broadcast (28 bytes or so each, and the words of those with few literals); more are joined by exchange.
BROADCAST_WINDOWS = 1_000_000

#: Marks of numbers, names and units and of a sign within a number (private characters).
NUMBER, NAME, UNIT, WITHIN = "\ue000", "\ue001", "\ue002", "\ue003"
#: Words that are numbers, words that are units after a number, and capitalised words that are no names.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty "
    "sixty seventy eighty ninety hundred thousand million billion half dozen once twice first second third fourth fifth sixth seventh eighth ninth tenth"
)
UNITS = (
    "mm cm km m mg kg g t ml l s ms min h millimetre millimetres millimeter millimeters centimetre centimetres centimeter centimeters metre metres meter meters "
    "kilometre kilometres kilometer kilometers milligram milligrams gram grams kilogram kilograms ton tons tonne tonnes millilitre millilitres milliliter milliliters "
    "litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years mile miles foot feet inch inches yard yards "
    "pound pounds ounce ounces gallon gallons dollar dollars euro euros cent cents percent degree degrees mph kmh"
)
NO_NAMES = (
    "a an the this that these those there here he she it they we you i his her its their our your my him them us me who whom whose which what when where why how "
    "if in on at of to for from by with as and or but not no so then than after before during until while since because although though each every all any some many "
    "much most more both either neither another other is are was were be been am do does did has have had can could will would shall should may might must let "
    "find compute calculate determine add take give suppose assume consider show prove write name list choose select explain describe solve note now today yes"
)


def _one_of(words: str) -> str:
    return words.replace(" ", "|")


def _by_letter(words: str) -> str:
    """A pattern for any of the words that are whole; it looks at the first letter, and then only at words that begin with it."""
    rest: dict[str, list[str]] = {}
    for w in words.split():
        rest.setdefault(w[0], []).append(w[1:])
    return f"(?=[{''.join(sorted(rest))}])({'|'.join(f'{a}(?:{_one_of(' '.join(r))})' for a, r in sorted(rest.items()))})"


def _valued(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys..., v): lower-case words by single spaces, in which a placeholder is followed by the value it stands for.

    One projection a step, each used once or by name, so that no step is worked out twice. Words are told apart with a
    space on both sides of each, which are made single at last.
    """
    numbers = F.col("text")
    for _ in range(2):
        numbers = F.regexp_replace(numbers, "([0-9])[.,:/]([0-9])", f"$1{WITHIN}$2")
    numbers = F.regexp_replace(numbers, f"([0-9][0-9{WITHIN}]*)", f" {NUMBER}$1 ")
    step = texts.select(*keys, F.when(F.col("text").rlike("[0-9]"), numbers).otherwise(F.col("text")).alias("v"))
    step = step.select(*keys, F.regexp_replace("v", "(^|[^\\p{L}\\p{N}])(\\p{Lu}\\p{Ll})", f"$1{NAME}$2").alias("v"))
    step = step.select(*keys, F.regexp_replace(F.lower("v"), f"[^\\p{{L}}\\p{{N}}{NUMBER}-{WITHIN}]+", "  ").alias("v"))
    v = F.concat(F.lit(" "), F.col("v"), F.lit(" "))
    v = F.regexp_replace(v, f" {NAME}?{_by_letter(NUMBER_WORDS)} ", f" {NUMBER}$1 ")
    v = F.regexp_replace(v, f" {NAME}{_by_letter(NO_NAMES)} ", " $1 ")
    step = step.select(*keys, v.alias("v"))
    units = F.regexp_replace("v", f"({NUMBER}[^ ]+)  {_by_letter(UNITS)} ", f"$1  {UNIT}$2 ")
    step = step.select(*keys, F.when(F.contains("v", F.lit(NUMBER)), units).otherwise(F.col("v")).alias("v"))
    return step.select(*keys, F.trim(F.replace("v", F.lit("  "), F.lit(" "))).alias("v"))


SLOT = f"[{NUMBER}-{UNIT}]"


def _windows(texts: DataFrame, keys: tuple[str, ...], sizes: list[int]) -> DataFrame:
    """(keys..., size, at, h, values): each window's first word, the hash of its template, and its text's words if any is a placeholder."""
    marked = _valued(texts, *keys).select(*keys, "v", F.col("v").rlike(SLOT).alias("has"))
    plain = F.when(F.col("has"), F.regexp_replace("v", f"({SLOT})[^ ]+", "$1")).otherwise(F.col("v"))
    size = F.explode(F.array(*map(F.lit, sizes))) if len(sizes) > 1 else F.lit(sizes[0])
    words = marked.select(*keys, F.when(F.col("has"), F.split("v", " ")).alias("values"), F.split(plain, " ").alias("t"), size.alias("size"))
    whole = (F.size("t") >= F.col("size")) & (F.element_at("t", 1) != "")
    hashed = words.select(*keys, "size", "values", F.when(whole, F.transform("t", lambda w: F.xxhash64(w))).alias("t"))
    # Rows of windows are made within generated code, up to the join: none of them gets a copy of its document's words.
    placed = hashed.select(*keys, "size", "values", "t", F.explode(F.when(F.col("t").isNotNull(), F.sequence(F.lit(1), F.size("t") - F.col("size") + 1))).alias("at"))
    own = {s: F.xxhash64(F.lit(s), *[F.get("t", F.col("at") + (k - 1)) for k in range(s)]) for s in sizes}
    return placed.select(*keys, "size", "at", F.coalesce(*[F.when(F.col("size") == s, h) for s, h in own.items()]).alias("h"), "values")


def _slots(values: str, at: str, size: str) -> Column:
    """The values of a window's placeholders, in order; null without any."""
    own = F.filter(F.slice(values, F.col(at), F.col(size)), lambda x: x.rlike("^" + SLOT))
    return F.when(F.size(own) > 0, own)


def _items(benchmark: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """Windows of the items, and how many an item has; an item with fewer words than a window is one window of its own size."""
    own = benchmark.select("item_id", "text", F.monotonically_increasing_id().alias("item_row")).where(F.col("text").isNotNull())
    sized = _valued(own.withColumn("own", F.col("text")), "item_id", "item_row", "own").select("item_id", "item_row", F.col("own").alias("text"), F.size(F.split("v", " ")).alias("_words"), F.length("v").alias("_length"))
    short = sized.where((F.col("_words") < window) & (F.col("_length") > 0)).select("_words").distinct().collect()  # fewer than `window` rows
    sizes = sorted({r["_words"] for r in short}) + [window]
    parts = [_windows(sized.where((F.col("_words") == s) if s < window else (F.col("_words") >= window)), ("item_id", "item_row"), [s]) for s in sizes]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found, sizes


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, least: int = FOUND) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots): the documents in which an item is found, one row for each such pair.

    An item (item_id, text) is found if `least` of its windows, or all if it has fewer, match with equal values, or on
    diagonals whose slots are consistent; windows with fewer than `literals` words that aren't placeholders (of shorter
    items, with any placeholder) match with equal values only. As other values may have been given to an item, it is
    found as well if that holds of its other windows. n_windows counts those windows once, n_slots the values of
    placeholders in them. Null or empty texts match nothing. Rows are judged one by one: of rows that repeat a doc_id or
    an item_id each must hold the item by itself, and the largest numbers are shown once; null ids are ids too.
    """
    windows, sizes = _items(benchmark, window)
    windows = windows.withColumn("slots", _slots("values", "at", "size"))
    literal = F.col("size") - F.coalesce(F.size("slots"), F.lit(0)) >= F.least(F.lit(literals), F.col("size"))
    exact = F.when(~literal, F.slice("values", F.col("at"), F.col("size")))
    items = cut(windows.select("item_id", "item_row", literal.alias("free"), "size", F.col("at").alias("item_at"), F.col("h").alias("item_h"), F.col("slots").alias("item_slots"), exact.alias("item_words")))
    n_free = F.count_if("free")
    of = (F.least(F.count("*"), F.lit(least)).alias("needed"), F.when(n_free > 0, F.least(n_free, F.lit(least))).alias("needed_free"))
    needed = items.groupBy(F.col("item_row").alias("_item")).agg(*of)
    side = items.drop("size").withColumnRenamed("item_h", "h")
    if items.count() <= BROADCAST_WINDOWS:
        side = F.broadcast(side)
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("doc_row"), "text").where(F.col("text").isNotNull())
    met = _windows(own, ("doc_id", "doc_row"), sizes).join(side, "h").withColumn("slots", _slots("values", "at", "size"))
    # Spark makes this a condition of the join; a comparison of slots would take it, and the rows of windows, out of generated code.
    met = met.where(F.col("free") | F.slice("values", F.col("at"), F.col("size")).eqNullSafe(F.col("item_words")))
    pairs = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    # Overlapping windows repeat their pairs; sets keep what a diagonal holds within the size of its item.
    none = F.array().cast("array<struct<i:string,d:string>>")
    rows = ("doc_id", "doc_row", "item_id", "item_row")
    found = met.select(*rows, F.struct("item_at", "free").alias("place"), (F.col("at") - F.col("item_at")).alias("shift"), F.coalesce(pairs, none).alias("pairs"))
    equal = F.forall("pairs", lambda p: p["i"] == p["d"])
    side = lambda c: F.struct(F.collect_set(F.when(c, F.col("place"))).alias("places"), F.array_distinct(F.flatten(F.collect_set(F.when(c, F.col("pairs"))))).alias("pairs"))
    diagonals = found.groupBy(*rows, "shift").agg(side(F.lit(True)).alias("whole"), side(equal).alias("equal"))
    consistent = F.size("whole.pairs") == F.size(F.array_distinct(F.transform("whole.pairs", lambda p: p["i"])))
    counted = diagonals.select(*rows, F.when(consistent, F.col("whole")).otherwise(F.col("equal")).alias("own")).select(*rows, "own.*").where(F.size("places") > 0)
    kept = counted.groupBy(*rows).agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.max(F.size("pairs")).cast("long").alias("n_slots"))
    n = F.size("places")
    enough = (n >= F.col("needed")) | (F.size(F.filter("places", lambda p: p["free"])) >= F.col("needed_free"))
    judged = kept.join(needed, F.col("item_row") == F.col("_item")).where(enough)
    return judged.groupBy("doc_id", "item_id").agg(F.max(n).cast("long").alias("n_windows"), F.max("n_slots").alias("n_slots"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, least: int = FOUND) -> DataFrame:
    """The rows of docs in which no benchmark item is found, with their columns; all rows of a doc_id go if one does.

    Null doc_ids count as one doc_id; null and empty texts, and an empty benchmark, take nothing away.
    """
    name = unused(docs, "_found")
    found = matches(docs, benchmark, window, literals, least).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def _oracle_text(text: str) -> str:
    r = lambda s, a, b: f"regexp_replace({s}, '{a}', '{b}', 'g')"
    number = text
    for _ in range(2):
        number = r(number, "([0-9])[.,:/]([0-9])", f"\\1{WITHIN}\\2")
    number = r(number, f"([0-9][0-9{WITHIN}]*)", f" {NUMBER}\\1 ")
    names = r(number, "(^|[^\\p{L}\\p{N}])(\\p{Lu}\\p{Ll})", f"\\1{NAME}\\2")
    words = f"' ' || {r(f'lower({names})', f'[^\\p{{L}}\\p{{N}}{NUMBER}-{WITHIN}]+', '  ')} || ' '"
    words = r(words, f" {NAME}?({_one_of(NUMBER_WORDS)}) ", f" {NUMBER}\\1 ")
    words = r(words, f" {NAME}({_one_of(NO_NAMES)}) ", " \\1 ")
    return f"trim(replace({r(words, f'({NUMBER}[^ ]+)  ({_one_of(UNITS)}) ', f'\\1  {UNIT}\\2 ')}, '  ', ' '))"


#: The same in DuckDB's SQL; windows are compared as strings.
ORACLE_MATCHES = f"""
WITH dv AS (SELECT doc_id, row_number() OVER () AS doc_row, string_split({_oracle_text("text")}, ' ') AS v FROM documents WHERE text IS NOT NULL),
bv AS (SELECT *, least({WINDOW}, len(v)) AS size FROM (SELECT item_id, row_number() OVER () AS item_row, string_split({_oracle_text("text")}, ' ') AS v FROM benchmark WHERE text IS NOT NULL) WHERE v <> ['']),
sizes AS (SELECT DISTINCT size FROM bv),
dp AS (SELECT doc_id, doc_row, size, v, string_split(regexp_replace(array_to_string(v, ' '), '([{NUMBER}-{UNIT}])[^ ]+', '\\1', 'g'), ' ') AS t, unnest(range(1, len(v) - size + 2)) AS pos FROM dv CROSS JOIN sizes WHERE v <> ['']),
bp AS (SELECT item_id, item_row, size, v, list_transform(v, lambda x: regexp_replace(x, '([{NUMBER}-{UNIT}]).+', '\\1')) AS t, unnest(range(1, len(v) - size + 2)) AS pos FROM bv),
dt AS (SELECT doc_id, doc_row, size, v, pos, array_to_string(t[pos:pos + size - 1], ' ') AS w FROM dp),
bw AS (SELECT item_id, item_row, size, pos, array_to_string(t[pos:pos + size - 1], ' ') AS w, list_filter(v[pos:pos + size - 1], lambda x: regexp_matches(x, '^[{NUMBER}-{UNIT}]')) AS slots FROM bp),
bl AS (SELECT *, size - len(slots) >= least({LITERALS}, size) AS free FROM bw),
needed AS (SELECT item_row, least(count(*), {FOUND}) AS needed, CASE WHEN count(*) FILTER (free) > 0 THEN least(count(*) FILTER (free), {FOUND}) END AS needed_free FROM bl GROUP BY item_row),
dw AS (SELECT doc_id, doc_row, size, pos, w, list_filter(v[pos:pos + size - 1], lambda x: regexp_matches(x, '^[{NUMBER}-{UNIT}]')) AS slots FROM dt WHERE (w, size) IN (SELECT (w, size) FROM bl)),
met AS (SELECT doc_id, doc_row, item_id, item_row, b.pos AS place, d.pos - b.pos AS shift, free, b.slots = d.slots AS same, list_zip(b.slots, d.slots) AS pairs FROM dw d JOIN bl b USING (w, size) WHERE free OR b.slots = d.slots),
flat AS (SELECT doc_row, item_row, shift, same, unnest(pairs) AS p FROM met),
slots AS (SELECT doc_row, item_row, shift, count(DISTINCT p) = count(DISTINCT p[1]) AS agree, count(DISTINCT p) AS n, count(DISTINCT p) FILTER (same) AS n_same FROM flat GROUP BY ALL),
kept AS (SELECT m.*, CASE WHEN coalesce(s.agree, true) THEN coalesce(s.n, 0) ELSE s.n_same END AS n FROM met m LEFT JOIN slots s ON s.doc_row = m.doc_row AND s.item_row = m.item_row AND s.shift = m.shift WHERE coalesce(s.agree, true) OR same),
judged AS (SELECT doc_id, item_id, count(DISTINCT place) AS n_windows, max(n) AS n_slots FROM kept JOIN needed USING (item_row) GROUP BY doc_row, item_row, doc_id, item_id, needed, needed_free
  HAVING count(DISTINCT place) >= needed OR count(DISTINCT place) FILTER (free) >= needed_free)
SELECT doc_id, item_id, max(n_windows) AS n_windows, max(n_slots) AS n_slots FROM judged GROUP BY doc_id, item_id
"""
