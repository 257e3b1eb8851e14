"""Sharding by histogram sort, with DataFrame functions only.

Rows are put in the order of (hash of the text, doc_id), in which equal texts are neighbours. The bytes below candidate
boundaries are counted exactly across all partitions, with a histogram of 4,096 probes at a time; each round refines the
probes in the buckets where a boundary has to lie, until every splitter is the very key at which its share of the bytes
is reached. What comes to the driver is a histogram of at most (shards x 4,096) buckets a round. Rows are then exchanged
once. A text that a third of all rows have is split by doc_id like any other run of rows, and rows that repeat text and
doc_id are split by their number at a boundary that falls among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chanspark.llm.common import cut, quoted, unused

SHARDS = 16
LAWS = ("bytes", "rows", "key")
#: Groups in which slots of a shard are numbered.
SLOT_GROUPS = 1024
#: The key's digits, the most significant first: part of the key, bits to its right, bits.
DIGITS = [("hash", s, 12) for s in (48, 36, 24, 12, 0)] + [(part, s, n) for part in ("high", "low") for s, n in ((20, 12), (8, 12), (0, 8))]
NULL_ID = -(1 << 63)


def _part(part: str) -> Column:
    """The hash has 60 bits; of the id the halves of 32 bits, the upper one moved so that it is not negative."""
    if part == "hash":
        return F.col("_hash")
    return F.shiftright("_id", 32) + (1 << 31) if part == "high" else F.col("_id").bitwiseAND(0xFFFFFFFF)


def _splitters(keys: DataFrame, goals: list[int]) -> list[tuple[int, int, int, int] | None]:
    """For each goal the first (hash, id) such that all keys up to it weigh more than goal; None if there is none.

    With it come how many rows of that key, which weigh the same, still fit below the goal, and how many there are.
    """
    found: dict[int, tuple[int, int, int, int]] = {}
    waiting: dict[tuple[int, ...], list[tuple[int, int]]] = {(): [(g, g) for g in sorted(set(goals))]}
    left = keys
    for at, (part, shift, bits) in enumerate(DIGITS):
        names = [f"_d{i}" for i in range(at + 1)]
        left = left.withColumn(names[-1], F.shiftrightunsigned(_part(part), shift).bitwiseAND((1 << bits) - 1))
        key = F.struct("_hash", "_id")
        counted = left.groupBy(*names).agg(F.sum("_weight").alias("n"), F.count("*").alias("copies"), F.min(key).alias("least"), F.max(key).alias("most")).collect()
        buckets: dict[tuple[int, ...], list] = {}
        for r in sorted(counted, key=lambda r: tuple(r[: at + 1])):
            buckets.setdefault(tuple(r[:at]), []).append(r)
        following: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for prefix, wanted in waiting.items():
            for goal, rest in wanted:
                for r in buckets.get(prefix, []):
                    if r["n"] > rest:
                        if r["least"] == r["most"]:
                            found[goal] = (*r["least"], rest * r["copies"] // r["n"], r["copies"])
                        else:
                            following.setdefault(tuple(r[: at + 1]), []).append((goal, rest))
                        break
                    rest -= r["n"]
        if not following:
            break
        waiting = following
        one_of = F.lit(False)
        for prefix in waiting:
            own = F.lit(True)
            for name, digit in zip(names, prefix, strict=True):
                own = own & (F.col(name) == digit)
            one_of = one_of | own
        left = left.where(one_of)
    return [found.get(g) for g in goals]


def _hash_of(text: Column) -> Column:
    """The upper 60 bits of the MD5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _group_of(row: Column) -> Column:
    """The group of an id in which slots are numbered."""
    return F.floor(F.conv(F.substring(F.md5(row.cast("string")), 1, 3), 16, 10).cast("int") / (4096 // SLOT_GROUPS)).cast("int")


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with column name: their number from 0 among those of the same keys, of which there are few.

    The rows are written, so that each has its partition for good; counts of (keys, partition) tell where each partition's
    numbers begin, so that a key that many rows have is numbered by many tasks.
    """
    part, of, begin, n = (unused(rows, c) for c in ("_part", "_in", "_begin", "_n"))
    fixed = cut(rows).withColumn(part, F.spark_partition_id())
    counts = fixed.groupBy(*keys, part).agg(F.count("*").alias(n))
    upto = F.sum(n).over(W.partitionBy(*keys).orderBy(part)) - F.col(n)
    begins = counts.select(*[F.col(k).alias(f"{of}{k}") for k in keys], F.col(part).alias(of), upto.alias(begin))
    same = F.col(part) == F.col(of)
    for k in keys:
        same = same & (F.col(k) == F.col(f"{of}{k}"))
    own = F.row_number().over(W.partitionBy(*keys, part).orderBy(part)) - 1
    # At most a row for each of the keys (fewer than shards) and partition.
    return fixed.withColumn(name, own).join(F.broadcast(begins), same).withColumn(name, F.col(name) + F.col(begin)).select(*map(quoted, rows.columns), name)


def _rendezvous(doc_id: Column, shards: int) -> Column:
    """The shard whose hash with doc_id is the largest: one more shard wins rows from others, but moves none between them."""
    tries = F.array(*[F.struct(F.xxhash64(doc_id, F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(shards)])
    return F.array_max(tries)["i"]


def assign(docs: DataFrame, shards: int = SHARDS, law: str = "bytes") -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (replaced if there), for every row.

    size is the UTF-8 bytes of the text plus 1; a null text has none, and the checksum of no bytes. Law `bytes`: a shard
    ends with the key at which its share of all bytes is passed, so sizes differ by about the largest row; `rows`: the
    same with one for each row, so counts are at most one apart; `key`: doc_id and the number of shards decide, and
    grown_shard is the shard if there is one more. slot counts a shard's rows from 0. Rows with the same text and doc_id are
    alike to the first two laws, so where a boundary falls among them it is any of them that go on. A null doc_id is below
    all others; an empty table has no rows. Other columns stay as they are, whatever their names.
    """
    if law not in LAWS or shards < 1:
        raise ValueError(f"law is one of {LAWS}, and there is at least one shard")
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    hashed, row, group, place, shard, of, begin = (unused(docs, c) for c in ("_hash", "_id", "_group", "_place", "_shard", "_of", "_begin"))
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumn("size", F.octet_length(text).cast("long") + 1).withColumn("text_crc32", F.crc32(text.cast("binary")))
    keyed = sized.withColumn(hashed, _hash_of(text)).withColumn(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    grown = F.lit(None).cast("int")
    if law == "key":
        placed = keyed.withColumn("shard", _rendezvous(F.col(row), shards))
        grown = _rendezvous(F.col(row), shards + 1)
    else:
        weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
        narrow = cut(keyed.select(F.col(hashed).alias("_hash"), F.col(row).alias("_id"), weight.alias("_weight")))
        total = narrow.agg(F.sum("_weight")).first()[0] or 0
        starts = [s for s in _splitters(narrow, [i * total // shards for i in range(1, shards)]) if s]
        key = F.struct(F.col(hashed).alias("h"), F.col(row).alias("i"))
        start = lambda s: F.struct(F.lit(s[0]).cast("long").alias("h"), F.lit(s[1]).cast("long").alias("i"))
        whole, among = [s for s in starts if not s[2]], [s for s in starts if s[2]]
        passed = [(key >= start(s)).cast("int") for s in whole] + [(key > start(s)).cast("int") for s in among]
        placed = keyed.withColumn("shard", sum(passed, F.lit(0)))
        if among:
            number, split = unused(docs, "_number"), F.lit(False)
            for s in among:
                split = split | (key == start(s))
            further = [((key == start(s)) & (F.col(number) >= s[2])).cast("int") for s in among]
            divided = _numbered(placed.where(split), [hashed, row], number).withColumn("shard", sum(further, F.col("shard"))).drop(number)
            placed = placed.where(~split).unionByName(divided)
    grouped = placed.withColumn(group, _group_of(F.col(row)))
    # At most shards x SLOT_GROUPS rows, whatever the input: where each group's slots begin.
    sizes = grouped.groupBy("shard", group).agg(F.count("*").alias("_n"))
    begins = sizes.select(F.col("shard").alias(shard), F.col(group).alias(of), (F.sum("_n").over(W.partitionBy("shard").orderBy(group)) - F.col("_n")).alias(begin))
    numbered = grouped.withColumn(place, F.row_number().over(W.partitionBy("shard", group).orderBy(row, hashed)))
    joined = numbered.join(F.broadcast(begins), (F.col("shard") == F.col(shard)) & (F.col(group) == F.col(of)))
    out = joined.withColumn("slot", F.col(begin) + F.col(place) - 1).withColumn("law", F.lit(law)).withColumn("grown_shard", grown)
    return out.select(*map(quoted, docs.columns), *made)


def summary(docs: DataFrame, shards: int = SHARDS, law: str = "bytes") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); the text stays where it is read, narrow rows are exchanged."""
    return assign(docs.select("doc_id", "text"), shards, law).drop("text")


#: The same in DuckDB's SQL, with the checksum written out from its polynomial.
ORACLE_SUMMARY = f"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size,
  ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h, coalesce(doc_id, {NULL_ID + 1} - 1) AS id FROM documents),
sums AS (SELECT doc_id, CAST(xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS BIGINT) AS text_crc32 FROM d, crc),
k AS (SELECT *, CAST(sum(size) OVER (ORDER BY h, id) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 3))::INTEGER // {4096 // SLOT_GROUPS} AS g FROM d),
s AS (SELECT *, CAST(len(list_filter(range(1, {SHARDS}), lambda i: upto > i * total // {SHARDS})) AS INTEGER) AS shard FROM k)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY g, id, h) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN sums USING (doc_id)
"""
