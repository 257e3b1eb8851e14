"""Queries of sources and streams: packet files, wire frames, text lines, paths, and inference from packets to states.

Vectors and events become the bytes, lines and paths that the sources read; what is read back must be what they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chanspark.functions import naming
from chanspark.plans.catalogue import register, table
from chanspark.plans.evaluation import probabilities
from chanspark.plans.sensor import HOP, events
from chanspark.sources import frames, packets
from chanspark.streaming import engine, machine

#: Vectors of a packet file.
IN_FILE = 50


def thousandths(x: Column) -> Column:
    """x * 1000 rounded down; the product is a float if x is one, where an integer factor would make it a double."""
    return F.floor(x * F.lit(1000).cast("float"))


def packet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each 50 vectors as a file of packets whose parts are the first eight values and the next eight, times 1000."""
    part = lambda at: F.transform(F.slice("embedding", at, 8), lambda x: thousandths(x).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / IN_FILE).alias("file"), "vec_id", part(1).alias("imag"), part(9).alias("real"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = [{"label": f"c{r.vec_id % 3}", "pc_timestamp": r.vec_id / 2, "sequence": r.vec_id, "rssi": -40 - r.vec_id % 7, "rate": 11, "channel": 6, "csi_len": 16, "imag": r.imag, "real": r.real} for r in frame.sort_values("vec_id").itertuples()]
        return pd.DataFrame([{"path": f"session_1/quad{key[0] % 4}/empty/f{key[0]}.bin", "content": packets.packet_bytes(own)}])

    return rows.groupBy("file").applyInPandas(run, "path string, content binary")


PACKETS = f"p AS (SELECT *, vec_id // {IN_FILE} AS file, 'session_1/quad' || CAST(vec_id // {IN_FILE} % 4 AS VARCHAR) || '/empty/f' || CAST(vec_id // {IN_FILE} AS VARCHAR) || '.bin' AS path FROM embeddings)"


@register(f"""
WITH {PACKETS} SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY vec_id) - 1 AS INTEGER) AS pos, 'c' || CAST(vec_id % 3 AS VARCHAR) AS label, vec_id AS sequence, CAST(-40 - vec_id % 7 AS INTEGER) AS rssi, 16 AS csi_len, 2 AS file_version,
  list_transform(embedding[1:8], lambda x: CAST(floor(x * 1000::FLOAT) AS INTEGER)) AS imag, list_transform(embedding[9:16], lambda x: CAST(floor(x * 1000::FLOAT) AS INTEGER)) AS real FROM p
""")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packets.decode(packet_files(spark, sf_dir))
    whole = lambda c: F.transform(c, lambda x: x.cast("int")).alias(c)
    return found.select("path", "pos", "label", "sequence", "rssi", F.col("csi_len").cast("int"), "file_version", whole("imag"), whole("real"))


@register(f"""
WITH {PACKETS}, f AS (SELECT path, file, count(*) AS n FROM p GROUP BY ALL)
SELECT path, CASE WHEN file % 3 = 0 THEN 0 ELSE n END AS packets, CASE WHEN file % 3 = 0 THEN 1 ELSE 0 END AS errors FROM f
""")
def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file is cut short: it gives a row with its error and no packets."""
    files = packet_files(spark, sf_dir)
    number = F.regexp_extract("path", "f([0-9]+)[.]bin$", 1).cast("long")
    damaged = files.withColumn("content", F.when(number % 3 == 0, F.substring("content", 1, 40)).otherwise(F.col("content")))
    return packets.decode(damaged, "report").groupBy("path").agg(F.count("pos").alias("packets"), F.count("error").alias("errors"))


@register(f"WITH {PACKETS} SELECT path, round(avg(-40 - vec_id % 7), 8) AS mean_rssi, count(*) AS packets FROM p GROUP BY path")
def mean_rssi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.decode(packet_files(spark, sf_dir)).groupBy("path").agg(F.round(F.avg("rssi"), 8).alias("mean_rssi"), F.count("*").alias("packets"))


@register(f"""
WITH {PACKETS} SELECT path AS source_file, CAST(row_number() OVER (ORDER BY path, vec_id) - 1 AS BIGINT) AS place, vec_id AS sequence FROM p
""")
def concatenated_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of all files as one sequence, in order of path and place, each with the file that it is from."""
    found = packets.concatenated(packets.decode(packet_files(spark, sf_dir)))
    return found.select(F.col("path").alias("source_file"), "place", "sequence")


@register("""
WITH e AS (SELECT event_id, ['empty', 'Static', 'presence', 'movement', 'other'][event_id % 5 + 1] AS folder, ['x', 'movement_1', 'static_a', 'empty', 'z'][event_id % 4 + 1] AS start, event_id % 3 AS q FROM events)
SELECT event_id, CASE lower(folder) WHEN 'empty' THEN 'empty' WHEN 'static' THEN 'static_presence' WHEN 'presence' THEN 'static_presence' WHEN 'movement' THEN 'movement' ELSE CASE start WHEN 'movement_1' THEN 'movement' WHEN 'static_a' THEN 'static_presence' WHEN 'empty' THEN 'empty' END END AS label,
  CASE WHEN q > 0 THEN 'quad' || CAST(q AS VARCHAR) END AS quadrant, coalesce(CASE WHEN q > 0 THEN 'quad' || CAST(q AS VARCHAR) END, '') || '|' || folder AS stratum, CAST(least(event_id % 128 // 32, 3) AS INTEGER) AS block FROM e
""")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chanspark.functions import arrays

    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    folder, start, q = at(["empty", "Static", "presence", "movement", "other"], 5), at(["x", "movement_1", "static_a", "empty"], 4), F.col("event_id") % 3
    path = F.concat(F.lit("data/"), F.when(q > 0, F.concat(F.lit("QUAD"), q.cast("string"))).otherwise("room"), F.lit("\\"), folder, F.lit("/"), start)
    quadrant = naming.part_starting(path, "quad")
    return events(spark, sf_dir).select("event_id", naming.label_of_path(path).alias("label"), quadrant.alias("quadrant"), naming.stratum(quadrant, folder).alias("stratum"), arrays.block_of(F.col("event_id") % 128, 128).alias("block"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as wire frames of devices, with a byte of noise before each and every tenth frame damaged; a frame is dealt to two chunks."""
    own = events(spark, sf_dir).select("event_id", (F.col("user_id") % 8).cast("string").alias("device"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for event_id, device in batch.itertuples(index=False):
                values = np.array([event_id % 100, 1, 2, -3], np.int8).tobytes()
                raw = bytearray(b"\x00" + frames.frame(frames.SAMPLE, frames.SAMPLE_FIELDS.pack(event_id, 10 * event_id, -50, 11, 6, 0, len(values)) + values))
                if event_id % 10 == 0:
                    raw[-3] ^= 0xFF
                out += [(device, 2 * event_id, bytes(raw[:9])), (device, 2 * event_id + 1, bytes(raw[9:]))]
            yield pd.DataFrame(out, columns=["device", "chunk_index", "data"])

    return own.mapInPandas(run, "device string, chunk_index long, data binary")


@register("SELECT CAST(user_id % 8 AS VARCHAR) AS device, event_id AS sequence, 10 * event_id AS timestamp_us, [CAST(event_id % 100 AS FLOAT), 2::FLOAT] AS imag, [1::FLOAT, (-3)::FLOAT] AS real FROM events WHERE event_id % 10 <> 0")
def frame_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.parse(_chunks(spark, sf_dir)).where("type = 'sample'").select("device", "sequence", "timestamp_us", "imag", "real")


@register("SELECT CAST(user_id % 8 AS VARCHAR) AS device, count(*) FILTER (event_id % 10 <> 0) AS sample_frames, count(*) FILTER (event_id % 10 = 0) AS crc_errors FROM events GROUP BY 1")
def frame_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = frames.parse(_chunks(spark, sf_dir)).where("type = 'counters'")
    return last.select("device", *[F.col("counters")[c].alias(c) for c in ("sample_frames", "crc_errors")])


@register("""
WITH b AS (SELECT event_id, list_transform(range(0, length(event_type)), lambda i: ord(event_type[i + 1])) AS b FROM events),
bits AS (SELECT event_id, list_concat([65535], flatten(list_transform(b, lambda x: list_transform(range(7, -1, -1), lambda k: x >> k & 1)))) AS bits FROM b)
SELECT event_id, CAST(list_reduce(bits, lambda c, bit: CASE WHEN xor(c >> 15 & 1, bit) = 1 THEN xor(c << 1 & 65535, 4129) ELSE c << 1 & 65535 END) AS INTEGER) AS crc FROM bits
""")
def crc16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of every event's type."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"event_id": batch["event_id"], "crc": [frames.crc16(x.encode()) for x in batch["event_type"]]})

    return events(spark, sf_dir).select("event_id", "event_type").mapInPandas(run, "event_id long, crc int")


@register("""
SELECT event_id AS esp_timestamp_us, -50 AS rssi, 4 AS csi_len, [event_id % 90, 3] AS imag, [user_id % 50, 4] AS real,
  [round(sqrt((event_id % 90) ** 2 + (user_id % 50) ** 2), 6), 5.0] AS amplitude FROM events WHERE event_id % 4 <> 0
""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text lines; of every fourth one the length is wrong, so that it is left out."""
    values = F.concat_ws(",", (F.col("event_id") % 90).cast("string"), (F.col("user_id") % 50).cast("string"), F.lit("3"), F.lit("4"))
    line = F.concat_ws(",", F.lit("CSI"), F.col("event_id").cast("string"), F.lit("-50"), F.lit("11"), F.lit("6"), F.when(F.col("event_id") % 4 == 0, "9").otherwise("4"), values)
    found = packets.lines(events(spark, sf_dir).select(line.alias("value")))
    return found.select("esp_timestamp_us", F.col("rssi").cast("int").alias("rssi"), F.col("csi_len").cast("int").alias("csi_len"), "imag", "real", F.transform("amplitude", lambda x: F.round(x, 6)).alias("amplitude"))


@register(HOP + """, m AS (SELECT user_id, window_index, start_packet AS window_start, end_packet_exclusive AS window_end, avg(value) AS m FROM hop GROUP BY ALL),
g AS (SELECT *, greatest(1 - m / 500, 0) AS a, 0.4 AS b, (m / 500) * (m / 500) AS c FROM m)
SELECT CAST(user_id AS BIGINT) AS stream_id, window_start, window_end, CASE WHEN a >= b AND a >= c THEN 'empty' WHEN b >= c THEN 'static_presence' ELSE 'movement' END AS raw_state FROM g
""")
def streaming_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From packets to states: windows of 20 packets in steps of 5, judged by their mean."""
    numbered = events(spark, sf_dir).withColumn("sequence", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    own = numbered.select(F.col("user_id").cast("long").alias("stream_id"), "sequence", F.col("sequence").cast("double").alias("seconds"), F.array(F.col("value").cast("double")).alias("amplitude"))
    judge = lambda x: [max(1 - x[0] / 500, 0.0), 0.4, (x[0] / 500) ** 2]
    settings = engine.Settings(1, [0.0], [1.0], [0], [0], judge, size=20, step=5, radius=0, width=1, context=0)
    return engine.run(own, settings).select("stream_id", "window_start", "window_end", "raw_state")


WEIGHTED = "(0.2 * coalesce(lag({0}, 2) OVER w, 0) + 0.3 * coalesce(lag({0}) OVER w, 0) + 0.5 * {0}) / (CASE WHEN lag({0}, 2) OVER w IS NULL THEN 0 ELSE 0.2 END + CASE WHEN lag({0}) OVER w IS NULL THEN 0 ELSE 0.3 END + 0.5)"


@register(f"""
WITH RECURSIVE v AS (SELECT user_id, ts, event_id, greatest(1 - value / 500, 0) AS x, 0.4 AS y, (value / 500) * (value / 500) AS z FROM events),
n AS (SELECT user_id, ts, event_id, x / (x + y + z) AS x, y / (x + y + z) AS y, z / (x + y + z) AS z FROM v),
s AS (SELECT user_id, event_id, row_number() OVER w AS k, x, y, z, {WEIGHTED.format("x")} AS sx, {WEIGHTED.format("y")} AS sy, {WEIGHTED.format("z")} AS sz FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, CASE WHEN x >= y AND x >= z THEN 'empty' WHEN y >= z THEN 'static_presence' ELSE 'movement' END AS raw, CASE WHEN sx >= sy AND sx >= sz THEN 'empty' WHEN sy >= sz THEN 'static_presence' ELSE 'movement' END AS target, greatest(sx, sy, sz) AS chance FROM s),
r AS (
  SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, '' AS raw, '' AS target, 'empty' AS state, NULL::VARCHAR AS candidate, 0 AS n, false AS accepted FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, k, event_id, raw, target, CASE WHEN good AND m >= wanted THEN target ELSE state END, CASE WHEN good AND m < wanted THEN target END, CASE WHEN good AND m < wanted THEN m ELSE 0 END, good AND m >= wanted
  FROM (SELECT *, CASE WHEN candidate = target THEN n + 1 ELSE 1 END AS m FROM (
    SELECT r.user_id, d.k, d.event_id, d.raw, d.target, r.state, r.candidate, r.n, CASE WHEN d.target <> 'movement' AND r.state <> 'movement' THEN 2 ELSE 1 END AS wanted,
      d.target <> r.state AND d.chance >= CASE WHEN d.target <> 'movement' AND r.state <> 'movement' THEN 0.55 ELSE 0.5 END AS good FROM r JOIN d ON d.user_id = r.user_id AND d.k = r.k + 1)))
SELECT event_id, raw AS raw_state, target AS smoothed_state, state AS stable_state, candidate AS candidate_state, CAST(n AS BIGINT) AS candidate_count, accepted AS transition_accepted FROM r WHERE k > 0
""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine's decisions, step by step."""
    found = machine.replay(probabilities(spark, sf_dir), "user_id", ["ts", "event_id"], machine.config([0.2, 0.3, 0.5]), ["event_id"])
    return found.select("event_id", "raw_state", "smoothed_state", "stable_state", "candidate_state", "candidate_count", "transition_accepted")
