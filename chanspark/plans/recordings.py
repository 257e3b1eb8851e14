"""Queries of recordings as data sources, of literal bytes, of the state API, of reports, and of models of two stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.operators import bundle, grid, metrics, panes, reports, signal
from chanspark.plans.acquisition import PACKETS, packet_files, thousandths
from chanspark.plans.catalogue import register, table
from chanspark.plans.experiments import SPLIT, _vectors
from chanspark.plans.sensor import HOP, events
from chanspark.sources import frames, packet_source, packets, shared
from chanspark.streaming import engine, stateful


@register("""
SELECT vec_id AS sequence, 'c' || CAST(vec_id % 3 AS VARCHAR) AS label, vec_id / 2.0::DOUBLE AS pc_timestamp, CAST(-40 - vec_id % 7 AS INTEGER) AS rssi, 'session_1' AS session, 'quad2' AS quadrant, 'movement' AS path_label, 2 AS file_version,
  list_transform(embedding[1:8], lambda x: CAST(floor(x * 1000::FLOAT) AS INTEGER)) AS imag, list_transform(embedding[9:16], lambda x: CAST(floor(x * 1000::FLOAT) AS INTEGER)) AS real FROM embeddings
""")
def packet_source_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as packet files and read again as a data source, in splits at packets."""
    packet_source.register(spark)
    part = lambda at: F.transform(F.slice("embedding", at, 8), lambda x: thousandths(x).cast("smallint"))
    own = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("label"), (F.col("vec_id") / 2).alias("pc_timestamp"), F.col("vec_id").alias("sequence"), (-40 - F.col("vec_id") % 7).cast("int").alias("rssi"),
        F.lit(16).cast("long").alias("csi_len"), part(1).alias("imag"), part(9).alias("real"),
    )
    folder = shared.new_folder(spark, "recordings") + "/session_1/QUAD2/movement"
    own.write.format("packets").mode("append").save(folder)
    whole = lambda c: F.transform(c, lambda x: x.cast("int")).alias(c)
    found = spark.read.format("packets").option("splitBytes", 4096).load(folder).where("quadrant = 'quad2'")
    return found.select("sequence", "label", "pc_timestamp", "rssi", "session", "quadrant", "path_label", "file_version", whole("imag"), whole("real"))


def _little(value: Column, size: int) -> Column:
    """The bytes of an integer, the lowest first, in hexadecimal."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)])


@register("""
SELECT 'quad1/empty/e' || CAST(event_id AS VARCHAR) || '.bin' AS path, 0 AS pos, 'static' AS label, 1.5::DOUBLE AS pc_timestamp, 1.5::DOUBLE AS capture_timestamp, 0 AS esp_timestamp_us, 0 AS sequence, 1 AS packet_index, CAST(-(event_id % 90) AS INTEGER) AS rssi, CAST(event_id % 12 AS INTEGER) AS rate,
  [CAST(event_id % 300 AS INTEGER), -2] AS imag, [CAST(-(event_id % 77) AS INTEGER), 256] AS real, 1 AS file_version FROM events
""")
def literal_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of version 1, whose bytes are put together by Spark and not by the library's writer."""
    e = F.col("event_id")
    head = F.lit(b"CSIBIN1".hex() + "01000000" + "0600" + "000000000000f83f")
    fields = [_little(-(e % 90), 4), _little(e % 12, 4), _little(F.lit(6), 4), _little(F.lit(4), 4), _little(F.lit(2), 4)]
    body = [F.lit(b"static".hex()), _little(e % 300, 2), _little(F.lit(-2), 2), _little(-(e % 77), 2), _little(F.lit(256), 2)]
    files = events(spark, sf_dir).select(F.concat(F.lit("quad1/empty/e"), e.cast("string"), F.lit(".bin")).alias("path"), F.unhex(F.concat(head, *fields, *body)).alias("content"))
    whole = lambda c: F.transform(c, lambda x: x.cast("int")).alias(c)
    names = ["path", "pos", "label", "pc_timestamp", "capture_timestamp", "esp_timestamp_us", "sequence", "packet_index", "rssi", "rate"]
    return packets.decode(files).select(*names, whole("imag"), whole("real"), "file_version")


#: A frame of statistics and one of a sample as bytes on the wire, with their checksums.
STATS_FRAME = "4353493201022e00050000000000000001000000020000000300000004000000050000000600000007000800ed07"
SAMPLE_FRAME = "4353493201012000070000004600000000000000ce0b0600040003ff0280313d"


@register("""
WITH d AS (SELECT CAST(user_id % 8 AS VARCHAR) AS device, count(*) AS n FROM events GROUP BY 1)
SELECT device, n AS stats_frames, n AS sample_frames, n AS crc_errors, 5 * n AS timestamps, 1 * n AS csi_received, 4 * n AS queue_drops, 8 * n AS reserved, 7 * n AS sequences, [3.0::FLOAT, 2.0::FLOAT] AS imag, [-1.0::FLOAT, -128.0::FLOAT] AS real FROM d
""")
def literal_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and samples of literal bytes, and a third frame whose checksum is wrong."""
    damaged = SAMPLE_FRAME[:-1] + ("0" if SAMPLE_FRAME[-1] != "0" else "1")
    chunks = events(spark, sf_dir).select((F.col("user_id") % 8).cast("string").alias("device"), F.col("event_id").alias("chunk_index"), F.unhex(F.lit(STATS_FRAME + damaged + SAMPLE_FRAME)).alias("data"))
    found = frames.parse(chunks)
    stats = lambda c: F.sum(F.col("stats")[c]).alias(c)
    told = F.col("type") == "counters"
    counted = lambda c: F.max(F.when(told, F.col("counters")[c])).alias(c)
    return found.groupBy("device").agg(
        counted("stats_frames"), counted("sample_frames"), counted("crc_errors"), F.sum(F.when(F.col("type") == "stats", F.col("timestamp_us"))).alias("timestamps"), stats("csi_received"), stats("queue_drops"), stats("reserved"),
        F.sum(F.when(F.col("type") == "sample", F.col("sequence"))).alias("sequences"), F.first(F.when(F.col("type") == "sample", F.col("imag")), True).alias("imag"), F.first(F.when(F.col("type") == "sample", F.col("real")), True).alias("real"),
    )


@register(HOP + """, m AS (SELECT user_id, window_index, start_packet AS window_start, end_packet_exclusive AS window_end, avg(value) AS m FROM hop GROUP BY ALL),
g AS (SELECT *, greatest(1 - m / 500, 0) AS a, 0.4 AS b, (m / 500) * (m / 500) AS c FROM m)
SELECT CAST(user_id AS BIGINT) AS stream_id, 'decision' AS event, window_start, window_end, CASE WHEN a >= b AND a >= c THEN 'empty' WHEN b >= c THEN 'static_presence' ELSE 'movement' END AS raw_state FROM g
""")
def stateful_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine on the state API: windows of 20 packets in steps of 5, judged by their mean; every packet comes once more, late."""
    numbered = panes.numbered(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "sequence")
    own = numbered.select(F.col("user_id").cast("long").alias("stream_id"), "sequence", F.col("sequence").cast("double").alias("seconds"), F.array(F.col("value").cast("double")).alias("amplitude"))
    twice = own.withColumn("amplitude", F.explode(F.array(F.col("amplitude"), F.col("amplitude"))))
    judge = lambda x: [max(1 - x[0] / 500, 0.0), 0.4, (x[0] / 500) ** 2]
    settings = engine.Settings(1, [0.0], [1.0], [0], [0], judge, size=20, step=5, radius=0, width=1, context=0)
    return stateful.run(twice, settings).select("stream_id", "event", "window_start", "window_end", "raw_state")


@register("""
WITH p AS (SELECT user_id, value, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT *, unnest(range(-2, 3)) AS k FROM p),
near AS (SELECT a.user_id, a.pos, a.value, a.n, list(b.value ORDER BY k) AS v FROM q a JOIN p b ON a.user_id = b.user_id AND b.pos = least(greatest(a.pos + k, 0), a.n - 1) GROUP BY ALL),
m AS (SELECT user_id, pos, value, n, list_median(v) AS med FROM near),
dev AS (SELECT *, abs(value - med) AS dev FROM m),
dq AS (SELECT *, unnest(range(-2, 3)) AS k FROM dev),
s AS (SELECT a.user_id, a.pos, a.value, a.n, a.med, a.dev, list_median(list(b.dev)) AS mad FROM dq a JOIN dev b ON a.user_id = b.user_id AND b.pos = least(greatest(a.pos + k, 0), a.n - 1) GROUP BY ALL),
c AS (SELECT user_id, pos, n, CASE WHEN n >= 3 AND mad > 0 AND dev > 3 * 1.4826 * mad THEN med ELSE value END AS x FROM s),
cq AS (SELECT *, unnest(range(-1, 2)) AS k FROM c),
f AS (SELECT a.user_id, a.pos, avg(b.x) AS x FROM cq a JOIN c b ON a.user_id = b.user_id AND b.pos = least(greatest(a.pos + k, 0), a.n - 1) GROUP BY ALL)
SELECT CAST(user_id AS BIGINT) AS stream_id, pos, round(x, 6) AS x FROM f
""")
def filtered_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine's filters give for whole streams: Hampel of radius 2, then the mean of three."""
    own = panes.numbered(events(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    clean = signal.hampel(own, ["user_id"], ["pos"], "value", 2)
    smooth = signal.moving_average(clean, ["user_id"], ["pos"], "clean", 3, "nearest")
    return smooth.select(F.col("user_id").cast("long").alias("stream_id"), "pos", F.round("smooth", 6).alias("x"))


@register(f"""
WITH {PACKETS} SELECT vec_id AS sequence, path FROM p WHERE vec_id // 50 % 4 IN (1, 3) AND vec_id / 2 BETWEEN 20 AND 90
""")
def collection_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of two quadrants within the time of a collection."""
    found = packets.decode(packet_files(spark, sf_dir).where(packets.on_path(labels=["empty"], quadrants=["quad1", "quad3"])))
    return signal.in_collection(found, "pc_timestamp", 20, 90).select("sequence", "path")


@register("""
WITH s AS (SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean FROM events GROUP BY event_type),
r AS (SELECT row_number() OVER (ORDER BY n DESC, event_type) + 1 AS line, '| ' || event_type || ' | ' || CAST(n AS VARCHAR) || ' | ' || format('{:.3f}', mean) || ' |' AS text FROM s)
SELECT CAST(line AS INTEGER) AS line, text FROM r UNION ALL SELECT 0, '| event_type | n | mean |' UNION ALL SELECT 1, '| --- | --- | --- |'
""")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return reports.markdown(found.select("event_type", "n", "mean"), [F.desc("n"), F.asc("event_type")], 3)


@register("""
WITH c AS (SELECT d.lang, l.quality AS t, l.toxic AS p FROM labels l JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL),
a AS (SELECT lang, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM c GROUP BY lang),
f AS (SELECT lang, 2 * count(*) FILTER (t = 1 AND p = 1) / (count(*) FILTER (t = 1) + count(*) FILTER (p = 1)) AS f FROM c GROUP BY lang HAVING count(*) FILTER (t = 1) + count(*) FILTER (p = 1) > 0)
SELECT a.lang, accuracy, round(f, 8) AS positive_f1 FROM a LEFT JOIN f ON a.lang = f.lang
""")
def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary by language with the F1 of one class from the table of classes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").where("lang IS NOT NULL")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", F.col("quality").alias("true_class"), F.col("toxic").alias("predicted_class"), F.array(F.lit(0.5), F.lit(0.5)).alias("probability"))
    classes = grid.per_class_by(rows, ["lang"], [0, 1])
    summary = metrics.accuracy_by(rows, "true_class", "predicted_class", "lang").select("lang", F.round("accuracy", 8).alias("accuracy"))
    return reports.lookup(summary, classes.where(F.col("support") + F.col("guessed") > 0).withColumn("f1", F.round("f1", 8)), ["lang"], 1, "f1", "positive_f1")


#: One split on the best feature for a question of two answers: the threshold, what each side says, and that for the held-out vectors.
def _stage(name: str, answer: str, where: str) -> str:
    return f"""
{name}_l AS (SELECT seed, vec_id, {answer} AS y, test, f, x FROM l WHERE seed = 1 AND (test OR {where})),
{name}_c AS (SELECT f, y, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM {name}_l WHERE NOT test GROUP BY ALL),
{name}_t AS (SELECT f, sum(n * m) / sum(n) AS mean FROM {name}_c GROUP BY ALL),
{name}_f AS (SELECT f FROM {name}_c JOIN {name}_t USING (f) GROUP BY f ORDER BY sum(n * (m - mean) * (m - mean)) / (sum(n * v) + 1e-8) DESC, f LIMIT 1),
{name}_x AS (SELECT {name}_l.* FROM {name}_l JOIN {name}_f USING (f)),
{name}_v AS (SELECT x, y, count(*) AS n FROM {name}_x WHERE NOT test GROUP BY ALL),
{name}_d AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT DISTINCT x FROM {name}_v)),
{name}_s AS (SELECT d.x AS upto, (d.x + nx) / 2 AS threshold, y, sum(n) FILTER (v.x <= d.x) AS l, sum(n) FILTER (v.x > d.x) AS r FROM {name}_d d, {name}_v v WHERE nx IS NOT NULL GROUP BY ALL),
{name}_k AS (SELECT threshold FROM {name}_s GROUP BY threshold ORDER BY round(sum(l) - sum(coalesce(l, 0)::DOUBLE ** 2) / sum(l) + sum(r) - sum(coalesce(r, 0)::DOUBLE ** 2) / sum(r), 9), threshold LIMIT 1),
{name}_e AS (SELECT x <= threshold AS low, y, count(*) AS n FROM {name}_x, {name}_k WHERE NOT test GROUP BY ALL),
{name}_a AS (SELECT low, y AS says FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY n DESC, y) AS i FROM {name}_e) WHERE i = 1),
{name} AS (SELECT vec_id, says FROM {name}_x, {name}_k, {name}_a WHERE test AND low = (x <= threshold))"""


@register(f"""
WITH {SPLIT}, {_stage("one", "CASE WHEN label < 5 THEN 0 ELSE 1 END", "true")}, {_stage("two", "label % 5", "label >= 5")}
SELECT vec_id, CASE WHEN one.says = 0 THEN 'none' ELSE 'c' || CAST(two.says AS VARCHAR) END AS prediction FROM one JOIN two USING (vec_id)
""")
def two_stage_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fitted stages, each with the feature that is best for its question."""
    label = F.when(F.col("label") < 5, "none").otherwise(F.concat(F.lit("c"), (F.col("label") % 5).cast("string")))
    rows = _vectors(spark, sf_dir).withColumn("label", label)
    model = bundle.fit_two_stage(rows.where("part = 'train'"), "none", grid.Spec("stump", "tree", "decision_tree", {"max_depth": 1}, 1), ["none", "c0", "c1", "c2", "c3", "c4"])
    return model.predict(rows.where("part = 'test'").select("vec_id", "features")).select("vec_id", "prediction")
