"""Queries of signals, windows, channels and sources. Events stand for a packet stream, embeddings for channel vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.functions import arrays, naming
from chanspark.operators import channels, ranking, signal, windows
from chanspark.plans.catalogue import register, table

KEYS, ORDER = ["user_id"], ["ts", "event_id"]
W = "PARTITION BY user_id ORDER BY ts, event_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.channels_long(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label")


LONG = "long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
FISHER = f"""
WITH {LONG},
c AS (SELECT channel, label, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY ALL),
t AS (SELECT channel, sum(n * m) / sum(n) AS mean FROM c GROUP BY ALL),
f AS (SELECT channel, sum(n * (m - mean) * (m - mean)) / (sum(n * v) + 1e-12) AS score FROM c JOIN t USING (channel) GROUP BY ALL)
"""


@register(FISHER + "SELECT CAST(row_number() OVER (ORDER BY score DESC, channel) AS INTEGER) AS rank, CAST(channel AS INTEGER) AS channel, round(score, 8) AS score FROM f ORDER BY score DESC, channel LIMIT 10")
def fisher_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ranking.fisher_scores(long(spark, sf_dir), "label", "channel", "x")
    return ranking.top_k(scores, 10).select("rank", "channel", F.round("score", 8).alias("score"))


@register(FISHER + "SELECT CAST(channel AS INTEGER) AS channel, round(score, 8) AS score FROM f")
def fisher_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fisher_scores(long(spark, sf_dir), "label", "channel", "x").select("channel", F.round("score", 8).alias("score"))


@register("SELECT event_id, round(value - lag(value) OVER (" + W + "), 6) AS diff FROM events")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.first_difference(events(spark, sf_dir), KEYS, ORDER, "value").select("event_id", F.round("diff", 6).alias("diff"))


@register(f"SELECT event_id, round(avg(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events")
def moving_average_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.moving_average(events(spark, sf_dir), KEYS, ORDER, "value", 5).select("event_id", F.round("smooth", 6).alias("smooth"))


@register(f"SELECT event_id, round((coalesce(lag(value) OVER w, value) + value + coalesce(lead(value) OVER w, value)) / 3, 6) AS smooth FROM events WINDOW w AS ({W})")
def moving_average_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.moving_average(events(spark, sf_dir), KEYS, ORDER, "value", 3, "nearest").select("event_id", F.round("smooth", 6).alias("smooth"))


PADS = "unnest(range(CASE WHEN lag(1) OVER w IS NULL THEN -5 ELSE 0 END, CASE WHEN lead(1) OVER w IS NULL THEN 6 ELSE 1 END)) AS pad"


@register(f"""
WITH a AS (SELECT event_id, user_id, ts, value, {PADS} FROM events WINDOW w AS ({W})),
m AS (SELECT *, median(value) OVER ({W}, pad ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS med FROM a),
d AS (SELECT event_id, user_id, ts, value, med, abs(value - med) AS dev, {PADS} FROM m WHERE pad = 0 WINDOW w AS ({W})),
s AS (SELECT *, median(dev) OVER ({W}, pad ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mad FROM d),
n AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT event_id, round(CASE WHEN n >= 3 AND mad > 0 AND dev > 3 * 1.4826 * mad THEN med ELSE value END, 6) AS clean FROM s JOIN n USING (user_id) WHERE pad = 0
""")
def hampel_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.hampel(events(spark, sf_dir), KEYS, ORDER, "value").select("event_id", F.round("clean", 6).alias("clean"))


@register(f"""
WITH a AS (SELECT event_id, value, list(value) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM events),
m AS (SELECT *, list_median(near) AS med FROM a),
s AS (SELECT *, list_median(list_transform(near, lambda x: abs(x - med))) AS mad FROM m)
SELECT event_id, round(CASE WHEN mad > 0 AND abs(value - med) > 3 * 1.4826 * mad THEN med ELSE value END, 6) AS clean FROM s
""")
def hampel_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.hampel(events(spark, sf_dir), KEYS, ORDER, "value", edges="truncate").select("event_id", F.round("clean", 6).alias("clean"))


@register(f"""
WITH d AS (SELECT user_id, ((event_id - lag(event_id) OVER ({W})) % 4294967296 + 4294967296) % 4294967296 AS d FROM events)
SELECT user_id, count(*) AS packets, CAST(sum(CASE WHEN d > 1 AND d < 2147483648 THEN d - 1 ELSE 0 END) AS BIGINT) AS gaps FROM d GROUP BY user_id
""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.sequence_gaps(events(spark, sf_dir), KEYS, ORDER, "event_id")


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("s", F.col("us") / F.lit(1e6))


@register("""
WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s FROM events), r AS (SELECT user_id, count(*) AS n, max(s) - min(s) AS d FROM e WHERE s > 0 GROUP BY user_id)
SELECT user_id, round(CASE WHEN n >= 2 AND d > 0 THEN d ELSE 0.0 END, 3) AS duration, round(CASE WHEN n >= 2 AND d > 0 THEN (n - 1) / d ELSE 0.0 END, 9) AS rate FROM r
""")
def sampling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.sampling_rate(_seconds(events(spark, sf_dir)), KEYS, ORDER, "s")
    return found.select("user_id", F.round("duration", 3).alias("duration"), F.round("rate", 9).alias("rate"))


@register("""
WITH r AS (SELECT user_id, (count(*) - 1) / (max(epoch_us(ts)) / 1e6 - min(epoch_us(ts)) / 1e6) AS rate FROM events GROUP BY user_id HAVING count(*) >= 2 AND max(ts) > min(ts))
SELECT round(median(rate), 9) AS rate FROM r
""")
def dataset_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = signal.sampling_rate(_seconds(events(spark, sf_dir)), KEYS, ORDER, "s")
    return signal.dataset_rate(rates).select(F.round("rate", 9).alias("rate"))


@register("""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM events),
r AS (SELECT event_id, us, count(*) OVER w AS n, min(us) OVER w AS low FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n >= 2 AND us > low THEN (n - 1) / ((us - low) / 1e6) ELSE n END, 9) AS rate FROM r
""")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.rolling_rate(_seconds(events(spark, sf_dir)), KEYS, "us", 86_400_000_000).select("event_id", F.round("rate", 9).alias("rate"))


@register(f"""
WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS s, (event_id * 7919) % 100000 AS dev FROM events),
b AS (SELECT *, CASE WHEN dev < lag(dev) OVER ({W}) THEN 1 ELSE 0 END AS back FROM e),
p AS (SELECT *, CAST(sum(back) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM b)
SELECT event_id, epoch, round(first(s - dev / 1e6) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) + dev / 1e6, 3) AS capture FROM p
""")
def clock_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _seconds(events(spark, sf_dir)).withColumn("dev", F.pmod(F.col("event_id") * 7919, F.lit(100000)))
    return signal.clock_epochs(df, KEYS, ORDER, "dev", "s").select("event_id", "epoch", F.round("capture", 3).alias("capture"))


@register(f"""
SELECT event_id, round((0.2 * coalesce(lag(value, 2) OVER w, 0) + 0.3 * coalesce(lag(value) OVER w, 0) + 0.5 * value)
  / (CASE WHEN lag(value, 2) OVER w IS NULL THEN 0 ELSE 0.2 END + CASE WHEN lag(value) OVER w IS NULL THEN 0 ELSE 0.3 END + 0.5), 6) AS smooth FROM events WINDOW w AS ({W})
""")
def weighted_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.smoothing(events(spark, sf_dir), KEYS, ORDER, "value", [0.2, 0.3, 0.5]).select("event_id", F.round("smooth", 6).alias("smooth"))


@register("SELECT user_id, count(*) AS rows, CASE WHEN count(*) >= 20 THEN (count(*) - 20) // 5 + 1 ELSE 0 END AS windows FROM events GROUP BY user_id")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_counts(events(spark, sf_dir), KEYS, 20, 5)


HOP = f"""
WITH p AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT user_id, n, unnest(range(0, (n - 20) // 5 + 1)) AS window_index FROM (SELECT DISTINCT user_id, n FROM p WHERE n >= 20)),
hop AS (SELECT p.*, k.window_index, k.window_index * 5 AS start_packet, k.window_index * 5 + 20 AS end_packet_exclusive FROM p JOIN k ON p.user_id = k.user_id AND pos >= k.window_index * 5 AND pos < k.window_index * 5 + 20)
"""


@register(HOP + "SELECT event_id, pos, window_index, start_packet, end_packet_exclusive FROM hop")
def hop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hop(events(spark, sf_dir), KEYS, ORDER, 20, 5).select("event_id", F.col("pos").cast("long"), "window_index", "start_packet", "end_packet_exclusive")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = events(spark, sf_dir).where("user_id IS NOT NULL")  # as the join of streams and windows in SQL leaves them out
    return windows.describe(windows.hop(known, KEYS, [F.col(c).asc_nulls_last() for c in ORDER], 20, 5), KEYS, "value")


DESCRIBED = HOP + """, d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, window_index ORDER BY pos) AS d FROM hop),
f AS (SELECT user_id, window_index, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS peak_to_peak, sum(value * value) AS energy,
  avg(abs(d)) AS mean_abs_diff, max(abs(d)) AS max_abs_diff, sum(d * d) AS diff_energy, stddev_pop(d) AS std_diff, regr_slope(value, pos) AS slope FROM d GROUP BY ALL)
"""


@register(DESCRIBED + "SELECT user_id, window_index, " + ", ".join(f"round({c}, 5) AS {c}" for c in naming.DESCRIPTORS) + " FROM f")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir).select("user_id", "window_index", *[F.round(c, 5).alias(c) for c in naming.DESCRIPTORS])


@register(DESCRIBED + "SELECT user_id, window_index, list_transform([" + ", ".join(naming.DESCRIPTORS) + "], lambda x: round(x, 4)) AS features FROM f")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.feature_vectors(_described(spark, sf_dir), KEYS)
    return found.select("user_id", "window_index", F.transform("features", lambda x: arrays.rounded(x, 4)).alias("features"))


@register(HOP + """, c AS (SELECT user_id, window_index, event_type, count(*) AS n FROM hop GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_index ORDER BY n DESC, event_type) AS r FROM c)
SELECT user_id, window_index, max(CASE WHEN r = 1 THEN event_type END) AS dominant, max(n) / sum(n) AS purity, string_agg(event_type, '|' ORDER BY event_type) AS labels FROM r GROUP BY ALL
""")
def window_label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.label_summary(windows.hop(events(spark, sf_dir), KEYS, ORDER, 20, 5), KEYS, "event_type")


@register(f"WITH {LONG} SELECT CAST(channel AS INTEGER) AS channel, count(x) AS n, round(avg(x), 8) AS mean, round(var_pop(x), 8) AS variance, round(stddev_pop(x), 8) AS std, min(x) AS min, max(x) AS max, stddev_pop(x) > 1e-6 AS informative FROM long GROUP BY channel")
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.stats(long(spark, sf_dir)).select("channel", "n", *[F.round(c, 8).alias(c) for c in ("mean", "variance", "std")], "min", "max", "informative")


@register(f"""
WITH {LONG}, s AS (SELECT label, channel, stddev_pop(x) AS std FROM long GROUP BY ALL)
SELECT label, count(*) AS channels, count(*) FILTER (std = 0) AS zero_std, count(*) FILTER (std > 1e-6) AS informative, round(min(std), 8) AS min_std, round(median(std), 8) AS median_std, round(max(std), 8) AS max_std FROM s GROUP BY label
""")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = channels.stage_summary(channels.stats(long(spark, sf_dir), "label"), "label")
    return found.select("label", "channels", "zero_std", "informative", *[F.round(c, 8).alias(c) for c in ("min_std", "median_std", "max_std")])


@register(f"""
WITH {LONG}, s AS (SELECT channel, stddev_pop(x) AS std FROM long GROUP BY ALL), t AS (SELECT unnest([0.0, 0.05, 0.1, 0.12, 0.125, 0.13, 0.5])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (std > threshold) AS n FROM s CROSS JOIN t GROUP BY threshold
""")
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.above(channels.stats(long(spark, sf_dir)), "std", [0.0, 0.05, 0.1, 0.12, 0.125, 0.13, 0.5])


@register(f"""
WITH {LONG}, s AS (SELECT channel, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY ALL)
SELECT vec_id, CAST(channel AS INTEGER) AS channel, round((x - m) / sd, 6) AS z FROM long JOIN s USING (channel) WHERE sd > 1e-6
""")
def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(spark, sf_dir)
    return channels.apply_zscore(rows, channels.fit_zscore(rows)).select("vec_id", "channel", F.round("z", 6).alias("z"))


@register(f"""
WITH {LONG}, s AS (SELECT channel, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY ALL)
SELECT vec_id, CAST(channel AS INTEGER) AS channel, round((x - m) / (sd + 1e-8), 6) AS z FROM long JOIN s USING (channel)
""")
def zscores_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(spark, sf_dir)
    return channels.apply_zscore(rows, channels.fit_zscore(rows), arrays.EPS).select("vec_id", "channel", F.round("z", 6).alias("z"))


@register("""
WITH k AS (SELECT a.i AS a, b.i AS b FROM range(64) a(i) JOIN range(64) b(i) ON a.i < b.i)
SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(coalesce(abs(corr(embedding[a + 1]::DOUBLE, embedding[b + 1]::DOUBLE)), 0), 6) AS r FROM embeddings CROSS JOIN k GROUP BY a, b
""")
def channel_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.correlations(table(spark, sf_dir, "embeddings"), "embedding", 64).select("a", "b", F.round("r", 6).alias("r"))


@register()
def prune_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(threshold, channels, features) of several correlation thresholds."""
    pairs = channels.correlations(table(spark, sf_dir, "embeddings"), "embedding", 64).cache()
    rows = [(t, len(kept := channels.prune(pairs, list(range(64)), t)), len(naming.DESCRIPTORS) * len(kept)) for t in (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 0.95, 1.0)]
    pairs.unpersist()
    return spark.createDataFrame(rows, "threshold double, channels int, features int")


@register(FISHER + """, r AS (SELECT channel, score, row_number() OVER (ORDER BY score DESC, channel) AS rank FROM f)
SELECT CAST(channel // 11 AS INTEGER) AS channel, count(*) AS n, round(avg(score), 8) AS mean_score, round(max(score), 8) AS max_score, string_agg(['mean','std','min','max','peak_to_peak','energy','mean_abs_diff','max_abs_diff','diff_energy','std_diff','slope'][channel % 11 + 1], '|' ORDER BY ['mean','std','min','max','peak_to_peak','energy','mean_abs_diff','max_abs_diff','diff_energy','std_diff','slope'][channel % 11 + 1]) AS features FROM r WHERE rank <= 30 GROUP BY ALL
""")
def channel_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ranking.fisher_scores(long(spark, sf_dir), "label", "channel", "x")
    ranked = ranking.top_k(scores, 30).select("rank", "score", naming.feature_channel(F.col("channel")).alias("c"), naming.feature_name(F.col("channel")).alias("name")).withColumnRenamed("c", "channel")
    return channels.occurrence(ranked, 30).select("channel", "n", F.round("mean_score", 8).alias("mean_score"), F.round("max_score", 8).alias("max_score"), "features")


@register("""
SELECT vec_id, list_transform(range(1, 33), lambda i: round(sqrt(embedding[i]::DOUBLE ** 2 + embedding[i + 32]::DOUBLE ** 2), 6)) AS amplitude,
  list_transform(range(1, 33), lambda i: round(atan2(embedding[i]::DOUBLE, embedding[i + 32]::DOUBLE), 6)) AS phase FROM embeddings
""")
def amplitude_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    imag, real = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(arrays.amplitude(imag, real)).alias("amplitude"), rounded(arrays.phase(imag, real)).alias("phase"))


@register("SELECT vec_id, list_transform(range(0, 32), lambda i: embedding[2 * i + 1]) AS imag, list_transform(range(0, 32), lambda i: embedding[2 * i + 2]) AS real, [embedding[4], embedding[10], embedding[64]] AS picked FROM embeddings")
def deinterleave_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.every_second("embedding", 0).alias("imag"), arrays.every_second("embedding", 1).alias("real"), arrays.pick("embedding", [3, 9, 63, 99]).alias("picked"))


@register("""
WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: exp(x::DOUBLE)) AS e FROM embeddings)
SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 8)) AS p, ['empty', 'static_presence', 'movement'][list_position(e, list_max(e))] AS winner FROM e
""")
def softmax_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    step = table(spark, sf_dir, "embeddings").select("vec_id", arrays.normalised(arrays.softmax(scores)).alias("p"))
    return step.select("vec_id", F.transform("p", lambda x: F.round(x, 8)).alias("p"), arrays.winner("p").alias("winner"))


@register("SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS subcarrier, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def exploded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spark, sf_dir).withColumnRenamed("channel", "subcarrier")


@register("""
WITH p AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)
SELECT page_id, lower(p[2]) AS host, coalesce(nullif(regexp_replace(regexp_replace(p[-1], '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') AS name FROM p
""")
def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = naming.path_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.try_element_at(parts, F.lit(2))).alias("host"), naming.safe_name(F.try_element_at(parts, F.lit(-1))).alias("name"))


@register("SELECT event_id, CAST(event_id % 256 & 1 AS INTEGER) AS bandwidth, CAST((event_id % 256) >> 1 & 3 AS INTEGER) AS sig_mode, CAST((event_id % 256) >> 3 & 1 AS INTEGER) AS stbc, CAST((event_id % 256) >> 4 & 1 AS INTEGER) AS first_word_invalid, CAST((event_id % 256) >> 5 & 7 AS INTEGER) AS mcs_low FROM events")
def packet_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", naming.flags((F.col("event_id") % 256).cast("int")).alias("f")).select("event_id", "f.*")


@register("SELECT event_id, CAST(greatest(2, round_even(value, 0)) AS INTEGER) AS packets FROM events")
def seconds_to_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", naming.packets_of(F.col("value"), F.lit(1.0)).alias("packets"))


@register("""
WITH c AS (SELECT user_id, length(event_type) AS len, count(*) AS n, min({'ts': ts, 'e': event_id}) AS f FROM events GROUP BY ALL)
SELECT user_id, len AS modal, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1
""")
def modal_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.modal_length(events(spark, sf_dir).withColumn("len", F.length("event_type").cast("long")), KEYS, "len", ORDER)


@register("""
WITH f AS (SELECT source, lang, count(*) AS packets, max(n_chars) AS modal FROM documents GROUP BY ALL),
r AS (SELECT *, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr') THEN 'label' WHEN source IS NULL THEN 'path' WHEN packets = 0 THEN 'empty' WHEN modal IS NULL THEN 'vectors' WHEN modal <> 128 THEN 'length' WHEN packets < 20 THEN 'packets' END AS rejection_reason FROM f)
SELECT source, lang, packets, rejection_reason, rejection_reason IS NULL AS accepted FROM r
""")
def admission_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("packets"), F.max("n_chars").alias("modal"))
    named = files.withColumn("label", F.col("lang")).withColumn("session", F.col("source")).withColumn("quadrant", F.col("source"))
    return channels.admission(named, ["en", "de", "fr"], 20, 128).select("source", "lang", "packets", "rejection_reason", "accepted")


@register("SELECT vec_id, len(embedding) > 0 AND list_max(embedding) < 'inf'::FLOAT AS valid FROM embeddings")
def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.is_valid("embedding").alias("valid"))
