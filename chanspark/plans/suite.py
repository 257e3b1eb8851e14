"""Queries of the experiment suite: probabilities by class, diagnostics, selection policies, and preprocessing as one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.functions import arrays, naming
from chanspark.operators import channels, metrics, models, preprocessing, ranking, selection, windows
from chanspark.plans.catalogue import register, table
from chanspark.plans.evaluation import RUNS, S, _runs, scored
from chanspark.plans.sensor import FISHER, HOP, LONG, events, long

SCORES = """
p AS (SELECT vec_id, label % 3 AS y, list_transform(embedding[1:3], lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
q AS (SELECT vec_id, y, list_transform(e, lambda x: round(x / list_sum(e), 3)) AS p FROM p),
r AS (SELECT c, y = c AS pos, p[c + 1] AS s FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS c)),
"""
BY_CLASS = SCORES + """
g AS (SELECT c, s, count(*) AS n, count(*) FILTER (pos) AS p FROM r GROUP BY ALL),
w AS (SELECT *, sum(n) OVER o AS cn, sum(p) OVER o AS cp FROM g WINDOW o AS (PARTITION BY c ORDER BY s DESC)),
m AS (SELECT c AS class, CAST(sum(p) AS BIGINT) AS support, 1 - sum(p * (cn - cp) - p * (n - p) / 2) / (sum(p) * sum(n - p)) AS auc, sum(p * cp / cn) / sum(p) AS average_precision FROM w GROUP BY c)
"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = arrays.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("y"), F.transform(soft, lambda x: F.round(x, 3)).alias("p"))


@register("WITH " + BY_CLASS + "SELECT class, support, round(auc, 8) AS auc, round(average_precision, 8) AS average_precision FROM m")
def auc_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.one_vs_rest(_classified(spark, sf_dir), "y", "p", [0, 1, 2])
    return found.select(F.col("class").cast("long"), "support", F.round("auc", 8).alias("auc"), F.round("average_precision", 8).alias("average_precision"))


@register("WITH " + BY_CLASS + "SELECT round(avg(auc), 8) AS auc_macro, round(sum(auc * support) / sum(support), 8) AS auc_weighted, round(avg(average_precision), 8) AS average_precision_macro, round(sum(average_precision * support) / sum(support), 8) AS average_precision_weighted FROM m")
def auc_macro_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.macro_and_weighted(metrics.one_vs_rest(_classified(spark, sf_dir), "y", "p", [0, 1, 2]), ["auc", "average_precision"])
    return found.select(*[F.round(c, 8).alias(c) for c in found.columns])


@register("""
WITH p AS (SELECT vec_id, greatest(embedding[1]::DOUBLE, 0) AS a, greatest(embedding[2]::DOUBLE, 0) AS b FROM embeddings)
SELECT vec_id, CASE WHEN a + b > 0 THEN [round(b / (a + b), 8), 0.0, round(a / (a + b), 8)] ELSE [round(1 / 3, 8), round(1 / 3, 8), round(1 / 3, 8)] END AS p FROM p
""")
def aligned_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classes in another order than wanted, and one that is missing."""
    own = F.transform(F.slice("embedding", 1, 2), lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    both = metrics.aligned(own, ["movement", "empty"], ["empty", "static_presence", "movement"])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(both, lambda x: F.round(x, 8)).alias("p"))


@register(f"WITH {RUNS} SELECT lang, round(avg(accuracy), 8) AS accuracy_mean, round(stddev_pop(accuracy), 8) AS accuracy_std, round(min(accuracy), 8) AS accuracy_min, round(max(accuracy), 8) AS accuracy_max FROM r GROUP BY lang")
def summary_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.summarise(_runs(spark, sf_dir), ["lang"], ["accuracy"], extremes=True)
    return found.select("lang", *[F.round(c, 8).alias(c) for c in found.columns[1:]])


@register(f"""
WITH {S}, c AS (SELECT source, count(*) AS windows, count(*) FILTER (quality = toxic) AS correct, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1 FROM s GROUP BY source)
SELECT *, round(correct / windows, 8) AS accuracy, CASE WHEN predicted_0 >= predicted_1 THEN 0 ELSE 1 END AS majority FROM c
""")
def predicted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.predicted_counts(scored(spark, sf_dir), ["source"], "quality", "toxic", [0, 1]).withColumn("accuracy", F.round("accuracy", 8))


DESCRIPTOR_LIST = "[" + ", ".join(f"'{d}'" for d in naming.DESCRIPTORS) + "]"


@register(FISHER + f", r AS (SELECT channel, row_number() OVER (ORDER BY score DESC, channel) AS rank FROM f) SELECT {DESCRIPTOR_LIST}[channel % 11 + 1] AS name, count(*) AS n FROM r WHERE rank <= 30 GROUP BY ALL")
def feature_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.top_k(ranking.fisher_scores(long(spark, sf_dir), "label", "channel", "x"), 30)
    return best.groupBy(naming.feature_name(F.col("channel")).alias("name")).agg(F.count("*").alias("n"))


@register(FISHER + f""", v AS (SELECT channel, var_pop(x) AS v FROM long GROUP BY ALL), zero AS (SELECT count(*) FILTER (v < 1e-12) AS zero_variance FROM v)
SELECT zero_variance, count(*) FILTER (score > 0.01) AS above_01, count(*) FILTER (score > 0.1) AS above_10, round(max(score), 8) AS best, round(list_sort(list(score))[count(*) // 2 + 1], 8) AS upper_median FROM f CROSS JOIN zero GROUP BY zero_variance
""")
def feature_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero variances, counts above thresholds of the Fisher score, and its upper median; a row a channel is gathered."""
    rows = long(spark, sf_dir)
    scores = ranking.fisher_scores(rows, "label", "channel", "x").agg(F.count_if(F.col("score") > 0.01).alias("above_01"), F.count_if(F.col("score") > 0.1).alias("above_10"), F.round(F.max("score"), 8).alias("best"), F.array_sort(F.collect_list("score")).alias("all"))
    zero = channels.stats(rows).agg(F.count_if(F.col("variance") < 1e-12).alias("zero_variance"))
    return zero.crossJoin(scores).withColumn("upper_median", F.round(F.element_at("all", F.floor(F.size("all") / 2).cast("int") + 1), 8)).drop("all")  # one row each


@register("SELECT user_id, count(*) AS windows, round(avg(CASE WHEN value < 100 THEN 1 ELSE 0 END), 8) AS empty_ratio, round(avg(greatest(1 - value / 500, 0)), 8) AS mean_empty, count(*) >= 5 AND (avg(CASE WHEN value < 100 THEN 1 ELSE 0 END) >= 0.6 OR avg(greatest(1 - value / 500, 0)) >= 0.55) AS approved FROM events GROUP BY user_id")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether enough windows of a stream are empty, by count or by probability."""
    ratio, chance = F.avg((F.col("value") < 100).cast("int")), F.avg(F.greatest(1 - F.col("value") / 500, F.lit(0.0)))
    found = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("windows"), ratio.alias("r"), chance.alias("c"))
    return found.select("user_id", "windows", F.round("r", 8).alias("empty_ratio"), F.round("c", 8).alias("mean_empty"), ((F.col("windows") >= 5) & ((F.col("r") >= 0.6) | (F.col("c") >= 0.55))).alias("approved"))


@register("SELECT vec_id, round(list_avg(e), 8) AS mean, round(list_var_pop(e), 8) AS variance, round(list_stddev_pop(e), 8) AS std, round(list_sum(list_transform(e, lambda x: x * x)), 8) AS energy, list_max(e) AS max, list_min(e) AS min, list_max(e) - list_min(e) AS range FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def vector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each single vector, without taking it apart."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    step = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).withColumn("mean", arrays.total(F.col("e")) / F.size("e"))
    step = step.withColumn("variance", arrays.total(F.transform("e", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / F.size("e"))
    rounded = {"mean": F.col("mean"), "variance": F.col("variance"), "std": F.sqrt("variance"), "energy": arrays.total(F.transform("e", lambda x: x * x))}
    return step.select("vec_id", *[F.round(c, 8).alias(k) for k, c in rounded.items()], F.array_max("e").alias("max"), F.array_min("e").alias("min"), (F.array_max("e") - F.array_min("e")).alias("range"))


@register(HOP + """, c AS (SELECT user_id, window_index, event_type, count(*) AS n FROM hop GROUP BY ALL),
s AS (SELECT user_id, window_index, arg_max(event_type, (n, -ord(event_type[1]))) AS dominant, max(n) / sum(n) AS purity FROM c GROUP BY ALL)
SELECT user_id, window_index, purity FROM s WHERE purity >= 0.4
""")
def pure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of which one label has a share that is large enough."""
    found = windows.label_summary(windows.hop(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 20, 5), ["user_id"], "event_type")
    return found.where(F.col("purity") >= 0.4).select("user_id", "window_index", "purity")


@register("SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'empty' ELSE 'presence' END AS presence, CASE label % 3 WHEN 1 THEN 'static_presence' WHEN 2 THEN 'movement' END AS kind FROM embeddings")
def binary_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of both binary tasks: all windows as empty or presence, those with presence as static or movement."""
    name = F.element_at(F.array(*map(F.lit, arrays.CLASSES)), (F.col("label") % 3 + 1).cast("int"))
    step = table(spark, sf_dir, "embeddings").select("vec_id", name.alias("name"))
    return step.select("vec_id", F.when(F.col("name") == "empty", "empty").otherwise("presence").alias("presence"), F.when(F.col("name") != "empty", F.col("name")).alias("kind"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands stand for candidates, the first seven letters for a family, the number of parts for a budget."""
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.substring("p_brand", 1, 7).alias("family"), F.col("p_brand").alias("name")).agg(F.round(F.avg("p_retailprice"), 4).alias("score"), F.round(F.avg("p_size"), 4).alias("second"), F.round(F.stddev_pop("p_retailprice"), 4).alias("std"), F.count("*").alias("top_k"))


CANDIDATES = "k AS (SELECT p_brand[1:7] AS family, p_brand AS name, round(avg(p_retailprice), 4) AS score, round(avg(p_size), 4) AS second, round(stddev_pop(p_retailprice), 4) AS std, count(*) AS top_k FROM part GROUP BY ALL)"


@register(f"WITH {CANDIDATES} SELECT family, name || '_top' || CAST(b AS VARCHAR) AS name, CAST(b AS INTEGER) AS top_k FROM k CROSS JOIN (SELECT unnest([40, 80, 160]) AS b)")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_budgets(_candidates(spark, sf_dir).select("family", "name"), [40, 80, 160])


@register(f"WITH {CANDIDATES} SELECT name, score, second, std FROM k ORDER BY score DESC, second DESC, std, name LIMIT 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_by(_candidates(spark, sf_dir), F.desc("score"), F.desc("second"), F.asc("std"), F.asc("name")).select("name", "score", "second", "std")


@register(f"WITH {CANDIDATES}, v AS (SELECT *, second > 26 AS valid FROM k) SELECT name, second FROM v WHERE valid OR NOT (SELECT max(valid) FROM v)")
def valid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.valid_or_all(_candidates(spark, sf_dir), F.col("second") > 26).select("name", "second")


@register(f"WITH {CANDIDATES} SELECT name, second FROM k")
def no_valid_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.valid_or_all(_candidates(spark, sf_dir), F.col("second") > 1000).select("name", "second")


@register(f"""
WITH {CANDIDATES}, b AS (SELECT family, max((score, second)) AS b FROM k GROUP BY family),
n AS (SELECT k.*, row_number() OVER (PARTITION BY k.family ORDER BY top_k, score DESC, name) AS r FROM k JOIN b USING (family) WHERE score >= b[1] - 20 AND second >= b[2] - 20)
SELECT family, name, top_k, score FROM n WHERE r = 1
""")
def compact_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.compact(_candidates(spark, sf_dir), "family", ["score", "second"], 20, [F.asc("top_k"), F.desc("score"), F.asc("name")])
    return found.select("family", "name", "top_k", "score")


@register(f"""
WITH {CANDIDATES}, u AS (SELECT family, name, score, 'a' AS source FROM k UNION ALL SELECT family, name, second AS score, 'b' FROM k WHERE top_k > 60)
SELECT family, round(avg(score), 6) AS score, min(name) AS name, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM u GROUP BY family
""")
def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _candidates(spark, sf_dir)
    parts = [own.select("family", "name", "score", F.lit("a").alias("source")), own.where("top_k > 60").select("family", "name", F.col("second").alias("score"), F.lit("b").alias("source"))]
    return selection.merged(parts, ["family"], ["score"]).withColumn("score", F.round("score", 6))


@register(f"WITH {CANDIDATES} SELECT name, round(score - lag(score) OVER (ORDER BY name), 4) AS change FROM k")
def change_to_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.change(_candidates(spark, sf_dir), "name", "score").select("name", F.round("change", 4).alias("change"))


@register("SELECT doc_id, coalesce(nullif(source, ''), coalesce(lang, '') || '|' || CAST(doc_id AS VARCHAR)) AS group_id, sha256(coalesce(text, '')) AS content FROM documents")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", naming.group_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("group_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))


@register(HOP + "SELECT user_id, count(DISTINCT window_index) AS windows, count(DISTINCT window_index) < 3 AS low_window_count FROM hop GROUP BY user_id")
def low_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.window_counts(events(spark, sf_dir), ["user_id"], 20, 5).where("windows > 0")
    return found.select("user_id", "windows", (F.col("windows") < 3).alias("low_window_count"))


@register(f"""
WITH {LONG}, s AS (SELECT channel, avg(x) AS m, stddev_pop(x) AS sd FROM long GROUP BY ALL)
SELECT vec_id, list(round((x - m) / sd, 5) ORDER BY channel) AS z FROM long JOIN s USING (channel) WHERE sd > 1e-6 GROUP BY vec_id
""")
def preprocessing_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from all vectors with a threshold that keeps all channels, and applied to them."""
    rows = table(spark, sf_dir, "embeddings")
    found = preprocessing.transform(rows, "embedding", preprocessing.fit(rows, "embedding", 64, 1.0))
    return found.select("vec_id", F.transform("z", lambda x: arrays.rounded(x, 5)).alias("z"))


@register("""
WITH k AS (SELECT a.i AS a, b.i AS b FROM range(64) a(i) CROSS JOIN range(64) b(i)),
c AS (SELECT a, b, abs(corr(embedding[a + 1]::DOUBLE, embedding[b + 1]::DOUBLE)) AS r FROM embeddings CROSS JOIN k GROUP BY a, b),
m AS (SELECT list(coalesce(r, 0) ORDER BY a, b) AS m FROM c), t AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 0.95, 1.0])::DOUBLE AS threshold),
g AS (SELECT threshold, CASE WHEN threshold >= 1 THEN range(64) ELSE list_reduce(list_transform(range(64), lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda j: m[j * 64 + x[1] + 1] >= threshold)) > 0 THEN kept ELSE list_concat(kept, x) END) END AS kept FROM t CROSS JOIN m)
SELECT threshold, CAST(len(kept) AS INTEGER) AS channels, CAST(11 * len(kept) AS INTEGER) AS features FROM g
""")
def prune_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chanspark.plans.sensor import prune_sweep

    return prune_sweep(spark, sf_dir)


@register("""
WITH r AS (SELECT l_returnflag AS y, unnest([0, 1, 2, 3]) AS feature, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE, l_linenumber::DOUBLE]) AS x FROM lineitem),
v AS (SELECT feature, x, count(*) FILTER (y = 'A') AS a, count(*) FILTER (y = 'N') AS n, count(*) FILTER (y = 'R') AS r FROM r GROUP BY ALL),
s AS (SELECT feature, x, lead(x) OVER w AS nx, sum(a) OVER w AS la, sum(n) OVER w AS ln, sum(r) OVER w AS lr, sum(a) OVER o AS ta, sum(n) OVER o AS tn, sum(r) OVER o AS tr FROM v WINDOW w AS (PARTITION BY feature ORDER BY x), o AS (PARTITION BY feature)),
g AS (SELECT feature, (x + nx) / 2 AS threshold, round((la + ln + lr) - (la * la + ln * ln + lr * lr)::DOUBLE / (la + ln + lr) + (ta + tn + tr - la - ln - lr) - ((ta - la) ** 2 + (tn - ln) ** 2 + (tr - lr) ** 2) / (ta + tn + tr - la - ln - lr), 9) AS cost FROM s WHERE nx IS NOT NULL)
SELECT CAST(feature AS INTEGER) AS feature, threshold FROM g ORDER BY cost, feature, threshold LIMIT 1
""")
def tree_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of the exact tree, of all splits there are."""
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double")).alias("f"), F.col("l_returnflag").alias("y"))
    root = models.fit_tree(rows, "f", "y", 4, max_depth=1)
    return spark.createDataFrame([(root.feature, float(root.threshold))], "feature int, threshold double")
