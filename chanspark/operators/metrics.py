"""Classification metrics, summaries over runs, and selection by policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs into which ordered scores are cut.
RUNS = 48


def confusion(df: DataFrame, true: str, predicted: str, *keys: str) -> DataFrame:
    """(keys, true_class, predicted_class, n, share): counts of pairs that occur, and their share of the true class."""
    n = df.groupBy(*keys, F.col(true).alias("true_class"), F.col(predicted).alias("predicted_class")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "true_class")))


def confusion_wide(df: DataFrame, true: str, predicted: str, classes: list) -> DataFrame:
    """(true_class, a column of counts for each class), zeros where nothing was predicted; classes that don't occur are left out."""
    each = [F.count_if(F.col(predicted) == F.lit(c)).alias(f"predicted_{c}") for c in classes]
    return df.where(F.col(true).isin(classes)).groupBy(F.col(true).alias("true_class")).agg(*each)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def per_class(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, f1) of each class that is true or predicted somewhere; 0 where undefined."""
    n = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))  # all else is over pairs of classes
    sides = n.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q"), F.lit(0).cast("long").alias("h")))).alias("e")).select("e.*")
    sums = sides.groupBy("class").agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    return sums.withColumn("precision", _ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", _ratio(F.col("hits"), F.col("support"))).withColumn("f1", _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")))


def overall(classes: DataFrame) -> DataFrame:
    """(accuracy, macro_precision, macro_recall, macro_f1, weighted_f1, supported_f1) from per_class(); the last one over classes with support."""
    n = F.sum("support")
    return classes.agg(
        (F.sum("hits") / n).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("supported_f1"),
    )


def _by_score(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(score, n, pos) by distinct score, with cp and cn: positives and rows of higher or equal scores.

    The running sums need all scores in one order: runs of scores, cut at quantiles, have running sums of their own, and
    the sums of the runs, some dozen rows, are added.
    """
    each = df.where(positive.isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.count_if(positive).alias("pos"))
    cuts = sorted(set(each.agg(F.percentile_approx("score", [i / RUNS for i in range(1, RUNS)], 50 * RUNS)).first()[0] or []))
    below = F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c > F.col("score"))
    runs = each.withColumn("_run", F.size(below))
    totals = runs.groupBy("_run").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_bp"))
    own = Window.partitionBy("_run").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return runs.join(F.broadcast(before), "_run").withColumn("cn", F.sum("n").over(own) + F.col("_bn")).withColumn("cp", F.sum("pos").over(own) + F.col("_bp")).drop("_run", "_bn", "_bp")


def auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(positives, negatives, auc): the chance that a positive scores above a negative, ties half; NaN without both."""
    # Of each score: its positives win against all negatives below, and half against those that are equal.
    step = _by_score(df, positive, score).withColumn("neg", F.col("n") - F.col("pos"))
    sums = step.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"), F.sum(F.col("pos").cast("double") * (F.col("cn") - F.col("cp")) - F.col("pos") * F.col("neg") * F.lit(0.5)).alias("lost"))
    both = F.col("positives").cast("double") * F.col("negatives")
    return sums.select("positives", "negatives", F.when(both > 0, 1 - F.col("lost") / both).otherwise(float("nan")).alias("auc"))


def average_precision(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(positives, average_precision): precision at each distinct score, weighted by the recall gained there."""
    step = _by_score(df, positive, score)
    sums = step.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.sum(F.col("pos") * (F.col("cp") / F.col("cn"))).alias("top"))
    return sums.select("positives", F.when(F.col("positives") > 0, F.col("top") / F.col("positives")).otherwise(float("nan")).alias("average_precision"))


def aligned(probabilities: Column, have: list, want: list) -> Column:
    """Probabilities of the classes `have` in the order `want`: a class that is missing has 0, and of all zeros each has its equal share."""
    own = F.array(*[F.coalesce(probabilities[have.index(c)].cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in want])
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
    return F.transform(own, lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(want)))


def one_vs_rest(df: DataFrame, true: str, probabilities: str, classes: list) -> DataFrame:
    """(class, support, auc, average_precision) of each class against the others by its probability; NaN where undefined."""
    out = None
    for k, c in enumerate(classes):
        own = df.select((F.col(true) == F.lit(c)).alias("_positive"), F.col(probabilities)[k].alias("_score"))
        row = auc(own, F.col("_positive"), "_score").crossJoin(average_precision(own, F.col("_positive"), "_score").drop("positives"))  # one row each
        row = row.select(F.lit(c).alias("class"), F.col("positives").alias("support"), "auc", "average_precision")
        out = row if out is None else out.unionByName(row)
    return out


def macro_and_weighted(classes: DataFrame, metrics: list[str]) -> DataFrame:
    """(every metric's _macro and _weighted) over rows of classes with support; NaN if it is undefined for a class."""
    each = [e for m in metrics for e in (F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"{m}_weighted"))]
    return classes.agg(*each)


def predicted_counts(df: DataFrame, keys: list[str], true: str, predicted: str, classes: list) -> DataFrame:
    """(keys, windows, correct, accuracy, predicted_<class>..., majority): what a file's windows were taken for; ties go to the first class."""
    n = {c: F.count_if(F.col(predicted) == F.lit(c)) for c in classes}
    found = df.groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if(F.col(true) == F.col(predicted)).alias("correct"), *[x.alias(f"predicted_{c}") for c, x in n.items()])
    most = F.greatest(*[F.col(f"predicted_{c}") for c in classes]) if len(classes) > 1 else F.col(f"predicted_{classes[0]}")
    majority = F.coalesce(*[F.when(F.col(f"predicted_{c}") == most, F.lit(c)) for c in classes])
    return found.withColumn("accuracy", F.col("correct") / F.col("windows")).withColumn("majority", majority)


def accuracy_by(df: DataFrame, true: str, predicted: str, *keys: str) -> DataFrame:
    """(keys, support, correct, accuracy)."""
    n = df.groupBy(*keys).agg(F.count("*").alias("support"), F.count_if(F.col(true) == F.col(predicted)).alias("correct"))
    return n.withColumn("accuracy", F.col("correct") / F.col("support"))


def summarise(runs: DataFrame, keys: list[str], metrics: list[str], ddof: int = 0, extremes: bool = False) -> DataFrame:
    """(keys, every metric's _mean and then _std, with extremes _min and _max too). NaN counts as missing, as do nulls; a sample deviation of one run is 0."""
    def clean(m: str) -> Column:
        return F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))

    std = (lambda m: F.stddev_pop(clean(m))) if ddof == 0 else (lambda m: F.coalesce(F.stddev_samp(clean(m)), F.lit(0.0)))
    return runs.groupBy(*keys).agg(*[e for m in metrics for e in (F.avg(clean(m)).alias(f"{m}_mean"), std(m).alias(f"{m}_std"), *([F.min(clean(m)).alias(f"{m}_min"), F.max(clean(m)).alias(f"{m}_max")] if extremes else []))])


def by_policy(candidates: DataFrame, main: str, within: float, then: list[Column], rest: list[Column], tie: str) -> DataFrame:
    """candidates with selected_by_policy and position: the winner first, then the others in the order `rest`.

    The winner is the first in the order `then` of those whose main metric is within a distance of the best. One row a
    candidate (a model, a setting): few by nature, and aggregated before.
    """
    best = candidates.agg(F.max(main)).scalar()
    near = candidates.where(F.col(main) >= best - within).orderBy(*then, tie).limit(1).select(F.col(tie).alias("_won"))
    marked = candidates.join(F.broadcast(near), F.col(tie) == F.col("_won"), "left").withColumn("selected_by_policy", F.col("_won").isNotNull()).drop("_won")
    return marked.withColumn("position", F.row_number().over(Window.orderBy(F.desc("selected_by_policy"), *rest, tie)))


def head_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; Spark cuts groups before the shuffle too, so hot groups stay small."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def upsert(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """index with the rows of new in place of those with the same key."""
    return index.join(new.select(key), key, "left_anti").unionByName(new)
