"""Classification metrics, and choices along a training history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import running, sketched


def confusion(scored: DataFrame, classes: int) -> DataFrame:
    """(label, pred, n) for all pairs of classes, zeros kept."""
    spark = scored.sparkSession
    one = spark.range(classes).select(F.col("id").cast("int").alias("label"))
    grid = one.crossJoin(one.withColumnRenamed("label", "pred"))
    counts = scored.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("_n"))
    return grid.join(counts, ["label", "pred"], "left").select("label", "pred", F.coalesce("_n", F.lit(0).cast("long")).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, c, support, hits, precision, recall, f1) from confusion counts; 0 where undefined."""
    both = counts.select(*keys, F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(True).alias("is_label")), F.struct(F.col("pred").alias("c"), F.lit(False).alias("is_label")))).alias("x"), "label", "pred", "n")
    sums = both.groupBy(*keys, F.col("x.c").alias("c")).agg(
        F.sum(F.when(F.col("x.is_label") & (F.col("label") == F.col("pred")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.is_label"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("x.is_label"), F.col("n")).otherwise(0)).alias("predicted")
    )
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return sums.select(*keys, "c", "support", F.col("tp").alias("hits"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def macro(scored: DataFrame, classes: int) -> DataFrame:
    """One row: accuracy as a fraction, and means over all classes."""
    by_class = precision_recall(confusion(scored, classes))
    return by_class.agg(ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"))


def macro_by(scored: DataFrame, classes: int, keys: tuple[str, ...]) -> DataFrame:
    """macro() of each key's rows. A class that no row has and none is taken for counts as 0."""
    by_class = precision_recall(scored.groupBy(*keys, "label", "pred").agg(F.count(F.lit(1)).alias("n")), keys)
    mean = lambda name: (F.sum(name) / classes).alias(f"{name}_macro")
    return by_class.groupBy(*keys).agg(ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"))


def macro_f1_present(scored: DataFrame) -> DataFrame:
    """Mean F1 over the classes that are labels or predictions of some row."""
    counts = scored.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    return precision_recall(counts).agg(F.avg("f1").alias("f1_macro"))


def macro_f1(scored: DataFrame) -> float:
    return macro_f1_present(scored).first()["f1_macro"] or 0.0


def one_vs_rest(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, c, score, pos, neg): for each class and distinct score, to nine decimals, its positives and negatives."""
    long = scored.select(*keys, "label", F.posexplode("probs").alias("c", "p"))
    return long.groupBy(*keys, "c", F.round("p", 9).alias("score")).agg(F.sum(F.when(F.col("label") == F.col("c"), 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") != F.col("c"), 1).otherwise(0)).alias("neg"))


def auroc(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, c, auroc) by the rank statistic, ties half: each positive beats the negatives below it. Null without both kinds."""
    below = running(points, sketched(points, "score"), ["score"], {"neg_to": "neg"}, (*keys, "c"))
    won = below.groupBy(*keys, "c").agg(F.sum(F.col("pos") * (F.col("neg_to") - F.col("neg") / 2)).alias("won"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return won.select(*keys, "c", F.try_divide(F.col("won").cast("double"), (F.col("_p") * F.col("_n")).cast("double")).alias("auroc"))


def auroc_macro(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over the classes; 0 where any class has no positives or no negatives, as the mean is then undefined."""
    of = auroc(points, keys)
    return of.groupBy(*keys).agg(F.when(F.count("auroc") == F.count(F.lit(1)), F.avg("auroc")).otherwise(0.0).alias("auroc_macro")).select(*keys, F.coalesce("auroc_macro", F.lit(0.0)).alias("auroc_macro"))


def roc_points(points: DataFrame) -> DataFrame:
    """(c, score, tpr, fpr), from the highest score down."""
    down = running(points, -sketched(points, "score"), [F.desc("score")], {"tp": "pos", "fp": "neg"}, ("c",))
    totals = points.groupBy("c").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return down.join(F.broadcast(totals), "c").select("c", "score", "pos", "neg", ratio(F.col("tp"), F.col("_p")).alias("tpr"), ratio(F.col("fp"), F.col("_n")).alias("fpr"), "_p", "_n")


def trapezoid_auc(points: DataFrame) -> DataFrame:
    """Area below the ROC points. Each point's step to the left is its own negatives, so no point needs its neighbour."""
    area = F.col("neg") / F.col("_n") * (F.col("tpr") - F.col("pos") / F.col("_p") / 2)
    return roc_points(points).groupBy("c").agg(F.sum(area).alias("auc"))


def epoch_loss(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """Loss and accuracy in percent: within a batch the loss is a mean by class weights, over batches a mean by their rows."""
    own = -F.log(F.element_at("probs", F.col("label") + 1))
    rows = scored.join(F.broadcast(weights.select("label", "weight")), "label")
    per_batch = rows.groupBy("batch").agg((F.sum(own * F.col("weight")) / F.sum("weight")).alias("loss"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("pred") == F.col("label"), 1).otherwise(0)).alias("hits"))
    return per_batch.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), (F.sum("hits") * 100.0 / F.sum("n")).alias("accuracy_pct"))


def history_flags(history: DataFrame, value: str = "f1", step: str = "step") -> DataFrame:
    """Adds best_before (0 at first), improved (strictly above it) and star (at least it). A history has a row for each step."""
    before = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    out = history.withColumn("best_before", F.greatest(F.coalesce(F.max(value).over(before), F.lit(0.0)), F.lit(0.0)))
    return out.withColumn("improved", F.col(value) > F.col("best_before")).withColumn("star", F.col(value) >= F.col("best_before"))


def best_step(history: DataFrame, value: str = "f1", step: str = "step") -> DataFrame:
    """The first step of the highest value above 0; none if there is none."""
    return history.filter(F.col(value) > 0).orderBy(F.desc(value), step).limit(1)


def early_stop(history: DataFrame, value: str, most: float, step: str = "step") -> DataFrame:
    """Steps up to and with the first whose value exceeds `most`."""
    before = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("_over", F.coalesce(F.max(F.when(F.col(value) > most, 1).otherwise(0)).over(before), F.lit(0))).filter("_over = 0").drop("_over")
