"""Quality of a scored classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classifier_metrics(rows: DataFrame, label: str = "label", score: str = "score", cut: float = 0.5, bins: int = 5) -> DataFrame:
    """One row: n, positives, roc_auc, pr_auc (average precision), brier, ece, tp, fp, tn, fn, precision, recall, f1.

    Rows with a null label or score are left out. Scores are ranked to six decimals, so the running sums are taken over a
    million counts at most, whatever the number of rows; equal scores share a rank. Without rows of both labels the areas
    are null, without predicted or real positives so are precision or recall."""
    rows = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("p"))
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins))
    sums = rows.groupBy(F.round("p", 6).alias("s"), bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("y").alias("k"), F.sum("p").alias("total"), F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"),
        F.count_if((F.col("p") >= cut) & (F.col("y") == 1)).alias("tp"), F.count_if((F.col("p") >= cut) & (F.col("y") != 1)).alias("fp"),
    )
    ranks = sums.groupBy("s").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    down = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    areas = ranks.withColumn("above", F.sum("n").over(down)).withColumn("hits", F.sum("k").over(down)).agg(
        F.sum("k").alias("pos"), F.sum("n").alias("all"),
        F.sum((F.col("n") - F.col("k")) * (F.col("hits") - F.col("k") / 2)).alias("pairs"),  # positives above each negative
        F.sum(F.col("k") * F.col("hits") / F.col("above")).alias("ap"),
    )
    by_bin = sums.groupBy("bin").agg(F.sum("n").alias("bn"), F.sum("k").alias("bk"), F.sum("total").alias("bt"), F.sum("sq").alias("bs"), F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"))
    whole = by_bin.agg(F.sum("bn").alias("n"), F.sum("bs").alias("sq"), F.sum(F.abs(F.col("bk") - F.col("bt"))).alias("gap"), F.sum("btp").alias("tp"), F.sum("bfp").alias("fp"))
    r = areas.join(F.broadcast(whole))  # one row each
    c = F.col
    tp, fp, fn = c("tp"), c("fp"), c("pos") - c("tp")
    div = F.try_divide
    return r.select(
        "n", c("pos").cast("long").alias("positives"), div(c("pairs"), c("pos") * (c("all") - c("pos"))).alias("roc_auc"), div(c("ap"), c("pos")).alias("pr_auc"),
        div(c("sq"), c("n")).alias("brier"), div(c("gap"), c("n")).alias("ece"), tp.alias("tp"), fp.alias("fp"), (c("n") - c("pos") - fp).cast("long").alias("tn"), fn.cast("long").alias("fn"),
        div(tp, tp + fp).alias("precision"), div(tp, c("pos")).alias("recall"), div(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
    )
