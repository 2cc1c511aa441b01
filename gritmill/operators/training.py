"""Training of the defect models: scaled logistic regression and a random forest with balanced weights, calibrated on scores
of rows that each model had not seen, and the artifact that scoring reads."""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logistic
from .splits import seeded

FOLDS = 5
#: Inverse of the weight of the ridge, as the sum of the rows' losses counts against it.
INVERSE_RIDGE = 0.5


def scales(rows: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature, in one pass; a constant feature has the deviation 1."""
    r = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i, c in enumerate(features)}


def _prepared(rows: DataFrame, features: list[str], label: str, scale: dict | None) -> DataFrame:
    """label, weight and vector of rows without nulls among them; either label has half of the weight."""
    value = lambda c: F.col(c).cast("double") if scale is None else (F.col(c).cast("double") - scale[c][0]) / scale[c][1]
    kept = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), "fold", *[F.coalesce(value(c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)])
    return VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features").transform(kept).select("label", "fold", "features")


def _balanced(rows: DataFrame) -> tuple[DataFrame, float]:
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = lambda k: total / (2 * n[k]) if n.get(k) else 1.0
    return rows.withColumn("weight", F.when(F.col("label") == 1, weight(1.0)).otherwise(weight(0.0))), float(total)


def _linear(rows: DataFrame):
    weighted, total = _balanced(rows)
    return LogisticRegression(weightCol="weight", regParam=1 / (INVERSE_RIDGE * total), standardization=False, maxIter=100, tol=1e-8).fit(weighted)


def _forest(rows: DataFrame, trees: int, depth: int):
    return RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, seed=42).fit(_balanced(rows)[0])


def platt(scored: DataFrame) -> tuple[float, float]:
    """Slope and shift of a logistic fit of label on score, whose targets are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2): each row counts
    for both labels by its target."""
    n = scored.agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).first()
    high, low = (n["a"] + 1) / (n["a"] + 2), 1 / (n["b"] + 2)
    target = F.when(F.col("label") == 1, high).otherwise(low)
    both = scored.select(F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("weight"), F.col("score")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("weight"), F.col("score")))).alias("r")).select("r.*")
    vectors = VectorAssembler(inputCols=["score"], outputCol="features").transform(both)
    fit = LogisticRegression(weightCol="weight", regParam=0.0, standardization=False, maxIter=100, tol=1e-10).fit(vectors)
    return float(fit.coefficients[0]), float(fit.intercept)


def _margin(model, rows: DataFrame) -> DataFrame:
    """The linear model's log-odds, or the forest's share of votes."""
    out = model.transform(rows)
    raw = F.get(vector_to_array("rawPrediction"), F.lit(1)) if hasattr(model, "coefficients") else F.get(vector_to_array("probability"), F.lit(1))
    return out.select("label", raw.alias("score"))


def train_defects(rows: DataFrame, features: list[str], label: str, group: str, forest: tuple[int, int] | None = None) -> dict:
    """The artifact: for each feature weight, mean and std; intercept; platt (slope, shift). With ``forest`` (trees, depth) also
    the platt of a forest, whose model is not part of the artifact.

    Calibration takes scores from FOLDS models, each fitted without the groups of its fold, so no group scores itself. Null
    features count as the mean, rows of other labels than 0 and 1 are left out. One label alone raises a ValueError."""
    folded = rows.withColumn("fold", (seeded(F.col(group), "fold") % FOLDS).cast("int"))
    scale = scales(folded.where(F.col(label).isin(0, 1)), features)
    x = _prepared(folded, features, label, scale).cache()
    try:
        if x.select("label").distinct().count() < 2:
            raise ValueError("training needs rows of both labels")
        model = _linear(x)

        def calibrated(fit) -> tuple[float, float]:
            parts = []
            for k in range(FOLDS):
                seen, unseen = x.where(F.col("fold") != k), x.where(F.col("fold") == k)
                if unseen.take(1) and seen.select("label").distinct().count() == 2:
                    parts.append(_margin(fit(seen), unseen))
            scored = parts[0] if parts else _margin(fit(x), x)
            for p in parts[1:]:
                scored = scored.union(p)
            return platt(scored)

        out = {
            "features": {c: {"weight": float(w), "mean": float(scale[c][0]), "std": float(scale[c][1])} for c, w in zip(features, model.coefficients)},
            "intercept": float(model.intercept), "platt": list(calibrated(_linear)),
        }
        if forest:
            out["forest_platt"] = list(calibrated(lambda seen: _forest(seen, *forest)))
        return out
    finally:
        x.unpersist()


def save_artifact(spark: SparkSession, artifact: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(artifact, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_artifact(spark: SparkSession, path: str, fallback: dict) -> dict:
    """The artifact saved at a path; ``fallback`` if there is none or it can't be read."""
    try:
        found = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
        return found if {"features", "intercept", "platt"} <= set(found) else fallback
    except Exception:  # whatever the file system raises
        return fallback


def defect_probability(artifact: dict) -> Column:
    """The calibrated probability as a column expression over the features; null features count as their mean."""
    logit = F.lit(artifact["intercept"])
    for name, f in artifact["features"].items():
        logit = logit + F.coalesce((F.col(name).cast("double") - f["mean"]) / (f["std"] or 1.0), F.lit(0.0)) * f["weight"]
    slope, shift = artifact["platt"]
    return logistic(logit * slope + shift)
