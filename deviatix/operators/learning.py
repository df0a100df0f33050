"""Simple detectors: standardised logistic heads, multiple-instance relabelling, folds, calibration, operating point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .quantiles import percentiles
from .windows import hash_order


def head(df: DataFrame, features: list[str], label: str, c: float = 0.3, balanced: bool = True):
    """Pipeline model: medians for nulls, standardised features, L2 logistic with classes ``balanced`` or as they are.

    The penalty is 1 / (c * sum of weights) as in the usual C parametrisation; the intercept is not penalised.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    # each stage of the fit reads the rows, which are written once
    rows = stored(df.select(*features, F.col(label).cast("int").alias("_c"), F.col(label).cast("double").alias("_y")), "rows")
    n, pos = rows.agg(F.count(F.lit(1)), F.sum("_y")).first()
    weight = F.when(F.col("_c") == 1, n / (2 * max(pos or 0, 1))).otherwise(n / (2 * max(n - (pos or 0), 1)))
    weight = weight if balanced else F.lit(1.0)
    filled = [f"{x}_filled" for x in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(withMean=True, inputCol="_raw", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", elasticNetParam=0.0, standardization=False, regParam=1 / (c * n), maxIter=200, tol=1e-9, probabilityCol="_p"),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("_w", weight))


def scored(model, df: DataFrame) -> DataFrame:
    """df with p, the probability of the positive class."""
    from pyspark.ml.functions import vector_to_array

    keep = df.columns
    return model.transform(df).select(*keep, vector_to_array("_p")[1].alias("p"))


def multiple_instance(df: DataFrame, features: list[str], bag: str, unit: str, label: str, k: int = 5, rounds: int = 3):
    """Positive bags keep only their k best-scored rows as positives; others drop out; negatives stay. Refits each round."""
    from pyspark.sql import Window

    df = stored(df.select(bag, unit, label, *[f for f in features if f not in (bag, unit, label)]), "bags")
    model = head(df, features, label)
    for _ in range(rounds):
        w = Window.partitionBy(bag).orderBy(F.desc("p"), unit)
        ranked = scored(model, df).withColumn("_rank", F.row_number().over(w))
        model = head(ranked.where((F.col(label) == 0) | (F.col("_rank") <= k)).drop("p", "_rank"), features, label)
    return model


def folded_scores(df: DataFrame, features: list[str], label: str, unit: str, folds: int, ridge: float = 1.0) -> DataFrame:
    """unit, label, p: each row scored by a fit on the other folds, which are drawn by hash. The fits are those of
    ``head`` without balance, distributed over the rows; a fold without rows is left out."""
    fold = F.conv(F.substring(hash_order(unit), 1, 8), 16, 10).cast("long") % folds
    rows = df.select(unit, label, *[F.col(f).cast("double").alias(f) for f in features]).withColumn("_own", fold)
    present = sorted(r[0] for r in rows.select("_own").distinct().collect())  # ``folds`` numbers at most
    parts = [scored(head(rows.where(F.col("_own") != k), features, label, 1 / ridge, balanced=False), rows.where(F.col("_own") == k)) for k in present]
    return reduce(DataFrame.unionByName, [p.select(unit, label, "p") for p in parts])


def calibrated(df: DataFrame, score: str, label: str):
    """Isotonic model of label on score."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    v = VectorAssembler(inputCols=[score], outputCol="_s").transform(df.withColumn("_y", F.col(label).cast("double")))
    return IsotonicRegression(featuresCol="_s", labelCol="_y").fit(v)


def operating_point(normals: DataFrame, score: str, false_positives: float = 0.01) -> DataFrame:
    """tau: the least threshold that no more than the given share of normals lies above (interpolated). One row, from a
    search that no task holds all scores in; null without normals."""
    found = percentiles(normals, [], score, {"tau": 1 - false_positives})
    return found.agg(F.max("tau").alias("tau"))


def production_label(focal: Column, normal: Column, general: Column) -> Column:
    """1 focal, 0 clean normal or general only, null otherwise."""
    return F.when(focal, 1).when(normal | (general & ~focal), 0)


def panel_scores(df: DataFrame, features: list[str], label: str, panel: Column) -> DataFrame:
    """All rows with p, of a head fitted on those that are not of the panel: a panel is scored, never learned from."""
    learned = df.where(~F.coalesce(panel, F.lit(False)) & F.col(label).isNotNull())
    return scored(head(learned, features, label), df)


def focal_scores(labels: DataFrame, key: str, focal: Column, normal: Column, general: Column, blocks: list[DataFrame], each: int, seed: str = "0"):
    """key, p of every key that all feature blocks have: a head learned on the de-confounded target (focal against clean
    normal or general only) from at most ``each`` keys of either class, drawn by hash: the training sample is bounded."""
    from .windows import capped

    target = labels.select(key, production_label(focal, normal, general).alias("_label")).where("_label IS NOT NULL")
    table = reduce(lambda a, b: a.join(b.hint("merge"), key), blocks)
    features = [c for c in table.columns if c != key]
    sample = capped(target, ["_label"], [key], each, seed).join(table.hint("merge"), key)
    return scored(head(sample, features, "_label"), table).select(key, "p")
