"""Fits and the deterministic parts around them: folds, weights, stacking and calibration."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritill.functions.hashing import fold64
from veritill.functions.scalars import logit


def error_weight(expected: Column, got: Column, missed: float = 3.0, false_alarm: float = 1.5) -> Column:
    """Weight of a row in a second fit: missed violations most, then false alarms."""
    return F.when(expected == got, F.lit(1.0)).when(expected != "APPROVE", F.lit(missed)).otherwise(F.lit(false_alarm))


def source_weight(source: Column, confidence: Column) -> Column:
    """Confidence, halved for weak labels."""
    return F.coalesce(confidence, F.lit(1.0)) * F.when(F.lower(source).startswith("weak"), 0.5).otherwise(1.0)


def with_fold(df: DataFrame, group: str, folds: int = 5, seed: str = "2026") -> DataFrame:
    """Rows with a fold by their group, so that a group is never on both sides."""
    return df.withColumn("fold", fold64(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group)), 256), folds))


def assembled(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    for c in categorical:
        df = StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep").fit(df).transform(df)
    return VectorAssembler(inputCols=[*numeric, *(f"{c}_index" for c in categorical)], outputCol="features", handleInvalid="keep").transform(df)


#: What a fitted model adds to its rows.
_ADDED = ("probability", "rawPrediction", "prediction")


def _applied(model, rows: DataFrame, name: str) -> DataFrame:
    """Rows with the model's probability of label 1 under a name; columns of theirs that a model would add stay."""
    own = [c for c in _ADDED if c in rows.columns]
    d = model.transform(rows.withColumnsRenamed({c: f"_own_{c}" for c in own}))
    return d.withColumn(name, vector_to_array("probability")[1]).drop(*_ADDED).withColumnsRenamed({f"_own_{c}": c for c in own})


def tree_scores(train: DataFrame, rows: DataFrame, label: str = "label", weight: str | None = None, trees: int = 20, depth: int = 4) -> DataFrame:
    """Rows with tree_score by boosted trees fitted on `train`; both have assembled features."""
    extra = {"weightCol": weight} if weight else {}
    model = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=2026, **extra).fit(train.drop(*_ADDED))
    return _applied(model, rows, "tree_score")


def out_of_fold(df: DataFrame, fit, folds: int = 5) -> DataFrame:
    """Every row scored by the fit that did not see its fold; `fit(train, rows)` scores rows."""
    out = None
    for k in range(folds):
        part = fit(df.filter(F.col("fold") != k), df.filter(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def stacked(train: DataFrame, rows: DataFrame, columns: list[str], label: str = "label", c: float = 1.0) -> DataFrame:
    """Rows with stack_score by a ridge-penalised logistic fit; the penalty is that of inverse strength c per row."""
    n = max(1, train.count())
    put = VectorAssembler(inputCols=columns, outputCol="stack_features")
    model = LogisticRegression(featuresCol="stack_features", labelCol=label, regParam=1 / (n * c), standardization=False, maxIter=200).fit(put.transform(train).drop(*_ADDED))
    return _applied(model, put.transform(rows), "stack_score").drop("stack_features")


def calibrated(train: DataFrame, rows: DataFrame, score: str = "stack_score", label: str = "label") -> DataFrame:
    """Rows with a calibrated probability: a logistic fit on the logit of the score."""
    put = lambda df: df.withColumn("_z", logit(F.col(score)))
    vec = VectorAssembler(inputCols=["_z"], outputCol="_v")
    model = LogisticRegression(featuresCol="_v", labelCol=label, maxIter=200).fit(vec.transform(put(train)).drop(*_ADDED))
    return _applied(model, vec.transform(put(rows)), "calibrated").drop("_z", "_v")
