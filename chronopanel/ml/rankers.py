"""Cross-sectional rankers on Spark ML: ranks per date as targets, purged folds, stitched predictions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.crosssec import percent_rank_average
from ..operators.validation import purged_panel_folds, ranking_diagnostics

FEATURES = ["r1", "r2", "r5", "r10", "gap_fraction", "log_adv", "range_pos"]


def model_frame(features: DataFrame, labels: DataFrame, side: str | None = None, score: str = "r5") -> DataFrame:
    """One row per (symbol, session) with a finite label; ``side`` keeps the extreme candidates only."""
    x = features.join(labels.select("symbol", "session", "label", "label_end"), ["symbol", "session"]).where("label is not null")
    if side is not None:
        p = percent_rank_average(score)
        x = x.withColumn("_p", p).where(F.col("_p") <= 0.3 if side == "LONG" else F.col("_p") > 0.7).drop("_p")
    return x


def rank_target(frame: DataFrame) -> DataFrame:
    return frame.withColumn("target", percent_rank_average("label", minimum=1))


def linear_ranker(ridge: float = 0.1, elastic: float = 0.0, features=FEATURES) -> Pipeline:
    filled = [f"{c}_f" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True), LinearRegression(labelCol="target", regParam=ridge, elasticNetParam=elastic, maxIter=20)])


def boosted_ranker(trees: int = 5, depth: int = 3, features=FEATURES) -> Pipeline:
    filled = [f"{c}_f" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"),
        GBTRegressor(labelCol="target", maxIter=trees, maxDepth=depth, seed=7)])


def meta_labeler(trees: int = 5, depth: int = 3, features=FEATURES) -> Pipeline:
    filled = [f"{c}_f" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"),
        GBTClassifier(labelCol="take", maxIter=trees, maxDepth=depth, seed=7)])


def predict(model, rows: DataFrame, probability: bool = False) -> DataFrame:
    out = model.transform(rows)
    score = vector_to_array("probability")[1] if probability else F.col("prediction")
    return out.select("symbol", "session", "label", score.alias("score"))


def purged_study(frame: DataFrame, folds: DataFrame, specs: dict[str, Pipeline], n_folds: list[int], purge: int = 5) -> tuple[DataFrame, DataFrame]:
    """Predictions of every spec on every fold, and date-level diagnostics per spec.

    The driver loops over folds and specs only; each fit and transform is a Spark job over the fold's rows.
    """
    rows = purged_panel_folds(frame, folds, purge)
    out = None
    for fold in n_folds:
        train = rows.where((F.col("fold") == fold) & (F.col("side") == "train"))
        test = rows.where((F.col("fold") == fold) & (F.col("side") == "test"))
        for name, pipe in specs.items():
            p = predict(pipe.fit(train), test).withColumn("spec", F.lit(name)).withColumn("fold", F.lit(fold))
            out = p if out is None else out.unionByName(p)
    return out, ranking_diagnostics(out, "score", "label", 3, by=("spec", "session"))
