"""Detectors and the selector head, as MLlib estimators fitted by distributed passes."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.storage import shared_dir


def balanced(train: DataFrame, label: str) -> DataFrame:
    """train with weight n / (2 * n_of_the_row's_class)."""
    counts = train.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(label) == 1).alias("__p"))
    own = F.when(F.col(label) == 1, F.col("__p")).otherwise(F.col("__n") - F.col("__p"))
    return train.join(F.broadcast(counts)).withColumn("weight", F.col("__n") / (2 * own)).drop("__n", "__p")


def assembled(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with features: the columns (MLlib vectors or arrays of numbers) side by side. A missing vector raises an error."""
    arrays = {c for c in columns if rows.schema[c].dataType.typeName() == "array"}
    held = rows.withColumns({f"__{c}": array_to_vector(F.transform(c, lambda x: x.cast("double"))) for c in arrays})
    out = VectorAssembler(inputCols=[f"__{c}" if c in arrays else c for c in columns], outputCol="features").transform(held)
    return out.drop(*(f"__{c}" for c in arrays))


def gathered(train: DataFrame) -> DataFrame:
    """train in no more partitions than tasks run at once. A fit shuffles gradients or split statistics of each partition in every step, so what it shuffles would grow with their number."""
    return train.coalesce(max(2, train.sparkSession.sparkContext.defaultParallelism))


def _regression(train: DataFrame, **params) -> LogisticRegressionModel:
    """The model, read from what it was saved as: a fitted one holds the summary of its training and with it the session, which tasks can't get once it has tags."""
    path = f"{shared_dir(train.sparkSession)}/regression-{uuid.uuid4().hex}"
    LogisticRegression(weightCol="weight", maxIter=50, **params).fit(gathered(train)).save(path)
    return LogisticRegressionModel.load(path)


def _scored(model, rows: DataFrame, out: str) -> DataFrame:
    done = model.transform(rows)
    return done.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def detector(train: DataFrame, rows: DataFrame, label: str, threshold: float = 0.5, regularisation: float = 0.01) -> DataFrame:
    """Balanced logistic regression over ``features``: rows with probability_1 and predicted."""
    fit = _regression(balanced(train, label), labelCol=label, regParam=regularisation)
    return _scored(fit, rows, "probability_1").withColumn("predicted", (F.col("probability_1") >= threshold).cast("int"))


def forest(train: DataFrame, rows: DataFrame, label: str, trees: int = 300, seed: int = 1) -> DataFrame:
    """Balanced random forest over ``features`` with square-root feature subsets."""
    fit = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, featureSubsetStrategy="sqrt", seed=seed).fit(gathered(balanced(train, label)))
    return _scored(fit, rows, "probability_1").withColumn("predicted", (F.col("probability_1") >= 0.5).cast("int"))


def selector(train: DataFrame, rows: DataFrame, positive_weight: float = 3.0, regularisation: float = 0.01) -> DataFrame:
    """Candidate log-odds from ``features``, trained on is_gold with weight positive_weight for replies."""
    known = train.withColumns({"label": F.col("is_gold").cast("double"), "weight": F.when(F.col("is_gold"), positive_weight).otherwise(1.0)})
    fit = _regression(known, labelCol="label", regParam=regularisation)
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    return _scored(fit, rows, "p").withColumn("selector_logit", F.log(p / (1 - p))).drop("p")


def holdout(group: Column, salt: str, modulus: int = 10) -> Column:
    from colloquy.functions.hashing import stable_int

    return stable_int(group, salt) % modulus == 0
