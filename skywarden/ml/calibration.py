"""Confidences of several-class boosting: margins of held-out rows against how often the class is right.

A boosted model per class gives margins that are no probabilities. Rows that no tree has seen say how often a row of a
margin belongs to the class; an isotonic curve per class follows these shares. Margins are first counted in steps of
``STEP``, so a curve is fitted on as many points as there are steps, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from skywarden.session import written

STEP = 0.001  # a margin is between -20 and 20 with 100 rounds, so a class has some 40000 points at most
DEALT = "_dealt"


def dealt(rows: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """``rows`` written with a number from 0 to 99 each. Equal rows get numbers of their own; the written ones stay as they are."""
    return written(rows.withColumn(DEALT, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(100))), name)


def margin_counts(scored: DataFrame, label: str = "label") -> DataFrame:
    """(class, margin, share, weight): of ``weight`` rows with about this margin for the class, the share that belongs to it."""
    each = scored.select(F.col(label).alias("label"), F.posexplode(vector_to_array("rawPrediction")).alias("class", "margin"))
    return each.groupBy("class", (F.round(F.col("margin") / STEP) * STEP).alias("margin")).agg(
        F.avg((F.col("label") == F.col("class")).cast("double")).alias("share"), F.count("*").cast("double").alias("weight"))


def curves(scored: DataFrame, classes: int) -> list[IsotonicRegressionModel]:
    """One curve per class, as a stage that reads the margins of a scored row. None without rows. The last classes have neither margins
    nor a curve where all their rows are held out; no row is predicted to be one of these."""
    counts = written(margin_counts(scored), "margins")
    having = {r["class"] for r in counts.select("class").distinct().collect()}
    found = []
    for k in (k for k in range(classes) if k in having):
        curve = IsotonicRegression(featuresCol="margin", labelCol="share", weightCol="weight", predictionCol=f"calibrated_{k}")
        found.append(curve.fit(counts.where(F.col("class") == k)).setFeaturesCol("rawPrediction").setFeatureIndex(k))
    return found


def confidence(columns: list[str], prediction: str = "prediction") -> Column:
    """The predicted class's part of the sum over all classes; 0 if no class is likely."""
    shares = F.array(*[F.col(c) for c in columns])
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    own = F.get(shares, F.col(prediction).cast("int"))
    return F.when(total > 0, own / total).otherwise(F.lit(0.0))


def reliability(scored: DataFrame, right: Column, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy): rows by confidence, their mean confidence and the share that is ``right``.

    A bin is half open; the last one includes 1. Rows without a confidence are left out; ``right`` null counts as wrong.
    """
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return (scored.where("confidence IS NOT NULL").groupBy(place.alias("bin"))
            .agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"),
                 F.avg(F.coalesce(right, F.lit(False)).cast("double")).alias("accuracy")))


def calibration_error(table: DataFrame) -> DataFrame:
    """(n, accuracy, calibration_error) of a ``reliability`` table; the error is the mean gap, weighted by rows."""
    n = F.sum("n")
    return table.agg(n.alias("n"), (F.sum(F.col("accuracy") * F.col("n")) / n).alias("accuracy"),
                     (F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n")) / n).alias("calibration_error"))
