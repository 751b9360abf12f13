"""Training, saving, loading, scoring and evaluating layer models with Spark ML."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from skywarden.ml import calibration
from skywarden.ml.layers import NORMAL_LABELS, SPECS, LayerSpec, training_rows

log = logging.getLogger(__name__)


def label_indexer(column: str, output: str = "label") -> StringIndexer:
    """Codes in alphabetical order of the labels."""
    return StringIndexer(inputCol=column, outputCol=output, stringOrderType="alphabetAsc", handleInvalid="keep")


def classifier(spec: LayerSpec, kind: str = "boosted", rounds: int = 100, seed: int = 42):
    """Boosted trees (one model per class where there are more than two) or a forest. Only margins of the former need a curve."""
    if kind == "forest":
        return RandomForestClassifier(numTrees=rounds, seed=seed)
    boosted = GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, seed=seed)
    return boosted if spec.binary else OneVsRest(classifier=boosted, parallelism=4)


def train(rows: DataFrame, spec: LayerSpec, kind: str = "boosted", rounds: int = 100, id_column: str | None = None,
          held_percent: int = 20) -> PipelineModel:
    """Fit one layer's pipeline on rows of ``training_rows``. ``id_column`` is kept out of the features.

    Boosting reads its input once per round, so the rows are written to the shared folder first. Boosting of several classes
    leaves ``held_percent`` of the rows to the curves that turn its margins into confidences (0: no confidences).
    """
    rows = calibration.dealt(rows, "training")
    indexed = {c: f"{c}_code" for c in spec.text if c in rows.columns}
    skip = {spec.label, id_column, calibration.DEALT}
    features = [indexed.get(c, c) for c in rows.columns if c not in skip]
    encoders = [label_indexer(c, code) for c, code in indexed.items()]
    labels = label_indexer(spec.label).setHandleInvalid("error").fit(rows)
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    encoded = labels.transform(rows)
    is_held = F.col(calibration.DEALT) < (0 if kind == "forest" or spec.binary else held_percent)
    held, kept = encoded.where(is_held), encoded.where(~is_held)
    if kept.isEmpty():  # a handful of rows: all are learnt from, none is left to a curve
        held, kept = kept, encoded
    fitted = Pipeline(stages=[*encoders, assembler, classifier(spec, kind, rounds)]).fit(kept)
    curves = [] if held.isEmpty() else calibration.curves(fitted.transform(held), len(labels.labels))
    # the label codes travel as the last stage; scoring reads their names and never runs it
    return PipelineModel(stages=[*fitted.stages, *curves, labels])


def label_names(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].labels)


def align(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Rows with every input column of the model: missing numbers become 0, missing texts ''."""
    text = [s for s in model.stages[:-1] if isinstance(s, StringIndexerModel)]
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    codes = {s.getOutputCol(): s.getInputCol() for s in text}
    inputs = {codes.get(c, c): F.lit("") if c in codes else F.lit(0) for c in assembler.getInputCols()}
    return rows.withColumns({c: F.coalesce(F.col(c), default) if c in rows.columns else default
                             for c, default in inputs.items()})


def score(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Rows with ``prediction`` (code), ``predicted`` (label), ``is_attack`` and ``confidence`` (null if the model has none).

    Whole tables are scored by the JVM model; there is no Python per row.
    """
    scored = align(rows, model)
    for stage in model.stages[:-1]:
        scored = stage.transform(scored)
    names = F.array(*[F.lit(n) for n in label_names(model)])
    scored = scored.withColumn("predicted", F.get(names, F.col("prediction").cast("int")))
    calibrated = [s.getPredictionCol() for s in model.stages if isinstance(s, IsotonicRegressionModel)]
    if calibrated:
        confidence = calibration.confidence(calibrated)
    elif "probability" in scored.columns:
        confidence = F.array_max(vector_to_array("probability"))
    else:
        confidence = F.lit(None).cast("double")
    made = [s.getOutputCol() for s in model.stages[:-1] if isinstance(s, StringIndexerModel)]
    return scored.withColumns({"confidence": confidence, "is_attack": (~F.col("predicted").isin(list(NORMAL_LABELS))).cast("int")}).drop(
        "features", "rawPrediction", "probability", *made, *calibrated)


def train_all(logs: Mapping[str, DataFrame], kind: str = "boosted", rounds: int = 100, exclude_leaky: bool = False) -> dict[str, PipelineModel]:
    """One model per layer log; a layer that fails is reported and left out."""
    models = {}
    for layer, rows in logs.items():
        try:
            spec = SPECS[layer]
            models[layer] = train(training_rows(rows, spec, exclude_leaky), spec, kind, rounds)
        except Exception:  # one layer must not stop the others
            log.exception("layer %s was not trained", layer)
    return models


def save(models: Mapping[str, PipelineModel], path: str) -> None:
    for layer, model in models.items():
        model.write().overwrite().save(f"{path}/{layer}")


def load(path: str) -> dict[str, PipelineModel]:
    """The saved models found under ``path``; with none, only rules apply."""
    models = {}
    for layer in SPECS:
        try:
            models[layer] = PipelineModel.load(f"{path}/{layer}")
        except Exception as error:
            log.warning("no model for layer %s: %s", layer, type(error).__name__)
    return models


def classification_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, and overall accuracy, from one count of (label, prediction) pairs."""
    pairs = predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    right = F.col("label") == F.col("prediction")
    sides = F.array(F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                             F.when(right, F.col("n")).otherwise(0).alias("right")),
                    F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                             F.col("n").alias("predicted"), F.lit(0).cast("long").alias("right")))
    classes = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("right").alias("right"))

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    precision, recall = ratio(F.col("right"), F.col("predicted")), ratio(F.col("right"), F.col("support"))
    totals = classes.agg(F.sum("right").alias("right"), F.sum("support").alias("support"))
    rows = classes.select(F.col("class").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"),
                          ratio(2 * precision * recall, precision + recall).alias("f1"), "support")
    overall = totals.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                            F.lit(None).cast("double").alias("recall"), ratio(F.col("right"), F.col("support")).alias("f1"), "support")
    return rows.unionByName(overall)
