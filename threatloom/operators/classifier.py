"""A trained classifier of chunks: features in a fixed order, a random forest, its measures, and the model as a folder."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.features import VERSIONS, columns
from threatloom.functions.text import KEYWORDS

# The forest, the share of rows held out, and the recall below which a model isn't put into service.
TREES, DEPTH, SEED, HELD_OUT, RECALL_GATE = 100, 10, 42, 0.2, 0.30


@dataclass
class Classifier:
    """A fitted pipeline with the version of its features, which load() restores with it."""

    model: PipelineModel
    version: str
    registry: dict[str, list[str]]

    def features(self, texts: DataFrame, text: str) -> DataFrame:
        named = columns(F.col(text), self.version, self.registry)
        names = [f"__f_{n}" for n in VERSIONS[self.version](F.lit(""), self.registry)]
        return texts.withColumns(dict(zip(names, named, strict=True)))

    def predict(self, texts: DataFrame, text: str = "text", *, score: Column | None = None) -> DataFrame:
        """The rows with positive and confidence: the larger probability, moved by up to 0.15 by a keyword score (0 to 100) if one is given."""
        found = self.model.transform(self.features(texts, text))
        sure = F.array_max(vector_to_array("__probability"))
        if score is not None:
            sure = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure + (score - 50) / 100 * 0.3)), sure)
        return found.select(*texts.columns, (F.col("__prediction") == 1.0).alias("positive"), sure.alias("confidence"))

    def save(self, folder: str) -> None:
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{folder}/model")
        about = json.dumps({"feature_version": self.version, "registry": self.registry})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load(spark: SparkSession, folder: str) -> Classifier:
    """A saved classifier with the features that it was trained on."""
    about = json.loads(spark.read.text(f"{folder}/about").first()["value"])
    if about["feature_version"] not in VERSIONS:
        raise ValueError(f"the model's features {about['feature_version']!r} are unknown")
    return Classifier(PipelineModel.load(f"{folder}/model"), about["feature_version"], about["registry"])


def split(rows: DataFrame, key: str, held_out: float = HELD_OUT) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and rows held out, by a hash of the key, so that the split is the same every time."""
    part = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1000))
    return rows.where(part >= round(held_out * 1000)), rows.where(part < round(held_out * 1000))


def train(rows: DataFrame, *, text: str = "text", label: str = "label", version: str = "v3", registry: dict[str, list[str]] = KEYWORDS) -> Classifier:
    """A forest over rows with a text and a label (1: positive); both classes weigh the same however many rows they have."""
    known = rows.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(F.col(label).cast("int")).count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError("training needs rows of both classes")
    total = sum(counts.values())
    empty = Classifier(None, version, registry)
    weight = F.when(F.col("__label") == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
    data = empty.features(known.withColumn("__label", F.col(label).cast("double")), text).withColumn("__weight", weight)
    names = [f"__f_{n}" for n in VERSIONS[version](F.lit(""), registry)]
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="__label", featuresCol="__features", weightCol="__weight", predictionCol="__prediction", probabilityCol="__probability", rawPredictionCol="__raw"
    )
    # The rows are put in order, so that equal data gives an equal forest.
    data = data.select("__label", "__weight", *names).orderBy(*names, "__label")
    return Classifier(Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="__features"), forest]).fit(data), version, registry)


def measures(found: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy, and precision, recall and F1 of both classes (0 where there is nothing to divide by), of rows with positive."""
    y, p = F.col(label) == 1, F.col("positive")
    c = found.where(F.col(label).isNotNull()).agg(*(F.count_if(k).alias(n) for n, k in {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}.items()))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = c.select(
        (F.expr("tp + fp + fn + tn")).alias("rows"),
        ratio(F.expr("tp + tn"), F.expr("tp + fp + fn + tn")).alias("accuracy"),
        ratio(F.col("tp"), F.expr("tp + fp")).alias("precision_positive"),
        ratio(F.col("tp"), F.expr("tp + fn")).alias("recall_positive"),
        ratio(F.expr("2 * tp"), F.expr("2 * tp + fp + fn")).alias("f1_positive"),
        ratio(F.col("tn"), F.expr("tn + fn")).alias("precision_negative"),
        ratio(F.col("tn"), F.expr("tn + fp")).alias("recall_negative"),
        ratio(F.expr("2 * tn"), F.expr("2 * tn + fp + fn")).alias("f1_negative"),
    )
    return out.withColumn("in_service", F.col("recall_positive") >= RECALL_GATE)


def evaluated(classifier: Classifier, rows: DataFrame, *, text: str = "text", label: str = "label") -> DataFrame:
    return measures(classifier.predict(rows, text), label)
