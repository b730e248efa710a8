"""Section classifier on Spark's own estimators, with the layout rules behind it."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from lectern.functions import text as T
from lectern.operators.segments import LABELS, distinct_segments, features, rule_labels

#: Below this probability the layout rules decide. Rows a label that training sees at most, taken by hash; hashed text features.
UNSURE, ROWS_A_LABEL, PLACES = 0.45, 2000, 1 << 14


def samples(segments: DataFrame) -> DataFrame:
    """Features with the label and the words and word pairs of the text."""
    own = distinct_segments(segments).select("segment_id", "label", F.transform(T.tokens(F.col("text")), F.lower).alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    grams = F.concat("w", F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.concat_ws(" ", a, b)))
    return features(segments).join(own.withColumn("grams", grams).drop("w"), "segment_id")


def train(labelled: DataFrame) -> PipelineModel:
    """Multinomial logistic regression over layout and tf-idf features, classes weighted alike. Fitted on a bounded sample:
    ROWS_A_LABEL rows of each label, the first by hash."""
    from pyspark.sql import Window

    own = Window.partitionBy("label").orderBy(F.xxhash64("segment_id"))
    rows = labelled.where(F.col("label").isin(*LABELS)).withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= ROWS_A_LABEL)
    count = Window.partitionBy("label")
    rows = rows.withColumn("weight", 1.0 / F.count("*").over(count)).drop("_r")
    layout = [c for c, t in labelled.dtypes if t == "double"]
    return Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep"),
        HashingTF(inputCol="grams", outputCol="tf", numFeatures=PLACES, binary=True), IDF(inputCol="tf", outputCol="idf"),
        VectorAssembler(inputCols=[*layout, "idf"], outputCol="features"),
        LogisticRegression(labelCol="target", weightCol="weight", maxIter=30, regParam=1e-4),
    ]).fit(rows)


def classify(model: PipelineModel, rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(segment_id, label, confidence, source): the most likely label, or the rule's below UNSURE."""
    names = model.stages[0].labelsArray[0]
    p = vector_to_array("probability")
    scored = model.transform(rows).select("segment_id", F.array_max(p).alias("confidence"), F.element_at(F.array(*map(F.lit, [*names, "PARAGRAPH"])), (F.col("prediction") + 1).cast("int")).alias("said"))
    both = scored.join(rules.select("segment_id", "rule"), "segment_id")
    sure = F.col("confidence") >= UNSURE
    return both.select("segment_id", F.when(sure, F.col("said")).otherwise(F.col("rule")).alias("label"), F.round("confidence", 4).alias("confidence"), F.when(sure, "model").otherwise("rule").alias("source"))


def evaluated(segments: DataFrame, specs: DataFrame) -> DataFrame:
    """(label, predicted, n) over the segments of test specs of a classifier trained on the train specs."""
    split = specs.where("spec_id is not null").groupBy("spec_id").agg(F.max(F.lower(F.trim("split"))).alias("split"))
    rows = samples(segments).join(split, "spec_id")
    model = train(rows.where("split = 'train' and label is not null"))
    held = rows.where("split = 'test' and label is not null")
    said = classify(model, held, rule_labels(segments)).withColumnRenamed("label", "predicted")
    return held.select("segment_id", "label").join(said, "segment_id").groupBy("label", "predicted").agg(F.count("*").alias("n"))
