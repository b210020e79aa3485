"""Tabular baselines on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numeric_features(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint") and n not in without]


def dummies(df: DataFrame, col: str, levels: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"{col}_{v}": (F.col(col) == v).cast("double") for v in levels})


def standardize(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - train mean) / (train population deviation + 1e-8), nulls as 0; the statistics are one row."""
    s = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    d = df.join(F.broadcast(s), F.lit(True))
    return d.withColumns({c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8), F.lit(0.0)) for c in cols}).drop(*s.columns)


def _fit(train: DataFrame, cols: list[str], label: str, learner) -> PipelineModel:
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="skip"), learner]).fit(train)


def linear_baseline(train: DataFrame, cols: list[str], label: str) -> PipelineModel:
    return _fit(train, cols, label, LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50))


def tree_baseline(train: DataFrame, cols: list[str], label: str, trees: int = 20, seed: int = 42) -> PipelineModel:
    return _fit(train, cols, label, RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=6, seed=seed))


def fused(frames: list[DataFrame], keys: list[str], regime: str | None = None, levels: tuple[str, ...] = ("low_vol", "normal_vol", "high_vol")) -> DataFrame:
    """Feature sets side by side by their keys, with the regime as dummies. Keys without a row in each set are left out; a
    column of an earlier set stands before one of the same name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select(*keys, *[c for c in f.columns if c not in out.columns]), keys)
    return dummies(out, regime, levels) if regime else out


def scored(model: PipelineModel, df: DataFrame, label: str, keep: list[str]) -> DataFrame:
    """keep, true_label, pred_label, p (a probability for each class in alphabetical order, 1 in all) of df's rows.

    Labels come from the model's own index; the class kept for unknown labels has no share.
    """
    names = [str(x) for x in model.stages[0].labels]
    p = F.slice(vector_to_array("probability"), 1, len(names))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    d = model.transform(df).select(*keep, F.col(label).alias("true_label"), p.alias("p"))
    d = d.withColumn("p", F.transform("p", lambda x: x / total))
    return d.withColumn("pred_label", F.element_at(F.array(*map(F.lit, names)), F.array_position("p", F.array_max("p")).cast("int")))


def model_report(scores: DataFrame, classes: list[str], by: str = "model") -> DataFrame:
    """accuracy, macro_f1, mcc and multiclass brier of each model's scores (by, true_label, pred_label, p by classes)."""
    each = F.aggregate(F.transform("p", lambda x, i: F.pow(x - (F.element_at(F.array(*map(F.lit, classes)), i + 1) == F.col("true_label")).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    pairs = scores.groupBy(by, "true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("b"))
    total = pairs.groupBy(by).agg(F.sum("n").alias("s"), F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("c"), F.sum("b").alias("b"))
    sides = pairs.select(by, F.col("true_label").alias("class"), F.col("n").alias("t"), F.lit(0).alias("p"), F.lit(0).alias("hit")).unionByName(pairs.select(by, F.col("pred_label").alias("class"), F.lit(0).alias("t"), F.col("n").alias("p"), F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("hit")))
    classes_ = sides.groupBy(by, "class").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("t") + F.col("p")), F.lit(0.0))
    sums = classes_.groupBy(by).agg(F.avg(f1).alias("macro_f1"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    s, c = F.col("s").cast("double"), F.col("c").cast("double")
    mcc = F.coalesce(F.try_divide(c * s - F.col("tp"), F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))), F.lit(0.0))
    return total.join(sums, by).select(by, (c / s).alias("accuracy"), "macro_f1", mcc.alias("mcc"), (F.col("b") / s).alias("brier"))
