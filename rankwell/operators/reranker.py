"""Training and applying rerankers with Spark ML; judgements as training data."""

from __future__ import annotations

import json
import random
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import kept, seeded_ranks


def fit(rows: DataFrame, features: list[str], label: str = "label", hidden: tuple[int, ...] = (64, 32, 16), seed: int = 42, kind: str = "mlp") -> PipelineModel:
    """Scaled features into a multilayer perceptron (or a logistic regression)."""
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    if kind == "mlp":
        stages.append(MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), *hidden, 2], seed=seed, maxIter=60))
    else:
        stages.append(LogisticRegression(labelCol=label, regParam=0.01))
    return Pipeline(stages=stages).fit(rows.na.fill(0.0, features))


def scored(rows: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    """``rows`` with ``p``, the probability of the positive class."""
    out = model.transform(rows.na.fill(0.0, features)).withColumn("p", vector_to_array("probability")[1])
    return out.drop("raw", "features", "rawPrediction", "probability", "prediction")


def save_model(model: PipelineModel, path: str, features: list[str], about: dict | None = None) -> None:
    """The model with its features and what else is known of it, in a folder; an older one is replaced."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    told = json.dumps({"features": features, "about": about or {}}, sort_keys=True)
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], dict]:
    """The model, its features and what is known of it, from :func:`save_model`'s folder."""
    told = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/about").collect()))  # one line
    return PipelineModel.load(f"{path}/model"), told["features"], told["about"]


def calibrator(rows: DataFrame, p: str = "p", label: str = "label"):
    """Isotonic calibration of held-out probabilities."""
    return IsotonicRegression(featuresCol=p, labelCol=label, predictionCol="calibrated").fit(rows)


def folds(rows: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """Folds by a hash of key and label, so every label is dealt about evenly and no sort or shuffle is needed."""
    mixed = F.xxhash64(key)
    return rows.withColumn("fold", F.pmod(F.xxhash64(mixed, F.col(label)), F.lit(k)).cast("int"))


def stratified_folds(rows: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with a fold from 0 to k - 1, dealt within each label in random order: a label's counts differ by one at most."""
    ranked = seeded_ranks(kept(rows, "rows"), [key], seed, "_rank", by=label)
    return ranked.withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank")


def out_of_fold(rows: DataFrame, features: list[str], label: str = "label", k: int = 5, **how) -> DataFrame:
    """``rows`` (with a column fold) and ``p``, each from the model that was fitted on the other folds; stored."""
    rows = kept(rows, "folds")
    parts = [scored(rows.where(F.col("fold") == f), fit(rows.where(F.col("fold") != f), features, label, **how), features) for f in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return kept(out, "out-of-fold")


def cross_calibrated(rows: DataFrame, label: str = "label", k: int = 5) -> DataFrame:
    """Out-of-fold rows with ``calibrated``: p through the isotonic curve that the other folds' probabilities give."""
    parts = [calibrator(rows.where(F.col("fold") != f), "p", label).transform(rows.where(F.col("fold") == f)) for f in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def classifier_metrics(rows: DataFrame, p: str = "p", label: str = "label", cut: float = 0.5) -> DataFrame:
    """n, accuracy, precision, recall, f1 in one aggregate."""
    yes, true = F.col(p) >= cut, F.col(label) == 1
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"))
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    accuracy = (F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")
    return out.select("n", F.round(accuracy, 6).alias("accuracy"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def auc(rows: DataFrame, p: str = "p", label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=p, labelCol=label).evaluate(rows)


def permuted(rows: DataFrame, features: list[str], key: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """``rows`` once as they are (feature null) and, for each repeat and feature, with that feature's values shuffled among the rows.

    A row takes the value of the row that has its place in another random order, so each column keeps its values.
    The two orders are joined once per repeat, for all features together.
    """
    rows = kept(rows, "rows")
    here = kept(seeded_ranks(rows, [key], seed, "_at"), "here")
    out = None
    for r in range(repeats):
        there = seeded_ranks(rows.select(key, *features), [key], seed + r + 1, "_at").select("_at", *(F.col(f).alias(f"_{f}") for f in features))
        both = here.join(there, "_at").drop("_at")
        variants = F.array(*(F.struct(F.lit(f).alias("feature"), *((F.col(f"_{g}") if g == f else F.col(g)).alias(g) for g in features)) for f in features))
        part = both.select(*(c for c in rows.columns if c not in features), F.lit(r).alias("repeat"), F.explode(variants).alias("_v"))
        part = part.select(*(c for c in rows.columns if c not in features), "repeat", "_v.*")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(rows.withColumn("repeat", F.lit(0)).withColumn("feature", F.lit(None).cast("string")))


def importances(rows: DataFrame, model: PipelineModel, features: list[str], key: str, label: str = "label", repeats: int = 3, seed: int = 42, cut: float = 0.5) -> DataFrame:
    """feature, importance_mean, importance_std (population): the loss of F1 when a feature is shuffled; all rows and features in one pass."""
    found = scored(permuted(rows, features, key, repeats, seed), model, features)
    yes, true = F.col("p") >= cut, F.col(label) == 1
    counts = found.groupBy("feature", "repeat").agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    told = kept(counts.select("feature", "repeat", f1.alias("f1")), "f1")  # features x repeats rows
    base = told.where("feature IS NULL").select(F.col("f1").alias("base"))
    losses = told.where("feature IS NOT NULL").join(F.broadcast(base), F.lit(True)).withColumn("loss", F.col("base") - F.col("f1"))
    return losses.groupBy("feature").agg(F.round(F.avg("loss"), 6).alias("importance_mean"), F.round(F.stddev_pop("loss"), 6).alias("importance_std"))


def permutation_importance(rows: DataFrame, model: PipelineModel, features: list[str], label: str = "label", key: str | None = None) -> list[tuple[str, float]]:
    """(feature, mean loss of F1), the greatest loss first; one entry per feature. Without a key the features tell rows apart."""
    found = importances(rows.withColumn("_key", F.xxhash64(*([key] if key else features))), model, features, "_key", label)
    return sorted(((r["feature"], r["importance_mean"]) for r in found.collect()), key=lambda x: -x[1])


def relevance_label(title: Column, expected: Column) -> Column:
    """1 if the titles are equal, or one begins with the other, case and outer spaces aside."""
    a, b = F.lower(F.trim(title)), F.lower(F.trim(expected))
    return (F.startswith(a, b) | F.startswith(b, a)).cast("int")


def judgement_rows(candidates: DataFrame, judgements: DataFrame, negatives: int = 5) -> DataFrame:
    """Candidates with label: judged title positive from 0.7 on; unjudged ones of the first ranks are negatives."""
    j = judgements.select("query_id", F.lower(F.trim("title")).alias("__t"), F.col("score").alias("judged"))
    rows = candidates.withColumn("__t", F.lower(F.trim("title"))).join(j, ["query_id", "__t"], "left").drop("__t")
    return rows.where(F.col("judged").isNotNull() | (F.col("ord") <= negatives)).withColumn("label", (F.coalesce("judged", F.lit(0.0)) >= 0.7).cast("int")).drop("judged")


def merged_features(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Union in which new rows take the place of old ones with their key."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def random_search(rows: DataFrame, features: list[str], label: str = "label", tries: int = 30, seed: int = 42) -> list[tuple[float, dict]]:
    """AUC on held-out folds for ``tries`` of the combinations of layers, iterations, step and solver, best first."""
    grid = {"hidden": [(64, 32, 16), (32, 16), (16, 8), (64,), (32,), (16,)], "maxIter": [30, 60, 100], "stepSize": [0.01, 0.03, 0.1], "solver": ["l-bfgs", "gd"]}
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    chosen = random.Random(seed).sample(every, min(tries, len(every)))
    dealt = folds(rows, label, features[0]).cache()
    train, held = dealt.where("fold <> 0"), dealt.where("fold = 0")
    out = []
    for c in chosen:
        base = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
        net = MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), *c["hidden"], 2], seed=seed, maxIter=c["maxIter"], stepSize=c["stepSize"], solver=c["solver"])
        model = Pipeline(stages=[*base, net]).fit(train.na.fill(0.0, features))
        out.append((auc(scored(held, model, features), label=label), c))
    dealt.unpersist()
    return sorted(out, key=lambda x: -x[0])


def retrained(rows: DataFrame, features: list[str], old: PipelineModel | None, label: str = "label", key: str = "id") -> tuple[PipelineModel, bool]:
    """A model trained on four fifths of the rows, and whether it takes the old one's place on the rest."""
    dealt = folds(rows, label, key).cache()
    held = dealt.where("fold = 0")
    new = fit(dealt.where("fold <> 0"), features, label)
    f1 = lambda m: classifier_metrics(scored(held, m, features), label=label).first()["f1"]
    use = better(f1(new), None if old is None else f1(old))
    dealt.unpersist()
    return (new if use else old), use


def better(new_f1: float, old_f1: float | None) -> bool:
    """A retrained model is deployed if it is at least as good."""
    return old_f1 is None or new_f1 >= old_f1
