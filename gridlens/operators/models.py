"""Supervised models on the ML library: training, selection, ensembles and batch scoring."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.names import align
from gridlens.operators import ensemble
from gridlens.operators.anomaly import fourier_features
from gridlens.operators.boosting import BoostedTrees
from gridlens.operators.evaluate import accuracy
from gridlens.operators.sampling import donors, with_fold
from gridlens.session import cut_lineage


def as_vectors(df: DataFrame, features: str | list[str], label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep…, label, features vector) from an array column or from numeric columns."""
    if isinstance(features, str):
        vector = array_to_vector(F.col(features).cast("array<double>")).alias("features")
        return df.select(*keep, F.col(label).cast("double").alias("label"), vector)
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return assembler.transform(df).select(*keep, F.col(label).cast("double").alias("label"), "features")


class OneAgainstRest(Estimator):
    """A binary classifier per class, with class probabilities, so that ensembles can use it like any other.

    With two classes one classifier is enough. Its parameters are those of the binary classifier, so a grid over them works.
    """

    def __init__(self, base: Estimator, classes: int, parallelism: int = 4):
        super().__init__()
        self.base, self.classes, self.parallelism = base, classes, parallelism

    def getParam(self, paramName: str):
        return self.base.getParam(paramName)

    def hasParam(self, paramName: str) -> bool:
        return self.base.hasParam(paramName)

    def copy(self, extra=None) -> OneAgainstRest:
        return OneAgainstRest(self.base.copy(extra), self.classes, self.parallelism)

    def _fit(self, df: DataFrame) -> OneAgainstRestModel:
        one = [1] if self.classes == 2 else range(self.classes)
        with ThreadPoolExecutor(self.parallelism) as pool:
            fits = pool.map(lambda c: self.base.fit(df.withColumn("label", (F.col("label") == float(c)).cast("double"))), one)
        return OneAgainstRestModel(list(fits))


class _Parts(MLWriter):
    """Saves a model of several models: its metadata, and a sub-folder for each."""

    def __init__(self, model: OneAgainstRestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"parts": len(self.model.models)})
        for i, part in enumerate(self.model.models):
            part.write().save(f"{path}/part-{i}")


class _PartsReader(MLReader):
    def load(self, path: str) -> OneAgainstRestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = OneAgainstRestModel([DefaultParamsReader.loadParamsInstance(f"{path}/part-{i}", self.sparkSession) for i in range(metadata["parts"])])
        model._resetUid(metadata["uid"])
        return model


class OneAgainstRestModel(Model, MLWritable, MLReadable):
    """Probabilities of the binary models, normalised; a model without them gives the logistic of its margin."""

    def __init__(self, models: list[Model]):
        super().__init__()
        self.models = models

    def write(self) -> MLWriter:
        return _Parts(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PartsReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in ("prediction", "probability", "rawPrediction")]
        out, shares = df.select(*keep), []
        for i, model in enumerate(self.models):
            named = model.copy().setPredictionCol(f"__prediction{i}").setRawPredictionCol(f"__raw{i}")
            if hasattr(named, "setProbabilityCol"):
                named = named.setProbabilityCol(f"__share{i}")
                share = vector_to_array(f"__share{i}")[1]
            else:
                share = 1 / (1 + F.exp(-vector_to_array(f"__raw{i}")[1]))
            out = named.transform(out)
            out = out.select(*keep, *[f"__s{j}" for j in range(i)], share.alias(f"__s{i}"))
            shares.append(F.col(f"__s{i}"))
        if len(shares) == 1:
            shares = [1 - shares[0], shares[0]]
        total = sum(shares[1:], shares[0])
        each = F.array(*[F.when(total > 0, s / total).otherwise(1.0 / len(shares)) for s in shares])
        return out.select(*keep, array_to_vector(each).alias("probability"), ensemble.top_class(each).alias("prediction"))


def classifier(kind: str, classes: int = 2, width: int | None = None, seed: int = 42, **params):
    """An estimator by short name. Depth is limited to 30 by the ML library."""
    if kind == "tree":
        return DecisionTreeClassifier(seed=seed, **{"maxDepth": 10, **params})
    if kind == "forest":
        return RandomForestClassifier(seed=seed, **{"numTrees": 50, "maxDepth": 10, **params})
    if kind == "boosted":
        boosted = GBTClassifier(seed=seed, **{"maxIter": 20, "maxDepth": 5, **params})
        return boosted if classes == 2 else OneAgainstRest(boosted, classes)
    if kind == "histogram":  # 300 rounds by default, all classes in one fit
        return BoostedTrees(seed=seed, **params)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(seed=seed, **{"layers": [width, 64, 32, classes], "maxIter": 60, **params})
    if kind == "svm":
        svm = LinearSVC(**{"maxIter": 50, "regParam": 0.01, **params})
        return OneAgainstRest(svm, classes)
    if kind == "logistic":
        return LogisticRegression(**{"maxIter": 50, "regParam": 0.01, **params})
    raise ValueError(f"unknown kind {kind!r}")


def kernel_vectors(df: DataFrame, features: str, width: int, count: int = 128, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """Replace ``features`` by random Fourier features, so that a linear SVM acts as an RBF one."""
    lifted = fourier_features(vector_to_array(features), width, count, gamma, seed)
    return df.withColumn(features, array_to_vector(lifted))


# ---- adaptive boosting -----------------------------------------------------------------

def fit_adaboost(df: DataFrame, classes: int, rounds: int = 10, depth: int = 1, seed: int = 42) -> list[tuple[float, object]]:
    """SAMME boosting (Zhu et al., 2009) of weighted stumps; (weight, tree) per round.

    Row weights are a function of the trees so far, so they are an expression over predictions,
    checkpointed every few rounds to keep the plan short.
    """
    rows = df.select("label", "features").withColumn("w", F.lit(1.0))
    fitted = []
    for r in range(rounds):
        total = rows.agg(F.sum("w")).first()[0]
        tree = DecisionTreeClassifier(maxDepth=depth, weightCol="w", seed=seed + r).fit(rows)
        scored = tree.transform(rows).select("label", "features", "w", "prediction")
        wrong = scored.agg(F.sum(F.when(F.col("prediction") != F.col("label"), F.col("w")).otherwise(0.0))).first()[0] / total
        if wrong >= 1 - 1 / classes:
            break
        alpha = math.log((1 - wrong) / max(wrong, 1e-10)) + math.log(classes - 1)
        fitted.append((alpha, tree))
        if wrong <= 1e-10:
            break
        grown = F.when(F.col("prediction") != F.col("label"), F.col("w") * math.exp(min(alpha, 30.0))).otherwise(F.col("w"))
        rows = scored.select("label", "features", (grown / F.lit(total)).alias("w"))
        if r % 4 == 3:
            rows = cut_lineage(rows)
    return fitted


def adaboost_predict(df: DataFrame, fitted: list[tuple[float, object]], classes: int) -> DataFrame:
    out = df
    for i, (_, tree) in enumerate(fitted):
        named = tree.copy().setPredictionCol(f"__p{i}").setProbabilityCol("").setRawPredictionCol("")
        out = named.transform(out)
    votes = [
        sum((F.when(F.col(f"__p{i}") == float(c), F.lit(a)).otherwise(0.0) for i, (a, _) in enumerate(fitted)), F.lit(0.0))
        for c in range(classes)
    ]
    return out.withColumn("prediction", ensemble.top_class(F.array(*votes))).select(*df.columns, "prediction")


# ---- scoring ------------------------------------------------------------------------------

def probabilities(model, df: DataFrame, row_id: str, name: str) -> DataFrame:
    """(id, array of class probabilities)."""
    return model.transform(df).select(row_id, vector_to_array("probability").alias(name))


def soft_vote(models: dict[str, object], df: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Add each model's probabilities in the same pass and the mean's class. No join: one row carries all."""
    out = df
    for name, model in models.items():
        scored = model.transform(out)
        out = scored.select(*out.columns, vector_to_array("probability").alias(f"p_{name}"))
    mean = ensemble.soft_vote([f"p_{n}" for n in models], weights)
    return out.withColumn("probability", mean).withColumn("prediction", ensemble.top_class("probability"))


def batch_score(model: PipelineModel, df: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """Predictions for a table of any columns: align to the feature list, score, -1 where a row cannot be scored."""
    bad = F.lit(False)
    for c in features:
        if c in df.columns:
            bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    marked = df.withColumn("__bad", bad)
    aligned = align(marked, features, keep=(row_id, "__bad"))
    scored = model.transform(aligned)
    return scored.select(row_id, F.when(F.col("__bad"), F.lit(-1.0)).otherwise(F.col("prediction")).alias("prediction"))


def importance_table(model, names: list[str], k: int = 15) -> list[tuple[str, float]]:
    """The k most important features of a tree model."""
    ranked = sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))
    return ranked[:k]


# ---- comparison, search and stacking --------------------------------------------------------

def compare(models: dict[str, object], test: DataFrame) -> list[tuple[str, float, float]]:
    """(name, accuracy, weighted F1), best first."""
    rows = []
    for name, model in models.items():
        scored = model.transform(test).select("label", "prediction")
        measure = lambda m: MulticlassClassificationEvaluator(metricName=m).evaluate(scored)
        rows.append((name, measure("accuracy"), measure("f1")))
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def cross_validate(kind: str, df: DataFrame, row_id: str, classes: int, folds: int = 5, seed: int = 42, **params) -> tuple[float, float]:
    """(mean accuracy, two standard deviations) over folds given by the id's hash."""
    assigned = with_fold(df, row_id, folds, seed)
    scores = []
    for f in range(folds):
        model = classifier(kind, classes, seed=seed, **params).fit(assigned.where(F.col("fold") != f))
        scores.append(accuracy(model.transform(assigned.where(F.col("fold") == f)), "label", "prediction").first()["accuracy"])
    mean = sum(scores) / folds
    return mean, 2 * (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5


def grid_search(kind: str, df: DataFrame, row_id: str, classes: int, grid: dict[str, list], folds: int = 3, seed: int = 42):
    """Best model and [(parameters, mean accuracy)] over the grid; fits run side by side."""
    estimator = classifier(kind, classes, seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=folds, foldCol="fold", parallelism=4,
    ).fit(with_fold(df, row_id, folds, seed))
    table = [({p.name: v for p, v in m.items()}, float(s)) for m, s in zip(maps, search.avgMetrics)]
    return search.bestModel, sorted(table, key=lambda r: -r[1])


def stack(bases: dict[str, object], df: DataFrame, row_id: str, classes: int, folds: int = 5, seed: int = 42, meta: str = "logistic"):
    """Out-of-fold stacking: (base models on all rows, meta model, out-of-fold rows).

    A fold's probabilities come from models that never saw it. Base outputs of one row are made in one pass.
    """
    assigned = with_fold(df, row_id, folds, seed)
    parts = []
    for f in range(folds):
        train, held = assigned.where(F.col("fold") != f), assigned.where(F.col("fold") == f)
        parts.append(_base_outputs({n: e.fit(train) for n, e in bases.items()}, held, row_id))
    out_of_fold = parts[0]
    for p in parts[1:]:
        out_of_fold = out_of_fold.unionByName(p)
    out_of_fold = cut_lineage(out_of_fold)
    full = {n: e.fit(df) for n, e in bases.items()}
    return full, classifier(meta, classes, seed=seed).fit(out_of_fold.select("label", "features")), out_of_fold


def _base_outputs(models: dict[str, object], df: DataFrame, row_id: str) -> DataFrame:
    out = df.select(row_id, "label", "features")
    for n, model in models.items():
        out = model.transform(out).select(*out.columns, vector_to_array("probability").alias(f"p_{n}"))
    joined = F.flatten(F.array(*[f"p_{n}" for n in models]))
    return out.select(row_id, "label", array_to_vector(joined).alias("features"))


def stack_predict(full: dict[str, object], meta, df: DataFrame, row_id: str) -> DataFrame:
    return meta.transform(_base_outputs(full, df, row_id))


# ---- importance by permutation and elimination ------------------------------------------------

def permutation_importance(model, df: DataFrame, row_id: str, features: str, columns: list[int], seed: int = 42) -> list[tuple[int, float]]:
    """Accuracy lost when one feature takes the values of other rows, best first.

    One random cyclic order gives every row a donor row; each feature is then swapped in place and scored.
    """
    base = df.select(row_id, "label", F.col(features).cast("array<double>").alias("x"))
    given = donors(base, row_id, "x", seed, "donor")
    rows = cut_lineage(base.join(given, row_id))
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    vector = lambda a: array_to_vector(a)
    score = lambda a: model.transform(rows.select("label", vector(a).alias("features"))).agg(hit).first()[0]
    whole, width = score(F.col("x")), rows.select(F.size("x")).first()[0]
    lost = []
    for j in columns:
        swapped = F.concat(F.slice("x", 1, j), F.slice("donor", j + 1, 1), F.slice("x", j + 2, width))
        lost.append((j, whole - score(swapped)))
    return sorted(lost, key=lambda r: (-r[1], r[0]))


def eliminate(df: DataFrame, features: str, start: list[int], keep: int, step: int = 2, seed: int = 42) -> list[int]:
    """Recursive elimination: fit a tree, drop the ``step`` least important features, repeat until ``keep`` are left."""
    chosen = list(start)
    rows = df.select("label", F.col(features).cast("array<double>").alias("x"))
    while len(chosen) > keep:
        part = rows.select("label", array_to_vector(F.array(*[F.col("x")[j] for j in chosen])).alias("features"))
        scores = DecisionTreeClassifier(maxDepth=8, seed=seed).fit(part).featureImportances.toArray()
        ranked = sorted(range(len(chosen)), key=lambda i: (scores[i], -i))
        drop = set(ranked[:min(step, len(chosen) - keep)])
        chosen = [c for i, c in enumerate(chosen) if i not in drop]
    return chosen


# ---- robustness of a model -----------------------------------------------------------------------

def predictor(model):
    """A function that adds ``prediction`` to rows with an array column ``features``."""
    def predict(rows: DataFrame) -> DataFrame:
        inner = rows.withColumnRenamed("features", "__array").withColumn("features", array_to_vector("__array"))
        return model.transform(inner).select(*[c for c in rows.columns if c != "features"], F.col("__array").alias("features"), "prediction")

    return predict


def flip_rate(model, df: DataFrame, moved: dict) -> DataFrame:
    """Per method: share of rows whose prediction changes and mean L2 move. Before and after stand in one row."""
    predict = predictor(model)
    base = predict(df.withColumnRenamed("prediction", "__old") if "prediction" in df.columns else df)
    base = base.withColumnRenamed("prediction", "before").withColumn("original", F.col("features"))
    parts = []
    for name, change in moved.items():
        after = predict(base.withColumn("features", change))
        square = F.zip_with("features", "original", lambda a, b: (a - b) * (a - b))
        parts.append(after.select(
            F.lit(name).alias("method"), (F.col("prediction") != F.col("before")).cast("double").alias("flip"),
            F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v)).alias("l2"),
        ))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("flip").alias("success_rate"), F.avg("l2").alias("mean_l2"))


def augmented_training(df: DataFrame, row_id: str, change) -> DataFrame:
    """Training rows plus their perturbed copies under the same labels."""
    moved = df.withColumn("features", change)
    return df.unionByName(moved)


def save_bundle(path: str, model: PipelineModel, features: list[str], labels: list[str], spark) -> None:
    """Model, feature list and label dictionary below one folder."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(list(enumerate(features)), "place int, name string").write.mode("overwrite").json(f"{path}/features")
    spark.createDataFrame(list(enumerate(labels)), "code int, name string").write.mode("overwrite").json(f"{path}/labels")


def load_bundle(path: str, spark) -> tuple[PipelineModel, list[str], list[str]]:
    names = lambda part, key: [r["name"] for r in spark.read.schema(f"{key} int, name string").json(f"{path}/{part}").orderBy(key).collect()]
    return PipelineModel.load(f"{path}/model"), names("features", "place"), names("labels", "code")


def load_or_train(path: str, spark, train):
    """The saved bundle if there is one, else the result of ``train()``, which is saved."""
    try:
        return load_bundle(path, spark)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
            raise
    model, features, labels = train()
    save_bundle(path, model, features, labels, spark)
    return model, features, labels


def fit_pipeline(kind: str, df: DataFrame, features: list[str], label: str, classes: int, **params) -> PipelineModel:
    """Assembler and classifier as one saved unit; rows with missing values are kept and scored as missing."""
    rows = df.withColumn("label", F.col(label).cast("double"))
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, classifier(kind, classes, width=len(features), **params)]).fit(rows)
