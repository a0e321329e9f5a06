"""Learned operators on Spark ML: embeddings, topics, classifiers and a readiness regression."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from hemiciclo.functions import lexicons as lex
from hemiciclo.functions import text as T
from hemiciclo.operators.groups import term_weights
from hemiciclo.session import checkpointed

VOCABULARY = 1 << 18
COLUMNS, SPARE = 1 << 16, 10


def bag(df: DataFrame, text: str, vocabulary: int = VOCABULARY, least: float = 2.0):
    """df with words, and the fitted stage that counts them. Past `vocabulary` different words the rarest aren't counted: the models' own size."""
    stops = F.array(*(F.lit(w) for w in lex.STOPWORDS))
    with_words = df.withColumn("words", F.filter(T.words(F.col(text)), lambda w: ~F.array_contains(stops, w)))
    return with_words, CountVectorizer(inputCol="words", outputCol="counts", vocabSize=vocabulary, minDF=least).fit(with_words)


class Decomposed:
    """Texts as the left singular vectors of their term weights, times the singular values.

    Weights are tf * ln(N / df) without a norm or a shift. Every term has a column; past `columns`
    different terms they share columns by hash, so that what the driver holds of a model stays
    bounded and no term is dropped. The right singular vectors are found by subspace iteration:
    each round is one pass over the texts, whose matrices of columns * (k + SPARE) numbers are
    added in a tree; it ends when the singular values stand still. With them a text's vector is a
    product of its own weights, so the texts themselves are never factored.
    """

    def __init__(self, df: DataFrame, key: str, text: str, k: int = 50, columns: int = COLUMNS, rounds: int = 12, exact: float = 1e-7):
        weights = checkpointed(term_weights(df.select(key, text), key, text, lex.STOPWORDS))
        self.key, spark = key, df.sparkSession
        terms = weights.select("term").distinct()
        many = terms.count()
        if many > columns:
            self.terms = terms.withColumn("column", F.pmod(F.xxhash64("term"), F.lit(columns)))
        else:
            self.terms = terms.orderBy("term").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("term string, column bigint")
        self.terms = checkpointed(self.terms)
        placed = weights.join(self.terms, "term").groupBy(key, "column").agg(F.sum("tf_idf").alias("w"))
        # a text's columns are bounded by its own words
        rows = checkpointed(placed.groupBy(key).agg(F.collect_list("column").alias("at"), F.collect_list("w").alias("w")))
        n, width = rows.count(), max(1, min(many, columns))
        self.k = max(1, min(k, width - 1, n - 1))
        self.columns: np.ndarray | None = None
        schema = StructType([df.schema[key], StructField("embedding", ArrayType(DoubleType()))])
        if n < 2 or width < 2:
            self.vectors = spark.createDataFrame([], schema)
            return
        size = min(width, self.k + SPARE)
        basis = np.linalg.qr(np.random.default_rng(17).standard_normal((width, size)))[0]
        before = None
        for _ in range(rounds):
            product = self._twice(rows, basis)
            values = np.linalg.eigvalsh(basis.T @ product)[::-1][: self.k]
            if before is not None and np.abs(values - before).max() <= exact * max(values[0], 1e-300):
                break
            before, basis = values, np.linalg.qr(product)[0]
        product = self._twice(rows, basis)
        values, turned = np.linalg.eigh(basis.T @ product)
        self.columns = basis @ turned[:, ::-1][:, : self.k]
        self.values = np.sqrt(np.maximum(values[::-1][: self.k], 0))
        shared = spark.sparkContext.broadcast(self.columns)  # columns * k numbers

        def run(batches):
            for b in batches:
                found = [np.asarray(w) @ shared.value[at] for at, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tolist() for v in found], pa.list_(pa.float64()))], names=[key, "embedding"])

        self.vectors = rows.select(key, "at", "w").mapInArrow(run, schema)

    @staticmethod
    def _twice(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
        """The weights' transpose times the weights times a basis, in one pass."""
        shared = rows.sparkSession.sparkContext.broadcast(basis)

        def part(records):
            out = np.zeros(shared.value.shape)
            for r in records:
                at, w = np.asarray(r["at"]), np.asarray(r["w"])
                out[at] += w[:, None] * (w @ shared.value[at])[None, :]
            yield out

        return rows.select("at", "w").rdd.mapPartitions(part).treeReduce(lambda a, b: a + b)

    def top_terms(self, direction: np.ndarray, n: int = 4) -> list[str]:
        """The n terms of greatest weight along a direction; of terms that share a column the smallest."""
        best = [int(i) for i in np.argsort(-np.abs(self.columns @ direction), kind="stable")[:n]]
        names = {r["column"]: r["term"] for r in self.terms.where(F.col("column").isin(best)).groupBy("column").agg(F.min("term").alias("term")).collect()}
        return [names[i] for i in best if i in names]


def svd_vectors(df: DataFrame, key: str, text: str, k: int = 50, columns: int = COLUMNS) -> DataFrame:
    """key, embedding (array of up to k) and method: term weights by truncated singular value decomposition, U times the singular values.

    k is at most the number of terms or texts less one. Signs of the directions aren't unique. Texts
    without a word are left out; fewer than two texts or terms give no rows.
    """
    return Decomposed(df, key, text, k, columns).vectors.withColumn("embedding_method", F.lit("tfidf_svd"))


def topics_number(n: int) -> int:
    return max(6, min(12, round(n**0.5)))


def topics(df: DataFrame, key: str, text: str, k: int | None = None, iterations: int = 10) -> DataFrame:
    """key, topic (its strongest), gamma and the topic's first words; latent Dirichlet allocation with 6 to 12 topics by the number of texts."""
    words, counter = bag(df.select(key, text), text)
    counted = checkpointed(counter.transform(words).select(key, "counts"))
    model = LDA(k=k or topics_number(counted.count()), maxIter=iterations, seed=1234, featuresCol="counts").fit(counted)
    names = [" ".join(counter.vocabulary[i] for i in row["termIndices"][:4]) for row in model.describeTopics(4).orderBy("topic").collect()]  # k rows
    found = model.transform(counted).select(key, vector_to_array("topicDistribution").alias("g"))
    best = found.withColumn("gamma", F.array_max("g")).withColumn("topic", F.array_position("g", F.col("gamma")).cast("int"))
    return best.select(key, "topic", F.round("gamma", 6).alias("gamma"), F.get(F.array(*(F.lit(n) for n in names)), F.col("topic") - 1).alias("topic_label"))


def topics_by_means(df: DataFrame, key: str, text: str, k: int | None = None) -> DataFrame:
    """key, topic and its label, where no topic model can be fitted: k-means of the singular vectors, 4 to 10 clusters by the number of texts.

    A label is the four terms of greatest weight along the cluster's centre.
    """
    space = Decomposed(df, key, text)
    n = space.vectors.count()
    if n < 2:
        return space.vectors.select(key, F.lit(None).cast("int").alias("topic"), F.lit(None).cast("string").alias("topic_label"))
    ready = space.vectors.select(key, array_to_vector("embedding").alias("features"))
    model = KMeans(k=min(n, k or max(4, min(10, int(n**0.5)))), seed=1234, maxIter=50).fit(ready)
    labels = [", ".join(space.top_terms(np.asarray(c))) for c in model.clusterCenters()]  # k short strings
    return model.transform(ready).select(key, (F.col("prediction") + 1).alias("topic"), F.get(F.array(*(F.lit(x) for x in labels)), F.col("prediction")).alias("topic_label"))


class LabelModel:
    """A sparse multinomial model of labels by the words of a text.

    Classes of under `least` labelled rows take no part. Folds are dealt in turn within each class,
    by hash of the key. The penalty is the best of `penalties` by log loss on one fold that is held
    out for it. Words in under `word_least` texts aren't counted.
    """

    def __init__(self, df: DataFrame, key: str, text: str, label: str, folds: int = 5, penalties: tuple[float, ...] = (0.0005, 0.002, 0.008), least: int = 8, word_least: float = 5.0):
        self.key, self.folds = key, folds
        rows = df.select(key, text, F.col(label).alias("truth"))
        kept = rows.where("truth IS NOT NULL").groupBy("truth").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("truth").alias("kept"))
        rows = rows.join(kept, F.col("truth") == F.col("kept"), "left")
        labelled = rows.where("kept IS NOT NULL")
        # in turn within a class, in parts that are numbered apart, so that no class is one task's
        part = Window.partitionBy("truth", "part").orderBy(F.xxhash64(key), key)
        dealt = labelled.withColumn("part", F.pmod(F.xxhash64(key, F.lit(5)), F.lit(64))).withColumn("fold", F.pmod(F.row_number().over(part) + F.col("part"), F.lit(folds))).select(key, "fold")
        _, self.counter = bag(labelled, text, VOCABULARY, word_least)
        words = rows.withColumn("words", F.coalesce(T.words(F.col(text)), F.array().cast("array<string>")))
        data = self.counter.transform(words).join(dealt, key, "left")
        self.ready = StringIndexer(inputCol="truth", outputCol="y", stringOrderType="alphabetAsc").fit(data.where("fold IS NOT NULL"))
        self.labels = self.ready.labels
        self.data = checkpointed(data.select(key, "truth", "fold", "counts"))
        self.train = checkpointed(self.ready.transform(self.data.where("fold IS NOT NULL")))
        inner = F.col("fold") == 0
        scores = {p: self._loss(self._fit(self.train.where(~inner), p), self.train.where(inner)) for p in penalties} if len(penalties) > 1 and len(self.labels) > 1 else {penalties[0]: 0.0}
        self.penalty = min(scores, key=lambda p: (scores[p], p))

    def _fit(self, rows: DataFrame, penalty: float):
        return LogisticRegression(featuresCol="counts", labelCol="y", family="multinomial", elasticNetParam=1.0, regParam=penalty, maxIter=30).fit(rows)

    def _loss(self, model, rows: DataFrame) -> float:
        p = F.greatest(F.get(vector_to_array("probability"), F.col("y").cast("int")), F.lit(1e-9))
        return model.transform(rows).agg(F.avg(-F.log(p))).first()[0] or 0.0

    def _named(self, scored: DataFrame) -> DataFrame:
        labels = F.array(*(F.lit(x) for x in self.labels))
        return scored.select(self.key, "truth", F.get(labels, F.col("prediction").cast("int")).alias("pred"), F.round(F.array_max(vector_to_array("probability")), 6).alias("prob"))

    def out_of_fold(self) -> DataFrame:
        """key, truth, pred and prob of the labelled rows, each predicted by the model that didn't see it."""
        parts = [self._fit(self.train.where(F.col("fold") != f), self.penalty).transform(self.train.where(F.col("fold") == f)) for f in range(self.folds)]
        return self._named(reduce(DataFrame.unionByName, parts))

    def predicted(self) -> DataFrame:
        """key, truth (null where there is none), pred and prob of all rows, by the model of all labelled ones."""
        self.model = self._fit(self.train, self.penalty)
        return self._named(self.model.transform(self.data))

    def save(self, folder: str) -> None:
        """The fitted stages, as Spark ML writes them; the labels stand in the indexer."""
        for name, stage in (("words", self.counter), ("labels", self.ready), ("model", self._fit(self.train, self.penalty))):
            stage.write().overwrite().save(f"{folder}/{name}")


def predicted_by(folder: str, df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pred and prob of any texts by a label model that save() wrote."""
    counter, ready, model = CountVectorizerModel.load(f"{folder}/words"), StringIndexerModel.load(f"{folder}/labels"), LogisticRegressionModel.load(f"{folder}/model")
    rows = df.select(key, F.coalesce(T.words(F.col(text)), F.array().cast("array<string>")).alias("words"))
    labels = F.array(*(F.lit(x) for x in ready.labels))
    return model.transform(counter.transform(rows)).select(key, F.get(labels, F.col("prediction").cast("int")).alias("pred"), F.round(F.array_max(vector_to_array("probability")), 6).alias("prob"))


def cross_validated(df: DataFrame, key: str, text: str, label: str, **options) -> DataFrame:
    """Out-of-fold predictions of LabelModel."""
    return LabelModel(df, key, text, label, **options).out_of_fold()


class Readiness:
    """A random forest of a score by features; it stands in for Bayesian trees.

    Rows with a null target or number take no part; categories are one column for each value, null
    being one; features of a single value are dropped; 80 % by hash train.
    """

    def __init__(self, df: DataFrame, key: str, target: str, features: list[str], categories: list[str] = (), trees: int = 40, others: list[str] = ()):
        rows = df.select(key, F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in features), *(F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in categories), *others).dropna(subset=["y", *features])
        several = rows.agg(*(F.count_distinct(c).alias(c) for c in [*features, *categories])).first().asDict()
        self.key, self.features, self.categories = key, [c for c in features if several[c] > 1], [c for c in categories if several[c] > 1]
        self.rows = checkpointed(rows.withColumn("is_train", F.pmod(F.xxhash64(key), F.lit(10)) < 8))
        stages = [StringIndexer(inputCols=self.categories, outputCols=[f"{c}__i" for c in self.categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__i" for c in self.categories], outputCols=[f"{c}__v" for c in self.categories])] if self.categories else []
        self.pipe = Pipeline(stages=[*stages, VectorAssembler(inputCols=[*self.features, *(f"{c}__v" for c in self.categories)], outputCol="x")]).fit(self.rows)
        self.model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=6, seed=7).fit(self.pipe.transform(self.rows.where("is_train")))

    def predictions(self, *others: str) -> DataFrame:
        """key, is_train, target, predicted, residual, and sd, the spread of the trees' predictions."""
        scored = self.model.transform(self.pipe.transform(self.rows))
        names = []
        for i, tree in enumerate(self.model.trees):
            names.append(f"__t{i}")
            scored = tree.setFeaturesCol("x").setPredictionCol(names[-1]).transform(scored)
        each = F.array(*names)
        mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(names)
        spread = F.sqrt(F.aggregate(each, F.lit(0.0), lambda a, x: a + (x - F.col("__mean")) * (x - F.col("__mean"))) / max(1, len(names) - 1))
        return scored.withColumn("__mean", mean).select(self.key, *others, "is_train", F.col("y").alias("target"), F.col("prediction").alias("predicted"), (F.col("y") - F.col("prediction")).alias("residual"), spread.alias("sd"))

    def importances(self) -> list[tuple[str, float]]:
        """Features and their part of the forest's gain, in percent, highest first; a category's columns together."""
        gains = self.model.featureImportances.toArray()
        parts = dict(zip(self.features, gains[: len(self.features)]))
        at = len(self.features)
        if self.categories:
            for c, size in zip(self.categories, self.pipe.stages[1].categorySizes):
                width = size if self.pipe.stages[1].getDropLast() is False else size - 1
                parts[c], at = gains[at : at + width].sum(), at + width
        return sorted(((f, 100 * float(g)) for f, g in parts.items()), key=lambda x: (-x[1], x[0]))

    def dependence(self, grid: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9), reference: int = 1200, top: int = 8) -> DataFrame:
        """feature, value, mean, low and high (10 and 90 %) of the predictions with a feature set to a value, for the `top` numbers of most gain.

        Values are the feature's own if it has two, else its quantiles at `grid`. The mean is over at
        most `reference` rows, those of smallest hash: its own feature.
        """
        chosen = [f for f, _ in self.importances() if f in self.features][:top]
        points = self.rows.agg(*(F.percentile(c, list(grid)).alias(c) for c in chosen), *(F.array_sort(F.collect_set(F.when(F.col(c).isin(0.0, 1.0), F.col(c)).otherwise(F.lit(None)))).alias(f"{c}__two") for c in chosen), *(F.count_distinct(c).alias(f"{c}__n") for c in chosen))  # one row of a few numbers
        sample = checkpointed(self.rows.orderBy(F.xxhash64(self.key, F.lit(1))).limit(reference))
        curves = []
        for c in chosen:
            values = F.when((F.col(f"{c}__n") <= 2) & (F.size(f"{c}__two") == F.col(f"{c}__n")), F.col(f"{c}__two")).otherwise(F.array_distinct(c))
            moved = sample.drop(c).join(F.broadcast(points.select(F.explode(values).alias(c))), F.lit(True))
            scored = self.model.transform(self.pipe.transform(moved))
            curves.append(scored.groupBy(c).agg(F.avg("prediction").alias("mean"), F.percentile("prediction", 0.1).alias("low"), F.percentile("prediction", 0.9).alias("high")).select(F.lit(c).alias("feature"), F.col(c).alias("value"), "mean", "low", "high"))
        return reduce(DataFrame.unionByName, curves)

    def save(self, folder: str) -> None:
        self.pipe.write().overwrite().save(f"{folder}/features")
        self.model.write().overwrite().save(f"{folder}/model")


def readiness(df: DataFrame, key: str, target: str, features: list[str], trees: int = 40, **options) -> tuple[DataFrame, DataFrame]:
    """Predictions and partial dependence of a Readiness model."""
    model = Readiness(df, key, target, features, trees=trees)
    return model.predictions(), model.dependence(**options)


def residuals_by_group(predicted: DataFrame, group: str) -> DataFrame:
    """group, rows_n, means of target, prediction, residual and its size, and which way the model errs."""
    means = predicted.groupBy(group).agg(F.count("*").alias("rows_n"), F.avg("target").alias("actual_mean"), F.avg("predicted").alias("pred_mean"), F.avg("residual").alias("residual_mean"), F.avg(F.abs("residual")).alias("residual_abs_mean"))
    return means.withColumn("sign", F.when(F.col("residual_mean") >= 0, "underestimated").otherwise("overestimated"))


def importances(df: DataFrame, key: str, target: str, features: list[str], trees: int = 40) -> list[tuple[str, float]]:
    """Features and their part of the forest's gain, in percent, highest first."""
    return Readiness(df, key, target, features, trees=trees).importances()


def plane(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x, y and method: the first two directions of an embedding as a map."""
    return vectors.select(key, F.get(vector, F.lit(0)).alias("x"), F.get(vector, F.lit(1)).alias("y"), F.lit("svd_first2").alias("method"))


def label_source(gold: DataFrame, silver: DataFrame, label: str, least: int = 60) -> tuple[DataFrame, str]:
    """The gold labels if there are enough of them, else the rule labels; and which they are."""
    enough = gold.where(F.col(label).isNotNull()).limit(least).count() >= least
    return (gold, "gold") if enough else (silver, "silver")


def errors(predicted: DataFrame) -> dict[str, float]:
    """RMSE, MAE and R² of held-out rows."""
    held = predicted.where("NOT is_train")
    return {m: RegressionEvaluator(labelCol="target", predictionCol="predicted", metricName=m).evaluate(held) for m in ("rmse", "mae", "r2")}
