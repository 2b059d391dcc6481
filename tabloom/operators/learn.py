"""Model fitting. Counting models are plain aggregations; the others use MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.text import drop_stop_words, words_of_rows
from tabloom.sources.inline import inline_table

MAX_CLASSES = 1000


def class_values(df: DataFrame, label: str) -> list:
    """The classes in order; more than ``MAX_CLASSES`` is an error."""
    found = df.select(label).filter(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in found)


def _argmax(scores: Sequence[Column], classes: Sequence) -> Column:
    """Class of the highest score, the first one on ties."""
    ranked = F.array(
        *[
            F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(c).alias("c"))
            for i, (s, c) in enumerate(zip(scores, classes))
        ]
    )
    return F.array_max(ranked)["c"]


def nb_multinomial(
    train: DataFrame, test: DataFrame, doc: str, label: str, tokens: str = "tokens", alpha: float = 1.0,
    stop: Sequence[str] = (),
) -> DataFrame:
    """(doc, predicted) for every test document. ``tokens`` is an array column in both inputs.

    Each document counts its own words first, so a word joins the model once per document, not once per token. The
    vocabulary is the training words without the ``stop`` words, which are dropped after a document has counted its own;
    a document with no known word gets the most frequent class.
    """
    classes = class_values(train, label)
    prior = train.groupBy().pivot(label, classes).agg(F.count(label))
    prior = prior.select(F.struct(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(classes)])).scalar()
    words = drop_stop_words(words_of_rows(train, F.col(tokens), [label]), stop).withColumnRenamed("word", "_word")
    counts = words.groupBy("_word").pivot(label, classes).agg(F.sum("tf")).na.fill(0)
    totals = counts.agg(
        F.struct(F.count("*").alias("v"), *[F.sum(f"`{c}`").alias(f"t{i}") for i, c in enumerate(classes)])
    ).scalar()
    model = counts.select(
        "_word",
        *[
            F.log((F.col(f"`{c}`") + alpha) / (totals[f"t{i}"] + totals["v"] * alpha)).alias(f"_l{i}")
            for i, c in enumerate(classes)
        ],
    )
    asked = drop_stop_words(words_of_rows(test, F.col(tokens), [doc]), stop).withColumnRenamed("word", "_word")
    found = asked.join(model, "_word").select(
        doc, *[(F.col("tf") * F.col(f"_l{i}")).alias(f"_l{i}") for i in range(len(classes))])
    every = test.select(doc, *[F.lit(0.0).alias(f"_l{i}") for i in range(len(classes))]).unionByName(found)
    sums = every.groupBy(doc).agg(*[F.sum(f"_l{i}").alias(f"_l{i}") for i in range(len(classes))])
    scores = [F.col(f"_l{i}") + F.log(prior[f"p{i}"]) for i in range(len(classes))]
    return sums.select(doc, _argmax(scores, classes).alias("predicted"))


def nb_bernoulli(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0
) -> DataFrame:
    """Add ``predicted``. Features count as on when they are above zero.

    The model is one count per class and feature: a single aggregation, then a
    table of at most ``MAX_CLASSES`` rows turned into an expression.
    """
    model = (
        train.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("_n"), *[F.count_if(F.col(f) > 0).alias(f"_f{i}") for i, f in enumerate(features)])
        .orderBy(label)
        .limit(MAX_CLASSES + 1)
        .collect()
    )
    if len(model) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    total = sum(r["_n"] for r in model)
    scores = []
    for row in model:
        score = F.log(F.lit(row["_n"] / total))
        for i, f in enumerate(features):
            on = (row[f"_f{i}"] + alpha) / (row["_n"] + 2 * alpha)
            score = score + F.when(F.col(f) > 0, F.log(F.lit(on))).otherwise(F.log(F.lit(1 - on)))
        scores.append(score)
    return test.withColumn("predicted", _argmax(scores, [r[label] for r in model]))


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector column; rows with a null feature are left out."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(df)


def linreg(train: DataFrame, features: Sequence[str], label: str):
    """Ordinary least squares over a feature vector, by the normal equations."""
    model = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0)
    return model.fit(assemble(train, features))


def linreg_terms(model, features: Sequence[str], test_errors: DataFrame) -> DataFrame:
    """(term, value): intercept, one coefficient per column, and the test error."""
    terms = [("intercept", float(model.intercept))]
    terms += [(f, float(c)) for f, c in zip(features, model.coefficients)]
    rows = inline_table(test_errors.sparkSession, terms, "term string, value double")
    return rows.unionByName(test_errors.select(F.lit("rmse").alias("term"), F.col("rmse").alias("value")))


def linreg_predict(model, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Add ``fitted`` and ``residual`` (fitted less observed) as plain expressions."""
    fitted = F.lit(float(model.intercept))
    for f, c in zip(features, model.coefficients):
        fitted = fitted + F.col(f) * F.lit(float(c))
    return df.withColumn("fitted", fitted).withColumn("residual", F.col("fitted") - F.col(label))


def logreg(train: DataFrame, features: Sequence[str], label: str, penalty: float = 1.0):
    """L2-penalised logistic regression, ``penalty`` in total; features come scaled."""
    rows = assemble(train, features)
    return LogisticRegression(
        featuresCol="features", labelCol=label, regParam=penalty / max(rows.count(), 1), standardization=False,
        maxIter=200, tol=1e-9,
    ).fit(rows)


def with_probability(model, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep…, predicted, score): class and probability of the positive class."""
    out = model.transform(assemble(df, features))
    return out.select(
        *keep, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("score")
    )


def dtree(label: str, seed: int = 66, **params) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol="features", labelCol=label, seed=seed, **params)


def mlp(label: str, inputs: int, classes: int = 2, hidden: Sequence[int] = (6, 6), **params):
    """A small network: two hidden layers of six and one output per class."""
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=label, layers=[inputs, *hidden, classes], **params
    )


def scaled_pipeline(features: Sequence[str], model) -> Pipeline:
    """The model on columns standardised by mean and deviation of the rows it is fitted on."""
    gather = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip")
    return Pipeline(stages=[gather, StandardScaler(inputCol="_raw", outputCol="features", withMean=True), model])
