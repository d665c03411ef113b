"""Character n-gram TF-IDF with a class-balanced logistic regression."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlgauge.functions.text import char_ngrams_sql
from urlgauge.models.tabular import without_summary
from urlgauge.operators.ngrams import class_weights, document_frequency, idf
from urlgauge.operators.split import exact_sample
from urlgauge.session import materialize

# N-gram sizes, document-frequency cut, iteration limit, tolerance.
LOW, HIGH, MIN_DF, MAX_ITER, TOLERANCE = 2, 3, 2, 2000, 1e-4

# Labelled rows a text model is fitted on at most.  A linear model keeps a weight
# per gram on the driver, and the rows of the fit bound the grams there can be.
FIT_ROWS = 500_000

GRAMS, COUNTS, SCALED, VECTOR = "_grams", "_gram_counts", "_gram_scaled", "_gram_vector"
ONE, INPUTS = "_one", "_text_inputs"


def fit_vectorizer(
    train: DataFrame,
    text: str = "url",
    low: int = LOW,
    high: int = HIGH,
    min_df: int = MIN_DF,
    documents: int | None = None,
) -> list[Transformer]:
    """Stages turning ``text`` into an L2-normalised TF-IDF vector.

    Document frequencies come from one aggregate; only the vocabulary itself, which
    the rows of ``train`` bound, reaches the driver.  Transforming is map-side.
    """
    documents = train.count() if documents is None else documents
    frequency = document_frequency(train, text, low, high, min_df)
    weighted = frequency.select("gram", idf(F.col("df"), F.lit(documents)).alias("idf"))
    rows = weighted.collect()
    if not rows:
        raise ValueError(f"no n-gram occurs in {min_df} or more texts")
    rows.sort(key=lambda row: row["gram"])
    return [
        SQLTransformer(statement=f"SELECT *, {char_ngrams_sql(text, low, high)} AS {GRAMS} FROM __THIS__"),
        CountVectorizerModel.from_vocabulary([row["gram"] for row in rows], GRAMS, COUNTS),
        ElementwiseProduct(
            scalingVec=Vectors.dense([row["idf"] for row in rows]), inputCol=COUNTS, outputCol=SCALED
        ),
        Normalizer(p=2.0, inputCol=SCALED, outputCol=VECTOR),
    ]


def fit_text_model(
    train: DataFrame,
    text: str = "url",
    label: str = "label",
    max_iter: int = MAX_ITER,
    rows: int | None = FIT_ROWS,
    seed: int = 42,
    tolerance: float = TOLERANCE,
    **vectorizer,
) -> PipelineModel:
    """Vectoriser and classifier as one savable pipeline.

    Balanced weights add up to the row count, so an L2 strength of 1/rows is the
    usual C = 1.  The intercept is penalised like any other weight: it is the weight
    of a column that is one everywhere, the last of the coefficients.  ``rows`` bounds the
    labelled rows of the fit: an exact sample by a hash of the text, ``None`` for
    all.  Texts and vectors are stored once, for the several passes of the fit.
    """
    narrow = materialize(train.select(text, label))
    narrow = narrow if rows is None else exact_sample(narrow, rows, text, seed)
    classes = class_weights(narrow, label).collect()
    fitted = sum(row["n"] for row in classes)
    stages = fit_vectorizer(narrow, text, documents=fitted, **vectorizer)
    weight = F.lit(None).cast("double")
    for row in classes:
        weight = F.when(F.col(label) == row[label], row["weight"]).otherwise(weight)
    stages += [
        SQLTransformer(statement=f"SELECT *, 1.0D AS {ONE} FROM __THIS__"),
        VectorAssembler(inputCols=[VECTOR, ONE], outputCol=INPUTS),
    ]
    vectors = PipelineModel(stages).transform(narrow).select(INPUTS, label, weight.alias("_weight"))
    # MLlib gives a column without variance no weight.  A row of zeros has the same loss whatever the weights are, so
    # one that counts as much as all others changes nothing but the variance of the column of ones.
    blank = [(Vectors.sparse(len(stages[1].vocabulary) + 1, [], []), float(fitted))]
    zeros = vectors.sparkSession.createDataFrame(blank, [INPUTS, "_weight"])
    zeros = zeros.select(INPUTS, F.lit(0).cast(vectors.schema[label].dataType).alias(label), "_weight")
    vectors = materialize(vectors.union(zeros))
    classifier = LogisticRegression(
        featuresCol=INPUTS,
        labelCol=label,
        weightCol="_weight",
        fitIntercept=False,
        regParam=0.5 / fitted,  # the row of zeros doubles the weight of all
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tolerance,
        rawPredictionCol="_text_raw",
        probabilityCol="_text_probability",
        predictionCol="_text_prediction",
    )
    return PipelineModel([*stages, without_summary(classifier.fit(vectors))])


def with_text_scores(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``text_logit``, ``text_proba`` and ``text_pred`` from a text model."""
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        vector_to_array("_text_raw")[1].alias("text_logit"),
        vector_to_array("_text_probability")[1].alias("text_proba"),
        F.col("_text_prediction").cast("int").alias("text_pred"),
    )


def out_of_fold_text_scores(
    train: DataFrame, folds: int = 5, seed: int = 42, key: str = "url", **options
) -> DataFrame:
    """Text scores for training rows, each from a model that has not seen the row.

    Folds follow a hash of the key.  One model per fold; the passes are inherent.
    """
    fold = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds))
    marked = materialize(train.withColumn("_fold", fold))
    parts = [
        with_text_scores(
            marked.filter(F.col("_fold") == k).drop("_fold"),
            fit_text_model(marked.filter(F.col("_fold") != k), key, **options),
        )
        for k in range(folds)
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined
