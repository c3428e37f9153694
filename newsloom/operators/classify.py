"""Text classification: tokens, TF-IDF and linear models, with margins and an UNKNOWN for texts without features."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, Normalizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import STOPWORDS, model_tokens

#: Longest n-grams, least documents, whether term frequencies are sublinear.
GRID = list(product((1, 2, 3), (1, 3, 5), (False, True)))


@F.udf(VectorUDT())
def damped(counts):
    """1 + ln of each count that isn't 0; a vector at a time."""
    return Vectors.sparse(counts.size, counts.indices, 1.0 + np.log(counts.values)) if counts.numNonzeros() else counts


class Sublinear(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Sublinear term frequencies of a column of counts."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), damped(self.getInputCol()))


def with_tokens(df: DataFrame, text: str = "text", stopwords: list[str] = STOPWORDS) -> DataFrame:
    return df.withColumn("tokens", model_tokens(F.coalesce(text, F.lit("")), stopwords))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """df with weight: rows over classes times the class's rows, so that classes weigh alike."""
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))  # one row
    w = counts.crossJoin(F.broadcast(total)).select(F.col(label).alias("_l"), (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(w), F.col(label) == F.col("_l")).drop("_l")  # a row for each class


def features(longest: int = 1, min_df: int = 5, vocabulary: int = 1 << 18, sublinear: bool = False) -> list[Transformer]:
    """n-grams up to longest, counted (sublinear: 1 + ln of the count), weighted by IDF, of length 1."""
    stages, columns = [], []
    for n in range(1, longest + 1):
        stages.append(NGram(n=n, inputCol="tokens", outputCol=f"grams{n}"))
        stages.append(CountVectorizer(inputCol=f"grams{n}", outputCol=f"counts{n}", minDF=float(min_df), vocabSize=vocabulary))
        columns.append(f"counts{n}")
    stages.append(VectorAssembler(inputCols=columns, outputCol="counts"))
    if sublinear:
        stages.append(Sublinear(inputCol="counts", outputCol="damped"))
    stages += [IDF(inputCol="damped" if sublinear else "counts", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features")]
    return stages


MODELS = {
    "linear_svm": lambda n: OneVsRest(classifier=LinearSVC(maxIter=n, regParam=0.01), labelCol="target", weightCol="weight"),
    "logistic_regression": lambda n: LogisticRegression(maxIter=n, regParam=0.001, labelCol="target", weightCol="weight"),
    "naive_bayes": lambda _: NaiveBayes(labelCol="target", weightCol="weight"),
}


def train(df: DataFrame, label: str = "label", model: str = "linear_svm", balanced: bool = True, longest: int = 1, min_df: int = 5, rounds: int = 50, sublinear: bool = False) -> PipelineModel:
    """A model of tokens; save and load it as any PipelineModel."""
    rows = balanced_weights(df, label) if balanced else df.withColumn("weight", F.lit(1.0))
    indexer = StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    names = IndexToString(inputCol="prediction", outputCol="label_found", labels=indexer.labels)
    stages = [SQLTransformer(statement=f"SELECT *, {float(len(indexer.labels))} AS classes FROM __THIS__"), *features(longest, min_df, sublinear=sublinear)]
    index = indexer.setOutputCol("target").transform(rows)
    return Pipeline(stages=[*stages, MODELS[model](rounds), names]).fit(index.where(F.col("target") < len(indexer.labels)))


def predict(model: PipelineModel, df: DataFrame, text: str = "text", top: int = 0) -> DataFrame:
    """df with prediction, score, margin and status; blank texts and ones without features are UNKNOWN.

    score is the largest decision value and margin what it is above the second; of two classes, that of the second class, and its absolute
    value. top: also labels, that many (label, score), best first.
    """
    names = model.stages[-1].getLabels()
    out = model.transform(with_tokens(df.drop("tokens"), text))
    each = F.transform(vector_to_array("rawPrediction"), lambda s, i: F.struct(s.alias("score"), F.element_at(F.array(*map(F.lit, names)), i + 1).alias("label")))
    ranked: Column = F.array_sort(each, lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(0))
    known = (F.trim(F.coalesce(text, F.lit(""))) != "") & F.exists(vector_to_array("features"), lambda x: x != 0)
    out = out.withColumn("_s", ranked).withColumn("_raw", vector_to_array("rawPrediction")).withColumn("_known", F.coalesce(known, F.lit(False)))
    when = lambda c: F.when(F.col("_known"), c)
    two = len(names) == 2
    score = F.col("_raw")[1] if two else F.col("_s")[0]["score"]
    margin = F.abs(score) if two else score - F.col("_s")[1]["score"]
    labels = [when(F.transform(F.slice("_s", 1, top), lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")))).alias("labels")] if top else []
    return out.select(*df.columns, when(F.col("label_found")).alias("prediction"), when(score).alias("score"), when(margin).alias("margin"), F.when(F.col("_known"), "OK").otherwise("UNKNOWN").alias("status"), *labels)


def grid(train_rows: DataFrame, held_out: DataFrame, label: str = "label", settings: list[tuple] = GRID, model: str = "logistic_regression") -> list[dict]:
    """Macro F1 of each setting on held-out rows, best first."""
    from newsloom.operators.evaluate import per_class

    found = []
    for longest, min_df, sublinear in settings:
        m = train(train_rows, label, model, True, longest, min_df, sublinear=sublinear)
        p = predict(m, held_out).withColumn("ground_truth", F.col(label)).withColumn("correct", F.coalesce(F.col("prediction") == F.col(label), F.lit(False)))
        found.append({"longest": longest, "min_df": min_df, "sublinear": sublinear, "macro_f1": per_class(p.where("prediction is not null")).agg(F.avg("f1")).first()[0]})
    return sorted(found, key=lambda r: -(r["macro_f1"] or 0.0))
