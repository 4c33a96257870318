"""Intent of an utterance from word counts and character n-grams within words."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda word: word != "")


def word_ngrams(tokens: Column, longest: int = 4) -> Column:
    """Character n-grams of length 1 to `longest` inside each blank-padded word."""
    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        of_length = [
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))),
                        lambda start, n=n: F.substring(padded, start, F.lit(n)))
            for n in range(1, longest + 1)
        ]
        return F.concat(*of_length)

    return F.flatten(F.transform(tokens, grams))


def features(utterances: DataFrame, text: str = "text") -> DataFrame:
    tokens = words(F.col(text))
    return utterances.withColumn("words", tokens).withColumn("grams", word_ngrams(tokens))


def train_intents(examples: DataFrame, text: str = "text", intent: str = "intent",
                  width: int = 1 << 18) -> PipelineModel:
    """Fit on annotated examples; every term counts, at its hash in one of two indexes of fixed width."""
    stages = [
        StringIndexer(inputCol=intent, outputCol="intent_index", stringOrderType="alphabetAsc"),
        HashingTF(inputCol="words", outputCol="word_counts", numFeatures=width),
        HashingTF(inputCol="grams", outputCol="gram_counts", numFeatures=width),
        VectorAssembler(inputCols=["word_counts", "gram_counts"], outputCol="features"),
        LogisticRegression(labelCol="intent_index", maxIter=10, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(features(examples, text))


def tag_intents(model: PipelineModel, utterances: DataFrame, text: str = "text") -> DataFrame:
    """Add predicted_intent."""
    # Labels are known from training, so the index stage is skipped when applying.
    indexer, *rest = model.stages
    tagged = PipelineModel(rest).transform(features(utterances, text))
    names = IndexToString(inputCol="prediction", outputCol="predicted_intent",
                          labels=indexer.labels)
    added = ["words", "grams", "word_counts", "gram_counts", "features", "rawPrediction",
             "probability", "prediction"]
    return names.transform(tagged).drop(*added)
