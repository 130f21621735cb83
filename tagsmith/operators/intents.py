"""Intents of search texts by multinomial Bayes, with weights in a table.

Training counts words by intent; every count becomes a weight, and a word's weights one row. Scoring
joins the words of the queries to these rows and adds up. What the driver and every plan hold is one
row for each intent, never words times intents. Scores are whole millionths of natural logarithms, so
sums are exact and don't depend on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.sources.tables import materialized

UNIT = 1_000_000
#: Terms up to which a query's words are added up where they are joined, as Spark may then broadcast the weights.
FEW_TERMS = 200_000


@dataclass(frozen=True)
class IntentModel:
    """`weights`: term, intents (intent, weight); `intents`: intent, prior, unseen."""

    weights: DataFrame
    intents: DataFrame

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.intents.write.mode("overwrite").parquet(f"{path}/intents")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IntentModel:
        return cls(spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/intents"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def _log(c: Column) -> Column:
    return F.round(F.ln(c) * UNIT).cast("bigint")


def train_intents(labelled: DataFrame, text_col: str = "search_query",
                  label_col: str = "standard_attribute_key") -> IntentModel:
    """Weights from cleaned, labelled texts; rows without a label are left out. Every count is raised by
    one, so a word that an intent has never had is unlikely there, not impossible."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("intent"), _words(F.col(text_col)).alias("words"))
    counts = materialized(
        rows.select("intent", F.explode("words").alias("term")).groupBy("intent", "term").agg(
            F.count(F.lit(1)).alias("n")), "intent_counts")
    weights = counts.groupBy("term").agg(F.sort_array(F.collect_list(
        F.struct("intent", _log(F.col("n") + 1.0).alias("weight")))).alias("intents"))
    vocabulary = counts.agg(F.count_distinct("term").alias("n")).scalar()
    queries = rows.groupBy("intent").agg(F.count(F.lit(1)).alias("queries"))
    total = rows.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    words = counts.groupBy("intent").agg(F.sum("n").alias("words"))
    intents = queries.join(words, "intent", "left").select(
        "intent", _log(F.col("queries") / total).alias("prior"),
        (-_log(F.coalesce("words", F.lit(0)) + F.greatest(vocabulary, F.lit(1)).cast("double"))).alias("unseen"))
    return IntentModel(materialized(weights, "intent_weights"), materialized(intents, "intents"))


def predict_intents(model: IntentModel, queries: DataFrame, text_col: str = "search_query",
                    out: str = "standard_attribute_key") -> DataFrame:
    """The most likely intent of each query (of equal ones the first by name) and its probability.

    Words that training hasn't seen don't count; a query without known words gets the most frequent
    intent. A model without intents gives NULL.
    """
    rows = materialized(queries.select(F.struct(*queries.columns).alias("query"),
                                       F.monotonically_increasing_id().alias("row")), "queries")
    words = rows.select("row", F.explode(_words(F.col(f"query.{text_col}"))).alias("term"))
    nothing = F.lit(None).cast("string")
    # besides its weights, every known word counts one under no intent
    own = F.concat(F.array(F.struct(nothing.alias("intent"), F.lit(1).cast("bigint").alias("weight"))), "intents")
    weighed = words.join(model.weights, "term").select("row", own.alias("own"))
    if model.weights.count() > FEW_TERMS:
        # joined by term, every task has words of almost every query: sums there would hold one entry for each
        weighed = weighed.repartition("row")
    sums = weighed.select("row", F.inline("own")).groupBy("row", "intent").agg(F.sum("weight").alias("weight"))
    found = sums.groupBy("row").agg(
        F.max(F.when(F.col("intent").isNull(), F.col("weight"))).alias("known"),
        F.map_from_entries(F.collect_list(F.when(F.col("intent").isNotNull(), F.struct("intent", "weight")))).alias("sums"))
    names = model.intents.agg(F.sort_array(F.collect_list(F.struct("intent", "prior", "unseen")))).scalar()

    def score(x: Column) -> Column:
        seen = F.coalesce(F.element_at("sums", x["intent"]), F.lit(0))
        return x["prior"] + x["unseen"] * F.coalesce("known", F.lit(0)) + seen

    scored = rows.join(found, "row", "left").withColumn("names", names)
    scored = scored.withColumn("scores", F.transform("names", score)).withColumn("top", F.array_max("scores"))
    share = F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.exp((s - F.col("top")) / float(UNIT)))
    return scored.select(
        *[F.col("query")[c].alias(c) for c in queries.columns if c not in (out, "confidence_score")],
        F.get(F.col("names"), F.array_position("scores", F.col("top")).cast("int") - 1)["intent"].alias(out),
        F.when(F.col("top").isNotNull(), 1.0 / share).alias("confidence_score"))
