"""Judged retrieval: validation of judgements, joining them with hits, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mismatch(expected: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without a judgement (``missing``) and judgements without a hit (``unexpected``)."""
    a = expected.select(*keys).distinct().join(returned.select(*keys).distinct(), keys, "left_anti").withColumn("problem", F.lit("missing"))
    b = returned.select(*keys).distinct().join(expected.select(*keys).distinct(), keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    return a.unionByName(b)


def faulty_judgements(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Judgements with a score that is not 1 to 5, an empty reason, or a repeated key: ``keys, problem``."""
    again = judged.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(*keys, F.lit("repeated").alias("problem"))
    bad = F.when(~F.col("relevance").between(1, 5) | F.col("relevance").isNull(), "relevance").when(~F.col("generic_overlap").between(1, 5) | F.col("generic_overlap").isNull(), "generic_overlap").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "reason")
    return again.unionByName(judged.select(*keys, bad.alias("problem")).filter(F.col("problem").isNotNull()))


def judged_hits(hits: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    return hits.join(judged, keys)


def summarize(judged: DataFrame, by: str, relevance: str = "relevance", good: int = 4) -> DataFrame:
    """Mean, median, number of good ones and precision by ``by``; nulls where nothing was judged."""
    a = judged.groupBy(by).agg(F.avg(relevance).alias("m"), F.median(relevance).alias("d"), F.count_if(F.col(relevance) >= good).alias("relevant"), F.count(relevance).alias("judged"))
    return a.select(by, F.round("m", 3).alias("mean_relevance"), F.col("d").cast("double").alias("median_relevance"), "relevant", "judged", F.round(F.try_divide("relevant", "judged"), 3).alias("precision_at_k"))
