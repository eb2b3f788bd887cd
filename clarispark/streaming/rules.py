"""Fitted rules and models on streams: their columns are stateless, so they work unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.functions.predicates import RuleList, RuleSet


def score_stream(stream: DataFrame, model: RuleList | RuleSet, to: str = "prediction") -> DataFrame:
    return model.predict(stream, to)


def windowed_hits(stream: DataFrame, model: RuleList, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows that each rule decides, by window of event time; rows later than the watermark are left out."""
    which = stream.withWatermark(time, late).withColumn("rule", model.matched_rule())
    return which.groupBy(F.window(time, width), "rule").agg(F.count(F.lit(1)).alias("hits"))
