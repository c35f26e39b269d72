"""The tables of a data folder as the engine's views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.calibrate import AXES


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def judgments(spark: SparkSession, d: str) -> DataFrame:
    """Judge scores in long form: every usable row of the pair examples is a run."""
    rows = table(spark, d, "pair_examples").select("sample_id", "tool_id", "raw_score")
    return rows.where("sample_id is not null and tool_id is not null and not isnan(raw_score) and raw_score between 0 and 100")


def usable(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the pair examples that :func:`pairs` takes."""
    return table(spark, d, "pair_examples").where("conversation_id is not null and tool_id is not null and label is not null and not isnan(raw_score) and raw_score between 0 and 100")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row a conversation and tool, with label, prediction and what describes the conversation."""
    rows = usable(spark, d)
    first = ("scenario_type", "relevance_mode", "latest_user_text", "latest_user_actionability")
    rows = rows.groupBy("conversation_id", "tool_id").agg(F.max("label").alias("label"), F.max("raw_score").alias("raw_score"), *(F.min(c).alias(c) for c in first))
    return rows.withColumn("prediction", F.col("raw_score") / 25 - 2)


def axis_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Seven axis scores of a sample (an order) and tool (a supplier), a column an axis, from the order lines."""
    scores = ("l_quantity", "l_discount * 1000", "l_tax * 1250", "cast(l_linenumber * 14 as double)", "cast(l_partkey % 101 as double)", "cast(l_suppkey % 101 as double)", "l_quantity * 2")
    return table(spark, d, "lineitem").selectExpr("l_orderkey as sample_id", "concat('plugin.s', l_suppkey) as tool_id", *(f"{x} as {a}" for x, a in zip(scores, AXES)))


def tools(spark: SparkSession, d: str) -> DataFrame:
    """Every tool once."""
    rows = table(spark, d, "tools").select("tool_id", "kind", "source_text", F.col("metadata.name").alias("name"), F.col("metadata.keywords").alias("keywords"), F.col("metadata.short_description").alias("short_description"), "tool_universe_id")
    return rows.dropDuplicates(["tool_id"])


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation once, with normalised fields."""
    rows = table(spark, d, "generation_tasks").where("conversation_id is not null")
    low = lambda c: F.lower(F.trim(c))
    return rows.groupBy("conversation_id").agg(F.min("target_tool_ids").alias("target_tool_ids"), F.min(low("scenario_type")).alias("scenario_type"), F.min(low("language")).alias("language"))
