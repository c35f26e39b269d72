"""Files of records: JSON lines, universes and predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdigris.operators.pairs import require_none

TOOLS = "tool_id string, kind string, source_text string, metadata string"
PREDICTIONS = "conversation_id string, tool_id string, label double, prediction double, raw_score double, factor_predictions array<double>, factor_labels array<double>"


def path_of(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = path_of(spark, path)
    return bool(fs.globStatus(p))


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = True, strict: bool = True) -> DataFrame:
    """JSON lines under a fixed schema. A missing file is empty (or raises), blank lines are skipped, a line
    that is no JSON raises when read, and with ``strict`` so does one with a field that the schema lacks."""
    kind = StructType.fromDDL(schema)
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], kind)
    if not strict:
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    extra = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, kind.names)))
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """The tools of a universe: a folder with manifest and lines, whose count must agree, or one JSON document."""
    if path.endswith(".json"):
        tools = spark.read.option("multiLine", True).schema(f"tool_universe_id string, tools array<struct<{TOOLS.replace(' string', ': string')}>>").json(path)
        return tools.select("tool_universe_id", F.explode("tools").alias("t")).select("tool_universe_id", "t.*")
    manifest = spark.read.option("multiLine", True).schema("tool_universe_id string, tool_count int").json(f"{path}/manifest.json").first()
    tools = read_jsonl(spark, f"{path}/tools.jsonl", TOOLS, missing_ok=False)
    if (n := tools.count()) != manifest.tool_count:
        raise ValueError(f"{path}: {n} tools, the manifest says {manifest.tool_count}")
    return tools.select(F.lit(manifest.tool_universe_id).alias("tool_universe_id"), *tools.columns)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """K1, K2: rows as JSON lines with sorted fields. A table that is replaced is written beside its place first and then
    moved there: until then the old one stands."""
    spark, rows = df.sparkSession, df.select(sorted(df.columns))
    if append:
        rows.write.mode("append").json(path)
        return
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    rows.write.json(new)
    (source, fs), (target, _) = path_of(spark, new), path_of(spark, path)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"could not write {path}")


def read_predictions(spark: SparkSession, run: str) -> DataFrame:
    """The predictions of a run's folds, or of the run; a pair that is there twice raises."""
    found = next((p for p in (f"{run}/fold_*/best_val_predictions.jsonl", f"{run}/best_val_predictions.jsonl") if _exists(spark, p)), None)
    if not found:
        raise FileNotFoundError(f"no predictions in {run}")
    rows = read_jsonl(spark, found, PREDICTIONS, missing_ok=False, strict=False)
    require_none(rows.groupBy("conversation_id", "tool_id").count().where("count > 1").drop("count"), "predicted twice")
    return rows
