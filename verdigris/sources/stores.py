"""Universes, configurations, run logs and reports as files."""

from __future__ import annotations

import copy
import json
import os
import tomllib
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.universe import union_universes
from verdigris.sources.records import TOOLS, path_of, read_jsonl

SECRET = ("key", "token", "secret", "password")  # parts of names whose values are never written
AGENT_FIELDS = ("id", "method", "enable_flag", "capability_key", "priority", "description")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """K5, K8: a small file, written beside its place and moved there, so that it appears whole or not at all."""
    target, fs = path_of(spark, path)
    part, _ = path_of(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    p, fs = path_of(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, path: str, value: Mapping) -> None:
    """K5, K8: an indented JSON document with sorted keys."""
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))


def utc_now() -> str:
    """the time in UTC, to the second."""
    return datetime.now(UTC).isoformat(timespec="seconds")


def write_universe(tools: DataFrame, path: str, universe_id: str, kind: str = "mixed", source: Mapping | None = None, created_at: str | None = None) -> dict:
    """K3, K4: a universe as one JSON document, if the path ends in .json, or as a folder of lines with a manifest that states how
    many they are. The manifest comes last, so a folder without one is unfinished. ``tools`` has ``tool_id, kind, source_text, metadata`` (a JSON text); repeated ids
    raise. Returns the manifest."""
    spark = tools.sparkSession
    rows = union_universes([tools.select("tool_id", "kind", "source_text", F.coalesce(F.col("metadata").cast("string"), F.lit("{}")).alias("metadata"))])
    manifest = {"tool_universe_id": universe_id, "created_at": created_at or utc_now(), "kind": kind, "source": dict(source or {})}
    if path.endswith(".json"):
        each = F.struct("kind", F.parse_json("metadata").alias("metadata"), "source_text", "tool_id")
        document = rows.select(F.to_json(each).alias("t"), "tool_id").orderBy("tool_id").select("t")
        lines = [r.t for r in document.toLocalIterator()]  # one document is for catalogues that one machine reads anyway
        head = json.dumps({"created_at": manifest["created_at"], "tool_universe_id": universe_id}, ensure_ascii=False)
        write_text(spark, path, f'{head[:-1]}, "tools": [{", ".join(lines)}]}}')
        return manifest | {"tool_count": len(lines)}
    p, fs = path_of(spark, f"{path}/manifest.json")
    fs.delete(p, False)
    rows.orderBy("tool_id").select("kind", "metadata", "source_text", "tool_id").write.mode("overwrite").json(f"{path}/tools.jsonl")
    manifest["tool_count"] = read_jsonl(spark, f"{path}/tools.jsonl", TOOLS, missing_ok=False).count()
    write_json(spark, f"{path}/manifest.json", manifest)
    return manifest


def merge_universes(parts: Mapping[str, DataFrame], path: str, universe_id: str, kind: str = "mixed") -> dict:
    """The tools of several universes, by id, written as one; an id that two of them hold raises, and nothing is written."""
    return write_universe(union_universes(list(parts.values())), path, universe_id, kind, {"type": "merged", "input_universe_ids": list(parts)})


def agent_tools(channels: DataFrame) -> DataFrame:
    """A tool for each agent channel, ``channels(id, method, enable_flag, capability_key, priority, description)``."""
    lines = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in AGENT_FIELDS]
    return channels.select(F.concat(F.lit("agent."), "id").alias("tool_id"), F.lit("agent").alias("kind"), F.concat_ws("\n", F.lit("kind: agent"), *lines).alias("source_text"), F.to_json(F.struct(*AGENT_FIELDS)).alias("metadata"))


def read_config(spark: SparkSession, path: str, defaults: Mapping, environment: Mapping[str, str] | None = None) -> dict:
    """A TOML file over ``defaults``, section by section. A value of the form ``env:NAME`` is taken from the environment, where
    it may be missing; a section or key without a default raises."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    env = os.environ if environment is None else environment

    def over(base: dict, given: Mapping, at: str) -> dict:
        for k, v in given.items():
            if k not in base:
                raise ValueError(f"unknown setting {at}{k}")
            base[k] = over(base[k], v, f"{at}{k}.") if isinstance(base[k], dict) else env.get(v[4:]) if isinstance(v, str) and v.startswith("env:") else v
        return base

    return over(copy.deepcopy(dict(defaults)), tomllib.loads(text), "")


def redacted(value: object) -> object:
    """K6: a configuration without its secrets: of each only whether it is set."""
    if isinstance(value, Mapping):
        return {k: bool(v) if any(s in k.lower() for s in SECRET) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list | tuple) else value


def write_manifest(spark: SparkSession, path: str, config: Mapping, status: str, **facts: object) -> dict:
    """K6: what a run is made of and how far it is (running, then completed)."""
    if status not in ("running", "completed", "failed"):
        raise ValueError(f"unknown status {status}")
    out = {"status": status, "updated_at": utc_now(), "config": redacted(config), **facts}
    write_json(spark, path, out)
    return out


def is_placeholder(value: str | None, known: Sequence[str] = ("", "...", "todo", "changeme")) -> bool:
    """Whether a setting was left as it came."""
    return (value or "").strip().lower() in known


def read_metrics(spark: SparkSession, run: str, schema: str) -> tuple[DataFrame, dict | None]:
    """A run's metrics by epoch, empty if there are none, and its report, if there is one."""
    text = read_text(spark, f"{run}/report.json")
    return read_jsonl(spark, f"{run}/metrics.jsonl", schema, strict=False), json.loads(text) if text else None


def read_train_losses(spark: SparkSession, path: str) -> DataFrame:
    """``epoch, pos, train_loss`` of a training log, ``pos`` being the line's place; none if the file is missing."""
    lines = read_jsonl(spark, path, "epoch int, train_loss double", strict=False)
    return lines.withColumn("pos", F.monotonically_increasing_id())


def write_predictions(rows: DataFrame, path: str) -> None:
    """K7: a line for each pair, with the factors' values where there are any."""
    wanted = [c for c in ("conversation_id", "tool_id", "label", "prediction", "raw_score", "factor_predictions", "factor_labels") if c in rows.columns]
    rows.select(*wanted).orderBy("conversation_id", "tool_id").write.mode("overwrite").json(path)


def keep_best(spark: SparkSession, run: str, best: DataFrame) -> dict[str, str]:
    """K9: for each objective of ``best(objective, epoch)`` the checkpoint folder of its epoch, copied to ``best_<objective>``."""
    out = {}
    for r in best.orderBy("objective").collect():
        (src, fs), (dst, _) = path_of(spark, f"{run}/epoch_{r.epoch:04d}"), path_of(spark, f"{run}/best_{r.objective}")
        if not fs.exists(src):
            raise FileNotFoundError(f"{run}/epoch_{r.epoch:04d}")
        fs.delete(dst, True)
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, fs, dst, False, spark._jsc.hadoopConfiguration())
        out[r.objective] = f"{run}/best_{r.objective}"
    return out


def epoch_of(path: str) -> int | None:
    """the epoch that a checkpoint's name ends in."""
    digits = "".join(c for c in os.path.splitext(os.path.basename(path.rstrip("/")))[0].rpartition("_")[2] if c.isdigit())
    return int(digits) if digits else None


def run_of(argument: str) -> tuple[str, str]:
    """``name=path`` as both, a bare path under its last part."""
    name, _, path = argument.rpartition("=")
    return (name or os.path.basename(path.rstrip("/")), path)


def markdown(title: str, sections: Mapping[str, DataFrame], limit: int = 20) -> str:
    """Bad cases as a Markdown text: a table a section, of its first ``limit`` rows, which come in the table's own order."""
    lines = [f"# {title}"]
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    for name, df in sections.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join(map(show, r)) + " |" for r in df.limit(limit).collect()]
    return "\n".join(lines) + "\n"


def summary_csv(df: DataFrame) -> DataFrame:
    """Every number with six places, NA where there is none."""
    cell = lambda c, t: F.when(F.col(c).isNull(), "NA").otherwise(F.format_string("%.6f", F.col(c).cast("double")) if t in ("double", "float") else F.col(c).cast("string")).alias(c)
    return df.select(*(cell(c, t) for c, t in df.dtypes))
