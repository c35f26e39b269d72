"""Plugin folders as tools."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.universe import clean_keywords, plugin_source_text

_SPEC = "folder string, id string, name string, type string, description string, short_description string, keywords array<string>, passive boolean, locale string"


def read_plugins(spark: SparkSession, root: str) -> DataFrame:
    """A tool for each ``*/plugin.toml`` under ``root``, in the order of paths.

    Missing ids are the folder's name, missing names the id. Names and descriptions that are keys of the plugin's locale file
    are replaced by its text; a missing or malformed locale file has none. Both kinds of file are read by the executors and
    met in a join on folder and locale.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for path, content in zip(x["path"], x["content"]):
                raw = tomllib.loads(bytes(content).decode())
                p = raw.get("plugin", raw)
                text = lambda v: str(v or "").strip()
                i18n, folder = p.get("i18n"), str(PurePosixPath(path).parent)
                locale = f"{folder}/{text(i18n.get('locales_dir')) or 'i18n'}/{text(i18n.get('default_locale')) or 'zh-CN'}.json" if isinstance(i18n, dict) else None
                words = [str(k) for k in p["keywords"]] if isinstance(p.get("keywords"), list) else []
                own = text(p.get("id")) or PurePosixPath(path).parent.name
                out.append((folder, own, text(p.get("name")) or own, text(p.get("type")) or "plugin", text(p.get("description")), text(p.get("short_description")), words, bool(p.get("passive", False)), locale))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SPEC.split(", ")])

    def locales(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for path, content in zip(x["path"], x["content"]):
                try:
                    data = json.loads(bytes(content))
                except ValueError:
                    data = None
                out.append((path, {str(k): v for k, v in data.items() if isinstance(v, str)} if isinstance(data, dict) else {}))
            yield pd.DataFrame(out, columns=["locale", "words"])

    files = lambda pattern: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")
    plugins = files("plugin.toml").mapInPandas(parse, _SPEC)
    words = files("*.json").mapInPandas(locales, "locale string, words map<string, string>")
    rows = plugins.join(words, "locale", "left")
    shown = lambda c: F.coalesce(F.trim(F.try_element_at("words", F.col(c))), F.col(c))
    rows = rows.withColumns({c: shown(c) for c in ("name", "description", "short_description")} | {"keywords": clean_keywords(F.col("keywords"))})
    text = plugin_source_text(*(F.col(c) for c in ("id", "name", "type", "description", "short_description", "keywords", "passive")))
    return rows.orderBy("folder").select(F.concat(F.lit("plugin."), F.col("id")).alias("tool_id"), F.lit("plugin").alias("kind"), text.alias("source_text"), "name", "keywords", "passive")
