"""Queries on tool universes: P1, P28-P31, U1-U6, A6-A8, J7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.catalog.bindings import table, tools
from verdigris.functions.text import id_family
from verdigris.operators import universe


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runtime_pool").select("tool_id", "kind", F.col("short_description").alias("source_text"))


def agents(spark: SparkSession, d: str) -> DataFrame:
    return tools(spark, d).where("kind = 'agent'").select("tool_id", "name")


def union_universes(spark: SparkSession, d: str) -> DataFrame:
    return universe.union_universes([tools(spark, d).select("tool_id", "kind", "source_text"), _pool(spark, d)]).select("tool_id", "kind")


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return universe.duplicate_ids(table(spark, d, "tools"))


def conflicting_ids(spark: SparkSession, d: str) -> DataFrame:
    """Tools that are also in the old report, on its left side."""
    return universe.conflicting_ids(tools(spark, d), table(spark, d, "runtime_tool_pool_v4").select(F.col("left_tool_id").alias("tool_id")))


def classify_tools(spark: SparkSession, d: str) -> DataFrame:
    c = universe.classify(tools(spark, d))
    return c.select("tool_id", "primary_category", F.array_join("secondary_categories", ",").alias("secondary"), F.array_join("generation_tags", ",").alias("tags"))


def taxonomy_counts(spark: SparkSession, d: str) -> DataFrame:
    return universe.taxonomy_counts(universe.classify(tools(spark, d)))


def inspect_universe(spark: SparkSession, d: str) -> DataFrame:
    return universe.inspect_universe(tools(spark, d))


def validate_synthetic(spark: SparkSession, d: str) -> DataFrame:
    """The tools table as a synthetic universe, with repeats, against the ids of the old report."""
    real = table(spark, d, "runtime_tool_pool_v4").select(F.col("right_tool_id").alias("tool_id"))
    return universe.synthetic_violations(table(spark, d, "tools"), real)


def clean_keywords(spark: SparkSession, d: str) -> DataFrame:
    return tools(spark, d).select("tool_id", F.array_join(universe.clean_keywords(F.col("keywords")), "|").alias("keywords"))


def normalised_texts(spark: SparkSession, d: str) -> DataFrame:
    return tools(spark, d).select("tool_id", universe.normalise_text(F.col("source_text")).alias("text"))


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the report's two sides: in either, and whether in both."""
    r = table(spark, d, "runtime_tool_pool_v4")
    left, right = r.select(F.col("left_tool_id").alias("tool_id")), r.select(F.col("right_tool_id").alias("tool_id"))
    both = left.intersect(right).withColumn("both", F.lit(True))
    return left.union(right).distinct().join(both, "tool_id", "left").select("tool_id", F.coalesce("both", F.lit(False)).alias("both"))


def id_families(spark: SparkSession, d: str) -> DataFrame:
    return tools(spark, d).select("tool_id", F.explode(id_family(F.col("tool_id"))).alias("part")).groupBy("part").agg(F.count("*").alias("tools"))


QUERIES = {f.__name__: f for f in (agents, union_universes, duplicate_ids, conflicting_ids, classify_tools, taxonomy_counts, inspect_universe, validate_synthetic, clean_keywords, normalised_texts, id_sets, id_families)}

_U = "u as (select tool_id, any_value(kind) kind, any_value(source_text) source_text, any_value(metadata.name) name, any_value(metadata.keywords) keywords from tools group by 1)"
_HIT = ", ".join(f"case when regexp_matches(t, '{'|'.join(w)}') then '{n}' end" for n, _, w in universe.CATEGORY_RULES)
_TAGS = ", ".join(f"case when regexp_matches(t, '{'|'.join(w)}') then {list(g)} end" for n, g, w in universe.CATEGORY_RULES)
_CLASS = f"""{_U}, x as (select tool_id, kind, lower(regexp_replace(tool_id || chr(10) || source_text, '\\s+', ' ', 'g')) t from u),
    y as (select *, list_filter([{_HIT}], lambda z: z is not null) m, list_sort(list_distinct(flatten(list_filter([{_TAGS}], lambda z: z is not null)))) g, regexp_matches(t, 'browser|网页|浏览器') w, regexp_matches(t, 'computer|desktop|电脑|操作系统') k from x),
    c as (select tool_id, case when kind = 'agent' then case when w then 'web_retrieval' when k then 'local_system' else 'agent_other' end else coalesce(m[1], 'other') end primary_category,
        case when kind = 'agent' then '' else coalesce(array_to_string(m[2:], ','), '') end secondary, case when kind = 'agent' then case when w then 'agent,browser,web' when k then 'agent,desktop,os' else 'agent' end else coalesce(array_to_string(g, ','), '') end tags from y)"""

ORACLES = {
    "agents": f"with {_U} select tool_id, name from u where kind = 'agent'",
    "union_universes": f"with {_U} select tool_id, kind from u union all select tool_id, kind from runtime_pool",
    "duplicate_ids": "select tool_id, count(*) copies from tools group by 1 having count(*) > 1",
    "conflicting_ids": "select distinct tool_id from tools where tool_id in (select left_tool_id from runtime_tool_pool_v4)",
    "classify_tools": f"with {_CLASS} from c",
    "taxonomy_counts": f"with {_CLASS} select primary_category, count(*) tools from c group by 1",
    "inspect_universe": f"with {_U} select count(*) tools, sum((kind = 'agent')::int) agents, sum((kind = 'plugin')::int) plugins from u",
    "validate_synthetic": """select tool_id, 'duplicate_id' fault from tools group by 1 having count(*) > 1 union all select distinct tool_id, 'conflicting_id' from tools where tool_id in (select right_tool_id from runtime_tool_pool_v4)
        union all select distinct tool_id, 'not_a_plugin' from tools where kind <> 'plugin' union all select distinct tool_id, 'forbidden_text' from tools where regexp_matches(source_text, 'runtime\\.enabled|runtime\\.auto_start|status:|available:|source_path')""",
    "clean_keywords": f"""with {_U}, e as (select tool_id, keywords is null nil, unnest(keywords) k, unnest(range(len(keywords))) p from u), f as (select tool_id, trim(k) k, min(p) p from e where trim(k) <> '' group by 1, 2),
        g as (select tool_id, string_agg(k, '|' order by p) keywords from f group by 1) select u.tool_id, case when u.keywords is null then null else coalesce(g.keywords, '') end keywords from u left join g using (tool_id)""",
    "normalised_texts": f"with {_U} select tool_id, lower(regexp_replace(source_text, '\\s+', ' ', 'g')) \"text\" from u",
    "id_sets": "with l as (select distinct left_tool_id i from runtime_tool_pool_v4), r as (select distinct right_tool_id i from runtime_tool_pool_v4) select i tool_id, count(*) = 2 \"both\" from (from l union all from r) group by 1",
    "id_families": f"with {_U} select part, count(*) tools from (select distinct tool_id, unnest(string_split(regexp_replace(tool_id, '^plugin\\.', ''), '_')) part from u) where part <> '' group by 1",
}
