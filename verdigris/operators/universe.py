"""Tool universes: unions, coverage, classification, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.pairs import require_none

# fixed values: a rule's category, its tags and the words of which one must occur; earlier rules come first
CATEGORY_RULES = (
    ("web_retrieval", ("web", "search", "browser", "download"), ("搜索", "search", "web", "网页", "浏览器", "browser", "download", "下载")),
    ("file_document", ("file", "document", "pdf", "read_write"), ("文件", "file", "document", "pdf", "docx", "excel", "csv", "读取", "写入")),
    ("image_media", ("image", "media", "vision"), ("图片", "image", "photo", "vision", "ocr", "截图", "视频", "video", "media")),
    ("code_dev", ("code", "developer", "repository"), ("代码", "code", "github", "git", "repo", "开发", "program", "debug", "测试")),
    ("productivity", ("calendar", "email", "note", "task"), ("日历", "calendar", "邮件", "email", "todo", "任务", "note", "笔记", "提醒")),
    ("data_analysis", ("data", "analysis", "table"), ("数据", "data", "分析", "analysis", "表格", "table", "统计", "chart", "图表")),
    ("local_system", ("desktop", "os", "automation"), ("电脑", "desktop", "computer", "操作系统", "应用", "窗口", "本地", "automation")),
    ("communication", ("chat", "social", "message"), ("消息", "message", "chat", "聊天", "社交", "social", "slack", "discord")),
)
# fixed values: what the text and the metadata of a synthetic tool must not name
FORBIDDEN_TEXT = ("runtime.enabled", "runtime.auto_start", "status:", "available:", "source_path")
FORBIDDEN_METADATA = ("runtime", "plugin_runtime", "status", "available", "enabled", "auto_start", "source_path")


def union_universes(parts: list[DataFrame], check: bool = True) -> DataFrame:
    """Tools of several universes in one; an id that occurs twice raises."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if check:
        require_none(duplicate_ids(out).select("tool_id"), "duplicate tool ids")
    return out


def duplicate_ids(tools: DataFrame, key: str = "tool_id") -> DataFrame:
    """Ids that occur more than once."""
    return tools.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def conflicting_ids(left: DataFrame, right: DataFrame, key: str = "tool_id") -> DataFrame:
    """Ids of both."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def normalise_text(text: Column) -> Column:
    """runs of white space as one space, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", " "))


def classify(tools: DataFrame, rules: tuple = CATEGORY_RULES, overrides: DataFrame | None = None) -> DataFrame:
    """The category of each tool: an override of its id and kind, if any, or the first rule with a word in its
    id or text; later rules are secondary, tags are those of all. Agents have rules of their own."""
    text = normalise_text(F.concat(F.col("tool_id"), F.lit("\n"), F.coalesce("source_text", F.lit(""))))
    rows = tools.select("tool_id", "kind", text.alias("t"))
    t = F.col("t")
    has = lambda words: reduce(lambda a, b: a | b, (t.contains(w.lower()) for w in words))
    matched = F.filter(F.array(*(F.when(has(words), F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, tags)).alias("tags"))) for name, tags, words in rules)), lambda x: x.isNotNull())
    rows = rows.withColumn("m", matched)
    m = F.col("m")
    strings = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    web, desk = has(("browser", "网页", "浏览器")), has(("computer", "desktop", "电脑", "操作系统"))
    agent = F.col("kind") == "agent"
    primary = F.when(agent & web, "web_retrieval").when(agent & desk, "local_system").when(agent, "agent_other").otherwise(F.coalesce(F.get(m, 0)["name"], F.lit("other")))
    later = F.when(agent | (F.size(m) < 2), strings()).otherwise(F.transform(F.slice(m, 2, 100), lambda x: x["name"]))
    tags = F.when(agent & web, strings("agent", "browser", "web")).when(agent & desk, strings("agent", "desktop", "os")).when(agent, strings("agent"))
    tags = tags.otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(m, lambda x: x["tags"])))))
    out = rows.select("tool_id", "kind", primary.alias("primary_category"), later.alias("secondary_categories"), tags.alias("generation_tags"), F.lit("heuristic").alias("source"))
    if overrides is None:
        return out
    own = tools.select("tool_id", "kind").join(overrides, ["tool_id", "kind"]).select(out.columns)
    return out.join(own, ["tool_id", "kind"], "left_anti").select(own.columns).unionByName(own)


def taxonomy_counts(classes: DataFrame) -> DataFrame:
    """Tools a primary category."""
    return classes.groupBy("primary_category").agg(F.count("*").alias("tools"))


def inspect_universe(tools: DataFrame) -> DataFrame:
    """Counts by kind, one row."""
    return tools.agg(F.count("*").alias("tools"), F.count_if(F.col("kind") == "agent").alias("agents"), F.count_if(F.col("kind") == "plugin").alias("plugins"))


def synthetic_violations(synthetic: DataFrame, real: DataFrame, metadata_keys: Column | None = None) -> DataFrame:
    """What is wrong with synthetic tools, a row for each id and fault: an id used twice or by a real tool, a kind
    other than plugin, metadata (``metadata_keys``, an array of names) or a text that tells of runtime state."""
    s = synthetic
    fault = lambda df, what: df.select("tool_id").distinct().withColumn("fault", F.lit(what))
    text = reduce(lambda a, b: a | b, (F.col("source_text").contains(x) for x in FORBIDDEN_TEXT))
    parts = [fault(duplicate_ids(s), "duplicate_id"), fault(conflicting_ids(s, real), "conflicting_id"), fault(s.where(F.col("kind") != "plugin"), "not_a_plugin"), fault(s.where(text), "forbidden_text")]
    if metadata_keys is not None:
        parts.append(fault(s.where(F.arrays_overlap(metadata_keys, F.array(*map(F.lit, FORBIDDEN_METADATA)))), "forbidden_metadata"))
    return reduce(DataFrame.unionByName, parts)


def clean_keywords(words: Column) -> Column:
    """Keywords trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(words, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def plugin_source_text(id_: Column, name: Column, kind: Column, description: Column, short: Column, words: Column, passive: Column) -> Column:
    """A plugin's canonical text, eight lines."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("")))
    return F.concat_ws("\n", F.lit("kind: plugin"), line("id", id_), line("name", name), line("type", kind), line("description", description), line("short_description", short), line("keywords", F.array_join(words, ", ")), line("passive", F.lower(passive.cast("string"))))


def quality_summary(candidates: DataFrame, judgments: DataFrame, tools: DataFrame, high: float = 80.0) -> DataFrame:
    """One row: samples, plugins exposed, samples that lack an agent, judgments whose scores do not cover their
    candidates, share of judgments with a score of at least ``high``.

    ``candidates(sample_id, tool_id)`` and ``judgments(sample_id, tool_id, raw_score)`` are in long form.
    """
    agents = tools.where("kind = 'agent'").select("tool_id").distinct()
    c, n = candidates.select("sample_id", "tool_id").distinct(), agents.count()
    held = c.join(agents, "tool_id", "left_semi").groupBy("sample_id").agg(F.count("*").alias("k"))
    samples = c.select("sample_id").distinct()
    lacking = samples.join(held, "sample_id", "left").where(F.coalesce("k", F.lit(0)) < n)
    exposed = c.join(tools.where("kind = 'plugin'").select("tool_id").distinct(), "tool_id", "left_semi")
    j = judgments.select("sample_id", "tool_id").distinct()
    odd = c.join(j, ["sample_id", "tool_id"], "left_anti").unionByName(j.join(c, ["sample_id", "tool_id"], "left_anti")).select("sample_id").distinct()
    top = judgments.groupBy("sample_id").agg(F.max("raw_score").alias("top"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(samples, "samples").crossJoin(one(exposed, "plugin_exposures")).crossJoin(one(lacking, "missing_agent_samples")).crossJoin(one(odd, "invalid_judgment_samples"))
    return out.crossJoin(top.agg(F.coalesce(F.try_divide(F.count_if(F.col("top") >= high), F.count("*")), F.lit(0.0)).alias("high_raw_score_ratio")))


def plugin_exposures(candidates: DataFrame, tools: DataFrame) -> DataFrame:
    """A5: in how many samples each plugin stands."""
    plugins = tools.where("kind = 'plugin'").select("tool_id").distinct()
    return candidates.select("sample_id", "tool_id").distinct().join(plugins, "tool_id").groupBy("tool_id").agg(F.count("*").alias("samples"))
