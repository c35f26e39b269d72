"""Tokens and small text functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens too common among tools to say anything
STOP_TOKENS = ("plugin", "assistant", "helper", "manager", "monitor", "bridge", "auto", "reply", "sync", "watcher", "agent", "工具", "助手", "管理", "监听", "自动", "回复", "同步", "提醒", "生成", "支持", "用户", "本地", "连接")
STABLE_MOD = 1_000_000_007


def tool_tokens(text: Column) -> Column:
    """lower-cased words, and Han runs in chunks of one or two, without stop tokens and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9_]+|[\\u4e00-\\u9fff]{1,2}"), F.lit(0))
    return F.filter(found, lambda x: (F.length(F.regexp_replace(x, "^_+|_+$", "")) > 1) & ~x.isin(*STOP_TOKENS))


def lex_tokens(text: Column) -> Column:
    """lower-cased words and single Han characters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+|[\\u4e00-\\u9fff]"), F.lit(0))


def id_tokens(tool_id: Column) -> Column:
    """F8: the parts of an id between characters that are no letter or digit."""
    return F.filter(F.split(F.lower(tool_id), "[^a-z0-9]+"), lambda x: x != "")


def id_family(tool_id: Column) -> Column:
    """the parts of a plugin's id between underscores, as a set."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(tool_id, "^plugin\\.", ""), "_"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """the share that two sets have in common, 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def score_any(text: Column, patterns: Sequence[str]) -> Column:
    """F16: how many of the patterns occur, against a third of what would be plenty, at most 1."""
    hits = sum((text.rlike(f"(?id){p}").cast("double") for p in patterns[1:]), text.rlike(f"(?id){patterns[0]}").cast("double"))
    return F.least(F.lit(1.0), hits / max(1.0, min(3.0, len(patterns) / 2)))


def json_object(text: Column) -> Column:
    """the JSON object of a reply: all of it, or from the first brace to the last; null if neither is one."""
    obj = lambda x: F.when(F.trim(x).startswith("{"), F.to_json(F.from_json(F.trim(x), "map<string,string>")))
    return F.coalesce(obj(text), obj(F.regexp_extract(text, "(?s)\\{.*\\}", 0)))


def stable_int(text: Column) -> Column:
    """a number of a text that is the same everywhere: 131 times the sum so far plus the code point."""
    return F.aggregate(F.filter(F.split(text, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda acc, x: F.pmod(acc * 131 + F.ascii(x), F.lit(STABLE_MOD).cast("long")))
