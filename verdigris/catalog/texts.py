"""Queries on texts and similarity: F1-F11, F16-F21, A9, A17, A18, J4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.catalog.bindings import pairs, table, tools, usable
from verdigris.catalog.ranking import rounded
from verdigris.functions import text
from verdigris.operators import similarity


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return similarity.token_counts(tools(spark, d), "tool_id", "source_text")


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return similarity.document_frequency(tools(spark, d), "tool_id", "source_text")


def corpus_size(spark: SparkSession, d: str) -> DataFrame:
    return rounded(similarity.corpus_size(tools(spark, d), "source_text"))


def bm25(spark: SparkSession, d: str) -> DataFrame:
    """each judged pair's BM25 of the last user text against the tool's text."""
    rows = usable(spark, d).where("latest_user_text is not null").select(F.col("conversation_id").alias("query_id"), F.col("tool_id").alias("doc_id"), F.col("latest_user_text").alias("text"))
    q = rows.select("query_id", "text").distinct().groupBy("query_id").agg(F.min("text").alias("text"))
    docs = tools(spark, d).select(F.col("tool_id").alias("doc_id"), F.col("source_text").alias("text"))
    scores = similarity.bm25(q, docs, rows.select("query_id", "doc_id").distinct(), "text", "text")
    return rounded(scores.join(docs.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "bm25"))


def tfidf_norms(spark: SparkSession, d: str) -> DataFrame:
    """Each tool's heaviest word weight."""
    w = similarity.tfidf(tools(spark, d), "tool_id", "source_text")
    return rounded(w.groupBy("tool_id").agg(F.max("weight").alias("top_weight"), F.count("*").alias("tokens")))


def lexical_features(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).where("latest_user_text is not null")
    conv = rows.groupBy("conversation_id").agg(F.min("latest_user_text").alias("t")).select("conversation_id", F.array_distinct(text.lex_tokens(F.col("t"))).alias("conv_tokens"))
    tool = tools(spark, d).select("tool_id", F.array_distinct(text.lex_tokens(F.col("source_text"))).alias("tool_tokens"))
    return rounded(similarity.lexical_features(rows.select("conversation_id", "tool_id").join(conv, "conversation_id").join(tool, "tool_id")))


def id_family_pairs(spark: SparkSession, d: str) -> DataFrame:
    """what the old report's pairs have in common in their ids."""
    r = table(spark, d, "runtime_tool_pool_v4").select("left_tool_id", "right_tool_id").distinct()
    return rounded(r.withColumn("family", text.jaccard(text.id_family(F.col("left_tool_id")), text.id_family(F.col("right_tool_id")))))


def _described(spark: SparkSession, d: str) -> DataFrame:
    """Every tool once, with the text that tools are compared by: id, name, descriptions and keywords."""
    m = F.col("metadata")
    words = F.concat_ws(" ", "tool_id", m["name"], m["description"], m["short_description"], F.array_join(m["keywords"], " "))
    return table(spark, d, "tools").select("tool_id", m["name"].alias("name"), words.alias("text"), m["keywords"].alias("keywords")).dropDuplicates(["tool_id"])


def similar_tools(spark: SparkSession, d: str) -> DataFrame:
    """J4 with names, over all tools."""
    return rounded(similarity.similar_tools(_described(spark, d)))


def similar_tools_all_plain(spark: SparkSession, d: str) -> DataFrame:
    """J4 without the names' part, over all tools."""
    return rounded(similarity.similar_tools(_described(spark, d), with_names=False).drop("name_similarity"))


def similar_tools_plain(spark: SparkSession, d: str) -> DataFrame:
    """J4 without the names' part, which SQL lacks, over the runtime pool alone: its SQL compares all pairs."""
    pool = table(spark, d, "runtime_pool").select("tool_id", "name", F.col("short_description").alias("text"), "keywords")
    return rounded(similarity.similar_tools(pool, with_names=False).drop("name_similarity"))


def similarity_summary(spark: SparkSession, d: str) -> DataFrame:
    """A9 over all tools."""
    return rounded(similarity.similarity_summary(tools(spark, d), similarity.similar_tools(_described(spark, d), with_names=False)))


def most_similar(spark: SparkSession, d: str) -> DataFrame:
    """O1: the fifty first pairs of the runtime pool by score."""
    return similarity.by_score(similar_tools_plain(spark, d)).limit(50)


def text_cosines(spark: SparkSession, d: str) -> DataFrame:
    """The cosines of each judged pair's last user text and tool text."""
    rows = pairs(spark, d).where("latest_user_text is not null")
    conv = rows.groupBy("conversation_id").agg(F.min("latest_user_text").alias("text"))
    tool = tools(spark, d).select("tool_id", F.col("source_text").alias("text"))
    return rounded(similarity.text_cosines(rows.join(tool.select("tool_id"), "tool_id", "left_semi"), conv, tool))


def json_objects(spark: SparkSession, d: str) -> DataFrame:
    """whether an event's properties are an object, bare and wrapped in prose."""
    e = table(spark, d, "events")
    bare, wrapped = text.json_object(F.col("props")), text.json_object(F.concat(F.lit("Result: "), F.col("props"), F.lit(" done")))
    return e.groupBy("event_type").agg(F.count(bare).alias("bare"), F.count(wrapped).alias("wrapped"))


def stable_ints(spark: SparkSession, d: str) -> DataFrame:
    return tools(spark, d).select("tool_id", text.stable_int(F.col("tool_id")).alias("n"))


def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    """F16: three intents scored on the last user text."""
    rows = pairs(spark, d).where("latest_user_text is not null").groupBy("conversation_id").agg(F.min("latest_user_text").alias("t"))
    t = F.lower("t")
    return rounded(rows.select("conversation_id", text.score_any(t, ("先别", "不用", "不要", "don't", "not now")).alias("no_call"), text.score_any(t, ("打开", "open .*page")).alias("browse"), text.score_any(t, ("提醒", "remind", "watch", "看着")).alias("monitor")))


QUERIES = {f.__name__: f for f in (token_counts, document_frequency, corpus_size, bm25, tfidf_norms, lexical_features, id_family_pairs, similar_tools, similar_tools_plain, similar_tools_all_plain, similarity_summary, most_similar, text_cosines, json_objects, stable_ints, policy_scores)}

_U = "u as (select tool_id, any_value(source_text) x from tools group by 1)"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_TOKENS)
_TOK = "regexp_extract_all(lower(x), '[a-zA-Z0-9_]+|[一-鿿]{1,2}')"
_LEX = "regexp_extract_all(lower({0}), '[a-z0-9_]+|[一-鿿]')"
_P = "p as (select distinct conversation_id, tool_id from pair_examples where conversation_id is not null and tool_id is not null and label is not null and not isnan(raw_score) and raw_score between 0 and 100)"
_Q = """pt as (select conversation_id, tool_id, min(latest_user_text) t from pair_examples where conversation_id is not null and tool_id is not null and label is not null and not isnan(raw_score) and raw_score between 0 and 100 group by 1, 2 having min(latest_user_text) is not null),
    q as (select conversation_id, min(t) t from pt group by 1)"""

_ONCE = "(select tool_id, metadata.name name, metadata.description description, metadata.short_description short_description, metadata.keywords keywords, concat_ws(' ', tool_id, metadata.name, metadata.description, metadata.short_description, array_to_string(metadata.keywords, ' ')) words from (select *, row_number() over (partition by tool_id order by imported_at) k from tools) where k = 1)"
_WORDS = "words"
_PASS = "where 0.58 * cs + 0.22 * kj + 0.1 * fs >= 0.28 or cs >= 0.42 or kj >= 0.3 or fs >= 0.5"
_SHOWN = f"select l left_tool_id, r right_tool_id, round(0.58 * cs + 0.22 * kj + 0.1 * fs, 6) score, round(cs, 6) text_cosine, round(kj, 6) keyword_jaccard, round(fs, 6) id_family_similarity from s {_PASS}"


def _similar(table: str, text: str, keywords: str) -> str:
    return f"""with t as (select tool_id, {text} x, list_distinct(list_transform(coalesce({keywords}, []), lambda z: lower(z))) kw, list_distinct(list_filter(string_split(regexp_replace(tool_id, '^plugin\\.', ''), '_'), lambda z: z <> '')) fam from {table}),
        e as (select tool_id, unnest({_TOK}) k from t), c as (select tool_id, k, count(*) n from e where length(trim(k, '_')) > 1 and k not in ({_STOP}) group by 1, 2), m as (select tool_id, sqrt(sum(n * n)) m from c group by 1),
        d as (select a.tool_id l, b.tool_id r, sum(a.n * b.n) dot from c a join c b using (k) where a.tool_id < b.tool_id group by 1, 2),
        s as (select a.tool_id l, b.tool_id r, coalesce(dot / (ma.m * mb.m), 0) cs, coalesce(len(list_intersect(a.kw, b.kw)) / nullif(len(list_distinct(a.kw || b.kw)), 0), 0) kj, coalesce(len(list_intersect(a.fam, b.fam)) / nullif(len(list_distinct(a.fam || b.fam)), 0), 0) fs
            from t a join t b on a.tool_id < b.tool_id left join d on d.l = a.tool_id and d.r = b.tool_id left join m ma on ma.tool_id = a.tool_id left join m mb on mb.tool_id = b.tool_id)
        """


ORACLES = {
    "token_counts": f"with {_U}, e as (select tool_id, unnest({_TOK}) token from u) select tool_id, token, count(*) n from e where length(trim(token, '_')) > 1 and token not in ({_STOP}) group by 1, 2",
    "document_frequency": f"with {_U}, e as (select distinct tool_id, unnest({_LEX.format('x')}) token from u) select token, count(*) df from e group by 1",
    "corpus_size": f"with {_U} select count(*) docs, round(avg(len({_LEX.format('x')})), 6) mean_length from u",
    "bm25": f"""with {_U}, {_Q}, w as (select tool_id, unnest({_LEX.format('x')}) k from u), tf as (select tool_id, k, count(*) tf from w group by 1, 2), l as (select tool_id, len({_LEX.format('x')}) n from u), df as (select k, count(*) df from tf group by 1),
        s as (select count(*) nd, avg(n) m from l), g as (select distinct conversation_id, unnest({_LEX.format('t')}) k from q),
        h as (select pt.conversation_id, pt.tool_id, sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l.n / m))) b from pt join g using (conversation_id) join tf using (tool_id, k) join df using (k) join l using (tool_id) cross join s group by 1, 2)
        select pt.conversation_id query_id, pt.tool_id doc_id, round(coalesce(b, 0), 6) bm25 from pt join u using (tool_id) left join h using (conversation_id, tool_id)""",
    "tfidf_norms": f"""with {_U}, e as (select tool_id, unnest({_LEX.format('x')}) k from u), t as (select tool_id, k, 1 + ln(count(*)) tf from e group by 1, 2), df as (select k, count(*) df from t group by 1),
        w as (select tool_id, tf * (ln((1 + (select count(*) from u)) / (1 + df)) + 1) w from t join df using (k)) select tool_id, round(max(w) / sqrt(sum(w * w)), 6) top_weight, count(*) tokens from w group by 1""",
    "lexical_features": f"""with {_U}, {_Q}, c as (select conversation_id, list_distinct({_LEX.format('t')}) c from q), t as (select tool_id, list_distinct({_LEX.format('x')}) t, list_distinct(list_filter(regexp_split_to_array(lower(tool_id), '[^a-z0-9]+'), lambda z: z <> '')) i from u)
        select conversation_id, tool_id, round(len(list_intersect(c, t)) / greatest(1, len(c)), 6) overlap_conv, round(len(list_intersect(c, t)) / greatest(1, len(t)), 6) overlap_tool,
            round(coalesce(len(list_intersect(c, t)) / nullif(len(list_distinct(c || t)), 0), 0), 6) jaccard, round(len(list_intersect(c, i)) / greatest(1, len(i)), 6) id_coverage, (len(list_intersect(c, i)) > 0)::int::double id_hit from (select conversation_id, tool_id from pt) join c using (conversation_id) join t using (tool_id)""",
    "id_family_pairs": """with r as (select distinct left_tool_id, right_tool_id, list_distinct(list_filter(string_split(regexp_replace(left_tool_id, '^plugin\\.', ''), '_'), lambda z: z <> '')) a, list_distinct(list_filter(string_split(regexp_replace(right_tool_id, '^plugin\\.', ''), '_'), lambda z: z <> '')) b from runtime_tool_pool_v4)
        select left_tool_id, right_tool_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0), 0), 6) family from r""",
    "similar_tools_plain": f"{_similar('runtime_pool', 'short_description', 'keywords')} {_SHOWN}",
    "similar_tools_all_plain": f"{_similar(_ONCE, _WORDS, 'keywords')} {_SHOWN}",
    "similarity_summary": f"{_similar(_ONCE, _WORDS, 'keywords')} select (select count(distinct tool_id) from tools) tools, (select count(distinct tool_id) from tools where kind = 'plugin') plugins, count(*) similar_pairs, round(max(score), 6) top_score, round(avg(score), 6) mean_score from (select 0.58 * cs + 0.22 * kj + 0.1 * fs score from s {_PASS})",
    "most_similar": f"{_similar('runtime_pool', 'short_description', 'keywords')} {_SHOWN} order by score desc, left_tool_id, right_tool_id limit 50",
    "json_objects": "select event_type, sum((json_valid(props) and starts_with(trim(props), '{'))::int) bare, sum((json_valid(props) and starts_with(trim(props), '{'))::int) wrapped from events group by 1",
    "stable_ints": f"with {_U} select tool_id, list_reduce(list_transform(string_split(tool_id, ''), lambda c: unicode(c)::bigint), lambda a, c: (a * 131 + c) % 1000000007, 0::bigint) n from u",
    "policy_scores": f"""with {_Q}, l as (select conversation_id, lower(t) t from q) select conversation_id,
        round(least(1, (contains(t, '先别')::int + contains(t, '不用')::int + contains(t, '不要')::int + contains(t, 'don''t')::int + contains(t, 'not now')::int) / 2.5), 6)::double no_call,
        round(least(1, (contains(t, '打开')::int + regexp_matches(t, 'open .*page')::int) / 1.0), 6)::double browse,
        round(least(1, (contains(t, '提醒')::int + contains(t, 'remind')::int + contains(t, 'watch')::int + contains(t, '看着')::int) / 2.0), 6)::double monitor from l""",
}
