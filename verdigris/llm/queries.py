"""The queries of this subpackage: problem N's are named pN_..., each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.chosen_path import similar_sets
from verdigris.llm.crf import toxic_documents
from verdigris.llm.mixing import mix_sources
from verdigris.llm.overlap import overlapping_ids, partner_counts, split_overlap
from verdigris.llm.packing import pack, pack_report
from verdigris.llm.proportions import sample_to_targets
from verdigris.llm.sets import item_set, word_set
from verdigris.llm.tokens import token_count
from verdigris.llm.top_n import top_n_per_group
from verdigris.llm.vp_forest import near_duplicate_groups
from verdigris.plans.scratch import spread


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a grouped tool: its group."""
    tools = _t(spark, d, "tools").select("tool_id", word_set(F.col("source_text")).alias("text"), word_set(F.col("metadata.short_description")).alias("short"))
    return near_duplicate_groups(tools, "tool_id", {"text": 1, "short": 10}, 0.7)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    g = p1_groups(spark, d).select("id", "grp")
    other = g.select(F.col("id").alias("right_tool_id"), "grp")
    return g.withColumnRenamed("id", "left_tool_id").join(other, "grp").where("left_tool_id < right_tool_id").select("left_tool_id", "right_tool_id")


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sample_to_targets(_t(spark, d, "generation_tasks"), _t(spark, d, "task_targets"), "conversation_id", ["scenario_type", "language"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].where("short").select("scenario_type", "language")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0]


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "dataset_bundle").select("conversation_id", F.lower(F.trim("split")).alias("split"), "source")
    return b.where("conversation_id is not null and split in ('train', 'valid', 'test')").distinct()


def _overlap(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return split_overlap(_t(spark, d, "pair_examples"), _bundle(spark, d), "conversation_id", "conversation_text", "split")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = overlapping_ids(*_overlap(spark, d))
    return p.select(F.least("eval_id", "train_id").alias("left_conversation_id"), F.greatest("eval_id", "train_id").alias("right_conversation_id")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the evaluation side: its conversations, those that overlap, and the pairs. A conversation from
    several sources counts for each of them."""
    of = _bundle(spark, d).where("split <> 'train'")
    hit = partner_counts(*_overlap(spark, d)).select(F.col("id").alias("conversation_id"), "partners")
    rows = of.join(hit, "conversation_id", "left").groupBy("split", "source")
    return rows.agg(F.count("*").alias("conversations"), F.count("partners").alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"))


def _keywords(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Classes and pairs over the tools and the runtime pool; ids carry their table as a prefix."""
    tools = _t(spark, d, "tools").select(F.concat(F.lit("t"), "tool_id").alias("id"), item_set(F.col("metadata.keywords")).alias("items"))
    pool = _t(spark, d, "runtime_pool").select(F.concat(F.lit("r"), "tool_id").alias("id"), item_set(F.col("keywords")).alias("items"))
    return similar_sets(tools.union(pool).where("id is not null"), "id", "items", 0.6)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = _keywords(spark, d)
    same = members.select("cls").distinct().select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    x = members.select(F.col("id").alias("l"), F.col("cls").alias("a"))
    y = members.select(F.col("id").alias("r"), F.col("cls").alias("b"))
    near = pairs.select("a", "b").union(same).join(x, "a").join(y, "b")
    near = near.where("(left(l, 1) = 't' or left(r, 1) = 't') and substr(l, 2) <> substr(r, 2) and (a <> b or l < r)")
    l, r = F.expr("substr(l, 2)"), F.expr("substr(r, 2)")
    return near.select(F.least(l, r).alias("left_tool_id"), F.greatest(l, r).alias("right_tool_id")).distinct()


def p4_reported(spark: SparkSession, d: str) -> DataFrame:
    """The old report's claims on keyword overlap against the exact ones: one row a reported pair."""
    members, pairs = _keywords(spark, d)
    members = members.select(F.expr("substr(id, 2)").alias("id"), "cls").distinct()
    claims = _t(spark, d, "runtime_tool_pool_v4").select(F.least("left_tool_id", "right_tool_id").alias("left_tool_id"), F.greatest("left_tool_id", "right_tool_id").alias("right_tool_id"), "keyword_jaccard")
    claims = claims.groupBy("left_tool_id", "right_tool_id").agg(F.max("keyword_jaccard").alias("claimed"))
    x = members.select(F.col("id").alias("left_tool_id"), F.col("cls").alias("x"))
    y = members.select(F.col("id").alias("right_tool_id"), F.col("cls").alias("y"))
    both = claims.join(x, "left_tool_id", "left").join(y, "right_tool_id", "left").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    both = both.join(pairs.select("a", "b", "jaccard"), ["a", "b"], "left")
    return both.select("left_tool_id", "right_tool_id", "claimed", F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.col("jaccard")).alias("found"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    top = top_n_per_group(_t(spark, d, "pair_examples"), "conversation_id", "tool_id", "raw_score", 3, 0.0, 100.0)
    return top.select("conversation_id", "tool_id")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(_t(spark, d, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d), "doc_id", "tokens", _t(spark, d, "pack_sizes"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return pack_report(p6_pack(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each source's share of all tokens: one that is too scarce for its share falls short alone."""
    return mix_sources(_sizes(spark, d), "doc_id", "source", "tokens", _t(spark, d, "source_weights"), total="all")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(_t(spark, d, "documents").select("doc_id", "source", "text"))
    return toxic_documents(docs, _t(spark, d, "doc_labels"), keep_cols=("source",)).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("flagged").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: its documents, how many are flagged, in all and by class, and the mean score."""
    rows = p8_scores(spark, d).groupBy(F.lower(F.trim("source")).alias("source"))
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return rows.agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"), of("abusive"), of("hateful"), of("sexual"), F.avg("score").alias("mean_score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_sample, p2_report, p3_found, p3_report, p4_found, p4_reported, p5_found, p6_pack, p6_report, p7_mix, p7_report, p8_found, p8_scores, p8_rates)}

#: Words of a text as the texts' definition has them: a run of a-z and 0-9, or of Han characters each two neighbours.
_WORDS = """w_{name} as (select distinct tool_id, unnest(case when regexp_matches(r, '^[一-鿿]{{2}}') then list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) else [r] end) w
            from (select tool_id, unnest(regexp_extract_all(lower({column}), '[a-z0-9]+|[一-鿿]+')) r from tools)),
        n_{name} as (select tool_id, count(*) n from w_{name} group by 1 having count(*) >= {least}),
        c_{name} as (select a.tool_id x, b.tool_id y from w_{name} a join w_{name} b on a.w = b.w and a.tool_id < b.tool_id
            join n_{name} n on n.tool_id = a.tool_id join n_{name} m on m.tool_id = b.tool_id group by 1, 2 having count(*) * 10 >= 7 * (any_value(n.n) + any_value(m.n) - count(*)))"""

_P1 = f"""
        with recursive {_WORDS.format(name="text", column="source_text", least=1)},
        {_WORDS.format(name="short", column="metadata.short_description", least=10)},
        e as (select x, y from c_text union select x, y from c_short),
        b as (select x, y from e union select y, x from e),
        r as (select x, y from b union select r.x, b.y from r join b on r.y = b.x)"""
_P2 = """
        with t as (select conversation_id, min(case when scenario_type is not null and language is not null then {'s': lower(trim(scenario_type)), 'l': lower(trim(language))} end) c from generation_tasks where conversation_id is not null group by 1),
        n as (select c.s s, c.l l, count(*) available from t group by 1, 2),
        z as (select count(*) // 5 size from t)"""
_P3 = """
        with b as (select distinct conversation_id, lower(trim(split)) s, source from dataset_bundle where conversation_id is not null and lower(trim(split)) in ('train', 'valid', 'test')),
        w as (select distinct conversation_id, s, regexp_extract_all(lower(conversation_text), '[a-z0-9]+|[一-鿿]') w from pair_examples join b using (conversation_id) where conversation_text is not null),
        g as (select distinct conversation_id, s, unnest(list_transform(range(1, length(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) g from w),
        n as (select conversation_id, count(*) n from g where s <> 'train' group by 1),
        f as (select e.conversation_id e, t.conversation_id t from g e join g t on e.g = t.g and e.s <> 'train' and t.s = 'train' and e.conversation_id <> t.conversation_id join n on n.conversation_id = e.conversation_id
        group by 1, 2 having count(*) * 4 >= 3 * any_value(n.n))"""
_P4 = """
        with u as (select tool_id, 1 o, metadata.keywords k from tools union all select tool_id, 0, keywords from runtime_pool),
        w as (select distinct tool_id, o, lower(trim(x)) x from (select tool_id, o, unnest(k) x from u) where x is not null and trim(x) <> ''),
        n as (select tool_id, o, count(*) n from w group by all)"""

ORACLES = {
    "p1_found": f"{_P1} select distinct x left_tool_id, y right_tool_id from r where x < y",
    "p1_groups": f"{_P1} select x id, least(x, min(y)) grp from r group by 1",
    "p2_found": f"""{_P2}
        select g.scenario_type, g.language from task_targets g cross join z left join n on n.s = lower(trim(g.scenario_type)) and n.l = lower(trim(g.language))
        where coalesce(n.available, 0) < greatest(g.min_count, g.target_share * z.size)""",
    "p2_report": f"""{_P2},
        g as (select lower(trim(scenario_type)) s, lower(trim(language)) l, sum(target_share) share, max(min_count)::bigint least from task_targets where scenario_type is not null and language is not null group by 1, 2),
        a as (select *, sum(case when share <= 0 then least else 0 end) over () fixed, sum(share) over w back, sum(least) over w least_back, sum(least) over () least_all from g window w as (order by share <= 0, least / nullif(share, 0) desc, s, l rows between current row and unbounded following)),
        k as (select *, share > 0 and share * greatest(0, size - (least_all - least_back) - fixed * (share > 0)::int) < least * back low from a cross join z),
        f as (select *, share <= 0 or min(low::int) over (order by share <= 0, least / nullif(share, 0) desc, s, l) = 1 low_all from k),
        x as (select *, greatest(0, size - sum(case when low_all then least else 0 end) over ()) rest, sum(case when low_all then 0 else share end) over () free from f),
        y as (select *, case when low_all then least else floor(share / free * rest) end::bigint base, case when low_all then 0 else share / free * rest - floor(share / free * rest) end part from x),
        q as (select *, base + (not low_all and row_number() over (order by low_all, part desc, s, l) <= rest - sum(case when low_all then 0 else base end) over ())::int quota from y)
        select s scenario_type, l "language", share target_share, least min_count, size, coalesce(available, 0) available, greatest(least, share * size) wanted, quota::bigint quota, least(quota, coalesce(available, 0))::bigint drawn,
            (quota - least(quota, coalesce(available, 0)))::bigint deficit, least(quota, coalesce(available, 0)) / size share, coalesce(available, 0) < greatest(least, share * size) short from q left join n using (s, l)""",
    "p3_found": f"{_P3} select distinct least(e, t) left_conversation_id, greatest(e, t) right_conversation_id from f",
    "p3_report": f"""{_P3}, h as (select e, count(distinct t) partners from f group by 1)
        select s split, source, count(*) conversations, count(partners) overlapping, coalesce(sum(partners), 0)::bigint pairs from (select distinct conversation_id, s, source from b where s <> 'train') left join h on e = conversation_id group by 1, 2""",
    "p4_found": f"""{_P4},
        c as (select a.tool_id l, a.o lo, b.tool_id r, b.o ro, count(*) c from w a join w b on a.x = b.x and a.tool_id < b.tool_id and a.o + b.o > 0 group by all)
        select distinct c.l left_tool_id, c.r right_tool_id from c join n x on x.tool_id = c.l and x.o = c.lo join n y on y.tool_id = c.r and y.o = c.ro
        where c.c * 10 >= 6 * (x.n + y.n - c.c)""",
    "p4_reported": f"""{_P4},
        m as (select least(left_tool_id, right_tool_id) l, greatest(left_tool_id, right_tool_id) r, max(keyword_jaccard) claimed from runtime_tool_pool_v4 group by 1, 2),
        c as (select l, r, count(*) c from m join w a on a.tool_id = l join w b on b.tool_id = r and a.x = b.x group by 1, 2)
        select l left_tool_id, r right_tool_id, claimed, case when c * 10 >= 6 * (x.n + y.n - c) then c / (x.n + y.n - c) end found from m left join c using (l, r) left join n x on x.tool_id = l left join n y on y.tool_id = r""",
    "p5_found": """
        with s as (select conversation_id, tool_id, max(raw_score) s from pair_examples
                   where conversation_id is not null and tool_id is not null and not isnan(raw_score) and raw_score between 0 and 100 group by 1, 2)
        select conversation_id, tool_id from s qualify row_number() over (partition by conversation_id order by s desc, tool_id) <= 3""",
}
