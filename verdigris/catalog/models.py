"""Queries on vectors, losses and the action policy: F11-F14, F23-F25, O12, R7, R8, A22, A23."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.catalog.bindings import pairs, table
from verdigris.catalog.ranking import PAIRS, rounded
from verdigris.operators import actions, losses, vectors


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each vector beside the first one of its label."""
    v = table(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return v.join(first, "label")


def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_vectors(spark, d).select("vec_id", vectors.cosine(F.col("embedding"), F.col("anchor")).alias("cosine")), 5)


def pair_vector_features(spark: SparkSession, d: str) -> DataFrame:
    f = _vectors(spark, d).select("vec_id", vectors.pair_features(F.col("embedding"), F.col("anchor")).alias("f"))
    return rounded(f.select("vec_id", F.size("f").alias("n"), F.aggregate("f", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total")), 4)


def masked_means(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return rounded(v.select("vec_id", vectors.masked_mean(F.col("embedding"), F.transform("embedding", lambda x: x > 0)).alias("positive_mean"), vectors.top_mean(F.col("embedding"), 5).alias("top5_mean")), 5)


def late_interaction(spark: SparkSession, d: str) -> DataFrame:
    """each vector cut into eight tokens of eight, against the first of its label."""
    cut = lambda c: F.array(*(F.slice(c, 8 * k + 1, 8) for k in range(8)))
    rows = _vectors(spark, d).select(F.col("vec_id").alias("pair_id"), cut("embedding").alias("left"), cut("anchor").alias("right"))
    return rounded(vectors.late_interaction(rows), 4)


def _states(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(F.col("conversation_id").alias("state_id"), "tool_id", F.col("label").alias("score"), (F.length("tool_id") % 2 == 0).alias("enabled"))


def desired_state_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(actions.gaps(_states(spark, d)))


def recommend_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = actions.recommend(_states(spark, d), max_actions=5)
    return rounded(rows.drop("action_probability", "desired_probability"))


def slates(spark: SparkSession, d: str) -> DataFrame:
    """The four kinds of slate that need no draw."""
    return rounded(actions.slates(_states(spark, d)).where("slate <> 'sampled'").select("state_id", "slate", "place", "tool_id"))


def slate_scores(spark: SparkSession, d: str) -> DataFrame:
    """R8 over R7."""
    s = actions.slates(_states(spark, d)).where("slate <> 'sampled'").groupBy("state_id", "slate").agg(F.count("*").alias("n"), F.count_if(F.col("gain") >= 0.75).alias("strong"))
    return rounded(s.select("state_id", "slate", actions.dry_run_slate_score(F.col("n"), F.col("strong")).alias("score")))


def policy_loss(spark: SparkSession, d: str) -> DataFrame:
    """The anchor and the over-recommending slate of each state, rewarded by their lengths and rated by gain."""
    states = _states(spark, d)
    chosen = actions.slates(states).where("slate in ('anchor', 'over_recommend')")
    judged = chosen.groupBy("state_id", "slate").agg(F.count("*").cast("double").alias("slate_score"))
    out = actions.group_loss(states, chosen, judged, chosen.select("state_id", "slate", "tool_id", F.round("gain", 6).alias("rating")), entropy_weight=0.01)
    return rounded(out, 4)


def feedback_advantages(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).select(F.col("conversation_id").alias("state_id"), "tool_id", F.col("label").alias("rating"), F.when(F.length("tool_id") % 2 == 0, "disable").otherwise("enable").alias("action"))
    return rounded(actions.feedback_advantages(rows).select("state_id", "tool_id", "advantage"))


def loss_margin(spark: SparkSession, d: str) -> DataFrame:
    return rounded(losses.margin_loss(pairs(spark, d)))


def loss_listnet(spark: SparkSession, d: str) -> DataFrame:
    return rounded(losses.listnet_loss(pairs(spark, d)))


def loss_lambda_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(losses.lambda_loss(pairs(spark, d)))


QUERIES = {f.__name__: f for f in (vector_cosine, pair_vector_features, masked_means, late_interaction, desired_state_gap, recommend_actions, slates, slate_scores, policy_loss, feedback_advantages, loss_margin, loss_listnet, loss_lambda_ndcg)}

_V = "a as (select label, arg_min(embedding, vec_id) anchor from embeddings group by 1), v as (select vec_id, embedding::double[] e, anchor::double[] a from embeddings join a using (label))"
_GAP = f"""{PAIRS}, s0 as (select conversation_id state_id, tool_id, label score, length(tool_id) % 2 = 0 enabled, 1 / (1 + exp(-label)) desired_probability from p),
    s as (select *, case when enabled then 1 - desired_probability else desired_probability end gain, 0.75 threshold from s0)"""
_SLATE = f"""{_GAP}, k as (select state_id, tool_id, gain, 'anchor' slate from s where gain > 0.75 union all select state_id, tool_id, gain, 'conservative' from s where gain > 0.85 union all select state_id, tool_id, gain, 'over_recommend' from s where gain > 0.75 - 0.18::double
        union all select state_id, tool_id, gain, 'hard_negative' from (select *, count(*) over w n, sum((gain > 0.75)::int) over w g, row_number() over (partition by state_id order by gain, tool_id desc) e,
            row_number() over (partition by state_id, gain > 0.75 order by gain desc, tool_id) sd, row_number() over (partition by state_id, gain > 0.75 order by gain, tool_id desc) su from s window w as (partition by state_id))
            where case when g = n then e = 1 when gain > 0.75 then sd < g else su = 1 end),
    r as (select *, row_number() over (partition by state_id, slate order by gain desc, tool_id) place from k qualify place <= 5)"""

ORACLES = {
    "vector_cosine": f"with {_V} select vec_id, round(list_dot_product(e, a) / sqrt(list_dot_product(e, e) * list_dot_product(a, a)), 5) \"cosine\" from v",
    "pair_vector_features": f"with {_V}, w as (select vec_id, unnest(e) x, unnest(a) y from v) select vec_id, 4 * count(*)::int n, round(sum(x + y + abs(x - y) + x * y), 4) total from w group by 1",
    "masked_means": "with w as (select vec_id, unnest(embedding)::double x from embeddings), r as (select *, row_number() over (partition by vec_id order by x desc) k from w) select vec_id, round(coalesce(avg(case when x > 0 then x end), 0), 5) positive_mean, round(avg(case when k <= 5 then x end), 5) top5_mean from r group by 1",
    "late_interaction": f"""with {_V}, l as (select vec_id, unnest(range(8)) i, e, a from v), m as (select l.vec_id, l.i, r.i j, list_dot_product(l.e[8 * l.i + 1:8 * l.i + 8], r.a[8 * r.i + 1:8 * r.i + 8]) s from l join l r using (vec_id)),
        x as (select vec_id, i, max(s) b, row_number() over (partition by vec_id order by max(s) desc) k from m group by 1, 2), y as (select vec_id, j, max(s) b, row_number() over (partition by vec_id order by max(s) desc) k from m group by 1, 2)
        select vec_id pair_id, round(max(x.b), 4) lr_max, round(avg(x.b), 4) lr_mean, round(avg(case when k <= 5 then x.b end), 4) lr_top, any_value(z.rl_max) rl_max, any_value(z.rl_mean) rl_mean, any_value(z.rl_top) rl_top
        from x join (select vec_id, round(max(b), 4) rl_max, round(avg(b), 4) rl_mean, round(avg(case when k <= 5 then b end), 4) rl_top from y group by 1) z using (vec_id) group by 1""",
    "desired_state_gap": f"""with {_GAP}, g as (select *, 1 / (1 + exp(-(gain - threshold) / 0.1)) q from s) select state_id, tool_id, round(score, 6) score, enabled, round(desired_probability, 6) desired_probability, round(gain, 6) gain, threshold::double threshold,
        round(q, 6) action_probability, round(case when enabled then -gain else gain end, 6) signed_gain, round(case when enabled then -q else q end, 6) signed_action_probability from g""",
    "recommend_actions": f"with {_GAP} select state_id, tool_id, case when enabled then 'disable' else 'enable' end \"action\", round(gain, 6) gain, row_number() over (partition by state_id order by gain desc, tool_id) place from s where gain > threshold qualify place <= 5",
    "slates": f"with {_SLATE} select state_id, slate, place, tool_id from r",
    "slate_scores": f"with {_SLATE}, c as (select state_id, slate, count(*) n, sum((gain >= 0.75)::int) g from r group by 1, 2) select state_id, slate, round(greatest(-1, least(1, (0.8 * g - 0.4 * (n - g)) / n - 0.15 * greatest(0, n - 2))), 6)::double score from c",
    "policy_loss": f"""with {_SLATE}, c as (select * from r where slate in ('anchor', 'over_recommend')), j as (select state_id, slate, count(*)::double sc from c group by 1, 2), q as (select state_id, tool_id, 1 / (1 + exp(-(gain - threshold) / 0.1)) q from s),
        l as (select j.state_id, j.slate, q.tool_id, case when c.tool_id is not null then ln(greatest(q, 1e-8)) else ln(greatest(1 - q, 1e-8)) end lp from j join q using (state_id) left join c on c.state_id = j.state_id and c.slate = j.slate and c.tool_id = q.tool_id),
        a as (select state_id, slate, sc, case when stddev_pop(sc) over w > 1e-6 then (sc - avg(sc) over w) / stddev_pop(sc) over w else 0 end adv from j window w as (partition by state_id)),
        p1 as (select state_id, -avg(adv * t) sl, avg(sc) mr from a join (select state_id, slate, sum(lp) t from l group by 1, 2) using (state_id, slate) group by 1),
        b as (select state_id, slate, tool_id, case when stddev_pop(round(gain, 6)) over w > 1e-6 then (round(gain, 6) - avg(round(gain, 6)) over w) / stddev_pop(round(gain, 6)) over w else 0 end adv from c window w as (partition by state_id, slate)),
        p2 as (select state_id, -avg(adv * lp) al from b join l using (state_id, slate, tool_id) group by 1), e as (select state_id, -avg(q * ln(greatest(q, 1e-8)) + (1 - q) * ln(greatest(1 - q, 1e-8))) en from q group by 1)
        select state_id, round(sl, 4) slate_loss, round(coalesce(al, 0), 4) action_loss, round(sl + 0.35 * coalesce(al, 0) - 0.01 * en, 4) loss, round(mr, 4) mean_reward from p1 left join p2 using (state_id) join e using (state_id)""",
    "feedback_advantages": f"""with {PAIRS}, x as (select conversation_id state_id, tool_id, label - avg(label) over w g, stddev_pop(label) over w s from p window w as (partition by conversation_id))
        select state_id, tool_id, round(case when length(tool_id) % 2 = 0 then -1 else 1 end * case when s > 1e-6 then g / s else g end, 6) advantage from x""",
    "loss_margin": f"""with {PAIRS}, x as (select conversation_id, tool_id, prediction, label, row_number() over (partition by conversation_id order by label desc, tool_id desc) b, row_number() over (partition by conversation_id order by label, tool_id) w from p),
        y as (select conversation_id, max(case when b = 1 then prediction end) bp, max(case when w = 1 then prediction end) wp, max(label) - min(label) g, count(*) n from x group by 1) select conversation_id, round(greatest(0, 0.3 - (bp - wp)), 6) loss from y where g >= 0.05 and n > 1""",
    "loss_listnet": f"""with {PAIRS}, g as (select conversation_id, max(label) tl, max(prediction) tp, max(label) - min(label) d, count(*) n from p group by 1), e as (select conversation_id, exp(label - tl) a, exp(prediction - tp) b, prediction - tp x from p join g using (conversation_id) where d >= 0.05 and n > 1)
        select conversation_id, round(ln(sum(b)) - sum(a * x) / sum(a), 6) loss from e group by 1""",
    "loss_lambda_ndcg": f"""with {PAIRS}, x as (select conversation_id, tool_id, label, prediction, label - min(label) over (partition by conversation_id) g, row_number() over (partition by conversation_id order by prediction desc, tool_id) r, row_number() over (partition by conversation_id order by label desc, tool_id) l from p),
        y as (select *, case when r <= 5 then 1 / log2(r + 1) else 0 end d from x), i as (select conversation_id, greatest(sum(g / log2(l + 1)), 1e-6) i from x where l <= 5 group by 1)
        select a.conversation_id, round(avg(abs(a.g - b.g) * abs(a.d - b.d) / i * (greatest(b.prediction - a.prediction, 0) + ln(1 + exp(-abs(b.prediction - a.prediction))))), 6) loss from y a join y b on a.conversation_id = b.conversation_id and a.label - b.label >= 0.05 + 1e-9 join i on i.conversation_id = a.conversation_id group by 1""",
}
