"""Queries on calibration: A1-A4, W1-W6, F22."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.catalog.bindings import axis_judgments, judgments
from verdigris.operators import calibrate as c


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({x: F.round(x, digits) for x in cols})


def aggregate_judgments(spark: SparkSession, d: str) -> DataFrame:
    return c.aggregate_judgments(judgments(spark, d))


def local_z(spark: SparkSession, d: str) -> DataFrame:
    return c.local_z(c.aggregate_judgments(judgments(spark, d))).select("sample_id", "tool_id", "local_z")


def calibrate_single(spark: SparkSession, d: str) -> DataFrame:
    return _r(c.calibrate(judgments(spark, d)).select("sample_id", "tool_id", "raw_score", "local_z", "confidence", "judge_disagreement"), "confidence")


def rank_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return _r(c.rank_gaussian(c.aggregate_judgments(judgments(spark, d)), "raw_score").select("sample_id", "tool_id", "raw_score", "confidence"), "confidence")


def calibrate_axis(spark: SparkSession, d: str) -> DataFrame:
    return _r(c.calibrate_axes(axis_judgments(spark, d)).select("sample_id", "tool_id", "axis", "raw_score", "local_z", "confidence"), "confidence")


def hybrid_final_preference(spark: SparkSession, d: str) -> DataFrame:
    """Only the final axis is scored."""
    rows = axis_judgments(spark, d).select("sample_id", "tool_id", F.lit(c.AXES[-1]).alias("axis"), F.col(c.AXES[-1]).alias("raw_score"))
    return _r(c.hybrid_final(c.calibrate_axes(rows)).select("sample_id", "tool_id", "raw_score", "confidence"), "confidence")


def calibrate_multiaxis(spark: SparkSession, d: str) -> DataFrame:
    """The maps' entries as columns."""
    rows = c.calibrate_multiaxis(axis_judgments(spark, d))
    out = rows.select("sample_id", "tool_id", "raw_score", "confidence", *(F.col("axis_scores")[a].alias(f"{a}_confidence") for a in c.AXES), *(F.col("raw_scores")[a].alias(f"{a}_raw_score") for a in c.AXES))
    return _r(out, "confidence", *(f"{a}_confidence" for a in c.AXES))


def final_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = axis_judgments(spark, d).unpivot(["sample_id", "tool_id"], list(c.AXES), "axis", "raw_score")
    return c.final_judgments(rows)


QUERIES = {f.__name__: f for f in (aggregate_judgments, local_z, calibrate_single, rank_gaussian, calibrate_axis, hybrid_final_preference, calibrate_multiaxis, final_projection)}


def quantile(p: str) -> str:
    """The published rational approximation of the normal quantile, as SQL."""
    num = "(((({0}*{x}+{1})*{x}+{2})*{x}+{3})*{x}+{4})*{x}+{5}"
    a = num.format(-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00, x="q2")
    b = "((((-5.447609879822406e01*q2+1.615858368580409e02)*q2-1.556989798598866e02)*q2+6.680131188771972e01)*q2-1.328068155288572e01)*q2+1"
    c_ = num.format(-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00, x="t")
    d_ = "(((7.784695709041462e-03*t+3.224671290700398e-01)*t+2.445134137142996e00)*t+3.754408661907416e00)*t+1"
    q, t = f"({p} - 0.5e0)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    inner = f"({a.replace('q2', f'({q}*{q})')}) * {q} / ({b.replace('q2', f'({q}*{q})')})"
    tail = f"({c_.replace('t', t)}) / ({d_.replace('t', t)})"
    return f"case when {p} < 0.02425 then {tail} when {p} > 0.97575 then -({tail}) else {inner} end"


_AGG = "j as (select sample_id, tool_id, median(raw_score) raw_score, max(raw_score) - min(raw_score) judge_disagreement from pair_examples where sample_id is not null and tool_id is not null and not isnan(raw_score) and raw_score between 0 and 100 group by 1, 2)"
_Z = "z as (select *, case when max(raw_score) over w = min(raw_score) over w then 0 else round((raw_score - avg(raw_score) over w) / stddev_pop(raw_score) over w, 9) + 0.0 end local_z from j window w as (partition by sample_id))"
_RANK = "r as (select *, least(greatest((rank() over (order by {v}) + (count(*) over (partition by {v}) - 1) / 2.0e0 - 0.5) / count(*) over (), 0.001), 0.999)::double p from {t})"
_AXIS = """l as (select l_orderkey sample_id, 'plugin.s' || l_suppkey tool_id, unnest([{'axis': 'capability_match', 'v': l_quantity}, {'axis': 'action_demand', 'v': l_discount * 1000}, {'axis': 'target_specificity', 'v': l_tax * 1250},
        {'axis': 'consent_boundary', 'v': (l_linenumber * 14)::double}, {'axis': 'intervention_cost', 'v': (l_partkey % 101)::double}, {'axis': 'companionship_fit', 'v': (l_suppkey % 101)::double}, {'axis': 'final_preference', 'v': l_quantity * 2}], recursive := true) from lineitem),
    j as (select sample_id, tool_id, axis, median(v) raw_score from l group by all),
    z as (select *, case when max(raw_score) over w = min(raw_score) over w then 0 else round((raw_score - avg(raw_score) over w) / stddev_pop(raw_score) over w, 9) + 0.0 end local_z from j window w as (partition by sample_id, axis)),
    r as (select *, least(greatest((rank() over (partition by axis order by local_z) + (count(*) over (partition by axis, local_z) - 1) / 2.0e0 - 0.5) / count(*) over (partition by axis), 0.001), 0.999)::double p from z)"""

_HYBRID = f"""{_AXIS},
        f as (select *, {quantile('p')} rel, least(greatest((least(greatest(raw_score, 0), 100) + 0.5) / 101.0e0, 0.001), 0.999)::double pa, max(raw_score) over (partition by sample_id) top, row_number() over (order by sample_id, tool_id) - 1 o from r where axis = 'final_preference'),
        g as (select *, case when top <= 10 then 0 else 0.35e0 * least(greatest((top - 10) / 50.0e0, 0), 1) end mix, {quantile('pa')} fixed from f),
        h as (select *, round((1 - mix) * fixed + mix * rel + rel * 1e-6 + o * 1e-12, 13) v from g),
        k as (select *, least(greatest((rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0e0 - 0.5) / count(*) over (), 0.001), 0.999)::double pf from h)"""

ORACLES = {
    "aggregate_judgments": f"with {_AGG} select * from j",
    "local_z": f"with {_AGG}, {_Z} select sample_id, tool_id, local_z from z",
    "calibrate_single": f"with {_AGG}, {_Z}, {_RANK.format(v='local_z', t='z')} select sample_id, tool_id, raw_score, local_z, round({quantile('p')}, 6) confidence, judge_disagreement from r",
    "rank_gaussian": f"with {_AGG}, {_RANK.format(v='raw_score', t='j')} select sample_id, tool_id, raw_score, round({quantile('p')}, 6) confidence from r",
    "calibrate_axis": f"with {_AXIS} select sample_id, tool_id, axis, raw_score, local_z, round({quantile('p')}, 6) confidence from r",
    "hybrid_final_preference": f"with {_HYBRID} select sample_id, tool_id, raw_score, round({quantile('pf')}, 6) confidence from k",
    "calibrate_multiaxis": f"""with {_HYBRID}, e as (select sample_id, tool_id, axis, raw_score, round({quantile('p')}, 6) c from r where axis <> 'final_preference' union all select sample_id, tool_id, axis, raw_score, round({quantile('pf')}, 6) from k)
        select sample_id, tool_id, max(case when axis = 'final_preference' then raw_score end) raw_score, max(case when axis = 'final_preference' then c end) confidence,
            {', '.join(f"max(case when axis = '{a}' then c end) {a}_confidence, max(case when axis = '{a}' then raw_score end) {a}_raw_score" for a in c.AXES)} from e group by 1, 2""",
    "final_projection": "select l_orderkey sample_id, 'plugin.s' || l_suppkey tool_id, l_quantity * 2 raw_score from lineitem",
}
