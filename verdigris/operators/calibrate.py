"""Judge scores to continuous labels: medians, group z-scores, global ranks, normal quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.numeric import clip, inverse_normal
from verdigris.operators.ranks import average_rank, ordinal
from verdigris.plans.scratch import materialise

# fixed values: the axes of a judgment, in their order
AXES = ("capability_match", "action_demand", "target_specificity", "consent_boundary", "intervention_cost", "companionship_fit", "final_preference")


def _check_clip(p: float) -> None:
    if not 0.0 <= p < 0.5:
        raise ValueError("clip must be in [0, 0.5)")


def _medians(judgments: DataFrame, keys: Sequence[str], scores: dict[str, tuple[str, str]]) -> DataFrame:
    """The exact median and the range of each score within ``keys``, under the names given for them. Of one or two runs the
    median is the middle of their bounds; only larger groups are sorted."""
    bounds = [x for c in scores for x in (F.min(c).alias(f"{c}_lo_"), F.max(c).alias(f"{c}_hi_"))]
    groups = judgments.groupBy(*keys).agg(F.count("*").alias("runs_"), *bounds)
    ranges = [(F.col(f"{c}_hi_") - F.col(f"{c}_lo_")).alias(r) for c, (_, r) in scores.items()]
    few = groups.where("runs_ <= 2").select(*keys, *((F.col(f"{c}_lo_") / 2 + F.col(f"{c}_hi_") / 2).alias(m) for c, (m, _) in scores.items()), *ranges)
    many = judgments.join(groups.where("runs_ > 2").select(*keys), list(keys), "left_semi")
    many = many.groupBy(*keys).agg(*(F.median(c).alias(m) for c, (m, _) in scores.items()), *((F.max(c) - F.min(c)).alias(r) for c, (_, r) in scores.items()))
    return few.unionByName(many)


def aggregate_judgments(judgments: DataFrame, keys: Sequence[str] = ("sample_id", "tool_id"), score: str = "raw_score") -> DataFrame:
    """A1, A3: each key's exact median score over its judge runs, and their range as ``judge_disagreement``."""
    return _medians(judgments, keys, {score: ("raw_score", "judge_disagreement")})


def _rounded(z: Column, digits: int) -> Column:
    z = F.round(z, digits)
    return F.when(z == 0, F.lit(0.0)).otherwise(z)  # one zero, not two of either sign


def local_z(rows: DataFrame, by: Sequence[str] = ("sample_id",), value: str = "raw_score", digits: int | None = 9) -> DataFrame:
    """``(value - mean) / population deviation`` within ``by``, 0 in a constant group.

    Rounded to ``digits``, so that equal scores of different groups tie whatever order they were summed in.
    Group figures are aggregated and joined back, so that a hot group is not gathered.
    """
    of = rows.groupBy(*by).agg(F.avg(value).alias("m_"), F.stddev_pop(value).alias("s_"), (F.max(value) == F.min(value)).alias("flat_"))
    z = F.when(F.col("flat_"), F.lit(0.0)).otherwise(F.try_divide(F.col(value) - F.col("m_"), F.col("s_")))
    z = _rounded(z, digits) if digits is not None else z
    return rows.join(of, list(by)).withColumn("local_z", z).drop("m_", "s_", "flat_")


def rank_gaussian(rows: DataFrame, value: str, by: Sequence[str] = (), clip_at: float = 0.001, name: str = "confidence") -> DataFrame:
    """The normal quantile of the average rank, ``(rank - 0.5) / N`` clipped, over all rows or within ``by``."""
    _check_clip(clip_at)
    ranked = average_rank(rows, value, by, "rank_")
    size = rows.groupBy(*by).agg(F.count(value).alias("n_"))
    ranked = ranked.join(size, list(by)) if by else ranked.crossJoin(F.broadcast(size))
    p = clip((F.col("rank_") - 0.5) / F.col("n_"), clip_at, 1 - clip_at)
    return ranked.withColumn(name, inverse_normal(p)).drop("rank_", "n_")


def calibrate(judgments: DataFrame, clip_at: float = 0.001, digits: int | None = 9) -> DataFrame:
    """Judge runs to ``sample_id, tool_id, raw_score, judge_disagreement, local_z, confidence``."""
    scored = materialise(aggregate_judgments(judgments), "scores")  # read three times: group figures, ranks, rows
    return rank_gaussian(local_z(scored, digits=digits), "local_z", clip_at=clip_at)


def aggregate_axes(judgments: DataFrame) -> DataFrame:
    """A3: medians and ranges for each axis. ``judgments`` has ``sample_id, tool_id`` and either ``axis, raw_score`` or, wide, a column an axis:
    then a run is one row, grouped once for all its axes, and only the results are unpivoted."""
    if "axis" in judgments.columns:
        return aggregate_judgments(judgments, ("sample_id", "tool_id", "axis"))
    return _long(_medians(judgments, ("sample_id", "tool_id"), {a: (f"{a}_m", f"{a}_d") for a in AXES}))


def _long(wide: DataFrame, z: dict[str, Column] | None = None) -> DataFrame:
    parts = lambda a: [F.lit(a).alias("axis"), F.col(f"{a}_m").alias("raw_score"), F.col(f"{a}_d").alias("judge_disagreement"), *([z[a].alias("local_z")] if z else [])]
    return wide.select("sample_id", "tool_id", F.explode(F.array(*(F.struct(*parts(a)) for a in AXES))).alias("x")).select("sample_id", "tool_id", "x.*")


def calibrate_axes(judgments: DataFrame, clip_at: float = 0.001) -> DataFrame:
    """As :func:`calibrate` for judgments by axis (see :func:`aggregate_axes`), ranked within each axis. Wide judgments stay
    wide until all axes have their z-scores."""
    if "axis" in judgments.columns:
        scored = local_z(materialise(aggregate_axes(judgments), "scores"), ("sample_id", "axis"))
    else:
        wide = materialise(_medians(judgments, ("sample_id", "tool_id"), {a: (f"{a}_m", f"{a}_d") for a in AXES}), "scores")
        of = wide.groupBy("sample_id").agg(*(x for a in AXES for x in (F.avg(f"{a}_m").alias(f"{a}_a"), F.stddev_pop(f"{a}_m").alias(f"{a}_s"), (F.max(f"{a}_m") == F.min(f"{a}_m")).alias(f"{a}_f"))))
        score = lambda a: F.when(F.col(f"{a}_f"), F.lit(0.0)).otherwise(F.try_divide(F.col(f"{a}_m") - F.col(f"{a}_a"), F.col(f"{a}_s")))
        scored = _long(wide.join(of, "sample_id"), {a: _rounded(score(a), 9) for a in AXES})
    return rank_gaussian(materialise(scored, "scores"), "local_z", ("axis",), clip_at)


def relative_mix(group_max: Column, absolute: float, full: float, weight: float) -> Column:
    """A4: how much the relative score counts in a group with this highest score."""
    ramp = clip((group_max - absolute) / (full - absolute), 0.0, 1.0)
    return F.when(group_max <= absolute, F.lit(0.0)).otherwise(weight * ramp)


def hybrid_final(axes: DataFrame, clip_at: float = 0.001, absolute: float = 10.0, full: float = 60.0, weight: float = 0.35) -> DataFrame:
    """The final axis anew, from :func:`calibrate_axes`: an absolute quantile of the score mixed with the relative
    confidence, ties split by relative confidence and then by the row's place in (sample, tool) order, ranked again.

    ``sample_id`` must be a number here, as places are counted in its order.
    """
    if not absolute < full:
        raise ValueError("absolute must be less than full")
    if not 0 <= weight <= 1:
        raise ValueError("weight must be in [0, 1]")
    rows = axes.where(F.col("axis") == AXES[-1]).withColumnRenamed("confidence", "relative")
    top = rows.groupBy("sample_id").agg(F.max("raw_score").alias("top"))
    rows = ordinal(rows.join(top, "sample_id"), "sample_id", ["tool_id"])
    mix = relative_mix(F.col("top"), absolute, full, weight)
    fixed = inverse_normal(clip((clip(F.col("raw_score"), 0.0, 100.0) + 0.5) / 101.0, clip_at, 1 - clip_at))
    value = (1.0 - mix) * fixed + mix * F.col("relative") + F.col("relative") * 1e-6 + F.col("ord") * 1e-12
    rows = materialise(rows.withColumn("hybrid", F.round(value, 13)).drop("top", "ord", "relative"), "hybrid")
    return rank_gaussian(rows, "hybrid", clip_at=clip_at).drop("hybrid")


def calibrate_multiaxis(judgments: DataFrame, clip_at: float = 0.001, **hybrid: float) -> DataFrame:
    """All axes, the final one by :func:`hybrid_final`, as maps from axis to value; ``confidence`` and
    ``raw_score`` are those of the final axis (P19)."""
    axes = materialise(calibrate_axes(judgments, clip_at), "axes")
    cols = ["sample_id", "tool_id", "axis", "raw_score", "judge_disagreement", "local_z", "confidence"]
    rows = axes.where(F.col("axis") != AXES[-1]).select(cols).unionByName(hybrid_final(axes, clip_at, **hybrid).select(cols))
    maps = {"axis_scores": "confidence", "raw_scores": "raw_score", "local_z": "local_z", "judge_disagreement": "judge_disagreement"}
    packed = [F.map_from_entries(F.sort_array(F.collect_list(F.struct("axis", c)))).alias(n) for n, c in maps.items()]
    out = rows.groupBy("sample_id", "tool_id").agg(*packed)
    return out.withColumns({"confidence": F.col("axis_scores")[AXES[-1]], "raw_score": F.col("raw_scores")[AXES[-1]]})


def final_judgments(judgments: DataFrame) -> DataFrame:
    """Multi-axis judgments as single-axis ones, by the final axis."""
    return judgments.where(F.col("axis") == AXES[-1]).drop("axis")
