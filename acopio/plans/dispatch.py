"""Rule dispatch: prioritised rules compiled to one chain of conditions."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import DESCRIPTORS
from .expressions import TEMPLATE, UnsafeExpression, compile_column, parse, template


@dataclass(frozen=True)
class Rule:
    id: str
    priority: int
    when: tuple[str, ...]
    stages: str  # "a + b + c"
    confidence: float
    params: dict = field(default_factory=dict)


_AFFINE, _OPEN = "affine_ordering_policy", "open_loop"
#: Priorities, conditions, stages and parameters of the rules.
RULES: tuple[Rule, ...] = (
    Rule("regla_001_existing_estable", 90, ("context.tipo_sku == 'existing'", "context.semanas_historia >= 52", "context.volatilidad_forecast < 0.3"), f"{_AFFINE} + ewma_smoothing + bounded_deviations + simple_absolute_deviation + dynamic_control_framing", 0.90, {"ewma_smoothing.alpha": 0.15, "bounded_deviations.epsilon_factor": 1.5}),
    Rule("regla_030_evento_proximo_lead_time", 88, ("context.evento_dentro_de_lead_time", "context.tipo_sku == 'existing'", "context.semanas_historia >= 52"), f"{_AFFINE} + lead_time_window_weighting + bounded_deviations + correlated_deviations + dynamic_control_framing", 0.78, {"lead_time_window_weighting.ventana_dias": 21, "bounded_deviations.epsilon_factor": 2.5}),
    Rule("regla_002_existing_volatil", 85, ("context.tipo_sku == 'existing'", "context.semanas_historia >= 52", "context.volatilidad_forecast >= 0.3"), f"{_AFFINE} + ewma_smoothing + bounded_deviations + correlated_deviations + dynamic_control_framing", 0.80, {"ewma_smoothing.alpha": 0.25, "bounded_deviations.epsilon_factor": 2.0}),
    Rule("regla_010_cold_start_similar_alto", 80, ("context.tipo_sku == 'new'", "context.similar_top_score >= 0.7"), f"{_OPEN} + cold_start_similarity + uniform_recency_weighting + bounded_deviations + simple_absolute_deviation + static_robust_framing", 0.65, {"cold_start_similarity.heredar_de_sku": "{{ context.similar_top_sku }}", "bounded_deviations.epsilon_factor": 3.0}),
    Rule("regla_020_trend_signal_alta_confidence", 78, ("context.trend_confidence >= 0.8", "context.tipo_sku == 'trending'"), f"{_AFFINE} + ewma_smoothing + unbounded_deviations + simple_absolute_deviation + dynamic_control_framing", 0.75, {"ewma_smoothing.alpha": 0.20}),
    Rule("regla_011_cold_start_similar_dudoso", 75, ("context.tipo_sku == 'new'", "context.similar_top_score < 0.7", "context.cold_start_confidence < 0.5"), f"{_OPEN} + uniform_recency_weighting + bounded_deviations + simple_absolute_deviation + static_robust_framing", 0.40, {"bounded_deviations.epsilon_factor": 4.0}),
    Rule("regla_003_existing_historia_corta", 70, ("context.tipo_sku == 'existing'", "context.semanas_historia < 52", "context.semanas_historia >= 12"), f"{_OPEN} + ewma_smoothing + bounded_deviations + simple_absolute_deviation + static_robust_framing", 0.65, {"ewma_smoothing.alpha": 0.30, "bounded_deviations.epsilon_factor": 2.5}),
    Rule("regla_021_trend_signal_dudosa", 65, ("context.tipo_sku == 'trending'", "context.trend_confidence < 0.8", "context.semanas_historia >= 52"), f"{_AFFINE} + ewma_smoothing + bounded_deviations + simple_absolute_deviation + dynamic_control_framing", 0.70, {"ewma_smoothing.alpha": 0.15, "bounded_deviations.epsilon_factor": 1.8}),
    Rule("regla_999_fallback", 1, (), f"{_OPEN} + uniform_recency_weighting + bounded_deviations + simple_absolute_deviation + static_robust_framing", 0.30, {"bounded_deviations.epsilon_factor": 3.0}),
)


def parse_stages(text: str) -> list[str]:
    """B19: 'a + b' -> [a, b]."""
    parts = [p.strip() for p in text.split("+")]
    if not all(parts):
        raise ValueError(f"an empty stage: {text!r}")
    return parts


def lint(rules: tuple[Rule, ...], names: set[str] | None = None) -> list[str]:
    """Everything that is wrong with a catalogue of rules, all of it and not only the first.

    Ids repeat, a stage is no descriptor, two stages are of one kind, a
    condition or a template is unsafe (or names an unknown field, if names
    are given), parameters go to a stage that the rule does not have.
    """
    kinds = {i: kind for i, kind, _ in DESCRIPTORS}
    out, seen = [], set()
    for r in rules:
        if r.id in seen:
            out.append(f"{r.id}: the id repeats")
        seen.add(r.id)
        try:
            stages = parse_stages(r.stages)
        except ValueError as error:
            out.append(f"{r.id}: {error}")
            stages = []
        out += [f"{r.id}: unknown descriptor {s}" for s in stages if s not in kinds]
        held = [kinds[s] for s in stages if s in kinds]
        out += [f"{r.id}: two stages of kind {k}" for k in sorted({k for k in held if held.count(k) > 1})]
        out += [f"{r.id}: parameter {p} has no stage" for p in r.params if p.split(".")[0] not in stages]
        for text in (*r.when, *(m[1] for v in r.params.values() if isinstance(v, str) and (m := TEMPLATE.fullmatch(v)))):
            try:
                tree = parse(text)
                out += [f"{r.id}: unknown field {n.attr}" for n in ast.walk(tree) if names is not None and isinstance(n, ast.Attribute) and n.attr not in names]
            except UnsafeExpression as error:
                out.append(f"{r.id}: {error}")
    return out


def _case(pairs: list[tuple[Column, Column]]) -> Column:
    out = F
    for condition, value in pairs:
        out = out.when(condition, value)
    return out


def dispatch(contexts: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: Column | None = None) -> DataFrame:
    """contexts with rule, stages, params (map) and confidence of the first rule that fires.

    All conditions of a rule must hold; null or an error is false.  A blocked
    decision gets no rule.
    """
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("rule ids repeat")
    names = {"context": {c: F.col(c) for c in contexts.columns}}
    fires = []
    for r in sorted(rules, key=lambda r: (-r.priority, r.id)):
        held = F.lit(True)
        for text in r.when:
            held &= F.coalesce(compile_column(text, names).try_cast("boolean"), F.lit(False))
        fires.append((r, held))
    stopped = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
    pick = lambda value: _case([(stopped, F.lit(None)), *((held, value(r)) for r, held in fires)])
    params = lambda r: F.map_from_arrays(F.array(*(F.lit(k) for k in r.params)), F.array(*(template(v, names).cast("string") for v in r.params.values())))
    base = pick(lambda r: F.lit(r.confidence))
    doubtful = F.when((F.col("tipo_sku") == "new") & (F.col("similar_top_score") < 0.7), base * F.greatest(F.lit(0.3), F.col("similar_top_score")))
    adjusted = doubtful.when((F.col("tipo_sku") == "trending") & (F.col("trend_confidence") >= 0.8), F.least(F.lit(1.0), base * 1.05)).otherwise(base)
    return contexts.select("*", pick(lambda r: F.lit(r.id)).alias("rule"), pick(lambda r: F.array(*(F.lit(x) for x in parse_stages(r.stages)))).alias("stages"), pick(params).alias("params"), F.when(base.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), adjusted)), 6)).alias("confidence"))


def stage_changes(before: Column, after: Column) -> Column:
    """Stages added and removed."""
    return F.struct(F.array_except(after, before).alias("added"), F.array_except(before, after).alias("removed"))
