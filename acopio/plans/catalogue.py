"""Descriptors of algorithms and of their parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Id, kind, and (name, type, default) of each parameter.
DESCRIPTORS = (
    ("affine_ordering_policy", "policy_form", (("y0_initial", "float", 0.0), ("y1_initial", "float", 0.0))),
    ("open_loop", "policy_form", (("y0", "float", 1.0),)),
    ("corrective_reformulation", "policy_form", (("kp", "float", 1.0), ("ki", "float", 0.1))),
    ("ewma_smoothing", "weighting", (("alpha", "float", 0.15), ("K", "float", 1.0))),
    ("uniform_recency_weighting", "weighting", ()),
    ("lead_time_window_weighting", "weighting", (("ventana_dias", "int", 14),)),
    ("unbounded_deviations", "uncertainty_set", ()),
    ("bounded_deviations", "uncertainty_set", (("epsilon_factor", "float", 1.5),)),
    ("simple_absolute_deviation", "deviation_metric", ()),
    ("correlated_deviations", "deviation_metric", (("cov_matrix_path", "str", ""),)),
    ("robust_constraint_aggregated", "constraint_family", ()),
    ("turnover_constraint", "constraint_family", (("psi_min", "float", 0.6),)),
    ("revenue_constraint", "constraint_family", (("revenue_floor_usd", "float", 0.0),)),
    ("cash_constraint", "constraint_family", (("cash_floor_usd", "float", 0.0),)),
    ("inventory_constraint", "constraint_family", ()),
    ("dynamic_control_framing", "framing", ()),
    ("static_robust_framing", "framing", ()),
    ("cold_start_similarity", "cold_start", (("heredar_de_sku", "str", ""), ("score_minimo", "float", 0.7))),
)


def catalogue(spark: SparkSession) -> DataFrame:
    """(id, kind, parameters); defaults as text."""
    rows = [(i, kind, [(name, type_, str(default)) for name, type_, default in parameters]) for i, kind, parameters in DESCRIPTORS]
    return spark.createDataFrame(rows, "id string, kind string, parameters array<struct<name:string,type:string,default:string>>")


def with_parameters(descriptor: str, **given: float | int | str) -> dict[str, float | int | str]:
    """The parameters of a run: defaults, and what is given; unknown names are errors."""
    known = {name: default for i, _, parameters in DESCRIPTORS if i == descriptor for name, _, default in parameters}
    if descriptor not in {d[0] for d in DESCRIPTORS}:
        raise KeyError(descriptor)
    if unknown := set(given) - set(known):
        raise ValueError(f"{descriptor} has no {sorted(unknown)}")
    return known | given
