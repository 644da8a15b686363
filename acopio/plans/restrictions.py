"""Restrictions that go with an order, and conditions that block it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _row(norm: str, kind: str, value: Column, severity: str) -> Column:
    return F.struct(F.lit(norm).alias("norm"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(severity).alias("severity"))


def restrictions() -> Column:
    """Columns: budget, volatility, trend_confidence, perishable, shelf_life, source, confidence; null conditions do not apply."""
    # Identifiers, kinds, limits and severities.
    held = (
        (F.col("budget") < 5000, _row("N-STUB-001", "preferir_proveedor_local", F.lit("nacional"), "recomendada")),
        (F.col("volatility") > 0.25, _row("N-STUB-002", "buffer_minimo", F.lit(1.3), "obligatoria")),
        (F.col("trend_confidence") > 0.7, _row("N-STUB-003", "min_proveedores", F.lit(2), "obligatoria")),
        (F.col("perishable") & (F.col("shelf_life") > 0), _row("N-STUB-004", "no_exceder_dias_validez", F.col("shelf_life"), "obligatoria")),
        ((F.col("source") == "inherited") & (F.col("confidence") < 0.5), _row("N-STUB-005", "requerir_revision_humana", F.lit("confianza_inherited_baja"), "recomendada")),
        (F.lit(True), _row("N-STUB-006", "cap_presupuesto", F.col("budget"), "obligatoria")),
    )
    return F.array_compact(F.array(*(F.when(when, row) for when, row in held)))


def blocked() -> Column:
    """The first reason not to order, else null.  Columns: perishable, shelf_life, n_suppliers, least_lead, budget."""
    late = F.col("perishable") & (F.coalesce("least_lead", F.lit(999)) >= F.col("shelf_life"))
    return F.when(late, "shelf_life").when(F.coalesce("n_suppliers", F.lit(0)) == 0, "no_supplier").when(F.col("budget") <= 0, "no_budget")
