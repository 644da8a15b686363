"""Norms: conditions compiled to columns, defeats, conflicts and verdicts.

A norm that errs or is null does not apply.  Steps: validity, condition,
explicit defeats, conflicts of one target by priority, verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Norm:
    id: str
    kind: str  # prohibition, obligation, permission
    when: str  # SQL over the decision's columns, or @name of a registered predicate
    target: str
    priority: int
    defeasible: bool = True
    defeats: tuple[str, ...] = field(default=())
    valid_from: str | None = "2026-01-01 00:00:00"
    valid_to: str | None = None


#: Predicates by name; each gives a column over the decision's columns.
PREDICATES: dict[str, Callable[[], Column]] = {}


def register_predicate(name: str) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """@register_predicate("name"); the same function may come again, another one under its name is an error."""

    def add(f: Callable[[], Column]) -> Callable[[], Column]:
        if PREDICATES.setdefault(name, f) is not f:
            raise ValueError(f"the predicate {name!r} is registered already")
        return f

    return add


def _condition(n: Norm) -> Column:
    """When a norm applies; a predicate that nobody registered is an error."""
    if not n.when.startswith("@"):
        return F.expr(n.when)
    if n.when[1:] not in PREDICATES:
        raise ValueError(f"{n.id} asks for the predicate {n.when[1:]!r}, which is unknown")
    return PREDICATES[n.when[1:]]()


_BUY = "tipo = 'compra' and "

#: Identifiers, targets, priorities and limits of the catalogue.
CATALOGUE: tuple[Norm, ...] = (
    Norm("F_compra_perecedero_sin_viabilidad", "prohibition", _BUY + "coalesce(perecedero, false) and (coalesce(shelf_life_dias, 0) <= 0 or coalesce(lead_time_dias, 0) >= shelf_life_dias)", "compra_de_producto", 90, False),
    Norm("F_compra_grande_sin_aprobacion_presupuesto_bajo", "prohibition", _BUY + "coalesce(monto_usd, 0) > 5000 and not coalesce(aprobacion_supervisor, false) and coalesce(budget_disponible_categoria_usd, 0) < coalesce(budget_threshold_low_usd, 10000)", "compra_grande_critica", 80, False),
    Norm("F_compra_a_proveedor_desactivado", "prohibition", _BUY + "not coalesce(proveedor_activo, true)", "compra_a_proveedor", 95, False),
    Norm("F_importacion_sin_lead_time_para_evento", "prohibition", _BUY + "coalesce(proveedor_exterior, false) and dias_hasta_evento < coalesce(lead_time_proveedor_dias, 0)", "importacion_para_evento", 85),
    Norm("O_sku_critico_dos_proveedores", "obligation", _BUY + "coalesce(sku_critico, false) and coalesce(proveedores_disponibles, 0) < 2", "compra_sku_critico", 60),
    Norm("O_validacion_humana_coldstart_low_conf", "obligation", "coalesce(cold_start, false) and coalesce(cold_start_confidence, 1.0) < 0.5 and not coalesce(validacion_humana, false)", "decision_coldstart", 70),
    Norm("O_justificacion_proveedor_exterior_nuevo", "obligation", _BUY + "coalesce(proveedor_exterior, false) and coalesce(proveedor_es_nuevo, false) and not coalesce(justificacion_escrita, false)", "compra_proveedor_exterior_nuevo", 55),
    Norm("P_compra_sku_critico_unico_proveedor_con_aprobacion", "permission", _BUY + "coalesce(sku_critico, false) and coalesce(proveedores_disponibles, 0) = 1 and coalesce(aprobacion_excepcion, false)", "compra_sku_critico", 80, False, ("O_sku_critico_dos_proveedores",)),
    Norm("P_excede_budget_categoria_15_temporada_pico", "permission", _BUY + "coalesce(exceso_budget_pct, 0) > 0 and exceso_budget_pct <= 15", "compra_excede_budget", 65, valid_from="2026-11-15 00:00:00", valid_to="2027-01-15 23:59:59"),
    Norm("P_compra_supera_moq_con_descuento_volumen", "permission", _BUY + "coalesce(cantidad, 0) > coalesce(moq_unidades, 0) and coalesce(descuento_volumen_pct, 0) >= coalesce(descuento_volumen_minimo_pct, 10)", "compra_volumen_excesivo", 50),
    Norm("P_relajar_stock_minimo_sku_piloto", "permission", "coalesce(sku_piloto, false)", "stock_minimo", 40),
)

#: Columns a decision may have, with their types; missing ones are null.
DECISION = {"tipo": "string", "now": "timestamp"} | dict.fromkeys(("perecedero", "aprobacion_supervisor", "proveedor_activo", "proveedor_exterior", "sku_critico", "cold_start", "validacion_humana", "proveedor_es_nuevo", "justificacion_escrita", "aprobacion_excepcion", "sku_piloto"), "boolean") | dict.fromkeys(("shelf_life_dias", "lead_time_dias", "monto_usd", "budget_disponible_categoria_usd", "budget_threshold_low_usd", "dias_hasta_evento", "lead_time_proveedor_dias", "proveedores_disponibles", "cold_start_confidence", "exceso_budget_pct", "cantidad", "moq_unidades", "descuento_volumen_pct", "descuento_volumen_minimo_pct"), "double")


def check(norms: tuple[Norm, ...]) -> None:
    """Q13: duplicate ids, defeats of unknown or of strict norms."""
    known = {n.id: n for n in norms}
    if len(known) < len(norms):
        raise ValueError("norm ids repeat")
    for n in norms:
        for d in n.defeats:
            if d not in known:
                raise ValueError(f"{n.id} defeats {d}, which is unknown")
            if not known[d].defeasible:
                raise ValueError(f"{n.id} defeats {d}, which is strict")


def _valid(n: Norm) -> Column:
    out = F.lit(True)
    if n.valid_from:
        out &= F.col("now") >= F.to_timestamp(F.lit(n.valid_from))
    if n.valid_to:
        out &= F.col("now") <= F.to_timestamp(F.lit(n.valid_to))
    return out


def evaluate(decisions: DataFrame, norms: tuple[Norm, ...] = CATALOGUE) -> DataFrame:
    """decisions with applied, defeated, blocked_by, pending, unresolved (sorted arrays) and verdict.

    A conflict is an obligation or permission against a prohibition of the
    same target: the higher priority wins; at a tie, or if the loser is
    strict, it is unresolved.
    """
    check(norms)
    missing = [F.lit(None).cast(kind).alias(c) for c, kind in DECISION.items() if c not in decisions.columns]
    df = decisions.select("*", *missing) if missing else decisions
    fired = {n.id: F.coalesce(_condition(n) & _valid(n), F.lit(False)) for n in norms}
    beaten = {n.id: F.lit(False) for n in norms}
    for n in norms:
        for d in n.defeats:
            beaten[d] |= fired[n.id] & fired[d]
    clash = []
    for a in norms:
        for b in norms:
            if b.kind == "prohibition" and a.kind != "prohibition" and a.target == b.target:
                both = fired[a.id] & fired[b.id] & ~beaten[a.id] & ~beaten[b.id]
                low = None if a.priority == b.priority else b if a.priority > b.priority else a
                if low is None or not low.defeasible:
                    clash.append(F.when(both, f"{a.id}|{b.id}"))
                else:
                    beaten[low.id] |= both
    listed = lambda pairs: F.array_sort(F.array_compact(F.array(*pairs)))
    stands = lambda n: fired[n.id] & ~beaten[n.id]
    out = df.select(
        *decisions.columns, listed([F.when(fired[n.id], n.id) for n in norms]).alias("applied"), listed([F.when(beaten[n.id], n.id) for n in norms]).alias("defeated"),
        listed([F.when(stands(n), n.id) for n in norms if n.kind == "prohibition"] or [F.lit(None).cast("string")]).alias("blocked_by"), listed([F.when(stands(n), n.id) for n in norms if n.kind == "obligation"] or [F.lit(None).cast("string")]).alias("pending"), listed(clash or [F.lit(None).cast("string")]).alias("unresolved"),
    )
    return out.withColumn("verdict", F.when(F.size("blocked_by") + F.size("unresolved") > 0, "blocked").when(F.size("pending") > 0, "conditional").otherwise("permitted"))
