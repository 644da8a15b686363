"""Parts that no SQL covers: readers, sinks, compilers, norms, rules, plans, forecasts, streams."""

import datetime
import json
from collections import namedtuple

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from acopio.functions import text as X
from acopio.operators.catalog import category_substitutes
from acopio.operators.contracts import by_method, contexts_from_json, correlation_matrix, forecast_faults, intake
from acopio.operators.planning import Restriction, _weekly_demand, confidence, ets_samples, holt_winters, profiles, risk_panel, simulate, sourced_series, trim_to_budget
from acopio.operators import scenarios as C
from acopio.operators.similarity import composite, gower
from acopio.operators.texts import match
from acopio.plans.dispatch import Rule, dispatch, parse_stages
from acopio.plans.expressions import UnsafeExpression, compile_column, parse, template
from acopio.plans.norms import CATALOGUE, Norm, check, evaluate
from acopio.plans.purchase import order, plan_confidence, score_suppliers
from acopio.sources import readers, sinks
from acopio.streaming import posts as S
from pyspark.sql import functions as F


@pytest.mark.parametrize("text", ["__import__('os')", "a.__class__", "_x", "(lambda: 1)()", "[x for x in a]", "open('f')", "a; b", "exec('1')", "a + 1", "a ** 2", "f'{a}'", "min(a, key=b)"])
def test_unsafe(text):
    with pytest.raises(UnsafeExpression):
        parse(text)


def test_expressions(spark):
    df = spark.createDataFrame([(5, "new", 0.4)], "weeks int, kind string, x double")
    names = {"context": {c: F.col(c) for c in df.columns}}
    for text, want in {"context.weeks >= 5 and context.kind == 'new'": True, "0 < context.x <= 0.3": False, "not context.kind in ['a', 'b']": True, "max(context.weeks, 7) == 7": True, "1 if context.x > 1 else 2": 2}.items():
        assert df.select(compile_column(text, names)).first()[0] == want
    assert df.select(template("{{ context.kind }}", names)).first()[0] == "new"
    with pytest.raises(UnsafeExpression):
        compile_column("context.nothing", names)


def decision(spark, **values):
    return spark.createDataFrame([{"tipo": "compra", "now": datetime.datetime(2026, 6, 1)} | values])


def verdict(spark, norms=CATALOGUE, **values):
    return evaluate(decision(spark, **values), norms).first()


def test_norms(spark):
    assert verdict(spark, monto_usd=100.0)["verdict"] == "permitted"
    assert verdict(spark, proveedor_activo=False)["blocked_by"] == ["F_compra_a_proveedor_desactivado"]
    out = verdict(spark, sku_critico=True, proveedores_disponibles=1.0, aprobacion_excepcion=True)
    assert out["defeated"] == ["O_sku_critico_dos_proveedores"] and out["verdict"] == "permitted"
    assert verdict(spark, sku_critico=True, proveedores_disponibles=0.0, aprobacion_excepcion=True)["verdict"] == "conditional"
    assert verdict(spark, exceso_budget_pct=10.0)["applied"] == []
    assert verdict(spark, exceso_budget_pct=10.0, now=datetime.datetime(2027, 1, 15, 23, 59, 59))["applied"] == ["P_excede_budget_categoria_15_temporada_pico"]
    clash = lambda a, b, soft=True: (Norm("O", "obligation", "true", "t", a), Norm("F", "prohibition", "true", "t", b, soft))
    assert verdict(spark, clash(9, 5))["verdict"] == "conditional"
    assert verdict(spark, clash(5, 9))["blocked_by"] == ["F"]
    assert verdict(spark, clash(5, 5))["unresolved"] == ["O|F"]
    assert verdict(spark, clash(9, 5, False))["verdict"] == "blocked"
    with pytest.raises(ValueError):
        check((Norm("A", "permission", "true", "t", 1, defeats=("B",)), Norm("B", "prohibition", "true", "t", 1, False)))


def test_dispatch(spark):
    df = spark.createDataFrame([("new", 0.5, None, 3), ("existing", None, 0.1, 60)], "tipo_sku string, similar_top_score double, trend_confidence double, w int")
    out = dispatch(df, (Rule("a", 5, ("context.w > 50",), "x + y", 0.9, {"x.k": "{{ context.w }}"}), Rule("z", 1, (), "o", 0.5))).collect()
    assert [(r["rule"], r["stages"], r["confidence"]) for r in out] == [("z", ["o"], 0.25), ("a", ["x", "y"], 0.9)] and out[1]["params"] == {"x.k": "60"}
    with pytest.raises(ValueError):
        parse_stages("a + + b")


def test_readers(spark, tmp_path):
    (tmp_path / "w.csv").write_text("﻿sku;anio;semana;unidades_vendidas;importe_total_pyg\n1;2026;5;3;10\n2;2026;54;3;10\nx;2026;5;3;10\n", encoding="utf-8")
    assert [r["sku"] for r in readers.weekly_sales(spark, str(tmp_path / "w.csv")).collect()] == [1]
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"post_id": "b", "fecha": "2026-01-02T00:00:00Z"}, {"post_id": "a", "fecha": "2026-01-01T00:00:00Z"}]}))
    assert [r["post_id"] for r in readers.posts(spark, str(tmp_path / "p.json")).collect()] == ["a", "b"]
    row = spark.range(1).select(readers.volume_tiers(F.lit("1000:0.03|2000:0.06")).alias("t"), readers.seasonal_vector(F.lit("1, 2,,3")).alias("v"), readers.event_date(F.lit(3)).alias("d"))
    assert row.first()["v"] == [1.0, 2.0, 3.0] and str(row.first()["d"]) == "2026-01-15"
    assert [row.select(readers.tier_discount(F.col("t"), F.lit(q))).first()[0] for q in (10, 1500, 2000)] == [0.0, 0.03, 0.06]


def test_sinks(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = sinks.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, sinks.upsert(once, new, ["k"]).collect()))
    assert tuple(sinks.upsert_counts(old, new, ["k"]).first()) == (1, 1)
    triples = spark.createDataFrame([("urn:a", "urn:p", 'say "x"', "literal", None), ("urn:a", "urn:q", "urn:b", "uri", None), ("urn:a", "urn:n", "5", "literal", "urn:int")], "s string, p string, o string, o_kind string, datatype string")
    sinks.ntriples(triples).write.text(str(tmp_path / "t"))
    back = readers.ntriples(spark, str(tmp_path / "t"))
    assert back.count() == 3 and {r["o_kind"] for r in back.collect()} == {"uri", "literal"} and back.where("datatype = 'urn:int' and o = '5'").count() == 1
    assert match(triples.select("s", "p", "o"), [("?x", "urn:q", "?y"), ("?x", "urn:n", "5")]).collect()[0]["y"] == "urn:b"
    sinks.append_new(str(tmp_path / "log"), old, "k", None)
    sinks.append_new(str(tmp_path / "log"), new, "k", spark.read.parquet(str(tmp_path / "log")))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def brute_trim(items, budget):
    rows = sorted(([s, q, p, round(q * p, 2)] for s, q, p in items), key=lambda r: (-r[3], r[0]))
    total = sum(r[3] for r in rows)
    for r in rows:
        if total <= budget:
            break
        half = max(1, int(r[1] * 0.5))
        if half < r[1]:
            total -= r[3] - round(half * r[2], 2)
            r[1], r[3] = half, round(half * r[2], 2)
    kept = []
    for r in rows:
        if total <= budget:
            kept.append((r[0], r[1]))
        else:
            total -= r[3]
    return sorted(kept)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 40)), min_size=1, max_size=7), st.integers(1, 2500))
def test_trim(spark, items, budget):
    items = [(k, q, float(p)) for k, (q, p) in enumerate(items)]
    df = spark.createDataFrame([(1, *i) for i in items], "plan int, sku int, quantity long, price double")
    assert sorted((r["sku"], r["quantity"]) for r in trim_to_budget(df, ["plan"], F.lit(float(budget))).collect()) == brute_trim(items, budget)


def test_scores(spark):
    df = spark.createDataFrame([("a", "a", "x", None, 0.5), (None, "b", None, None, None)], "a string, b string, c string, d string, lex double")
    s = df.select(gower([(F.col("a"), F.col("b"), 2.0), (F.col("c"), F.col("d"), 1.0)]).alias("g"), *composite({"l": F.col("lex"), "s": F.lit(1.0)}, {"l": 0.5, "s": 0.3})).collect()
    assert s[0][0] == 1.0 and abs(s[0][1] - 0.55 / 0.8) < 1e-9 and s[1][0] == 0.0 and s[1][1] == 1.0 and abs(s[1][2] - 0.3) < 1e-9
    best = score_suppliers(spark.createDataFrame([("s1", 1, 0.9, 30, 10.0), ("s1", 2, 0.5, 0, 5.0)], "sku string, supplier int, reliability double, lead_days int, price double"), ["sku"]).where("place = 1").first()
    assert best["supplier"] == 2 and abs(best["score"] - (0.25 + 0.3 + 0.1)) < 1e-6
    item = spark.createDataFrame([(10.4, 4.0, 10.0, 20.0, 3.0, False, 0.8, 2.0, 12.0, 1.5, 5.0, 0.1, 8)], "mean double, p5 double, p50 double, p95 double, std double, perishable boolean, confidence double, price double, budget double, buffer double, level double, slope double, weeks int")
    for name in ("open_loop", "cold_inherit", "inv_buffer", "safety_stock", "affine_simple"):
        r = order(item, name).first()
        assert r["quantity"] == 6 and r["quantity_p5"] <= 6 <= r["quantity_p95"] and r["cost"] == 12.0
    assert abs(item.select(plan_confidence(F.lit(0.3), F.lit(2))).first()[0] - 0.6) < 1e-9


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.keywords(F.lit("The QUICK, quick brown! foxes (over) a dog"))) == ["quick", "brown", "foxes", "(over)"]
    assert one(X.numbers(F.lit("3,50 x2 and -7 or 1.0 a4b"))) == ["3.5", "-7", "1"]
    assert one(X.chunks(F.lit("x" * 1000))) == ["x" * 800, "x" * 300] and one(X.chunks(F.lit(""))) == []
    assert one(X.perturbation(F.lit("presupuesto a 30000")))["number"] == "30000"
    assert one(X.platform(F.lit(" ig "))) == "INSTAGRAM" and one(X.platform(F.lit("x"))) == "OTHER"
    assert one(X.confidence(F.lit(85.0))) == 0.85 and one(X.confidence(F.lit(0.4))) == 0.4
    assert one(X.field(F.lit(" a . ."))) == "a" and one(X.local_name(F.lit("http://x/y#z"))) == "z" and one(X.empty_description(F.lit("de la x")))


def test_forecast(spark):
    y = np.arange(60.0) * 2 + 10
    mean, std = holt_winters(y, 4)
    assert np.allclose(mean, 130 + 2 * np.arange(4), rtol=0.1) and std > 0
    season = np.tile(np.r_[np.ones(40) * 10, np.ones(12) * 30], 3)
    assert holt_winters(season, 52)[0][45] > 1.5 * holt_winters(season, 52)[0][5]
    assert holt_winters(np.array([]), 2)[0].tolist() == [0, 0]
    items = spark.createDataFrame([(1, 1, 100.0, 50.0, 0.0, 10.0, 6.0, 70, 8, True)], "plan int, sku int, quantity double, mean double, std double, price double, cost double, shelf_days int, weeks int, perishable boolean")
    assert {r["profit"] for r in simulate(items, 3, 1).collect()} == {50 * 10 - 600 - 50 * 6.0}


def test_forecast_sources(spark):
    parts = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, "A"), (6, "A")], "part long, category string")
    series = spark.createDataFrame([(p, 2000, w, float(p * w)) for p, n in ((1, 12), (2, 11), (5, 12), (6, 2)) for w in range(1, n + 1)], "part long, year long, week long, units double")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.6), (2, 3, 0.5), (3, 1, 0.59), (6, 5, 0.7), (6, 1, 0.7)], "id long, other long, score double")
    donors = spark.createDataFrame([(5, 1)], "part long, donor long")
    got = {r["part"]: (r["source"], r["donor"], r["n_own"], r["y"][:2]) for r in sourced_series(parts, series, edges, donors).collect()}
    assert got == {1: ("own", None, 12, [1, 2]), 2: ("inherited", 1, 11, [1, 2]), 3: ("category_default", None, 0, [3.5, 7]), 4: ("trend_only", None, 0, []), 5: ("inherited", 1, 12, [1, 2]), 6: ("inherited", 1, 2, [1, 2])}
    y = np.concatenate([k * np.r_[np.ones(40) * 10, np.ones(12) * 30] for k in (1, 2, 4)])
    ahead = holt_winters(y, 52)[0]
    assert 2.5 < ahead[45] / ahead[5] < 3.5  # a multiplicative peak grows with its level
    skewed = np.where(np.arange(60) % 10 == 0, 100.0, 10.0)
    draws = ets_samples(skewed, 1, 4000, 1)
    assert len(np.unique(draws)) <= 60 and np.percentile(draws, 98) > 2 * np.percentile(draws, 80)  # residuals, not a normal curve
    assert np.isclose(confidence(np.array([]), "trend_only"), 0.25 + 0.075 + 0.09)


def test_restrictions_of_simulations(spark):
    shape = "plan int, sku int, quantity double, mean double, std double, price double, cost double, shelf_days int, weeks int, perishable boolean, min_order int"
    items = spark.createDataFrame([(1, 1, 50.0, 400.0, 60.0, 10.0, 6.0, 7, 8, True, None), (1, 2, 30.0, 40.0, 5.0, 8.0, 5.0, 7, 8, False, 20), (2, 1, 5.0, 40.0, 5.0, 10.0, 6.0, 90, 8, True, 20)], shape)
    shelf, least, budget, other = Restriction("no_exceder_dias_validez", "V"), Restriction("cantidad_minima_proveedor", "Q"), Restriction("presupuesto_maximo_pyg", "B", 100.0), Restriction("otro", "X", 0.0)
    rows = simulate(items, 4000, 1, (shelf, least, budget, other)).toPandas()
    got = {r["plan"]: r for r in risk_panel(items, 4000, 1, (shelf, least, budget, other)).collect()}
    assert got[1]["violations"]["B"] == 4000 and got[1]["n_valid"] == 0 and got[1]["revenue_p05"] is None and set(got[1]["violations"]) == {"V", "B"}
    assert got[2]["violations"] == {"Q": 4000} and not rows["valid"].any()
    # Weekly demand of 50 against 50 units on the shelf for one week: half of the simulations are valid.
    rows, got = simulate(items, 4000, 1, (shelf, other)).where("plan = 1").toPandas(), risk_panel(items, 4000, 1, (shelf, other)).where("plan = 1").first()
    assert got["n_valid"] == rows["valid"].sum() == 4000 - got["violations"]["V"] and abs(got["n_valid"] - 2000) < 150
    assert np.allclose([got["revenue_p05"], got["revenue_p50"], got["revenue_p95"]], np.percentile(rows.loc[rows["valid"], "revenue"], [5, 50, 95]), atol=1e-3)
    assert np.isclose(got["var"], max(0, -np.percentile(rows["profit"], 5)), atol=1e-3) and got["total_cost"] == 450
    assert risk_panel(items, 200, 1, (Restriction("cantidad_minima_proveedor", "Q", 31),)).where("plan = 1").first()["violations"] == {"Q": 200}


def test_chunks_of_plans(spark):
    shape = "plan int, sku int, quantity double, mean double, std double, price double, cost double, shelf_days int, weeks int, perishable boolean"
    rows = [(1, k, 40.0, 40.0, 2.0 if k % 2 else 30.0, 10.0, 6.0, 14 if k % 3 else None, 8, k % 4 < 2) for k in range(12)] + [(None, 1, 5.0, 6.0, 1.0, 9.0, 6.0, None, 8, False), (None, 2, 5.0, 6.0, 1.0, 9.0, 6.0, None, 8, False)]
    norms = (Restriction("no_exceder_dias_validez", "V"), Restriction("presupuesto_maximo_pyg", "B", 1000.0))
    items = spark.createDataFrame(rows, shape)
    whole, split = ({r["plan"]: r for r in risk_panel(items, 500, 3, norms, chunk).collect()} for chunk in (100, 1))
    assert whole.keys() == split.keys() == {1, None}
    for plan, r in whole.items():
        assert r["violations"] == split[plan]["violations"] and r["n_valid"] == split[plan]["n_valid"] and np.isclose(r["mean"], split[plan]["mean"]) and np.isclose(r["cvar"], split[plan]["cvar"])
    assert whole[1]["violations"]["B"] == 500 and whole[1]["violations"]["V"] > 0 and whole[None]["n_valid"] == 500
    assert risk_panel(items.limit(0), 10, 1).count() == 0


def test_sums_of_clipped_weeks():
    def same(a, b):  # Kolmogorov's distance of two samples of 200,000: 0.0062 is passed once in 2,000 pairs
        both = np.sort(np.r_[a, b])
        return np.abs(np.searchsorted(np.sort(a), both, "right") - np.searchsorted(np.sort(b), both, "right")).max() / len(a) < 0.0062

    item = namedtuple("item", "mean std weeks")
    for mean, std, within in ((40.0, 2.0, 3), (40.0, 5.0, 3), (20.0, 6.3, 1), (3.0, 7.0, 7), (0.0, 1.0, 2), (-4.0, 6.0, 2)):
        total, early = _weekly_demand(np.random.default_rng(1), item(mean, std, 8), 200_000, within)
        weeks = np.maximum(0, np.random.default_rng(2).standard_normal((8, 200_000)) * std / np.sqrt(8) + mean / 8)
        atoms = lambda v: np.round(v, 2)
        assert same(atoms(total), atoms(weeks.sum(0))) and same(atoms(early), atoms(weeks[:within].sum(0)))
        assert np.isclose(np.corrcoef(total, early)[0, 1], np.corrcoef(weeks.sum(0), weeks[:within].sum(0))[0, 1], atol=0.01)
    assert (_weekly_demand(np.random.default_rng(1), item(5.0, 0.0, 8), 10, 0)[0] == 5).all()


def test_methods_of_forecasts(spark):
    curve = [2.0] * 26 + [0.5] * 26
    parts = spark.createDataFrame([(1, "A", curve), (2, "A", curve), (3, "A", curve), (4, "B", curve)], "part long, category string, curve array<double>")
    weeks = [(1, 1 + w // 52, 1 + w % 52, 20.0 + w % 3) for w in range(52)] + [(2, 1, w, 4.0 * w) for w in range(1, 4)]
    series = spark.createDataFrame(weeks, "part long, year long, week long, units double")
    got = {r["part"]: r for r in by_method(parts, series, n_samples=20_000).collect()}
    assert [(got[k]["method"], got[k]["calibrated"]) for k in (1, 2, 3, 4)] == [("ets", True)] + [("categoria_cold_start", False)] * 3
    assert {r["week"] for r in got.values()} == {1}  # the week after the last one of all series, which is the year's 52nd
    units = np.array([w[3] for w in weeks])
    assert 19 < got[1]["mean"] < 23 and got[1]["p5"] <= got[1]["p50"] <= got[1]["p95"]
    assert abs(got[2]["p50"] - 2 * 8) < 0.3 and abs(got[3]["p50"] - 2 * units.mean()) < 0.3 and np.isclose(got[3]["std"], 1.5 * units.std(), rtol=0.05) and abs(got[4]["p50"] - 2 * 5) < 0.1
    assert {r["method"] for r in by_method(parts, series.limit(0)).collect()} == {"categoria_cold_start"} and by_method(parts.limit(0), series).count() == 0


def test_similar_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(min(rng.integers(0, 9), 4)) if k < 56 else 5 + k % 2, float(rng.integers(0, 4)), float(rng.integers(0, 3))) for k in range(60)]
    want = {a[0]: [b[0] for b in sorted((b for b in rows if b[0] != a[0]), key=lambda b: (a[1] != b[1], abs(a[2] - b[2]), abs(a[3] - b[3]), b[0]))][:3] for a in rows}
    got = {}
    for r in C.similar_rows(spark.createDataFrame(rows, "id long, region int, reliability double, reputation double")).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got == want


def test_contracts(spark):
    shape = "part long, mean array<double>, std array<double>, p5 array<double>, p50 array<double>, p95 array<double>, source string, donor long, n_own int, confidence double"
    one = ([1.0],) * 5
    rows = [(1, *one, "own", None, 3, 0.5), (2, [1.0], [], [1.0], None, [1.0, 2.0], "own", None, 0, 1.0), (3, *one, "inherited", None, 0, 0.0), (4, *one, "inherited", 4, 0, 0.2), (5, *one, "inherited", 4, -1, 1.5), (6, *one, None, None, None, None)]
    got = {r["part"]: r["f"] for r in spark.createDataFrame(rows, shape).select("part", forecast_faults().alias("f")).collect()}
    assert got == {1: [], 2: ["length of std", "length of p50", "length of p95"], 3: ["donor is missing"], 4: ["donor is the part itself"], 5: ["n_own", "confidence"], 6: ["source", "n_own", "confidence"]}
    texts = ['{"part": 1, "tipo_sku": "new", "similar_top_k": [{"sku": "a", "score": 0.5}], "evaluated_at": "2026-01-02T03:04:05Z", "eval_deontica": {"permitida": false}}', '{"part": 2, "tipo_sku": "new", "eval_deontica": {}}', '{"part": 3, "tipo_sku": "?"}', "no object", None]
    read = contexts_from_json(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, json string")).orderBy("k").collect()
    assert [(r["part"], r["stopped"], r["error"]) for r in read] == [(1, True, None), (2, False, None), (3, False, "tipo_sku"), (None, False, "tipo_sku"), (None, False, "tipo_sku")]
    assert read[0]["similar_top_k"][0]["score"] == 0.5 and read[0]["evaluated_at"] == datetime.datetime(2026, 1, 2, 3, 4, 5) and read[0]["eval_deontica"]["bloqueada_por"] == [] and read[1]["eval_deontica"]["permitida"]
    shape = "trend_id string, descripcion string, palabras_clave array<string>, fuente string, fecha_deteccion timestamp, metadata_fuente map<string,string>, velocidad_crecimiento int, confianza_extraccion double, productos_existentes_similares array<struct<sku:int,score:int,nombre:string,categoria:string,precio_referencia:int>>, validado_shacl boolean, provisional boolean, more int"
    taken = intake(spark.createDataFrame([("t", "d", ["x"], f, None, {}, 2, 0.5, [(7, 1, "n", "c", 3)], True, False, 1) for f in ("PINTEREST", "TUMBLR", None)], shape)).collect()
    assert [r["fuente"] for r in taken] == ["PINTEREST", "OTHER", "OTHER"] and taken[0]["productos_existentes_similares"][0]["sku"] == "7" and "more" not in taken[0]
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=30), rng.normal(size=30)
    filled = spark.createDataFrame([(n, 1, w, float(v[w])) for n, v in (("a", x), ("b", x + y), ("c", np.ones(30))) for w in range(30)], "category string, year int, week int, units double")
    assert np.allclose(correlation_matrix(filled, ["b", "c", "a", "d"]), [[1, 0, np.corrcoef(x, x + y)[0, 1], 0], [0, 1, 0, 0], [np.corrcoef(x, x + y)[0, 1], 0, 1, 0], [0, 0, 0, 1]], atol=1e-6)
    with pytest.raises(ValueError):
        correlation_matrix(filled, [str(k) for k in range(2001)])


def test_category_substitutes(spark, tmp_path):
    parts = [(k, "A", "x" if k % 2 else "y") for k in range(1, 9)] + [(20, "B", "x"), (21, "B", "y"), (22, "C", "x")]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {}
    for r in category_substitutes(spark, str(tmp_path)).orderBy("part", "place").collect():
        got.setdefault(r["part"], []).append(r["substitute"])
    assert got == {p: [q for q, t, _ in parts if t == kind and q != p][:5] for p, kind, _ in parts if kind != "C"}


def test_streams(spark, tmp_path):
    at = lambda h: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)
    rows = [(1, at(0), 7, "click", 1.0, ""), (2, at(24), 7, "purchase", 2.0, ""), (3, at(25), 8, "view", 3.0, ""), (3, at(25), 8, "view", 3.0, "")]
    spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"))

    def drained(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    counts = {(r["t"], r["event_type"]): r["n"] for r in drained(S.windowed(stream), "complete", "w").collect()}
    assert counts == {(at(0), "click"): 1, (at(24), "purchase"): 1, (at(48), "view"): 2}
    assert drained(S.distinct_events(S.event_stream(spark, str(tmp_path / "in"))), "append", "d").count() == 3
    held = {r["user_id"]: r for r in drained(S.profiles(S.event_stream(spark, str(tmp_path / "in"))), "update", "p").collect()}
    batch = spark.createDataFrame([(7, at(0), 1, "RECHAZAR"), (7, at(24), 2, "APROBAR")], "operator long, at timestamp, id long, action string")
    assert abs(held[7]["confidence"] - profiles(batch).first()["confidence"]) < 1e-9 and held[7]["version"] == 3
    seen = []
    S.run_batches(S.event_stream(spark, str(tmp_path / "in")), lambda df, k: seen.append(df.count()), str(tmp_path / "b")).awaitTermination(120)
    assert seen == [4]


def test_scenarios(spark):
    fixed = C.nearest_psd(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))
    assert np.linalg.eigvalsh(fixed).min() > -1e-9 and np.allclose(np.diag(fixed), 1)
    draws = C.correlated_demand(spark, ["a", "b"], np.array([100.0, 50.0]), np.array([5.0, 5.0]), np.array([[1, 0.8], [0.8, 1]]), 3000).groupBy("sim").pivot("name", ["a", "b"]).agg(F.first("demand"))
    assert abs(draws.select(F.corr("a", "b")).first()[0] - 0.8) < 0.05
    df = spark.createDataFrame([(1, "chair red"), (2, "red chairs"), (3, None)], "k int, t string")
    assert C.dataset_hash(df).first()[0] == C.dataset_hash(df.orderBy(F.desc("k"))).first()[0] != C.dataset_hash(df.where("k < 3")).first()[0]
    v = {r["k"]: np.array(r["embedding"]) for r in C.embed(df, "k", "t").collect()}
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-5 and v[1] @ v[2] > 0.4
    row = spark.range(1).select(C.invented_numbers(F.lit("5 units at 3.0"), F.lit("buy 5 for 7")).alias("n"), C.cited(F.lit("by rule_1"), ["rule_1", "rule_2"]).alias("c"), C.explain(F.lit("sku"), F.lit(4)).alias("e")).first()
    assert row["n"] == ["7"] and row["c"] == ["rule_1"] and "4 unidades" in row["e"]


def test_rules_lint():
    from acopio.plans.dispatch import RULES, Rule, lint

    assert lint(RULES) == []
    bad = (Rule("a", 1, ("context.x + 1 > 2",), "open_loop + affine_ordering_policy", 0.5, {"ewma_smoothing.alpha": 1}), Rule("a", 1, ("context.y > 1",), "nothing", 0.5), Rule("c", 1, (), "open_loop + ", 0.5))
    found = lint(bad, names={"x"})
    for said in ("a: the id repeats", "two stages of kind policy_form", "unknown descriptor nothing", "parameter ewma_smoothing.alpha has no stage", "BinOp is not allowed", "unknown field y", "c: an empty stage"):
        assert any(said in f for f in found), said


def test_safe_expressions_of_lists(spark):
    row = spark.range(1).select(F.array(F.lit(0.9), F.lit(0.5)).alias("scores"), F.lit("b").alias("kind"))
    names = {"scores": F.col("scores"), "kind": F.col("kind")}
    said = {"scores[0] > 0.7": True, "scores[-1] > 0.7": False, "sum(scores) > 1.3": True, "any([scores[1] > 1, kind == 'b'])": True, "all([kind == 'b', False])": False, "kind in {'a', 'b'}": True, "{'a': 1, 'b': 2}[kind] == 2": True, "len(scores[:1]) == 1": True, "max(scores) == 0.9": True, "+scores[0] == 0.9": True, "scores[7] is None": True}
    got = row.select(*(compile_column(e, names).alias(str(k)) for k, e in enumerate(said))).first()
    assert dict(zip(said, got, strict=True)) == said
    for refused in ("1 + 2", "scores[0] * 2", "[x for x in scores]", "kind._a", "lambda: 1", "open('x')"):
        with pytest.raises(UnsafeExpression):
            parse(refused)


def test_patterns_must_be_connected(spark):
    data = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("c", "p", "d")], "s string, p string, o string")
    assert [tuple(r) for r in match(data, [("?x", "p", "?y"), ("?z", "p", "d"), ("?y", "q", "?z")]).select("x", "y", "z").collect()] == [("a", "b", "c")]
    with pytest.raises(ValueError):
        match(data, [("?x", "p", "?y"), ("?u", "q", "?v")])
    from acopio.operators.texts import ask, run_named

    assert ask(data, [("?x", "q", "c")]).first()["holds"] and not ask(data, [("?x", "q", "z")]).first()["holds"]
    with pytest.raises(ValueError, match="until"):
        run_named(spark, {"v": data}, "SELECT * FROM v WHERE s > :since AND s < :until", {"since": "a"})


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "x", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "d", 5), (2, "e", 5)], "k int, v string, at int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], ["at"]).collect())) == [(1, "b", 2), (2, "e", 5)]


def test_folds_of_profiles(spark):
    """Composed clamps against a plain fold, with steps that reach both ends."""
    import random

    from acopio.operators.planning import profiles

    draw = random.Random(3)
    rows = [(k, f"2026-01-{1 + n // 40:02d} {n % 24:02d}:{n % 60:02d}:00", n, draw.choice(["APROBAR", "RECHAZAR", "MODIFICAR", "otro"])) for k in range(4) for n in range(400)]
    got = {r["operator"]: r for r in profiles(spark.createDataFrame(rows, "operator int, at string, id int, action string").withColumn("at", F.to_timestamp("at"))).collect()}
    for k in range(4):
        x = 0.5
        for _, _, _, action in sorted(r for r in rows if r[0] == k):
            x = min(1.0, max(0.0, x + {"APROBAR": 0.03, "RECHAZAR": -0.06, "MODIFICAR": 0.02}.get(action, 0.0)))
        assert abs(got[k]["confidence"] - x) < 1e-6 and got[k]["version"] == 401


def test_sequential_budget(spark):
    from acopio.operators.recommend import sequential

    rows = [("p", 1, 7, "open_loop", 10, 100, 9000, 1500), ("p", 2, 7, "open_loop", 10, 100, 10000, 1500), ("p", 3, 7, "open_loop", 10, 50, 5000, 1500), ("q", 1, 7, "open_loop", 3, 10, 1000, 5)]
    got = sequential(spark.createDataFrame(rows, "plan string, sku long, supplier long, algorithm string, central long, cents long, unit long, budget long"))
    # 10 units at 90 cents leave 600; 6 at a full 100 leave nothing; what costs more than is left is not bought.
    assert sorted(tuple(r) for r in got.select("plan", "sku", "quantity", "cost").collect()) == [("p", 1, 10, 900), ("p", 2, 6, 600)]


def test_changes_of_settings(spark):
    from acopio.operators.recommend import changed

    rows = [(k, kind, number, 5) for k, (kind, number) in enumerate([("QUIEBRE_PROVEEDOR", None), ("CAMBIO_DEMANDA", 0.6), ("CAMBIO_PRESUPUESTO", 99.0), ("NUEVO_COMPETIDOR", 0.99), ("CUSTOM", 3.0)])]
    df = spark.createDataFrame(rows, "plan int, kind string, number double, supplier long").select("*", F.lit(100).cast("long").alias("budget"), F.lit(1.0).alias("factor"), F.array().cast("array<long>").alias("excluded"))
    got = [(r["budget"], round(r["factor"], 4), r["excluded"]) for r in changed(df, F.col("kind"), F.col("number"), F.col("supplier")).orderBy("plan").collect()]
    assert got == [(100, 1.0, [5]), (100, 0.6, []), (99, 1.0, []), (100, 0.05, []), (100, 1.0, [])]
