"""Files, graphs, settings, and functions on signals and candidates."""

import datetime
import json

import numpy as np
import pytest

from acopio.__main__ import main
from acopio.functions import trends as X
from acopio.operators.catalog import card
from acopio.plans import affine
from acopio.plans.catalogue import catalogue, with_parameters
from acopio.sources import files, graph
from pyspark.sql import functions as F

TURTLE = """@prefix : <http://x.org/v1#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment; not a fact .
:Thing a <http://www.w3.org/2002/07/owl#Class> ; :label "cosa \\"fina\\""@es , "thing" .
:has a <http://www.w3.org/2002/07/owl#ObjectProperty> .
:N1 a :Prohibition ; :target "buy" ; :appliesWhen "p1" ; :priority 90 ; :defeasible false ; :validFrom "2026-01-01T00:00:00"^^xsd:dateTime .
:N2 a :Permission ; :target "buy" ; :appliesWhen '''x''' ; :defeats :N1 .
"""


def test_turtle(spark, tmp_path):
    with pytest.raises(graph.TurtleError):
        graph.parse_turtle(TURTLE)  # single quotes are not read
    text = TURTLE.replace("'''", '"""')
    (tmp_path / "a.ttl").write_text(text)
    t = graph.turtle(spark, str(tmp_path / "a.ttl"))
    assert t.where("lang = 'es'").first()["o"] == 'cosa "fina"'
    assert graph.summary(t).first().asDict() == {"n_classes": 1, "n_properties": 1, "n_triples": t.count()}
    assert graph.world(t, t).count() == t.count()
    n = {r["id"]: r for r in graph.norms(t).collect()}
    assert n["N1"]["priority"] == 90 and n["N1"]["defeasible"] is False and n["N1"]["broken"] == [] and n["N1"]["valid_from"] == datetime.datetime(2026, 1, 1)
    assert n["N2"]["defeasible"] is True and n["N2"]["defeats"] == ["N1"] and n["N2"]["broken"] == ["priority"]
    value = t.where("datatype is not null").select("p", *(c.alias(k) for k, c in graph.native(F.col("o"), F.col("datatype")).items())).collect()
    assert {r["as_long"] for r in value} == {90, None} and {r["as_boolean"] for r in value} == {False, None}
    assert graph.parse_turtle("") == [] and graph.parse_turtle("_:a <http://x/p> [ <http://x/q> 1.5 ] .")[1][2] == "_:n1"
    with pytest.raises(graph.TurtleError):
        graph.parse_turtle("z:a z:b z:c .")


def test_signals(spark, tmp_path):
    good = {"trend_id": "t", "descripcion": "luces", "fuente": " tik tok ", "fecha_deteccion": "2026-01-02T03:04:05Z", "confianza_extraccion": 0.5, "velocidad_crecimiento": 1.0}
    for k, body in enumerate(([good, good | {"fuente": "radio"}], {"trends": [good, {}]}, {"none": 1})):
        (tmp_path / f"{k}.json").write_text(json.dumps(body, indent=1))
    valid, rejected = files.signals(spark, str(tmp_path / "0.json"))
    assert valid.count() == 1 and rejected.first()["errors"] == ["fuente"]
    valid, rejected = files.signals(spark, str(tmp_path / "1.json"))
    assert valid.count() == 1 and len(rejected.first()["errors"]) == 6
    assert [x.count() for x in files.signals(spark, str(tmp_path / "2.json"))] == [0, 0]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, body in {"a.pdf": "uno", "b.pdf": "  ", "c.pdf": ""}.items():
        (tmp_path / "d" / name).write_text(body)
    assert [tuple(r) for r in files.document_files(spark, str(tmp_path / "d")).collect()] == [("a.pdf", "uno")]
    assert files.document_files(spark, str(tmp_path / "d"), lambda b: b.decode() + "!").count() == 2  # files without bytes are not listed
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id int, v array<double>")
    files.save_vectors(rows, str(tmp_path / "v"))
    assert files.vectors(spark, str(tmp_path / "v"), "id", "v").count() == 2
    with pytest.raises(Exception, match="dimension of 2"):
        files.vectors(spark, str(tmp_path / "v"), "id", "v", 2).collect()
    missing, empty = (lambda: spark.read.parquet(str(tmp_path / "none"))), (lambda: rows.where("false"))
    assert files.first_available(missing, empty, lambda: rows).count() == 2
    with pytest.raises(LookupError):
        files.first_match(rows, F.col("id") == 9)
    for _ in range(2):
        files.append_json(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    known = spark.createDataFrame([("a", 0.9, None)], "op string, risk double, cost double")
    got = files.profiles_or_default(known, spark.createDataFrame([("a",), ("b",)], "op string"), "op", {"risk": 0.5, "cost": 0.1})
    assert sorted(map(tuple, got.collect())) == [("a", 0.9, 0.1), ("b", 0.5, 0.1)]
    line = files.catalogue_turtle(spark.createDataFrame([("x", "Form", 'a "b"')], "id string, kind string, name string"), "http://x.org/").first()["value"]
    assert graph.parse_turtle(line)[1][2] == 'a "b"'


def test_settings():
    base = {"a": 0.5, "b": 0.5, "k": 10}
    assert files.settings('{"a": 0.25, "b": 0.75}', base, ("a", "b")) == {"a": 0.25, "b": 0.75, "k": 10}
    for bad in ({"a": 0.9}, {"z": 1}, {"a": 1.5, "b": -0.5}):
        with pytest.raises(ValueError):
            files.settings(bad, base, ("a", "b"))


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_functions(spark):
    s = F.lit
    text = lambda a, b: X.product_text(s(a), s(b), s("LUCES"), s("NAV"), s(None).cast("string"))
    r = one(spark, a=text("CAJA AZUL. 17", "Caja azul"), b=text("BOLA", "Bola de agua."), c=text(None, None), d=text("BOLA  DE AGUA ..", "Esfera"))
    assert r["a"] == "CAJA AZUL. 17. Categoria: LUCES. Grupo: NAV. Origen: ." and r["b"].startswith("Bola de agua. Categoria")
    assert r["c"].startswith(". Categoria") and r["d"].startswith("BOLA DE AGUA. Esfera.")
    r = one(spark, a=X.season_bonus(s("Velas LED y guirnalda"), s("LUCES"), s("Guirnalda led")), b=X.season_bonus(s("japandi"), s("X"), s("adorno")), c=X.season_words(s("¡Navidad!"), s(None).cast("string"), s("luces, luces")))
    assert r["a"] == 0.35 and r["b"] == 0.2 and r["c"] == ["navidad", "luces", "luces"]
    r = one(spark, a=X.strict_source(s(" ig ")), b=X.strict_source(s("radio x")), c=X.iso_time(s("2026-01-02T00:00:00+02:00")), d=X.iso_time(s("soon")), e=X.cast_or(s("x"), "double", 1.5), f=X.iso_time(s("2026-01-02 03:04:05")))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == ("INSTAGRAM", "RADIO_X", datetime.datetime(2026, 1, 1, 22), None, 1.5, datetime.datetime(2026, 1, 2, 3, 4, 5))
    r = one(spark, a=X.supplier_of_catalogue(s("Catalogo_Proveedor_1_NORTE_SUR.pdf")), b=X.supplier_of_catalogue(s("catalogo_del_sur_2026.pdf")), c=X.supplier_code(s("x_prov_asia_01.pdf")), d=X.supplier_code(s("x.pdf")))
    assert tuple(r["a"]) == ("SUP-01", "NORTE_SUR") and tuple(r["b"]) == ("del_sur", "del_sur") and (r["c"], r["d"]) == ("PROV_ASIA_01", "UNKNOWN")
    found = F.from_json(s('[{"sku":"a","score":0.9},{"sku":"b","score":0.9},{"sku":"a","score":0.1}]'), "array<struct<sku:string,score:double>>")
    r = one(spark, a=X.merged(found, F.array(s("b"), s("c"), s("c")), s(0.2), 3), b=X.best(found), c=X.union_in_order(F.array(s("b"), s("a")), F.array(s("a"), s("c"))), d=X.with_defaults(F.array(s("q"))), e=X.negotiation_letter(s("ACME"), s(2), s(10.0)))
    assert [x["sku"] for x in r["a"]] == ["a", "b", "c"] and r["b"]["sku"] == "a" and r["c"] == ["b", "a", "c"] and r["d"][0]["category"] == "DESCONOCIDA" and "ACME" in r["e"]


def test_missing_level(spark):
    c = spark.createDataFrame([(1, " A ", 1), (2, "B", 9), (3, None, None)], "c_custkey int, c_name string, c_nationkey int")
    n, r = spark.createDataFrame([(1, "N", 7)], "n_nationkey int, n_name string, n_regionkey int"), spark.createDataFrame([(8, "R")], "r_regionkey int, r_name string")
    assert sorted(card(c, n, r).collect()) == [(1, "A", "N", None), (2, "B", None, None), (3, None, None, None)]


def test_affine(spark):
    w = affine.error_weights(4, 0.5, 2.0)
    assert np.allclose(w[1], [2, 0, 0, 0]) and np.allclose(w[3], [2 * np.exp(-1), 2 * np.exp(-0.5), 2, 0])
    # The geometric sum is that of the decays of the periods that are left.
    got = one(spark, x=affine.sensitivity(F.lit(1.0), F.lit(0.5), F.lit(2.0), 8))["x"]
    assert got == pytest.approx(sum(np.exp(-0.15 * k) for k in range(5)) - 0.5)
    rows = spark.createDataFrame([(1, True, 30), (2, False, 30), (3, True, 90), (4, True, None)], "supplier int, active boolean, lead_max int")
    assert sorted(r[0] for r in affine.viable(rows, ["1"], 60).collect()) == [4]
    assert affine.solve(rows, "supplier", "supplier int", None, lambda df: df.limit(1)).count() == 1
    assert affine.solve(rows, "supplier", "supplier int", lambda p: p[["supplier"]], lambda df: df).count() == 4


def test_command(capsys):
    assert main(["nothing", "here"]) == 2 and main([]) == 2


def test_catalogue(spark):
    rows = catalogue(spark).collect()
    assert len(rows) == 18 and len({r["kind"] for r in rows}) == 7
    assert with_parameters("ewma_smoothing", alpha=0.3) == {"alpha": 0.3, "K": 1.0}
    for bad in (lambda: with_parameters("open_loop", z=1), lambda: with_parameters("none")):
        with pytest.raises((KeyError, ValueError)):
            bad()
