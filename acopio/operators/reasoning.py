"""What follows from facts and axioms: closures, inferred facts, class counts, contradictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import inference
from ..plans.vocabulary import DERIVED, VOCABULARY
from ..registry import query
from ..sources.readers import table


def _fact(df: DataFrame, s, p: str, o) -> DataFrame:
    return df.select(s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))


def _node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


@query("""WITH RECURSIVE e AS (SELECT 'part/' || p_partkey AS a, 'part/' || p_partkey // 2 AS b FROM part WHERE p_partkey > 1 UNION SELECT 'supplier/' || s_suppkey, 'supplier/' || CASE WHEN s_suppkey % 7 = 6 THEN s_suppkey - 6 ELSE s_suppkey + 1 END FROM supplier UNION SELECT 'part/' || min(p_partkey), 'world' FROM part),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
SELECT a AS member, b AS ancestor, a = b OR b IN (SELECT a FROM c WHERE a = b) AS in_cycle FROM c""")
def membership_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of any depth, with the ancestors that lie on a cycle.

    Parts are a binary tree of some log2(n) levels; suppliers are rings of seven.
    """
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    edge = lambda df, a, b: df.select(a.alias("member"), b.alias("ancestor"))
    tree = edge(part.where("p_partkey > 1"), _node("part", "p_partkey"), F.concat(F.lit("part/"), F.expr("p_partkey div 2").cast("string")))
    rings = edge(supplier, _node("supplier", "s_suppkey"), F.concat(F.lit("supplier/"), F.when(k % 7 == 6, k - 6).otherwise(k + 1).cast("string")))
    root = edge(part.agg(F.min("p_partkey").alias("p_partkey")), _node("part", "p_partkey"), F.lit("world"))
    known = inference.closure(tree.unionByName(rings).unionByName(root))
    cycles = known.where("member = ancestor").select("ancestor").withColumn("in_cycle", F.lit(True))
    return known.join(cycles, "ancestor", "left").select("member", "ancestor", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


_FACTS = """main AS (SELECT 'part/' || l_partkey AS s, 'supplier/' || min(l_suppkey) AS o FROM lineitem GROUP BY l_partkey),
given AS (SELECT 'part/' || p_partkey AS s, 'perecedero' AS p, (p_type = 'PROMO')::VARCHAR AS o FROM part WHERE p_size % 5 <> 0 UNION SELECT 'part/' || p_partkey, 'altaRotacion', (p_size > 25)::VARCHAR FROM part WHERE p_size % 7 <> 0 UNION SELECT 'part/' || p_partkey, 'tieneHistorial', (p_size > 10)::VARCHAR FROM part WHERE p_size % 3 <> 0
UNION SELECT 'supplier/' || s_suppkey, 'esExterior', (s_nationkey % 2 = 0)::VARCHAR FROM supplier UNION SELECT 'supplier/' || s_suppkey, 'type', 'ProveedorLocal' FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT s, 'proveedorPrincipal', o FROM main UNION SELECT 'part/' || p_partkey, 'similarA', 'part/' || (p_partkey + 1) FROM part WHERE p_partkey % 10 = 0
UNION SELECT 'part/' || p_partkey, 'perteneceA', 'categoria/' || p_type FROM part UNION SELECT 'categoria/' || p_type, 'perteneceA', 'grupo/' || left(p_type, 1) FROM part UNION SELECT 'grupo/' || left(p_type, 1), 'perteneceA', 'seccion/1' FROM part),
up AS (SELECT s, o FROM given WHERE p = 'perteneceA' UNION SELECT up.s, g.o FROM up JOIN given g ON g.s = up.o AND g.p = 'perteneceA'),
edges AS (SELECT s, p, o FROM given UNION SELECT s, 'perteneceA', o FROM up UNION SELECT s, 'suministradoPor', o FROM main UNION SELECT o, 'suministra', s FROM main UNION SELECT o, 'similarA', s FROM given WHERE p = 'similarA' UNION SELECT s, 'esExterior', 'false' FROM given WHERE p = 'type'),
named AS (SELECT s, 'Producto' AS o FROM edges WHERE p IN ('perecedero', 'altaRotacion', 'tieneHistorial', 'suministradoPor', 'similarA') UNION SELECT s, 'Proveedor' FROM edges WHERE p IN ('esExterior', 'suministra') UNION SELECT s, 'ProductoPerecedero' FROM edges WHERE p = 'perecedero' AND o = 'true' UNION SELECT s, 'ProductoAltaRotacion' FROM edges WHERE p = 'altaRotacion' AND o = 'true'
UNION SELECT s, 'ProductoCritico' FROM edges WHERE p IN ('perecedero', 'altaRotacion') AND o = 'true' UNION SELECT s, 'ProductoColdStart' FROM edges WHERE p = 'tieneHistorial' AND o = 'false' UNION SELECT s, CASE o WHEN 'true' THEN 'ProveedorExterior' ELSE 'ProveedorLocal' END FROM edges WHERE p = 'esExterior'),
world AS (SELECT s, p, o FROM edges UNION SELECT s, 'type', o FROM named)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of parts and suppliers (a null flag is no fact), main suppliers, likeness and membership as (s, p, o)."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    size, type_ = F.col("p_size"), F.col("p_type")
    p = _node("part", "p_partkey")
    main = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    said = (
        _fact(part.where(size % 5 != 0), p, "perecedero", type_ == "PROMO"), _fact(part.where(size % 7 != 0), p, "altaRotacion", size > 25), _fact(part.where(size % 3 != 0), p, "tieneHistorial", size > 10),
        _fact(supplier, _node("supplier", "s_suppkey"), "esExterior", F.col("s_nationkey") % 2 == 0), _fact(supplier.where("s_suppkey % 10 = 0"), _node("supplier", "s_suppkey"), "type", F.lit("ProveedorLocal")),
        _fact(main, _node("part", "l_partkey"), "proveedorPrincipal", _node("supplier", "l_suppkey")), _fact(part.where("p_partkey % 10 = 0"), p, "similarA", F.concat(F.lit("part/"), (F.col("p_partkey") + 1).cast("string"))),
        _fact(part, p, "perteneceA", F.concat(F.lit("categoria/"), type_)), _fact(part, F.concat(F.lit("categoria/"), type_), "perteneceA", F.concat(F.lit("grupo/"), F.substring(type_, 1, 1))).distinct(),
        _fact(part, F.concat(F.lit("grupo/"), F.substring(type_, 1, 1)), "perteneceA", F.lit("seccion/1")).distinct(),
    )
    return reduce(DataFrame.unionByName, said)


@query(f"WITH RECURSIVE {_FACTS} SELECT s, p, o FROM world EXCEPT SELECT s, p, o FROM given")
def inferred_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that follows from the facts by the vocabulary's axioms, chained to a fixpoint."""
    given = facts(spark, sf_dir)
    return inference.infer(given, inference.axioms(VOCABULARY))[0].join(given, ["s", "p", "o"], "left_anti")


@query(f"WITH RECURSIVE {_FACTS} SELECT c AS class, count(s) AS n, coalesce(array_to_string(list(s ORDER BY s)[:5], ','), '') AS samples FROM (SELECT unnest([{', '.join(repr(c) for c in DERIVED)}]) AS c) LEFT JOIN world ON p = 'type' AND o = c GROUP BY 1")
def inference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each derived class, and the first five of them."""
    world, _ = inference.infer(facts(spark, sf_dir), inference.axioms(VOCABULARY))
    return inference.census(world, list(DERIVED)).select("class", "n", F.array_join("samples", ",").alias("samples"))


@query(f"WITH RECURSIVE {_FACTS} SELECT s AS node, 'ProveedorExterior' AS a, 'ProveedorLocal' AS b FROM world WHERE p = 'type' AND o IN ('ProveedorExterior', 'ProveedorLocal') GROUP BY 1 HAVING count(DISTINCT o) = 2")
def inferred_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that the axioms put into two classes that exclude each other (local suppliers that are abroad)."""
    given = inference.axioms(VOCABULARY)
    return inference.clashes(inference.infer(facts(spark, sf_dir), given)[0], given)
