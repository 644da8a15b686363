"""Queries over texts: chunks, keywords, numbers, posts, trends, validation, triples, audit."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import shapes
from ..plans.norms import evaluate
from ..registry import query
from ..sources.readers import table


@query("""SELECT doc_id, i::INT AS chunk, trim(substr(text, i * 700 + 1, 800), ' ') AS chunk_text FROM (SELECT doc_id, text, unnest(range((length(text) + 699) // 700)) AS i FROM documents WHERE length(text) > 800) WHERE trim(substr(text, i * 700 + 1, 800), ' ') <> ''
UNION ALL SELECT doc_id, 0, trim(text, ' ') FROM documents WHERE length(text) <= 800 AND trim(text, ' ') <> ''""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X35, K14, D8."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "chunk_text"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM documents) SELECT doc_id, count(*) AS n_chunks, sum(length(x)) AS n_chars FROM (SELECT doc_id, substr(t, i * 700 + 1, 800) AS x FROM (SELECT doc_id, t, unnest(range(greatest(length(t) - 101, 0) // 700 + 1)) AS i FROM c)) WHERE x <> '' GROUP BY 1""")
def collapsed_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X39, A15, A20."""
    clean = table(spark, sf_dir, "documents").select("doc_id", X.collapsed(F.col("text")).alias("clean"))
    parts = clean.select("doc_id", F.explode(X.collapsed_chunks(F.col("clean"))).alias("x"))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("x")).alias("n_chars"))


@query("""SELECT conv_id, turn, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda x: length(x) > 2))) AS n_tokens,
CASE WHEN regexp_matches(lower(text), 'presupuesto|escenario|que pasa si') THEN 'counterfactual' WHEN regexp_matches(lower(text), 'proveedor|negoci') THEN 'negotiation' WHEN regexp_matches(lower(text), 'por que|explica') THEN 'explanation' WHEN regexp_matches(lower(text), 'recom|comprar') THEN 'recommendation' ELSE 'other' END AS intent FROM conversations""")
def conversation_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14, X16, X33."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(X.token_set(F.col("text"))).cast("long").alias("n_tokens"), X.intent(F.col("text")).alias("intent"))


@query("""WITH e AS (SELECT event_type, user_id, ts, event_id, list_value('TIKTOK', 'INSTAGRAM', 'PINTEREST', 'OTHER')[user_id % 4 + 1] AS platform, round(value + 5 * (user_id % 3) + 3 * (event_id % 5) + 0.01::DOUBLE * (event_id % 1000), 4) AS engagement FROM events),
p AS (SELECT event_type, platform, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, platform) AS place FROM e GROUP BY 1, 2)
SELECT e.event_type, count(*) AS n, count(DISTINCT user_id) AS authors, round(avg(engagement), 4) AS mean_engagement, max_by(event_id, (engagement, ts, event_id)) AS top_event, any_value(p.platform) AS platform FROM e JOIN p ON p.event_type = e.event_type AND place = 1 GROUP BY 1""")
def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, authors, mean engagement, top post and modal platform of each cluster."""
    aliases = F.array(*(F.lit(x) for x in ("tik_tok", "META", "pin", "fax")))
    e = table(spark, sf_dir, "events").withColumn("platform", X.platform(F.get(aliases, (F.col("user_id") % 4).cast("int")))).withColumn("engagement", F.round(X.engagement(F.col("value"), F.col("user_id") % 3, F.col("event_id") % 5, F.col("event_id") % 1000), 4))
    by_platform = e.groupBy("event_type", "platform").agg(F.count(F.lit(1)).alias("m"))
    modal = by_platform.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("m"), "platform"))).where("place = 1").select("event_type", "platform")
    clusters = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("authors"), F.round(F.avg("engagement"), 4).alias("mean_engagement"), F.max_by("event_id", F.struct("engagement", "ts", "event_id")).alias("top_event"))
    return clusters.join(modal, "event_type")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 7 DAY AS t FROM events) SELECT event_id, event_type FROM events, m WHERE ts > t - INTERVAL 24 HOUR AND ts <= t""")
def events_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the window (t - 24 h, t] for the clock t = last event less seven days."""
    events = table(spark, sf_dir, "events")
    clock = events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("t"))
    return events.join(F.broadcast(clock), (F.col("ts") > F.col("t") - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= F.col("t"))).select("event_id", "event_type")


@query("""SELECT event_id, 'trend_' || left(sha256(event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%d')), 12) AS trend_id, CASE WHEN value <= 1 THEN greatest(0, value) WHEN value <= 100 THEN value / 100 WHEN value <= 10000 THEN value / 10000 ELSE value / 1000000 END AS confidence,
CASE WHEN event_type = 'click' THEN 'rejected_stopwords' WHEN value < 40 THEN 'manual_review' ELSE 'processed' END AS state FROM events""")
def trend_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9, X21, P21, ST5, ST10, A22: stable ids, normalised confidence and end state of each signal."""
    state = F.when(F.col("event_type") == "click", "rejected_stopwords").when(F.col("value") < 40, "manual_review").otherwise("processed")
    return table(spark, sf_dir, "events").select("event_id", X.trend_id(F.col("event_type"), F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trend_id"), X.confidence(F.col("value")).alias("confidence"), state.alias("state"))


@query("""SELECT 'part_size' AS shape, p_partkey::VARCHAR AS node, 'size out of range' AS message FROM part WHERE p_size NOT BETWEEN 2 AND 48
UNION ALL SELECT 'supplier_balance', s_suppkey::VARCHAR, 'negative balance' FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'line_key', l_orderkey || '-' || l_linenumber, 'key is not unique' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'order_customer', o_orderkey::VARCHAR, 'unknown customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11, Q18: each rule is a query for its violations."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, shape, node, message: df.select(F.lit(shape).alias("shape"), node.cast("string").alias("node"), F.lit(message).alias("message"))
    out = row(t("part").where("p_size not between 2 and 48"), "part_size", F.col("p_partkey"), "size out of range")
    out = out.unionByName(row(t("supplier").where("s_acctbal < 0"), "supplier_balance", F.col("s_suppkey"), "negative balance"))
    twice = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(row(twice, "line_key", F.concat_ws("-", "l_orderkey", "l_linenumber"), "key is not unique"))
    known = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return out.unionByName(row(t("orders").join(known, "o_custkey", "left_anti"), "order_customer", F.col("o_orderkey"), "unknown customer"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN value < 0 THEN 'value below 0' END, CASE WHEN value > 90 THEN 'value over 90' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown type' END, CASE WHEN user_id % 10 = 0 THEN 'blocked user' END], lambda x: x IS NOT NULL), '; ') AS messages FROM events""")
def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules each row breaks, as messages."""
    broken = F.array(F.when(F.col("value") < 0, "value below 0"), F.when(F.col("value") > 90, "value over 90"), F.when(~F.col("event_type").isin("click", "view", "purchase"), "unknown type"), F.when(F.col("user_id") % 10 == 0, "blocked user"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_compact(broken), "; ").alias("messages"))


_TRIPLES = """t AS (SELECT 'part/' || p_partkey AS s, unnest(['type', 'brand', 'category', 'size']) AS p, unnest(['Producto', p_brand, p_type, p_size::VARCHAR]) AS o FROM part)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as triples, one row for each property."""
    part = table(spark, sf_dir, "part")
    said = F.create_map(F.lit("type"), F.lit("Producto"), F.lit("brand"), "p_brand", F.lit("category"), "p_type", F.lit("size"), F.col("p_size").cast("string"))
    return part.select(F.concat(F.lit("part/"), "p_partkey").alias("s"), F.explode(said).alias("p", "o"))


def match(data: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """A basic graph pattern; terms that start with ? are variables, and repeated ones are join keys.

    Patterns are taken in an order in which each shares a variable with those
    before it; one that shares none has no such order and is an error, as it
    would multiply all rows.
    """
    variables = [{t for t in p if t.startswith("?")} for p in patterns]
    order, seen, rest = [], set(), list(range(len(patterns)))
    while rest:
        k = next((k for k in rest if not order or variables[k] & seen), None)
        if k is None:
            raise ValueError(f"the patterns are not connected: {[patterns[k] for k in rest]}")
        order.append(k)
        rest.remove(k)
        seen |= variables[k]
    out = None
    for pattern in (patterns[k] for k in order):
        part, names = data, {}
        for column, term in zip("spo", pattern, strict=True):
            if term.startswith("?"):
                part = part.where(F.col(column) == F.col(names[term[1:]])) if term[1:] in names else part
                names.setdefault(term[1:], column)
            else:
                part = part.where(F.col(column) == term)
        part = part.select(*(F.col(c).alias(n) for n, c in names.items()))
        out = part if out is None else out.join(part, [n for n in names if n in out.columns])
    return out.distinct()


def ask(data: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """One row that says whether the pattern occurs, and how often."""
    return match(data, patterns).agg((F.count(F.lit(1)) > 0).alias("holds"), F.count(F.lit(1)).alias("n"))


def disjoint_members(data: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(node, a, b) for the nodes that are members of two classes that exclude each other."""
    types = data.where("p = 'type'").groupBy("s").agg(F.collect_set("o").alias("classes"))
    both = F.filter(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)), lambda x: F.array_contains(F.col("classes"), x["a"]) & F.array_contains(F.col("classes"), x["b"]))
    return types.select(F.col("s").alias("node"), F.explode(both).alias("x")).select("node", "x.a", "x.b")


def run_named(spark: SparkSession, views: dict[str, DataFrame], text: str, args: dict) -> DataFrame:
    """A query text with :name parameters; one that is missing is an error."""
    missing = sorted(set(re.findall(r"(?<![:\w]):([a-zA-Z_]\w*)", text)) - set(args))
    if missing:
        raise ValueError(f"missing parameters: {missing}")
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return spark.sql(text, args=args)


@query(f"WITH {_TRIPLES} SELECT s, p, o FROM t")
def part_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2, K6."""
    return triples(spark, sf_dir)


@query(f"WITH {_TRIPLES} SELECT DISTINCT a.s AS x, a.o AS b, c.o AS z FROM t a JOIN t b ON a.s = b.s JOIN t c ON a.s = c.s WHERE a.p = 'brand' AND b.p = 'category' AND b.o = 'PROMO' AND c.p = 'size'")
def graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """?x brand ?b . ?x category PROMO . ?x size ?z"""
    return match(triples(spark, sf_dir), [("?x", "brand", "?b"), ("?x", "category", "PROMO"), ("?x", "size", "?z")])


@query("""WITH f AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_type = 'PROMO' END AS perishable, CASE WHEN p_size % 7 <> 0 THEN p_size > 25 END AS fast, CASE WHEN p_size % 3 <> 0 THEN p_size > 10 END AS history FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN fast THEN 'AltaRotacion' END, CASE WHEN NOT history THEN 'ColdStart' END, CASE WHEN perishable OR fast THEN 'Critico' END, CASE WHEN perishable THEN 'Perecedero' END], lambda x: x IS NOT NULL), ',') AS classes FROM f""")
def derived_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class membership in an open world; a null flag belongs nowhere."""
    size = F.col("p_size")
    flags = table(spark, sf_dir, "part").select("p_partkey", F.when(size % 5 != 0, F.col("p_type") == "PROMO").alias("perishable"), F.when(size % 7 != 0, size > 25).alias("fast"), F.when(size % 3 != 0, size > 10).alias("history"))
    held = F.array(F.when(F.col("fast"), "AltaRotacion"), F.when(~F.col("history"), "ColdStart"), F.when(F.col("perishable") | F.col("fast"), "Critico"), F.when(F.col("perishable"), "Perecedero"))
    return flags.select("p_partkey", F.array_join(F.array_compact(held), ",").alias("classes"))


@query("""SELECT o_orderkey AS decision, o_orderpriority AS agent, o_orderdate AS at FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-01' AND o_orderpriority = '1-URGENT'""")
def agent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named query with parameters."""
    text = "SELECT o_orderkey AS decision, o_orderpriority AS agent, o_orderdate AS at FROM decision_log WHERE o_orderdate BETWEEN :since AND :until AND o_orderpriority = :agent"
    return run_named(spark, {"decision_log": table(spark, sf_dir, "orders")}, text, {"since": datetime.datetime(1996, 1, 1), "until": datetime.datetime(1996, 3, 1), "agent": "1-URGENT"})


@query("""SELECT 'supplier' AS shape, s_suppkey::VARCHAR AS node, 'country is not two capitals' AS message FROM supplier WHERE NOT regexp_full_match(CASE WHEN s_nationkey % 5 = 0 THEN 'Py' WHEN s_nationkey % 7 = 0 THEN 'PRY' ELSE 'PY' END, '[A-Z]{2}')
UNION ALL SELECT 'norm', p_partkey::VARCHAR, 'priority is not in 0..100' FROM part WHERE p_size * 3 - 10 NOT BETWEEN 0 AND 100 UNION ALL SELECT 'norm', p_partkey::VARCHAR, 'valid from is after valid to' FROM part WHERE DATE '2026-01-01' + p_size > DATE '2026-02-10'
UNION ALL SELECT 'norm', p_partkey::VARCHAR, 'no modality' FROM part WHERE p_type NOT IN ('PROMO', 'SMALL', 'LARGE') UNION ALL SELECT 'decision', o_orderkey::VARCHAR, 'no time' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'decision', o_orderkey::VARCHAR, 'no algorithm' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'decision', o_orderkey::VARCHAR, 'reasoning under ten characters' FROM orders WHERE length(o_orderpriority) < 10""")
def record_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3-Q5: suppliers, norms and decisions that break their shapes.  Countries, limits and reasons are stand-ins made of the tables' columns."""
    t = lambda n: table(spark, sf_dir, n)
    country = F.when(F.col("s_nationkey") % 5 == 0, "Py").when(F.col("s_nationkey") % 7 == 0, "PRY").otherwise("PY")
    suppliers = shapes.violations(t("supplier").select(F.col("s_suppkey").alias("id"), country.alias("country")), "supplier", "id", shapes.SUPPLIER)
    start = F.to_date(F.lit("2026-01-01"))
    norms = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 3 - 10).alias("priority"), F.date_add(start, F.col("p_size")).alias("valid_from"), F.to_date(F.lit("2026-02-10")).alias("valid_to"), F.when(F.col("p_type") == "PROMO", "Obligation").when(F.col("p_type") == "SMALL", "Permission").when(F.col("p_type") == "LARGE", "Prohibition").alias("modality"))
    called = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("algorithm", F.lit("open_loop"))
    decisions = t("orders").join(called, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("at"), "algorithm", F.col("o_orderpriority").alias("reasoning"))
    return suppliers.unionByName(shapes.violations(norms, "norm", "id", shapes.NORM)).unionByName(shapes.violations(decisions, "decision", "id", shapes.DECISION))


@query("""WITH d AS (SELECT l_orderkey AS decision, l_partkey AS part, l_suppkey AS supplier, s_acctbal >= 0 AS active FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT decision, part, supplier, 'F_compra_a_proveedor_desactivado' AS norm FROM d WHERE NOT active GROUP BY 1, 2, 3""")
def blocked_by_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions that one norm blocks, asked by its id."""
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    d = d.select(F.col("l_orderkey").alias("decision"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.lit("compra").alias("tipo"), F.to_timestamp(F.lit("2026-12-01 00:00:00")).alias("now"), (F.col("s_acctbal") >= 0).alias("proveedor_activo")).distinct()
    log = evaluate(d)
    asked = run_named(spark, {"norm_log": log}, "SELECT decision, part, supplier, :norm AS norm FROM norm_log WHERE array_contains(blocked_by, :norm)", {"norm": "F_compra_a_proveedor_desactivado"})
    return asked


@query("""SELECT 'decision/17' AS decision, p, o FROM (SELECT 'agent' AS p, o_orderpriority AS o FROM orders WHERE o_orderkey = 17 UNION ALL SELECT 'at', strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderkey = 17 UNION ALL SELECT DISTINCT 'used', 'part/' || l_partkey FROM lineitem WHERE l_orderkey = 17 UNION ALL SELECT DISTINCT 'wasInformedBy', 'supplier/' || l_suppkey FROM lineitem WHERE l_orderkey = 17)""")
def decision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property and value of everything that one decision's provenance says."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    say = lambda d, key, p, value: d.select(F.concat(F.lit("decision/"), key).alias("s"), F.lit(p).alias("p"), value.alias("o"))
    log = say(o, F.col("o_orderkey"), "agent", F.col("o_orderpriority")).unionByName(say(o, F.col("o_orderkey"), "at", F.date_format("o_orderdate", "yyyy-MM-dd")))
    log = log.unionByName(say(i, F.col("l_orderkey"), "used", F.concat(F.lit("part/"), "l_partkey")).distinct()).unionByName(say(i, F.col("l_orderkey"), "wasInformedBy", F.concat(F.lit("supplier/"), "l_suppkey")).distinct())
    return run_named(spark, {"provenance_log": log}, "SELECT s AS decision, p, o FROM provenance_log WHERE s = :decision", {"decision": "decision/17"})


@query("""WITH t AS (SELECT 'part/' || p_partkey AS s, 'Local' AS o FROM part WHERE p_size % 4 = 0 UNION ALL SELECT 'part/' || p_partkey, 'Exterior' FROM part WHERE p_size % 6 = 0) SELECT a.s AS node, 'Local' AS a, 'Exterior' AS b FROM t a JOIN t b ON a.s = b.s WHERE a.o = 'Local' AND b.o = 'Exterior'""")
def inconsistent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in two classes that exclude each other."""
    part = table(spark, sf_dir, "part")
    kind = F.array_compact(F.array(F.when(F.col("p_size") % 4 == 0, "Local"), F.when(F.col("p_size") % 6 == 0, "Exterior"), F.lit("Producto")))
    data = part.select(F.concat(F.lit("part/"), "p_partkey").alias("s"), F.lit("type").alias("p"), F.explode(kind).alias("o"))
    return disjoint_members(data, [("Producto", "Proveedor"), ("Decision", "Algorithm"), ("Local", "Exterior")])
