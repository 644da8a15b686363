"""Texts against a catalogue: TF-IDF, embeddings and plain overlap, with bonuses, thresholds and filters.

Searches: every conversation whose id is divisible by 50 asks, against the
whole catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.trends import season_bonus, season_themes
from ..registry import query
from ..sources.readers import table
from .similarity import top_k_edges

MAX_FEATURES, LEAST_LENGTH = 8192, 10


def grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): words of two characters or more, and pairs of them."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    none = F.array().cast("array<string>")
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(none)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(words, none).alias("w"))
    return rows.select("id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(terms: DataFrame, n: int, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, idf) of the max_features most frequent terms of n texts; idf = ln((1 + n) / (1 + df)) + 1."""
    counts = terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("tf"), "term").limit(max_features)
    return counts.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, term, weight): unit vectors; what is not in the vocabulary (at most MAX_FEATURES rows) counts nothing."""
    raw = terms.join(F.broadcast(vocabulary), "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("weight"))


def cosines(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(q, id, cosine) of the texts asked (id, text) and the items (id, text) that share a term; the index is of the items."""
    terms = grams(items, "id", "text")
    known = vocabulary(terms, items.count())
    a, b = (weighted(t, known) for t in (grams(asked, "id", "text"), terms))
    return a.select(F.col("id").alias("q"), "term", F.col("weight").alias("x")).join(b, "term").groupBy("q", "id").agg(F.sum(F.col("x") * F.col("weight")).alias("cosine"))


def first_items(items: DataFrame, k: int, *groups: str) -> DataFrame:
    """The k first items of each group: what fills a list where nothing is shared.  Groups are few."""
    w = Window.partitionBy(*groups).orderBy("id") if groups else None
    if w is None:
        return items.orderBy("id").limit(k)
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best (q, id, score), the smaller id first on ties."""
    rounded = scores.withColumn("score", F.round("score", 6))
    return rounded.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k)


def asked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user' and conv_id % 50 = 0")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", F.col("conv_id"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, name, category, supplier of the benchmark texts, as articles of a catalogue."""
    category = F.get(F.array(*(F.lit(c) for c in ("LUCES", "ORNAMENTOS", "ARBOLES", "OTROS"))), (F.col("item_id") % 4).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.split(F.lower(F.coalesce("text", F.lit(""))), " ")[0].alias("name"), category.alias("category"), (F.col("item_id") % 3).alias("supplier"))


def trend_scores(trends: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """(q, id, score) by TF-IDF cosine, 0.04 for each shared word (0.3 at most) and the bonus of the season, at most 1.

    All pairs that share a word, and of every combination of themes the k
    first items, which may have a bonus without a shared word: no other item
    can be among the k best.
    """
    words = lambda d, name: d.select(F.col("id").alias(name), F.explode(X.token_set(F.col("text"))).alias("word"))
    shared = words(trends, "q").join(words(items, "id"), "word").groupBy("q", "id").agg(F.count(F.lit(1)).alias("shared"))
    themed = items.withColumn("themes", season_themes(F.col("category"), F.col("name")))
    few = [r["id"] for r in first_items(themed, k, "themes").select("id").collect()]  # at most 8 k items
    filled = trends.select(F.col("id").alias("q"), F.explode(F.array(*(F.lit(x) for x in few)) if few else F.array().cast("array<bigint>")).alias("id"))
    pairs = cosines(trends, items).withColumn("shared", F.lit(0)).unionByName(shared.withColumn("cosine", F.lit(0.0))).unionByName(filled.withColumn("cosine", F.lit(0.0)).withColumn("shared", F.lit(0)))
    pairs = pairs.groupBy("q", "id").agg(F.sum("cosine").alias("cosine"), F.sum("shared").alias("shared"))
    said = pairs.join(trends.select(F.col("id").alias("q"), F.col("text").alias("said")), "q").join(items.select("id", "name", "category"), "id")
    bonus = F.least(F.lit(0.3), 0.04 * F.col("shared")) + season_bonus(F.col("said"), F.col("category"), F.col("name"))
    return said.select("q", "id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cosine") + bonus)).alias("score"))


def validated(trends: DataFrame, scores: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """Each trend with its k best matches, their mean, and whether the best reaches the threshold; short descriptions are turned down."""
    best = ranked(scores, k).groupBy("q").agg(F.max("score").alias("best"), F.avg("score").alias("mean"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",").alias("skus"))
    short = F.length(F.trim("text")) < LEAST_LENGTH
    rows = trends.select(F.col("id").alias("q"), "text").join(best, "q", "left").withColumn("short", F.coalesce(short, F.lit(True)))
    ok = ~F.col("short") & (F.coalesce("best", F.lit(0.0)) >= threshold)
    reason = F.when(F.col("short"), "short").when(F.col("best").isNull(), "no_candidates").when(~ok, "below_threshold").otherwise("")
    none = lambda c, other: F.when(F.col("short"), other).otherwise(c)
    return rows.select("q", none(F.round(F.coalesce("best", F.lit(0.0)), 4), 0.0).alias("best"), none(F.round(F.coalesce("mean", F.lit(0.0)), 4), 0.0).alias("mean"), none(F.coalesce("skus", F.lit("")), "").alias("skus"), ok.alias("approved"), reason.alias("reason"))


_ASKED = "a AS (SELECT conv_id || ':' || turn AS q, text, conv_id FROM conversations WHERE role = 'user' AND conv_id % 50 = 0)"
_ITEMS = "i AS (SELECT item_id AS id, coalesce(text, '') AS text, string_split(lower(coalesce(text, '')), ' ')[1] AS name, list_value('LUCES', 'ORNAMENTOS', 'ARBOLES', 'OTROS')[item_id % 4 + 1] AS category, item_id % 3 AS supplier FROM benchmark)"


def _grams_sql(name: str, source: str, key: str) -> str:
    return f"""{name}_w AS (SELECT {key} AS k, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {source}), {name}_t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda j: w[j] || ' ' || w[j + 1]))) AS term FROM {name}_w) GROUP BY 1, 2)"""


_VECTORS = f"""{_grams_sql('d', 'i', 'id')}, {_grams_sql('u', 'a', 'q')}, voc AS (SELECT term, ln((1 + (SELECT count(*) FROM i)) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf) AS tf, count(*) AS df FROM d_t GROUP BY 1 ORDER BY tf DESC, term LIMIT {MAX_FEATURES})),
dv AS (SELECT k, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS x FROM d_t JOIN voc USING (term)), uv AS (SELECT k, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS x FROM u_t JOIN voc USING (term)),
cos AS (SELECT uv.k AS q, dv.k AS id, sum(uv.x * dv.x) AS cosine FROM uv JOIN dv USING (term) GROUP BY 1, 2)"""
_SET = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: length(x) > 2))"
_BONUS = """least(0.35::DOUBLE, CASE WHEN regexp_matches(lower(a.text), 'vela|velas|led|termocrom|luz|lumin') AND (category LIKE '%LUCES%' OR category LIKE '%LUZ%' OR regexp_matches(name, 'led|luz|lumin')) THEN 0.2::DOUBLE ELSE 0 END
+ CASE WHEN regexp_matches(lower(a.text), 'cerámica|ceramica|japones|japonesa|japandi|minimal') AND (category LIKE '%ORNAMENT%' OR name LIKE '%adorno%') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(a.text), 'guirnalda|flores secas|cottagecore|eucalipto|lavanda') AND (category LIKE '%ARBOL%' OR name LIKE '%guirn%') THEN 0.2::DOUBLE ELSE 0 END)"""
_VERDICT = """CASE WHEN short THEN 0.0::DOUBLE ELSE round(coalesce(best, 0), 4) END AS best, CASE WHEN short THEN 0.0::DOUBLE ELSE round(coalesce(mean, 0), 4) END AS mean, CASE WHEN short THEN '' ELSE coalesce(skus, '') END AS skus, NOT short AND coalesce(best, 0) >= {0} AS approved,
CASE WHEN short THEN 'short' WHEN best IS NULL THEN 'no_candidates' WHEN best < {0} THEN 'below_threshold' ELSE '' END AS reason"""


@query(f"""WITH {_ASKED}, {_ITEMS}, {_VECTORS}, p AS (SELECT a.q, i.id, round(least(1, greatest(0, coalesce(cosine, 0) + least(0.3::DOUBLE, 0.04::DOUBLE * len(list_intersect({_SET.format('a.text')}, {_SET.format('i.text')}))) + {_BONUS})), 6) AS score FROM a CROSS JOIN i LEFT JOIN cos ON cos.q = a.q AND cos.id = i.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM p QUALIFY place <= 5), g AS (SELECT q, max(score) AS best, avg(score) AS mean, string_agg(id::VARCHAR, ',' ORDER BY place) AS skus FROM r GROUP BY 1)
SELECT a.q, {_VERDICT.format(0.22)} FROM (SELECT *, coalesce(length(trim(text, ' ')) < {LEAST_LENGTH}, true) AS short FROM a) a LEFT JOIN g ON g.q = a.q""")
def trend_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends approved or turned down, with the five articles they match."""
    trends, items = asked_turns(spark, sf_dir), catalogue(spark, sf_dir)
    return validated(trends, trend_scores(trends, items), 0.22)


@query(f"""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, round(least(1, greatest(0, least(1, greatest(0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) + 0.2::DOUBLE * (a.label = b.label)::INT)), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT q, id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM p QUALIFY place <= 5) SELECT q, round(max(score), 4) AS best, round(avg(score), 4) AS mean, string_agg(id::VARCHAR, ',' ORDER BY place) AS skus, max(score) >= 0.85 AS approved FROM r GROUP BY 1""")
def embedding_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cosine of embeddings and a bonus for an equal theme (label), approved from 0.85 on."""
    vectors = table(spark, sf_dir, "embeddings")
    found = top_k_edges(vectors, "vec_id", "embedding", "label", k=5, wanted=vectors.where("vec_id % 50 = 0"), bonus=0.2).select(F.col("id").alias("q"), F.col("other").alias("id"), F.round("score", 6).alias("score"), "place")
    skus = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",")
    return found.groupBy("q").agg(F.round(F.max("score"), 4).alias("best"), F.round(F.avg("score"), 4).alias("mean"), skus.alias("skus"), (F.max("score") >= 0.85).alias("approved"))


@query(f"""WITH {_ASKED}, {_ITEMS}, s AS (SELECT a.q, i.id, len(list_intersect(x, y)) / greatest(len(x), len(y)) AS score FROM (SELECT q, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: length(t) > 2)) AS x FROM a) a
CROSS JOIN (SELECT id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: length(t) > 2)) AS y FROM i) i WHERE len(x) > 0 AND len(y) > 0)
SELECT q, id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, id) AS place FROM s QUALIFY place <= 10""")
def lexical_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten articles with the most words in common, over the larger set; in catalogue order where nothing is shared."""
    def words(d: DataFrame) -> DataFrame:
        clean = F.regexp_replace(F.lower("text"), r"[!-/:-@\[-`{-~]", " ")
        return d.select("id", F.array_distinct(F.filter(F.split(clean, r"[ \t\n\x0B\f\r]+"), lambda t: F.length(t) > 2)).alias("w")).where("size(w) > 0")

    a, b = words(asked_turns(spark, sf_dir)), words(catalogue(spark, sf_dir))
    one = lambda d, name: d.select(F.col("id").alias(name), F.size("w").alias(f"n_{name}"), F.explode("w").alias("word"))
    shared = one(a, "q").join(one(b, "id"), "word").groupBy("q", "id").agg((F.count(F.lit(1)) / F.greatest(F.max("n_q"), F.max("n_id"))).alias("score"))
    few = [r["id"] for r in first_items(b, 10).select("id").collect()]  # at most ten
    filled = a.select(F.col("id").alias("q"), F.explode(F.array(*(F.lit(x) for x in few)) if few else F.array().cast("array<bigint>")).alias("id"), F.lit(0.0).alias("score"))
    return ranked(shared.unionByName(filled).groupBy("q", "id").agg(F.max("score").alias("score")), 10)


@query(f"""WITH {_ASKED}, {_ITEMS}, {_VECTORS}, p AS (SELECT a.q, i.id, round(coalesce(cosine, 0), 6) AS score FROM a JOIN i ON i.supplier = a.conv_id % 3 LEFT JOIN cos ON cos.q = a.q AND cos.id = i.id)
SELECT q, id, round(score, 4) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS place FROM p QUALIFY place <= 5""")
def nearest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five texts of one supplier nearest to a question, filtered before they are ranked."""
    asked, items = asked_turns(spark, sf_dir).withColumn("supplier", F.col("conv_id") % 3), catalogue(spark, sf_dir)
    near = cosines(asked, items).join(asked.select(F.col("id").alias("q"), "supplier"), "q").join(items.select("id", "supplier"), ["id", "supplier"])
    few = first_items(items, 5, "supplier").groupBy("supplier").agg(F.collect_list("id").alias("ids"))
    filled = asked.join(few, "supplier").select(F.col("id").alias("q"), F.explode("ids").alias("id"), F.lit(0.0).alias("cosine"))
    scores = near.select("q", "id", "cosine").unionByName(filled).groupBy("q", "id").agg(F.max("cosine").alias("score"))
    return ranked(scores, 5).select("q", "id", F.round("score", 4).alias("score"), "place")


@query("""WITH w AS (SELECT conv_id, turn, text, list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\\[-`{-~¡¿]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS t FROM conversations)
SELECT conv_id, turn, len(list_filter(t, lambda x: length(x) >= 2 AND NOT list_contains(list_value({0}), x)))::INT AS n_useful, len(list_filter(t, lambda x: length(x) >= 2 AND NOT list_contains(list_value({0}), x))) < 2 AS rejected,
array_to_string(list_slice(list_filter(k, lambda x, j: list_position(k, x) = j), 1, 10), ' ') AS keywords FROM (SELECT *, list_filter(list_transform(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: length(x) > 3), lambda x: trim(x, ',.!?;:#')), lambda x: x <> '' AND NOT list_contains(list_value({1}), x)) AS k FROM w)""".replace("{0}", ", ".join(f"'{w}'" for w in X.STOP_WORDS)).replace("{1}", ", ".join(f"'{w}'" for w in X.KEYWORD_STOP_WORDS)))
def turn_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of each turn, its useful words, and whether too few are left."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", F.size(X.useful(X.tokens(text))).alias("n_useful"), X.empty_description(text).alias("rejected"), F.array_join(X.keywords(text), " ").alias("keywords"))
