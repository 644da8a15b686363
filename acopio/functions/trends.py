"""Signals and candidates as columns: product texts, bonuses, names, casts, merged and defaulted lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import field, tokens

#: Words of the season, and names of sources.
SEASON_WORDS = (
    "navidad", "navideno", "navideño", "christmas", "xmas", "esfera", "esferas", "arbol", "arbolito", "arboles", "decoracion", "luces", "guirnalda", "guirnaldas", "santa", "noel", "muneco", "muñeco",
    "led", "wifi", "smart", "bluetooth", "inflable", "minimalista", "nordico", "rustico", "boho", "regalo", "envoltorio", "pesebre", "corona",
)
SOURCES = {"TIK_TOK": "TIKTOK", "META": "INSTAGRAM", "IG": "INSTAGRAM", "PIN": "PINTEREST", "GOOGLE": "GOOGLE_TRENDS", "TRENDS": "GOOGLE_TRENDS"}
#: What a description says, and what the category or the name of an article says, of a theme of the season.
LIGHTS = ("vela", "velas", "led", "termocrom", "luz", "lumin")
CERAMICS = ("cerámica", "ceramica", "japones", "japonesa", "japandi", "minimal")
GARLANDS = ("guirnalda", "flores secas", "cottagecore", "eucalipto", "lavanda")


def product_text(name: Column, short: Column, category: Column, group: Column, country: Column) -> Column:
    """The sentence that is embedded.  A short name inside the name is left out, and one around it stands for it; runs of blanks and dots become one."""
    a, b = field(name), field(short)
    inside = (a != "") & (b != "") & F.contains(F.upper(a), F.upper(b))
    around = (a != "") & (b != "") & ~inside & F.contains(F.upper(b), F.upper(a))
    first, second = F.when(around, b).otherwise(a), F.when(inside | around, "").otherwise(b)
    text = F.concat(first, F.lit(". "), second, F.lit(". Categoria: "), field(category), F.lit(". Grupo: "), field(group), F.lit(". Origen: "), field(country), F.lit("."))
    for old, new in ((r"\.[ .]*\.", "."), (" {2,}", " "), (r":\.", ":")):
        text = F.regexp_replace(text, old, new)
    return F.trim(text)


def _has(text: Column, *words: str) -> Column:
    return text.rlike("|".join(words))


def season_themes(category: Column, name: Column) -> Column:
    """The themes (bits 1, 2, 4) that an article belongs to."""
    c, n = F.upper(category), F.lower(name)
    of = (_has(c, "LUCES", "LUZ") | _has(n, "led", "luz", "lumin"), _has(c, "ORNAMENT") | _has(n, "adorno"), _has(c, "ARBOL") | _has(n, "guirn"))
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(of)), F.lit(0))


def season_bonus(description: Column, category: Column, name: Column) -> Column:
    """0.2 for each theme that a description and an article share, at most 0.35."""
    themes = season_themes(category, name)
    said = (_has(F.lower(description), *words) for words in (LIGHTS, CERAMICS, GARLANDS))
    return F.least(F.lit(0.35), sum((F.when(x & (themes.bitwiseAND(1 << k) > 0), 0.2).otherwise(0.0) for k, x in enumerate(said)), F.lit(0.0)))


def season_words(*fields: Column) -> Column:
    """The words of the season in a post's fields, in order, repeated ones too."""
    return F.filter(tokens(F.concat_ws(" ", *fields)), lambda x: x.isin(*SEASON_WORDS))


def strict_source(name: Column) -> Column:
    """Upper case, blanks as underscores, other names mapped; unknown ones stay."""
    known = F.create_map(*(F.lit(x) for kv in SOURCES.items() for x in kv))
    bare = F.replace(F.upper(F.trim(name)), F.lit(" "), F.lit("_"))
    return F.coalesce(F.element_at(known, bare), bare)


def iso_time(text: Column) -> Column:
    """ISO 8601 with Z, an offset or none (UTC), a blank or T; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), " ", "T"))


def cast_or(value: Column, kind: str, default: object) -> Column:
    """X28."""
    return F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))


def supplier_of_catalogue(file: Column) -> Column:
    """(id, name) from a file name: Catalogo_Proveedor_<n>_<name>, else without prefix and year."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    pattern = r"(?i)^catalogo_proveedor_(\d+)_(.+)$"
    other = F.regexp_replace(F.regexp_replace(stem, "(?i)^catalogo_?", ""), r"_\d{4}$", "")
    numbered = F.struct(F.format_string("SUP-%02d", F.coalesce(F.regexp_extract(stem, pattern, 1).try_cast("int"), F.lit(0))).alias("id"), F.trim(F.regexp_extract(stem, pattern, 2)).alias("name"))
    return F.when(stem.rlike(pattern), numbered).otherwise(F.struct(other.alias("id"), other.alias("name")))


def supplier_code(file: Column) -> Column:
    """X40."""
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(file), r"PROV_[A-Z]+_\d{2}", 0), F.lit("")), F.lit("UNKNOWN"))


def union_in_order(a: Column, b: Column) -> Column:
    """U9."""
    return F.array_distinct(F.concat(a, b))


def merged(found: Column, named: Column, score: Column, limit: int = 10) -> Column:
    """Found (array of (sku, score), best first), then the named ones not among them with a score of their own; the first limit."""
    have = F.transform(found, lambda x: x["sku"])
    once = F.filter(F.transform(found, lambda x, i: F.when(F.array_position(have, x["sku"]) == i + 1, F.struct(x["sku"].alias("sku"), x["score"].alias("score")))), lambda x: x.isNotNull())
    more = F.transform(F.array_except(named, have), lambda x: F.struct(x.alias("sku"), score.alias("score")))
    return F.slice(F.concat(once, more), 1, limit)


def best(found: Column) -> Column:
    """The element with the largest score, the first of equal ones; null if there is none."""
    top = F.array_max(F.transform(found, lambda y: y["score"]))
    return F.get(F.filter(found, lambda x: x["score"] == top), 0)


def with_defaults(skus: Column) -> Column:
    """Q21: bare keys as products that are not known."""
    return F.transform(skus, lambda x: F.struct(x.alias("sku"), F.lit(0.0).alias("score"), x.alias("name"), F.lit("DESCONOCIDA").alias("category"), F.lit(0.0).alias("price")))


def of_supplier(items: Column, supplier: Column) -> Column:
    """The items of a plan that one supplier delivers."""
    return F.filter(items, lambda i: i["supplier"] == supplier)


def season_curve(peak: Column, spread: Column) -> Column:
    """52 weekly factors with mean 1."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(52)), lambda w: F.greatest(F.lit(0.1), F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.sin(2 * F.pi() * (w - 47) / 52) + 1)) * peak * spread + (1 - spread)))
    # Held in a struct, so that the sum is not taken again for each week.
    held = F.struct(raw.alias("raw"), F.aggregate(raw, F.lit(0.0), lambda s, x: s + x).alias("total"))
    return F.get(F.transform(F.array(held), lambda h: F.transform(h["raw"], lambda x: x / h["total"] * 52)), 0)


def week_of_year(week: Column) -> Column:
    """1..52 from a week counted from 1."""
    return F.pmod(week - 1, F.lit(52)) + 1


def negotiation_letter(supplier: Column, n_items: Column, total: Column) -> Column:
    """The fixed letter that goes out when no language model writes one."""
    return F.format_string("Estimados %s: solicitamos mejores condiciones para %d productos por un total de %.2f.", supplier, n_items, total)
