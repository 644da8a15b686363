"""Text functions as columns: tokens, keywords, chunks, numbers, identifiers, normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCTUATION = r"""[!-/:-@\[-`{-~¡¿]"""
#: Words that say nothing in a description (Spanish, English, the season), and in a list of keywords.
STOP_WORDS = (
    "el", "la", "los", "las", "un", "una", "unos", "unas",
    "de", "del", "al", "a", "en", "y", "o", "u", "que", "es", "son",
    "con", "por", "para", "pero", "sin", "sobre", "tras", "ante",
    "se", "su", "sus", "le", "les", "lo", "yo", "tu", "ella",
    "esta", "este", "estas", "estos", "ese", "esa", "esos", "esas",
    "aquel", "aquella", "aquellos", "aquellas",
    "muy", "mas", "menos", "mucho", "poco",
    "the", "an", "of", "in", "on", "at", "to", "for", "by",
    "with", "from", "and", "or", "but", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "this", "that", "these", "those",
    "navidad", "navideno", "navidena", "navidenos", "navidenas",
    "christmas", "xmas", "noel", "santa",
)
KEYWORD_STOP_WORDS = (
    "el", "la", "de", "y", "a", "en", "que", "es", "con", "por", "para",
    "un", "una", "los", "las", "del", "al", "se", "su", "sus", "esta",
    "estos", "estas", "este", "ese", "esa", "esos", "esas",
)
PLATFORMS = {"TIKTOK": "TIKTOK", "TIK_TOK": "TIKTOK", "INSTAGRAM": "INSTAGRAM", "IG": "INSTAGRAM", "META": "INSTAGRAM", "PINTEREST": "PINTEREST", "PIN": "PINTEREST", "GOOGLE": "GOOGLE_TRENDS", "GOOGLE_TRENDS": "GOOGLE_TRENDS"}


def tokens(text: Column) -> Column:
    """X11: lower-cased, ASCII punctuation and inverted marks as blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), _PUNCTUATION, " "), r"\s+"), lambda x: x != "")


def useful(words: Column) -> Column:
    """Tokens of two characters or more that are not stop words."""
    return F.filter(words, lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS))


def empty_description(text: Column, least: int = 2) -> Column:
    """X13."""
    return F.size(useful(tokens(text))) < least


def keywords(text: Column, limit: int = 10) -> Column:
    """The first distinct words of over three characters (before , . ! ? ; : # are stripped)."""
    long_ = F.filter(F.split(F.lower(text), r"\s+"), lambda x: F.length(x) > 3)
    bare = F.transform(long_, lambda x: F.btrim(x, F.lit(",.!?;:#")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: (x != "") & ~x.isin(*KEYWORD_STOP_WORDS))), 1, limit)


def token_set(text: Column) -> Column:
    """Distinct words of over two characters; letters of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda x: F.length(x) > 2))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def numbers(text: Column) -> Column:
    """Distinct numbers that are not parts of words; commas as points, no trailing zeros."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z_\d])-?\d+(?:[.,]\d+)?(?![A-Za-z_\d])"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.replace(x, F.lit(","), F.lit(".")), r"(\.\d*?)0+$", "$1"), r"\.$", "")))


def chunks(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Sliding chunks, stripped, empty ones skipped; a short text is one."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    parts = F.when(F.length(text) <= size, F.array(F.trim(text))).otherwise(F.transform(starts, lambda i: F.trim(F.substring(text, i + 1, F.lit(size)))))
    return F.filter(parts, lambda x: x != "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def collapsed_chunks(clean: Column, size: int = 800, overlap: int = 100) -> Column:
    """Chunks of a collapsed text; ends where the text ends, without an overlap-only tail."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(clean) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda i: F.substring(clean, i + 1, F.lit(size))), lambda x: x != "")


def trend_id(*parts: Column) -> Column:
    """X9."""
    return F.concat(F.lit("trend_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def platform(name: Column) -> Column:
    """X20."""
    known = F.create_map(*(F.lit(x) for kv in PLATFORMS.items() for x in kv))
    return F.coalesce(F.element_at(known, F.upper(F.trim(name))), F.lit("OTHER"))


def engagement(likes: Column, shares: Column, comments: Column, views: Column) -> Column:
    """X19."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(likes) + 5 * zero(shares) + 3 * zero(comments) + 0.01 * zero(views)


def field(value: Column) -> Column:
    """Null as empty, trimmed, without trailing dots."""
    return F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(\s*\.)+\s*$", "")


def confidence(value: Column) -> Column:
    """Divided by 100 until at most 1; below 0 is 0."""
    return F.when(value > 1, value / F.power(F.lit(100.0), F.ceil(F.log(value) / F.log(F.lit(100.0))))).otherwise(F.greatest(F.lit(0.0), value))


def local_name(uri: Column) -> Column:
    """X24."""
    return F.regexp_extract(uri, r"[^#/]+$", 0)


def intent(text: Column) -> Column:
    """The first intent whose words occur."""
    low = F.lower(text)
    return F.when(low.rlike("presupuesto|escenario|que pasa si"), "counterfactual").when(low.rlike("proveedor|negoci"), "negotiation").when(low.rlike("por que|explica"), "explanation").when(low.rlike("recom|comprar"), "recommendation").otherwise("other")


def perturbation(text: Column) -> Column:
    """Kind and number of a change in plain words; the whole number, not only its last digit."""
    low = F.lower(text)
    kind = F.when(low.rlike("presupuesto"), "budget").when(low.rlike("demanda"), "demand").when(low.rlike("proveedor"), "exclude_supplier").otherwise("none")
    return F.struct(kind.alias("kind"), F.expr("1").cast("double").alias("unit"), F.nullif(F.regexp_extract(low, r".*?(-?\d+(?:[.,]\d+)?)", 1), F.lit("")).alias("number"))
