"""Surrogates for personal data (list item 1), in DataFrame functions only.

Entities are found by patterns: mail addresses, telephone and account numbers,
network addresses, secrets, and names after a title or a known given name.
Each distinct entity of the corpus gets one surrogate, derived with a key from
the entity, of the same kind, format, script and (for given names) gender; the
country of a telephone or account number stays, and valid check digits stay
valid.  All mentions of an entity get the same surrogate (coreference): names
are replaced token by token, whatever title or token stands beside them, so
that "Mr. Hale" and "Ada Hale" keep their link, and a capitalised word that is
a name elsewhere in the same text is replaced there too ("Hale said").

Distinct entities stay distinct: surrogates are drawn in rounds, and one that
equals another surrogate of its kind (all names are one kind), or a real
entity of the corpus, is drawn again.

Texts are searched once, and written with what was found.  Only entities take
part in the drawing; a text moves once more, and only if it has an entity.

Names that no title and no known given name announces are not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, materialise_counted, table

#: Titles, and given names with which a name may begin.
_MALE_TITLES, _FEMALE_TITLES, _OTHER_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña"), ("Dr", "Prof")
_MALE_NAMES = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Peter", "Paul", "Andrew", "Steven", "George", "Hans", "Klaus", "Jürgen", "Pierre", "Jean", "Luis", "Carlos", "José", "Miguel", "Antonio", "Giovanni", "Ahmed", "Mohammed", "Kwame", "Hiroshi", "Arjun", "Иван", "Сергей", "Алексей")
_FEMALE_NAMES = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Emily", "Jane", "Margaret", "Laura", "Anna", "Julia", "Petra", "Sabine", "Marie", "Sophie", "Camille", "María", "Carmen", "Lucía", "Giulia", "Fatima", "Aisha", "Priya", "Ingrid", "Анна", "Мария", "Ольга")

_NAME = r"\p{Lu}[\p{L}'’-]{1,30}"


def _any(*words: str) -> str:
    """A pattern for the words, as they are and in capitals."""
    return f"(?:{'|'.join(dict.fromkeys(w for x in words for w in (x, x.upper())))})"


_TITLE, _GIVEN = _any(*_MALE_TITLES, *_FEMALE_TITLES, *_OTHER_TITLES), _any(*_MALE_NAMES, *_FEMALE_NAMES)
#: name of the kind -> pattern; the first kind that matches at a place wins.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9](?:[\w.%+-]{0,63})@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,5}\.[A-Za-z]{2,24}(?![\w@])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,38}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w|[.-]\d)|(?<!\w)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|AKIA)[-_]?(?=\w{0,60}\d)\w{16,60})(?!\w)",
    "titled": rf"(?<![\p{{L}}])(?=\p{{Lu}}){_TITLE}\.? (?:{_GIVEN} (?=\p{{Lu}})){{0,2}}{_NAME}(?: (?!{_TITLE}[. ]){_NAME})?",
    "name": rf"(?<![\p{{L}}])(?=\p{{Lu}}){_GIVEN} (?:{_GIVEN} (?=\p{{Lu}})){{0,2}}{_NAME}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A word that may be a later mention of a name.
_CAPITALISED = rf"(?<![\p{{L}}]){_NAME}"
#: The first digits of telephone numbers that are country codes of one or two digits.
_CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})[ .-]?"
_LATIN = ("ba be bi bo bu da de di do du fa fe fi fo ga ge go ha he hi ho ja jo ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no ra re ri ro ru sa se si so ta te ti to va ve vi vo".split(), ("a", "ia", "ina", "elle"), ("o", "an", "us", "er"), ("son", "ford", "mann", "ley", "ez", "ier", "ton", "berg"))
_CYRILLIC = ("ба бе би бо ва ве ви во га го да де ди до жа же за зе зо ка ке ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се си со та те ти то фа фе ша ше".split(), ("а", "ия", "ина"), ("ан", "ий", "ор"), ("ов", "ский", "енко", "ин"))
_GREEK = ("βα βε βι γα γε δα δε δι θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι ρα ρε ρι ρο σα σε σι τα τε τι το φα φι χα".split(), ("α", "ια", "η"), ("ος", "ης", "ας"), ("ίδης", "όπουλος", "άκης"))
_WIDEN_AFTER = 24


def _hex(key: str, *parts: Column, blocks: int = 1) -> Column:
    """blocks * 64 hexadecimal digits that depend on the key and the parts."""
    said = F.concat_ws("\x1f", *parts)
    return F.concat(*(F.sha2(F.concat(F.lit(f"{key}\x1f{k}\x1f"), F.sha2(F.concat(F.lit(f"{key}\x1e"), said), 256)), 256) for k in range(blocks)))


def _number(stream: Column, at: Column | int, n: int = 4) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(stream, at + 1, F.lit(n)), 16, 10).cast("long")


def _pick(values: tuple | list, number: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (number % len(values)).cast("int"))


def _shaped(text: Column, stream: Column, digits: str = "0123456789", lower: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """text with each digit and letter replaced by another of its class; all else stays."""
    def one(c: Column, k: Column) -> Column:
        n = _number(stream, (k * 4) % 572)
        at = lambda letters: F.substring(F.lit(letters), (n % len(letters)).cast("int") + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), at(digits)).when(c.rlike("[a-z]"), at(lower)).when(c.rlike("[A-Z]"), at(lower.upper())).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    place = F.reverse(F.split(digits, ""))
    add = lambda c, k: F.when(k % 2 == 1, F.get(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(place, add), F.lit(0), lambda s, x: s + x) % 10


def _mod97(account: Column) -> Column:
    """A lower-case account number, its first four characters last and letters as 10 to 35, modulo 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = lambda c: F.when(c.rlike("[a-z]"), F.ascii(c) - 87).otherwise(c.cast("int"))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[a-z]"), 100).otherwise(10) + value(c)) % 97)


def _iban(norm: Column, shaped: Column, stream: Column) -> Column:
    """The country stays; check digits are right if they were."""
    compact = lambda x: F.regexp_replace(x, " ", "")
    body = F.substring(shaped, F.lit(5), F.length(norm))
    right = 98 - _mod97(F.concat(F.substring(norm, 1, 2), F.lit("00"), compact(body)))
    check = F.when(_mod97(compact(norm)) == 1, right).otherwise((right - 2 + 1 + _number(stream, 500) % 95) % 97 + 2)
    return F.concat(F.substring(norm, 1, 2), F.lpad(check.cast("string"), 2, "0"), body)


def _name_like(norm: Column, stream: Column, kind: str, attempt: Column) -> Column:
    def built(script: tuple) -> Column:
        syllables, female, male, family = script
        ends = {"given_f": female, "given_m": male, "given_u": (*female[:1], *male[:1]), "surname": family}[kind]
        body = F.concat(_pick(syllables, _number(stream, 0)), _pick(syllables, _number(stream, 4)))
        # More syllables in later rounds: the space grows until all are apart.
        more = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.when(k <= attempt + F.lit(1 if kind == "surname" else 0), _pick(syllables, _number(stream, 8 + k * 4))).otherwise(F.lit("")))
        return F.concat(body, F.array_join(more, ""), _pick(ends, _number(stream, 4 * 20)))

    return F.when(norm.rlike(r"\p{IsCyrillic}"), built(_CYRILLIC)).when(norm.rlike(r"\p{IsGreek}"), built(_GREEK)).otherwise(built(_LATIN))


def surrogate(kind: Column, norm: Column, role: Column, attempt: Column, key: str) -> Column:
    """The surrogate drawn for an entity in this round, in the entity's normal (lower-case) form; role: what sort of name it is."""
    stream = _hex(key, kind, norm, attempt.cast("string"), blocks=9)
    # Only where all of a format is taken the format gives way.
    wide = F.when(attempt >= _WIDEN_AFTER, F.substring(F.regexp_replace(stream, "[a-f]", ""), F.lit(1), attempt - _WIDEN_AFTER + 1)).otherwise("")
    shaped = _shaped(norm, stream)
    bare = F.regexp_replace(shaped, "[^0-9]", "")
    check = (10 - _luhn(F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit("0")))) % 10
    last = F.when(_luhn(F.regexp_replace(norm, "[^0-9]", "")) == 0, check).otherwise((check + 1 + _number(stream, 250) % 9) % 10)
    octet = lambda k: (_number(stream, 8 * k) % 254 + 1).cast("string")
    top, country = F.regexp_extract(norm, r"(\.[a-z]+)$", 1), F.regexp_extract(norm, rf"({_CALLING})", 1)
    out = (
        F.when(kind == "email", F.concat(_shaped(F.substring(norm, F.lit(1), F.length(norm) - F.length(top)), stream), wide, top))
        .when(kind == "ip", F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
        .when(kind == "ipv6", F.concat(_shaped(norm, stream, lower="abcdef"), wide))
        .when(kind == "card", F.concat(F.regexp_replace(shaped, "[0-9]$", ""), last.cast("string"), wide))
        .when(kind == "secret", F.concat(F.when(norm.rlike("^[0-9a-f]+$"), _shaped(norm, stream, lower="abcdef")).otherwise(shaped), wide))
        .when(kind == "iban", F.concat(_iban(norm, shaped, stream), wide))
        .when(kind == "phone", F.concat(country, F.substring(shaped, F.length(country) + 1, F.length(shaped)), wide))
    )
    for name in ("given_m", "given_f", "given_u", "surname"):
        out = out.when((kind == "person") & (role == name), _name_like(norm, stream, name, attempt))
    return out.otherwise(F.concat(shaped, wide))


def surrogates(entities: DataFrame, key: str, max_rounds: int = 60) -> DataFrame:
    """(kind, norm, role) -> (kind, norm, surrogate), all different within a kind and none equal to a real entity.

    A name is a given name if it is one anywhere, of the gender that its
    mentions agree on.  Each round draws for the entities that have none; of
    those that draw the same, the first by hash keeps it.
    """
    some = lambda *roles: F.max(F.col("role").isin(*roles))
    roles = entities.where("norm is not null").groupBy("kind", "norm").agg(some("given_m").alias("m"), some("given_f").alias("f"), some("given_m", "given_f", "given_u").alias("g"))
    role = F.when(F.col("m") & ~F.col("f"), "given_m").when(F.col("f") & ~F.col("m"), "given_f").when(F.col("g"), "given_u").otherwise("surname")
    real = materialise(roles.select("kind", "norm", role.alias("role")), "entities")
    open_, done = real, None
    for k in range(max_rounds):
        drawn = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("role"), F.lit(k), key))
        free = drawn.join(real.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min_by("norm", F.struct(F.xxhash64("norm"), "norm")).alias("norm"))
        won = materialise(won.select("kind", "norm", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        open_, left = materialise_counted(open_.join(won, ["kind", "norm"], "left_anti"), "open", n=F.count(F.lit(1)))
        if not left["n"]:
            return done
    raise ValueError("surrogates of some entities are not distinct after the last round")


def _kinds(entity: Column) -> Column:
    out = F
    for name, pattern in PATTERNS.items():
        # Around an entity there is nothing, so its pattern holds for the whole of it.
        out = out.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out


def _tokens(entity: Column, kind: Column) -> Column:
    """array<struct<kind, norm, role, said, lead>>: what of the entity is replaced; lead stays before it."""
    title = F.regexp_extract(entity, r"^(\p{L}+)\.? ", 1)
    lead = F.when(kind == "titled", F.regexp_extract(entity, r"^(\p{L}+\.? )", 1)).otherwise("")
    names = F.split(F.substring(entity, F.length(lead) + 1, F.length(entity)), " ")
    gender = lambda male, female, x: F.when(F.lower(x).isin(*(v.lower() for v in male)), "given_m").when(F.lower(x).isin(*(v.lower() for v in female)), "given_f").otherwise("given_u")
    by_title = F.when(kind == "titled", gender(_MALE_TITLES, _FEMALE_TITLES, title)).otherwise("given_u")

    def name(said: Column, k: Column) -> Column:
        known = gender(_MALE_NAMES, _FEMALE_NAMES, said)
        role = F.when(k == F.size(names) - 1, "surname").when(known != "given_u", known).otherwise(by_title)
        return F.struct(F.lit("person").alias("kind"), F.lower(said).alias("norm"), role.alias("role"), said.alias("said"), F.when(k == 0, lead).otherwise(" ").alias("lead"))

    whole = F.struct(kind.alias("kind"), F.lower(entity).alias("norm"), F.lit("").alias("role"), entity.alias("said"), F.lit("").alias("lead"))
    return F.when(kind.isin("titled", "name"), F.transform(names, name)).otherwise(F.array(whole))


def _cased(value: Column, said: Column) -> Column:
    """value in the case of what was said."""
    lettered = said.rlike(r"\p{L}")
    return F.when(lettered & (said == F.upper(said)) & (F.length(said) > 1), F.upper(value)).when(said.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, F.lit(2), F.length(value)))).otherwise(value)


def _woven(pieces: Column, between: Column) -> Column:
    """pieces with the strings of between (one fewer) between them."""
    return F.array_join(F.flatten(F.zip_with(pieces, between, lambda p, e: F.array(p, F.coalesce(e, F.lit(""))))), "")


def _in_order(rows: DataFrame, by: list[str], place: str, what: str) -> DataFrame:
    """by, and what of its rows as one array in the order of place."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(place, what))).alias("held")).select(*by, F.transform("held", lambda x: x[what]).alias(what))


def _by_text(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(rid, kind, norm, surrogate) of the entities of each text; the texts of an entity are dealt to salts."""
    salts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = tokens.select("rid", "kind", "norm").distinct().withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int"))
    dealt = named.select("kind", "norm", "salt").distinct().groupBy("kind", "norm").agg(F.collect_list("salt").alias("salts"))
    dealt = known.join(dealt, ["kind", "norm"]).select("kind", "norm", "surrogate", F.explode("salts").alias("salt"))
    return named.join(dealt, ["kind", "norm", "salt"]).select("rid", "kind", "norm", "surrogate")


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = "acopio") -> DataFrame:
    """docs with the entities of text_col replaced, and n_entities and entity_kinds (sorted, by commas).

    n_entities counts what the patterns find, not the later mentions of names.
    The two columns replace columns of these names; all others pass through,
    null ids too.  Null and empty texts stay and have no entities.  Rows that
    repeat are replaced alike; of surrogates drawn alike the smaller hash
    keeps its own.  Long texts are searched whole.  An empty table gives an
    empty table.  The result depends on the key and on the set of entities in
    the table, not on the order or number of its rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Every pattern needs one of these; without them a text is not searched further.
    likely = text.rlike(rf"[0-9@]|(?<![\p{{L}}])(?=\p{{Lu}})(?:{_TITLE}|{_GIVEN})[. ]|[A-Fa-f]{{32}}")
    found = F.when(likely, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    scanned = materialise(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("rid"), F.coalesce(found, F.array().cast("array<string>")).alias("found")), "scanned")
    others = [c for c in docs.columns if c not in (text_col, "n_entities", "entity_kinds")]
    passed = [F.col(f"row.`{c}`").alias(c) for c in others]
    untouched = scanned.where(F.size("found") == 0).select(*passed, F.col(f"row.`{text_col}`").alias(text_col), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_kinds"))

    touched = scanned.where(F.size("found") > 0).select("rid", "row", "found", F.split(F.col(f"row.`{text_col}`"), ENTITY, -1).alias("pieces"))
    entities = touched.select("rid", F.posexplode("found").alias("k", "entity")).withColumn("sort", _kinds(F.col("entity")))
    tokens = materialise(entities.select("rid", "k", "sort", F.posexplode(_tokens(F.col("entity"), F.col("sort"))).alias("j", "t")).select("rid", "k", "sort", "j", "t.*"), "tokens")
    named = materialise(_by_text(tokens, surrogates(tokens, key)), "named")

    said = tokens.join(named, ["rid", "kind", "norm"]).select("rid", "k", "sort", "j", F.concat("lead", _cased(F.col("surrogate"), F.col("said"))).alias("said"))
    said = said.groupBy("rid", "k").agg(F.sort_array(F.collect_list(F.struct("j", "said"))).alias("parts"), F.first("sort").alias("sort")).select("rid", "k", F.array_join(F.transform("parts", lambda x: x["said"]), "").alias("said"), "sort")
    said = said.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "said"))).alias("held"), F.collect_set(F.when(F.col("sort") == "titled", "name").otherwise(F.col("sort"))).alias("sorts"))

    # Later mentions of names: the capitalised words of texts that have a name.
    names = named.where("kind = 'person'").select("rid", "norm", "surrogate")
    words = touched.join(names.select("rid").distinct(), "rid", "left_semi").select("rid", F.posexplode("pieces").alias("k", "piece")).select("rid", "k", F.posexplode_outer(F.regexp_extract_all("piece", F.lit(_CAPITALISED), F.lit(0))).alias("i", "word"))
    words = words.withColumn("norm", F.lower("word")).join(names, ["rid", "norm"], "left").withColumn("word", F.when(F.col("surrogate").isNull(), F.col("word")).otherwise(_cased(F.col("surrogate"), F.col("word"))))
    words = _in_order(_in_order(words, ["rid", "k"], "i", "word"), ["rid"], "k", "word").withColumnRenamed("word", "words")

    pieces = F.when(F.col("words").isNull(), F.col("pieces")).otherwise(F.transform("pieces", lambda p, k: _woven(F.split(p, _CAPITALISED, -1), F.get(F.col("words"), k))))
    changed = touched.join(said, "rid").join(words, "rid", "left").select(
        *passed, _woven(pieces, F.transform("held", lambda x: x["said"])).alias(text_col), F.size("found").cast("long").alias("n_entities"), F.array_join(F.array_sort("sorts"), ",").alias("entity_kinds")
    )
    return untouched.unionByName(changed)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_entities", "entity_kinds", "text")
