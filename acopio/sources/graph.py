"""Turtle files (vocabularies, norms, catalogues) as triples, and what is read from them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"
XSD, RDF = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKEN = re.compile(
    r'\s+|#[^\n]*|(?P<text>"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*")|(?P<uri><[^>\s]*>)|(?P<word>@prefix|@base|PREFIX\b|BASE\b)|(?P<lang>@[A-Za-z-]+)|(?P<mark>\^\^|[;,\[\]()]|\.(?!\w))'
    r"|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>_:[\w-]+|(?:[\w-]+(?:\.[\w-]+)*)?:[\w%-]*(?:\.[\w%-]+)*|a\b|true\b|false\b)",
    re.S,
)


class TurtleError(ValueError):
    pass


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise TurtleError(f"line {text.count(chr(10), 0, at) + 1}: {text[at : at + 30]!r}")
        at = found.end()
        if found.lastgroup:
            yield found.lastgroup, found[found.lastgroup]


def parse_turtle(text: str) -> list[tuple]:
    """(s, p, o, kind, datatype, language); prefixes, lists by ; and , nested [] and collections (rdf:first, rdf:rest) are read."""
    todo, at, prefixes, base, out, blanks = [*_tokens(text), ("end", "")], 0, {}, "", [], 0

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal at
        kind, value = todo[at]
        if kind == "end" or (want and value != want):
            raise TurtleError(f"{want or 'a term'} is missing before {value!r}")
        at += 1
        return kind, value

    def term() -> tuple:
        nonlocal blanks
        kind, value = take()
        if kind == "uri":
            return base + value[1:-1] if "://" not in value and not value.startswith("<urn:") else value[1:-1], "uri", None, None
        if kind == "name":
            if value == "a":
                return f"{RDF}type", "uri", None, None
            if value in ("true", "false"):
                return value, "literal", f"{XSD}boolean", None
            head, tail = value.split(":", 1)
            if head == "_":
                return value, "uri", None, None
            if head not in prefixes:
                raise TurtleError(f"prefix {head!r} is unknown")
            return prefixes[head] + tail, "uri", None, None
        if kind == "number":
            return value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if kind == "text":
            body = value[3:-3] if value.startswith('"""') else value[1:-1]
            body = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body, flags=re.S)
            if todo[at][1] == "^^":
                take()
                return body, "literal", term()[0], None
            return body, "literal", None, take()[1][1:] if todo[at][0] == "lang" else None
        if value == "[":
            blanks += 1
            node = f"_:n{blanks}"
            facts(node, "]")
            take("]")
            return node, "uri", None, None
        if value == "(":
            head = last = None
            while todo[at][1] != ")":
                blanks += 1
                node = f"_:n{blanks}"
                if last:
                    out.append((last, f"{RDF}rest", node, "uri", None, None))
                head, last = head or node, node
                out.append((node, f"{RDF}first", *term()))
            take(")")
            if last:
                out.append((last, f"{RDF}rest", f"{RDF}nil", "uri", None, None))
            return head or f"{RDF}nil", "uri", None, None
        raise TurtleError(f"{value!r} is no term")

    def facts(subject: str, end: str) -> None:
        while todo[at][1] != end:
            predicate = term()[0]
            out.append((subject, predicate, *term()))
            while todo[at][1] == ",":
                take()
                out.append((subject, predicate, *term()))
            if todo[at][1] != end:
                take(";")

    while todo[at][0] != "end":
        kind, value = todo[at]
        if kind == "word":
            take()
            name = "" if value.lower().endswith("base") else take()[1][:-1]
            uri = take()[1][1:-1]
            if value.lower().endswith("base"):
                base = uri
            else:
                prefixes[name] = uri
            if value.startswith("@"):
                take(".")
        else:
            facts(term()[0], ".")
            take(".")
    return out


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """file, error (null if the file was read) and a triple for each row; every file is parsed by a task."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                # Blank nodes of different files are different nodes.
                own = lambda x, tag=f"_:f{zlib.crc32(file.encode()):08x}": tag + x[2:] if x and x.startswith("_:") else x
                try:
                    rows = [(file, None, own(s), p, own(o) if kind == "uri" else o, kind, datatype, lang) for s, p, o, kind, datatype, lang in parse_turtle(text)]
                except TurtleError as error:
                    rows = [(file, str(error), *[None] * 6)]
                yield pd.DataFrame(rows, columns=["file", "error", "s", "p", "o", "o_kind", "datatype", "lang"], dtype=object)

    return texts.mapInPandas(run, f"file string, error string, {TRIPLE}")


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a Turtle file or of all files of a folder, read in parallel; a file that breaks the grammar is an error that names it."""
    rows = _parsed(spark, path)
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "file", "error")).cast("boolean")).otherwise(True)).select(*(c.split()[0] for c in TRIPLE.split(", ")))


def turtle_faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) for the files that break the grammar."""
    return _parsed(spark, path).where("error is not null").select("file", "error")


def world(*parts: DataFrame) -> DataFrame:
    """Vocabulary and facts as one set of triples."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def native(o: Column, datatype: Column) -> dict[str, Column]:
    """The value of a literal by its datatype; what does not fit is null."""
    kind = F.regexp_extract(datatype, r"[^#/]+$", 0)
    return {
        "as_long": F.when(kind.isin("integer", "int", "long"), o.try_cast("long")),
        "as_double": F.when(kind.isin("decimal", "double", "float"), o.try_cast("double")),
        "as_boolean": F.when(kind == "boolean", o.try_cast("boolean")),
        "as_time": F.when(kind.isin("dateTime", "date"), F.try_to_timestamp(o)),
    }


#: The properties of a norm.
NORM = ("target", "appliesWhen", "priority", "defeasible", "validFrom", "validTo", "source")


def norms(triples: DataFrame) -> DataFrame:
    """One row for each obligation, permission and prohibition; defeasible unless it says otherwise, defeats as an array."""
    name = lambda c: F.regexp_extract(c, r"[^#/]+$", 0)
    typed = triples.where((F.col("p") == f"{RDF}type") & name("o").isin("Obligation", "Permission", "Prohibition")).select("s", F.lower(name("o")).alias("kind"))
    facts = triples.groupBy("s").agg(*(F.max(F.when(name("p") == c, F.col("o"))).alias(c) for c in NORM), F.array_sort(F.collect_set(F.when(name("p") == "defeats", name("o")))).alias("defeats"))
    out = typed.join(facts, "s").select(name("s").alias("id"), "kind", "target", F.col("appliesWhen").alias("condition"), F.col("priority").try_cast("int").alias("priority"), F.coalesce(F.col("defeasible").try_cast("boolean"), F.lit(True)).alias("defeasible"), F.try_to_timestamp("validFrom").alias("valid_from"), F.try_to_timestamp("validTo").alias("valid_to"), "source", "defeats")
    return out.withColumn("broken", F.array_compact(F.array(F.when(F.col("target").isNull(), "target"), F.when(F.col("condition").isNull(), "condition"), F.when(~F.coalesce(F.col("priority").between(0, 100), F.lit(False)), "priority"))))


def summary(triples: DataFrame) -> DataFrame:
    """How many classes, properties and triples there are."""
    name = F.regexp_extract("o", r"[^#/]+$", 0)
    typed = F.col("p") == f"{RDF}type"
    return triples.agg(F.count_distinct(F.when(typed & name.isin("Class"), F.col("s"))).alias("n_classes"), F.count_distinct(F.when(typed & name.isin("ObjectProperty", "DatatypeProperty", "Property"), F.col("s"))).alias("n_properties"), F.count(F.lit(1)).alias("n_triples"))
