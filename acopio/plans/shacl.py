"""Shapes read from Turtle and compiled to one aggregation by node (Q1-Q8, Q20)."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import RDF, parse_turtle
from .inference import TYPE, Axioms, infer, short

SH = "http://www.w3.org/ns/shacl#"


@dataclass(frozen=True)
class Property:
    """What a shape asks of the values of one property; None asks nothing."""

    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    among: tuple[str, ...] | None = None
    of_class: str | None = None
    not_after: str | None = None
    message: str | None = None


@dataclass(frozen=True)
class Shape:
    name: str
    target: str
    properties: tuple[Property, ...] = ()
    any_class: tuple[str, ...] = ()
    message: str | None = None


class ShapeError(ValueError):
    pass


_NUMBERS = {"minCount": ("min_count", int), "maxCount": ("max_count", int), "minLength": ("min_length", int), "maxLength": ("max_length", int), "minInclusive": ("min_inclusive", float), "maxInclusive": ("max_inclusive", float)}
_NAMES = {"datatype": "datatype", "class": "of_class", "lessThanOrEquals": "not_after"}
_TEXTS = {"pattern": "pattern", "message": "message"}
#: What is said about shapes and asks nothing.
_SAID = {"name", "description", "severity", "flags", "order", "group", "path", "in"}


def shapes(text: str) -> list[Shape]:
    """The node shapes of a Turtle text, by name.

    Read are target classes, property shapes with the constraints that Property
    lists, and sh:or over classes.  A constraint that is none of these is a
    ShapeError: a shape that is only half asked would pass what it should not.
    """
    said: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for s, p, o, _, _, _ in parse_turtle(text):
        said[s].append((p.removeprefix(SH) if p.startswith(SH) else short(p), o))
    get = lambda s, p: [o for q, o in said.get(s, ()) if q == p]

    def items(node: str) -> list[str]:
        out = []
        while node != f"{RDF}nil":
            out += get(node, "first")
            node = get(node, "rest")[0]
        return out

    def asked(node: str) -> Property:
        held = {}
        for p, o in said[node]:
            if p in _NUMBERS:
                held[_NUMBERS[p][0]] = _NUMBERS[p][1](o)
            elif p in _NAMES:
                held[_NAMES[p]] = short(o)
            elif p in _TEXTS:
                held[_TEXTS[p]] = o
            elif p not in _SAID:
                raise ShapeError(f"{p} is not read")
        if not get(node, "path") or get(node, "path")[0].startswith("_:"):
            raise ShapeError("a property shape has one property as its path")
        return Property(path=short(get(node, "path")[0]), among=tuple(items(get(node, "in")[0])) if get(node, "in") else None, **held)

    out = []
    for s in sorted(x for x in said if f"{SH}NodeShape" in get(x, TYPE)):
        unknown = {p for p, _ in said[s]} - _SAID - {TYPE, "targetClass", "property", "or", "message"}
        if unknown:
            raise ShapeError(f"{', '.join(sorted(unknown))} of {short(s)} is not read")
        classes = [c for part in get(s, "or") for x in items(part) for c in get(x, "class")]
        if get(s, "or") and len(classes) != sum(len(items(part)) for part in get(s, "or")):
            raise ShapeError(f"sh:or of {short(s)} is read over classes only")
        for target in get(s, "targetClass"):
            out.append(Shape(short(s), short(target), tuple(asked(p) for p in get(s, "property")), tuple(short(c) for c in classes), next(iter(get(s, "message")), None)))
    return out


def _member(name: str) -> Column:
    return F.coalesce(F.col(f"`is:{name}`"), F.lit(False))


def _value_checks(p: Property) -> dict[str, Column]:
    """component -> what holds for a value (o, datatype, and is:C for each class C) that keeps it."""
    o, number = F.col("o"), F.col("o").try_cast("double")
    held = {
        "Datatype": None if p.datatype is None else F.coalesce(F.regexp_extract("datatype", r"[^#/]+$", 0), F.lit("string")) == p.datatype,
        "Pattern": None if p.pattern is None else o.rlike(p.pattern),
        "MinLength": None if p.min_length is None else F.length(o) >= p.min_length,
        "MaxLength": None if p.max_length is None else F.length(o) <= p.max_length,
        "MinInclusive": None if p.min_inclusive is None else number >= p.min_inclusive,
        "MaxInclusive": None if p.max_inclusive is None else number <= p.max_inclusive,
        "In": None if p.among is None else o.isin(list(p.among)),
        "Class": None if p.of_class is None else _member(p.of_class),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in held.items() if v is not None}


def _linked(values: DataFrame, members: DataFrame, tasks: int) -> DataFrame:
    """values and what their objects are members of (s, is:C ...), without bringing the values of one object into one task.

    Values are dealt to as many salts as tasks; what meets at an object is one row for each of its salts, and goes back to them.
    """
    dealt = values.withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(tasks)).cast("int"))
    found = dealt.select("o", "salt").distinct().join(members.withColumnRenamed("s", "o"), "o")
    return dealt.join(found, ["o", "salt"], "left").drop("salt")


def violations(triples: DataFrame, asked: list[Shape], given: Axioms | None = None, tasks: int | None = None) -> DataFrame:
    """(shape, node, path, component, n, message) for each constraint that a node breaks, n values or times.

    triples: s, p, o, datatype (null: a plain string); rows that repeat count
    once.  Membership is what is said and what follows from the axioms.  path
    is null for what a shape asks of the node itself.  A node without a message
    of its shape's author gets one of its path and component.

    All shapes share one aggregation by node; only values that must be of a
    class meet the classes of their nodes, in one more join.  Nodes are dealt
    to so many tasks (shuffle partitions, if left out) and stay there.
    """
    tasks = tasks or int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = triples.select("s", "p", "o")
    types = (infer(facts, given)[0] if given else facts).where(F.col("p") == TYPE).select("s", F.col("o").alias("class"))
    member = lambda names: types.where(F.col("class").isin(names)).repartition(tasks, "s").groupBy("s").agg(*(F.max(F.col("class") == c).alias(f"is:{c}") for c in names))
    ends = sorted({p.of_class for x in asked for p in x.properties if p.of_class})
    paths = sorted({q for x in asked for p in x.properties for q in (p.path, p.not_after) if q})
    linked = sorted({p.path for x in asked for p in x.properties if p.of_class})
    values = triples.where(F.col("p").isin(paths)).select("s", "p", "o", "datatype")
    if linked:
        links = _linked(values.where(F.col("p").isin(linked)), member(ends), tasks)
        values = values.where(~F.col("p").isin(linked)).unionByName(links, allowMissingColumns=True)
    values = values.repartition(tasks, "s").distinct()
    counts, broken = {}, []
    said = lambda shape, path, component, n, message: F.struct(F.lit(shape.name).alias("shape"), F.lit(path).cast("string").alias("path"), F.lit(component).alias("component"), n.cast("long").alias("n"), F.lit(message or f"{path or shape.target}: {component}").alias("message"))
    number = F.col("o").try_cast("double")
    for shape in asked:
        target = _member(shape.target)
        for p in shape.properties:
            here = F.col("p") == p.path
            counts[f"n:{p.path}"] = F.count_if(here)
            n = F.coalesce(F.col(f"`n:{p.path}`"), F.lit(0))
            if p.min_count:
                broken.append(F.when(target & (n < p.min_count), said(shape, p.path, "MinCount", p.min_count - n, p.message)))
            if p.max_count is not None:
                broken.append(F.when(target & (n > p.max_count), said(shape, p.path, "MaxCount", n - p.max_count, p.message)))
            for component, kept in _value_checks(p).items():
                name = f"{shape.name}:{p.path}:{component}"
                counts[name] = F.count_if(here & ~kept)
                broken.append(F.when(target & (F.col(f"`{name}`") > 0), said(shape, p.path, component, F.col(f"`{name}`"), p.message)))
            if p.not_after:
                for q, best in ((p.path, F.max), (p.not_after, F.min)):
                    counts[f"number:{q}:{best.__name__}"], counts[f"text:{q}:{best.__name__}"] = best(F.when(F.col("p") == q, number)), best(F.when(F.col("p") == q, F.col("o")))
                first, last = (lambda kind, p=p: (F.col(f"`{kind}:{p.path}:max`"), F.col(f"`{kind}:{p.not_after}:min`")))("number"), (lambda kind, p=p: (F.col(f"`{kind}:{p.path}:max`"), F.col(f"`{kind}:{p.not_after}:min`")))("text")
                broken.append(F.when(target & F.coalesce(first[0] > first[1], last[0] > last[1], F.lit(False)), said(shape, p.path, "LessThanOrEquals", F.lit(1), p.message)))
        if shape.any_class:
            broken.append(F.when(target & ~reduce(lambda a, b: a | b, map(_member, shape.any_class)), said(shape, None, "Or", F.lit(1), shape.message)))
    found = values.groupBy("s").agg(*(c.alias(k) for k, c in counts.items())) if counts else values.select("s").distinct()
    nodes = member(sorted({c for x in asked for c in (x.target, *x.any_class)})).where(reduce(lambda a, b: a | b, (_member(x.target) for x in asked)))
    out = nodes.join(found, "s", "left").select(F.col("s").alias("node"), F.explode(F.array_compact(F.array(*broken))).alias("x"))
    return out.select("x.shape", "node", "x.path", "x.component", "x.n", "x.message")


def messages(found: DataFrame, longest: int = 500) -> DataFrame:
    """Q8, Q20: the distinct messages of each node, each cut to longest characters."""
    return found.groupBy("node").agg(F.array_sort(F.collect_set(F.substring("message", 1, longest))).alias("messages"))
