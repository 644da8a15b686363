"""Forward chaining over triples to a fixpoint, with axioms read from Turtle.

Axioms are a vocabulary: as many as its author wrote, so they are compiled on
the driver into small maps and rules.  Facts (s, p, o) are a table.  Each round
derives what follows from the facts of the last round, by joins with all facts
only where a rule needs a second fact, and ends when nothing is new.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import RDF, parse_turtle
from ..sources.shared import written

RDFS, OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
TYPE = "type"

Atom = tuple[str, str]  # (property, value); membership is (TYPE, class)


@dataclass(frozen=True)
class Axioms:
    """What a vocabulary says, closed over its own hierarchy."""

    follows: dict[Atom, frozenset[Atom]] = field(default_factory=dict)  # one fact of a node gives others of it
    rules: tuple[tuple[frozenset[Atom], Atom], ...] = ()  # several facts of a node give another
    paths: dict[str, frozenset[tuple[str, bool]]] = field(default_factory=dict)  # a property gives others; True: backwards
    domain: dict[str, frozenset[str]] = field(default_factory=dict)
    range: dict[str, frozenset[str]] = field(default_factory=dict)
    transitive: frozenset[str] = frozenset()
    disjoint: tuple[tuple[str, str], ...] = ()


def short(uri: str) -> str:
    """A name after the last # or /."""
    return uri.rsplit("#", 1)[-1].rsplit("/", 1)[-1] if not uri.startswith("_:") else uri


def _closed(step: dict, start) -> set:
    """Everything that start leads to."""
    seen, todo = set(), [start]
    while todo:
        for x in step.get(todo.pop(), ()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def axioms(text: str) -> Axioms:
    """Subclass, equivalence, intersection, union, value restriction, subproperty, inverse, symmetry, transitivity, domain, range and disjointness of a Turtle text.

    Other axioms (cardinalities, complements, quantifiers over classes) are not
    rules and are left out.  A class that is equivalent to an expression has
    exactly its members; one that is a subclass of an expression only gives
    what each of its members has.
    """
    said = defaultdict(list)
    for s, p, o, kind, _, _ in parse_turtle(text):
        said[s].append((short(p) if p.startswith((RDF, RDFS, OWL)) else p, o, kind))
    get = lambda s, p: [o for q, o, _ in said.get(s, ()) if q == p]

    def items(node: str) -> list[str]:
        out = []
        while node != f"{RDF}nil":
            out += get(node, "first")
            node = get(node, "rest")[0]
        return out

    def expression(node: str) -> list[frozenset[Atom]] | None:
        """The sets of facts each of which makes a node a member; None where facts do not decide."""
        if not node.startswith("_:"):
            return [frozenset({(TYPE, short(node))})]
        if get(node, "hasValue"):
            return [frozenset({(short(get(node, "onProperty")[0]), short(get(node, "hasValue")[0]))})]
        for part in get(node, "unionOf"):
            inner = [expression(x) for x in items(part)]
            return None if any(x is None for x in inner) else [y for x in inner for y in x]
        for part in get(node, "intersectionOf"):
            inner = [expression(x) for x in items(part)]
            return None if any(x is None for x in inner) else [frozenset().union(*c) for c in product(*inner)]
        return None

    step, rules = defaultdict(set), []
    follow = lambda a, b: step[a].update(x for x in b if x != a)
    paths, domain, range_, transitive, disjoint = defaultdict(set), defaultdict(set), defaultdict(set), set(), []
    for s in list(said):
        name, own = short(s), (TYPE, short(s))
        for o in [] if s.startswith("_:") else get(s, "subClassOf") + get(s, "equivalentClass"):
            e = expression(o)
            if e and len(e) == 1:
                follow(own, e[0])
            for p in get(o, "intersectionOf") if o.startswith("_:") else ():  # what all members share, although a union is among the parts
                for x in items(p):
                    e2 = expression(x)
                    if e2 and len(e2) == 1:
                        follow(own, e2[0])
        for o in [] if s.startswith("_:") else get(s, "equivalentClass"):
            for e in expression(o) or ():
                if len(e) == 1:
                    follow(next(iter(e)), {own})
                else:
                    rules.append((e, own))
        for o in get(s, "subPropertyOf"):
            paths[name, False].add((short(o), False))
            paths[name, True].add((short(o), True))
        for o in get(s, "inverseOf"):
            for a, b in ((name, short(o)), (short(o), name)):
                paths[a, False].add((b, True))
                paths[a, True].add((b, False))
        kinds = {short(x) for x in get(s, TYPE)}
        if "SymmetricProperty" in kinds:
            paths[name, False].add((name, True))
            paths[name, True].add((name, False))
        if "TransitiveProperty" in kinds:
            transitive.add(name)
        for key, into in (("domain", domain), ("range", range_)):
            into[name].update(short(o) for o in get(s, key) if not o.startswith("_:") and not o.startswith(OWL) and "XMLSchema" not in o)
        disjoint += [tuple(sorted((name, short(o)))) for o in get(s, "disjointWith")]
        for part in get(s, "members") if "AllDisjointClasses" in kinds else ():
            names = sorted(short(x) for x in items(part))
            disjoint += [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    frozen = lambda d: {k: frozenset(v) for k, v in d.items() if v}
    return Axioms(
        frozen({a: _closed(step, a) - {a} for a in list(step)}), tuple(rules),
        frozen({p: {(q, back) for q, back in _closed(paths, (p, False)) if (q, back) != (p, False)} for p, back in list(paths) if not back}), frozen(domain), frozen(range_), frozenset(transitive), tuple(sorted(set(disjoint))))


def _lookup(key: Column, table: dict[str, Column]) -> Column:
    """The array that the table has for key; an empty one for others."""
    parts = [x for k, v in table.items() for x in (F.lit(k), v)]
    return F.coalesce(F.try_element_at(F.create_map(*parts), key), F.slice(next(iter(table.values())), 1, 0))


def _pairs(values) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("p"), F.lit(b).alias("o")) for a, b in sorted(values)))


def _one_fact(delta: DataFrame, given: Axioms) -> DataFrame:
    """What follows from single facts."""
    say = lambda s, p, o: F.struct(s.alias("s"), p.alias("p"), o.alias("o"))
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    out = []
    if given.follows:
        key = lambda a: f"{a[0]}\n{a[1]}"
        out.append(F.transform(_lookup(F.concat_ws("\n", p, o), {key(a): _pairs(v) for a, v in given.follows.items()}), lambda x: say(s, x["p"], x["o"])))
    if given.paths:
        ways = {q: F.array(*(F.struct(F.lit(x).alias("p"), F.lit(back).alias("back")) for x, back in sorted(v))) for q, v in given.paths.items()}
        out.append(F.transform(_lookup(p, ways), lambda x: say(F.when(x["back"], o).otherwise(s), x["p"], F.when(x["back"], s).otherwise(o))))
    members = lambda held, node: F.transform(_lookup(p, {q: F.array(*map(F.lit, sorted(v))) for q, v in held.items()}), lambda c: say(node, F.lit(TYPE), c))
    out += [members(held, node) for held, node in ((given.domain, s), (given.range, o)) if held]
    if not out:
        return delta.limit(0)
    return delta.select(F.explode(F.concat(*out)).alias("x")).select("x.*")


def _several_facts(delta: DataFrame, facts: DataFrame, given: Axioms) -> DataFrame:
    """What follows from several facts of one node, of the nodes that the last round says something of."""
    atoms = sorted({a for body, _ in given.rules for a in body})
    asked = F.concat_ws("\n", "p", "o").isin([f"{p}\n{o}" for p, o in atoms])
    nodes = delta.where(asked).select("s").distinct()
    held = facts.where(asked).join(nodes, "s", "left_semi").groupBy("s").agg(F.collect_set(F.concat_ws("\n", "p", "o")).alias("held"))
    heads = F.array_compact(F.array(*(F.when(F.forall(F.array(*(F.lit(f"{p}\n{o}") for p, o in sorted(body))), lambda a: F.array_contains("held", a)), F.struct(F.lit(p).alias("p"), F.lit(o).alias("o"))) for body, (p, o) in given.rules)))
    return held.select("s", F.explode(heads).alias("x")).select("s", "x.p", "x.o")


def _longer_paths(delta: DataFrame, facts: DataFrame, given: Axioms) -> DataFrame:
    """Two steps of a transitive property, one of them new: paths double each round."""
    names = sorted(given.transitive)
    new, all_ = delta.where(F.col("p").isin(names)), facts.where(F.col("p").isin(names))
    join = lambda a, b: a.select("s", "p", F.col("o").alias("via")).join(b.select(F.col("s").alias("via"), "p", "o"), ["via", "p"]).select("s", "p", "o")
    return join(new, all_).unionByName(join(all_, new))


def infer(facts: DataFrame, given: Axioms) -> tuple[DataFrame, int]:
    """facts (s, p, o) with all that follows from them, and the number of rounds.

    Rows that repeat count once; rows with a null are left out.
    """
    facts = written(facts.select("s", "p", "o").where("s is not null and p is not null and o is not null").distinct(), "facts")
    delta, rounds = facts, 0
    while True:
        derived = _one_fact(delta, given)
        if given.rules:
            derived = derived.unionByName(_several_facts(delta, facts, given))
        if given.transitive:
            derived = derived.unionByName(_longer_paths(delta, facts, given))
        delta = written(derived.distinct().join(facts, ["s", "p", "o"], "left_anti"), "delta")
        if delta.isEmpty():
            return facts, rounds
        facts, rounds = facts.unionByName(delta), rounds + 1


def clashes(facts: DataFrame, given: Axioms) -> DataFrame:
    """(node, a, b): members of two classes that exclude each other; the facts are consistent if there is none."""
    if not given.disjoint:
        return facts.select(F.col("s").alias("node"), F.col("p").alias("a"), F.col("o").alias("b")).limit(0)
    names = sorted({x for pair in given.disjoint for x in pair})
    types = facts.where((F.col("p") == TYPE) & F.col("o").isin(names)).groupBy("s").agg(F.collect_set("o").alias("held"))
    both = F.filter(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in given.disjoint)), lambda x: F.array_contains("held", x["a"]) & F.array_contains("held", x["b"]))
    return types.select(F.col("s").alias("node"), F.explode(both).alias("x")).select("node", "x.a", "x.b")


def census(facts: DataFrame, classes: list[str], samples: int = 5) -> DataFrame:
    """Of each class its members' number and the first of them by name; a class without members has 0 and none.

    Samples come from a top-k of each task, so no class is gathered.
    """
    members = facts.where((F.col("p") == TYPE) & F.col("o").isin(classes)).select(F.col("o").alias("class"), "s").distinct()
    spread = members.withColumn("part", F.pmod(F.xxhash64("s"), F.lit(1024)))
    first = lambda c: F.slice(F.array_sort(c), 1, samples)
    some = spread.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"), first(F.collect_list("s")).alias("samples"))
    some = some.groupBy("class").agg(F.sum("n").alias("n"), first(F.flatten(F.collect_list("samples"))).alias("samples"))
    named = facts.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    return named.join(some, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def closure(edges: DataFrame) -> DataFrame:
    """Edges (member, ancestor) with those of any depth, and hops, the fewest between the two.

    Path doubling: after k rounds all pairs up to 2 ** k hops apart are known, so
    a hierarchy of depth d takes log2(d) + 1 rounds.  The shortest way of a pair
    up to twice as far apart begins with one of exactly 2 ** k hops, so only
    pairs that far apart are lengthened, and a tree's pairs are each met once.
    A node of a cycle is its own ancestor; a cycle ends as its shortest ways are known.
    """
    held = written(edges.where("member is not null and ancestor is not null").select("member", "ancestor").distinct().withColumn("hops", F.lit(1)), "closure")
    reach = 1
    while True:
        ahead = held.select(F.col("member").alias("ancestor"), F.col("ancestor").alias("above"), F.col("hops").alias("more"))
        longer = held.where(F.col("hops") == reach).join(ahead, "ancestor").groupBy("member", F.col("above").alias("ancestor")).agg((F.min("more") + reach).alias("hops"))
        new = written(longer.join(held, ["member", "ancestor"], "left_anti"), "closure")
        if new.isEmpty():
            return held
        held, reach = held.unionByName(new), 2 * reach
