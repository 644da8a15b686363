"""Safe expressions: a small part of Python's syntax, compiled once to Spark columns or run on dictionaries.

B6, B7, B8.  Names are bound to columns; attributes are struct fields.  What
cannot be converted is null, which rules and norms take for false.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NODES = (ast.Expression, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.USub, ast.UAdd, ast.Compare, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn, ast.Is, ast.IsNot, ast.IfExp, ast.Name, ast.Attribute, ast.Constant, ast.List, ast.Tuple, ast.Set, ast.Dict, ast.Subscript, ast.Slice, ast.Call, ast.Load)
_CALLS = {"abs": F.abs, "min": lambda *a: F.least(*a), "max": lambda *a: F.greatest(*a), "len": F.size, "round": F.bround, "float": lambda c: c.try_cast("double"), "int": lambda c: c.try_cast("long"), "str": lambda c: c.cast("string"), "bool": lambda c: c.try_cast("boolean"),
          "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.try_cast("double")), "any": lambda a: F.exists(a, lambda x: x.try_cast("boolean")), "all": lambda a: F.forall(a, lambda x: x.try_cast("boolean"))}


TEMPLATE = re.compile(r"\s*\{\{(.+)\}\}\s*", re.S)


class UnsafeExpression(ValueError):
    pass


def parse(text: str) -> ast.Expression:
    """The checked syntax tree of an expression."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise UnsafeExpression(f"not an expression: {text!r}") from error
    for node in ast.walk(tree):
        if not isinstance(node, _NODES):
            raise UnsafeExpression(f"{type(node).__name__} is not allowed: {text!r}")
        if isinstance(node, ast.Attribute) and node.attr.startswith("_") or isinstance(node, ast.Name) and node.id.startswith("_"):
            raise UnsafeExpression(f"private names are not allowed: {text!r}")
        if isinstance(node, ast.Call) and (not isinstance(node.func, ast.Name) or node.func.id not in _CALLS or node.keywords):
            raise UnsafeExpression(f"this call is not allowed: {text!r}")
    return tree


def _wrap(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def compile_column(text: str, names: dict[str, Column | dict]) -> Column:
    """The expression as a column; names maps a name to a column, or to its fields."""

    def go(node):
        match node:
            case ast.Constant():
                return node.value
            case ast.Name():
                if node.id not in names:
                    raise UnsafeExpression(f"unknown name {node.id!r}")
                return names[node.id]
            case ast.Attribute():
                held = go(node.value)
                if isinstance(held, dict):
                    if node.attr not in held:
                        raise UnsafeExpression(f"unknown field {node.attr!r}")
                    return held[node.attr]
                return held.getField(node.attr)
            case ast.BoolOp():
                parts = [_wrap(go(v)) for v in node.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(node.op, ast.And) else out | p
                return out
            case ast.UnaryOp():
                held = _wrap(go(node.operand))
                return ~held if isinstance(node.op, ast.Not) else held if isinstance(node.op, ast.UAdd) else -held
            case ast.IfExp():
                return F.when(_wrap(go(node.test)), _wrap(go(node.body))).otherwise(_wrap(go(node.orelse)))
            case ast.List() | ast.Tuple() | ast.Set():
                return [go(v) for v in node.elts]
            case ast.Dict():
                return {go(k): go(v) for k, v in zip(node.keys, node.values, strict=True)}
            case ast.Subscript():
                held = go(node.value)
                if isinstance(node.slice, ast.Slice):
                    a, b = (go(x) if x is not None else None for x in (node.slice.lower, node.slice.upper))
                    if isinstance(held, list):
                        return held[a:b]
                    if node.slice.step is not None or isinstance(a, Column) or isinstance(b, Column) or (a or 0) < 0 or (b or 0) < 0:
                        raise UnsafeExpression("slices have fixed bounds from the start")
                    return F.slice(held, (a or 0) + 1, max(0, b - (a or 0)) if b is not None else F.size(held))
                at = go(node.slice)
                if isinstance(held, (list, dict)) and not isinstance(at, Column):
                    return held[at]
                if isinstance(at, int):  # a place of an array, from its end if below 0
                    return F.try_element_at(held, F.lit(at + 1 if at >= 0 else at))
                return F.try_element_at(held, _wrap(at)) if isinstance(held, Column) else F.try_element_at(F.create_map(*(_wrap(x) for kv in held.items() for x in kv)), _wrap(at))
            case ast.Call():
                given = [go(a) for a in node.args]
                given = [F.array(*(_wrap(x) for x in a)) if isinstance(a, list) else _wrap(a) for a in given]
                if node.func.id in ("min", "max") and len(given) == 1:
                    return (F.array_min if node.func.id == "min" else F.array_max)(given[0])
                return _CALLS[node.func.id](*given)
            case ast.Compare():
                out, left = None, go(node.left)
                for op, right in zip(node.ops, node.comparators, strict=True):
                    right = go(right)
                    one = _compare(op, left, right)
                    out, left = one if out is None else out & one, right
                return out
        raise UnsafeExpression(ast.dump(node))

    return _wrap(go(parse(text).body))


def _compare(op: ast.cmpop, a, b) -> Column:
    if isinstance(op, (ast.In, ast.NotIn)):
        held = _wrap(a).isin(*b) if isinstance(b, (list, dict)) else F.array_contains(b, _wrap(a))
        return ~held if isinstance(op, ast.NotIn) else held
    if isinstance(op, (ast.Is, ast.IsNot)):
        same = _wrap(a).eqNullSafe(_wrap(b))
        return ~same if isinstance(op, ast.IsNot) else same
    a, b = _wrap(a), _wrap(b)
    return {ast.Eq: a.__eq__, ast.NotEq: a.__ne__, ast.Lt: a.__lt__, ast.LtE: a.__le__, ast.Gt: a.__gt__, ast.GtE: a.__ge__}[type(op)](b)


def template(value: object, names: dict[str, Column | dict]) -> Column:
    """B8: '{{ expr }}' compiled, all else a literal."""
    found = TEMPLATE.fullmatch(value) if isinstance(value, str) else None
    return compile_column(found[1], names) if found else F.lit(value)
