"""Aggregation within a collection, and recursion over it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpath.functions.registry import function
from lumenpath.lang.errors import InvalidOperation, TypeMismatch
from lumenpath.plans import temporal
from lumenpath.plans.coll import EMPTY, NUMERIC, SPARK_TYPES, Coll, child, choice_item, none, to_many


@function("sum")
def sum_(c, this, args):
    this = choice_item(this, "decimal")
    if this.kind == "empty":
        return EMPTY if c.spec else Coll("integer", F.lit(0).cast("long"))
    if this.kind not in NUMERIC:
        return EMPTY
    total = F.aggregate(to_many(this), F.lit(0).cast(SPARK_TYPES[this.kind]), lambda a, x: a + x, lambda a: F.round(a, 12) if this.kind == "decimal" else a)
    return Coll(this.kind, F.when(F.size(to_many(this)) > 0, total) if c.spec else total)


@function("avg")
def avg(c, this, args):
    this = choice_item(this, "decimal")
    if this.kind not in NUMERIC:
        return EMPTY
    items = to_many(this).cast("array<double>")
    return Coll("decimal", F.round(F.aggregate(items, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(items), F.lit(0)), 16))


def _extreme(name, pick, sign):
    @function(name)
    def build(c, this, args):
        this = choice_item(this, "decimal")
        if this.kind in NUMERIC or this.kind == "string":
            return Coll(this.kind, pick(to_many(this)))
        if this.kind not in ("date", "time", "datetime"):
            return EMPTY
        better = lambda a, x: F.coalesce(temporal.compare(this.kind, x, a) == sign, F.lit(False))
        start = F.get(to_many(this), F.lit(0))
        return Coll(this.kind, F.aggregate(to_many(this), start, lambda a, x: F.when(better(a, x), x).otherwise(a)))


_extreme("min", F.array_min, -1)
_extreme("max", F.array_max, 1)


@function("aggregate", 1, 2)
def aggregate(c, this, args):
    """A fold: $this is the item, $total what was made so far."""
    start = c.one(c.argument(args[1], this), "aggregate") if len(args) > 1 else EMPTY
    if this.kind == "empty":
        return start
    start = choice_item(start, this.kind)
    kind = start.kind
    if kind == "empty":  # the type of the first step, from its item alone
        kind = c.item(args[0], replace(this, many=True), F.get(to_many(this), F.lit(0)), F.lit(0), EMPTY).kind
        kind = this.kind if kind == "empty" else kind
    probe = c.item(args[0], replace(this, many=True), F.get(to_many(this), F.lit(0)), F.lit(0), Coll(kind, none(kind)))
    if probe.kind == "decimal" and kind == "integer":
        kind = "decimal"
    if kind not in SPARK_TYPES:
        raise TypeMismatch("aggregate: a simple type is needed")
    first_value = none(kind) if start.kind == "empty" else start.col.cast(SPARK_TYPES[kind])

    def step(total, x):
        got = c.item(args[0], replace(this, many=True), x, None, Coll(kind, total))
        return none(kind) if got.kind == "empty" else c.one(got).col.cast(SPARK_TYPES[kind])

    return Coll(kind, F.aggregate(to_many(this), first_value, step))


def _same(a: Coll, b: Coll) -> bool:
    return a.kind == b.kind and (a.kind != "object" or a.dtype == b.dtype)


@function("repeat", 1)
def repeat(c, this, args):
    """All that the projection reaches, again and again; distinct items, level by level until the schema has no more.

    Each level has to go down in the schema, which bounds their number; what doesn't is for the evaluator without a schema.
    """
    levels, now = [], this
    while (below := c.argument(args[0], now)).kind != "empty":
        if levels and _height(below) >= _height(now) or below is now:
            raise InvalidOperation("repeat: the schema doesn't bound this projection; operators.dynamic evaluates it without one")
        levels.append(below)
        now = below
    return _joined(c, levels, distinct=True)


def _levels(dtype: T.DataType) -> int:
    if isinstance(dtype, T.ArrayType):
        return _levels(dtype.elementType)
    return 1 + max((_levels(f.dataType) for f in dtype.fields), default=0) if isinstance(dtype, T.StructType) else 0


def _height(x: Coll) -> int:
    """How far the schema goes down from x; the root, whose fields are the frame's columns, is above all."""
    if x.kind == "choice":
        return max(_height(v) for _, v in x.variants)
    if x.fields is not None:
        return 1 + max((_levels(t) for _, t in x.fields.values()), default=0)
    return _levels(x.dtype) if x.dtype is not None else 0


def _joined(c, levels, distinct=False):
    """Levels as one collection. Objects of different types have only what they share: their JSON as text."""
    if not levels:
        return EMPTY
    if all(_same(levels[0], x) for x in levels):
        out = Coll(levels[0].kind, F.concat(*[to_many(x) for x in levels]), True, levels[0].dtype)
    else:
        out = Coll("string", F.concat(*[c.texts(x).col for x in levels]), True)
    return out.with_col(F.array_distinct(out.col)) if distinct else out


def _fields(this: Coll) -> list[Coll]:
    if this.kind != "object":
        return []
    names = list(this.fields) if this.fields is not None else this.dtype.names
    return [x for n in names if (x := child(this, n)) is not None and x.kind != "empty"]


@function("children")
def children(c, this, args):
    """All child values, in the schema's order."""
    return _joined(c, _fields(this))


@function("descendants")
def descendants(c, this, args):
    """children() of children() and so on, until the schema has no more."""
    found, level = [], _fields(this)
    while level:
        found += level
        level = [x for one in level for x in _fields(one)]
    return _joined(c, found)
