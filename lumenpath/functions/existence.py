"""Filters, existence, subsets and set functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lumenpath.functions.registry import function
from lumenpath.lang.errors import InvalidArguments, TypeMismatch
from lumenpath.lang.nodes import type_name_of
from lumenpath.plans.coll import EMPTY, TYPE_NAMES, Coll, choice_item, first, let, present, size, to_many


def _bounded(c, items):
    """items, or an error where there are more than the limit."""
    if c.max_items is None:
        return items
    return let(items, lambda x: F.when(F.size(x) > c.max_items, F.raise_error(F.lit(f"more than {c.max_items} items"))).otherwise(x))


def _true(c, node, this, x, i=None):
    return F.coalesce(c.boolean(c.item(node, this, x, i)), F.lit(False))


def _each_variant(this, apply):
    return replace(this, variants=tuple((s, apply(v)) for s, v in this.variants))


@function("where", 1)
def where(c, this, args):
    if this.kind == "empty":
        return EMPTY
    if this.kind == "choice":
        return _each_variant(this, lambda v: where(c, v, args))
    if not this.many and this.fields is not None:
        keep = F.coalesce(c.boolean(c.argument(args[0], this)), F.lit(False))
        return replace(this, guard=keep if this.guard is None else this.guard & keep)
    if not this.many:
        return this.with_col(F.when(_true(c, args[0], this, this.col, F.lit(0)), this.col))
    return this.with_col(F.filter(_bounded(c, this.col), lambda x, i: _true(c, args[0], this, x, i)))


@function("select", 1)
def select(c, this, args):
    if this.kind == "empty":
        return EMPTY
    if this.kind == "choice":
        return select(c, choice_item(this, "object"), args)
    if not this.many:
        return c.within(replace(c.scope, this=this, index=F.lit(0)), args[0])
    model: list[Coll] = []

    def body(x, i):
        got = c.item(args[0], this, x, i)
        if got.kind == "choice":
            got = c.texts(got)
        model.append(got)
        return to_many(got)

    out = F.flatten(F.transform(_bounded(c, this.col), body))
    got = model[0]
    return EMPTY if got.kind == "empty" else Coll(got.kind, _bounded(c, out), True, got.dtype)


@function("exists", 0, 1)
def exists(c, this, args):
    if not args:
        return Coll("boolean", present(this))
    if this.kind == "choice":
        return Coll("boolean", present(where(c, this, args)))
    if this.many:
        return Coll("boolean", F.exists(this.col, lambda x: _true(c, args[0], this, x)))
    return Coll("boolean", present(where(c, this, args)))


@function("all", 1)
def all_(c, this, args):
    if this.kind == "empty":
        return Coll("boolean", F.lit(True))

    def good(x):
        got = c.item(args[0], this, x)
        return F.coalesce(c.boolean(got), F.lit(False)) if got.kind in ("boolean", "empty") else present(got)

    if this.many:
        return Coll("boolean", F.forall(this.col, good))
    if this.col is None:
        return Coll("boolean", F.when(present(this), F.coalesce(c.boolean(c.argument(args[0], this)), F.lit(False))).otherwise(True))
    return Coll("boolean", F.when(present(this), good(this.col)).otherwise(True))


@function("empty")
def empty(c, this, args):
    return Coll("boolean", ~present(this))


@function("count")
def count(c, this, args):
    return Coll("integer", size(this).cast("long"))


def _booleans(name, quantifier, wanted, of_others):
    @function(name)
    def build(c, this, args):
        this = choice_item(this, "boolean")
        if this.kind != "boolean":
            return Coll("boolean", F.lit(not of_others) if this.kind == "empty" else (~present(this) if not of_others else F.lit(False)))
        return Coll("boolean", quantifier(to_many(this), lambda x: x if wanted else ~x))


_booleans("allTrue", F.forall, True, False)
_booleans("allFalse", F.forall, False, False)
_booleans("anyTrue", F.exists, True, True)
_booleans("anyFalse", F.exists, False, True)


@function("distinct")
def distinct(c, this, args):
    return EMPTY if this.kind == "empty" else c.distinct(this)


@function("isDistinct")
def is_distinct(c, this, args):
    return Coll("boolean", F.lit(True) if this.kind == "empty" else F.size(c.distinct(this).col) == size(this))


def _all_in(c, inner, outer):
    x, y = c.together(inner, outer)
    return Coll("boolean", F.forall(x.col, lambda v: c.is_in(y, v)))


@function("subsetOf", 1)
def subset_of(c, this, args):
    return _all_in(c, this, c.argument(args[0], this))


@function("supersetOf", 1)
def superset_of(c, this, args):
    return _all_in(c, c.argument(args[0], this), this)


@function("union", 1)
def union(c, this, args):
    return c.union(this, c.argument(args[0], this))


@function("combine", 1)
def combine(c, this, args):
    x, y = c.together(this, c.argument(args[0], this))
    return x.with_col(F.concat(x.col, y.col))


@function("intersect", 1)
def intersect(c, this, args):
    x, y = c.together(this, c.argument(args[0], this))
    return x.with_col(F.array_distinct(F.filter(x.col, lambda v: c.is_in(y, v))))


@function("exclude", 1)
def exclude(c, this, args):
    x, y = c.together(this, c.argument(args[0], this))
    return x.with_col(F.filter(x.col, lambda v: ~c.is_in(y, v)))


@function("first")
def first_(c, this, args):
    return _each_variant(this, first) if this.kind == "choice" else first(this)


@function("last")
def last(c, this, args):
    return this.with_col(F.try_element_at(this.col, F.lit(-1)), False) if this.many else this


def _number(c, node, this, name):
    got = c.one(c.argument(node, this), name)
    if got.kind == "empty":
        raise InvalidArguments(f"{name}: a number is needed")
    if got.kind != "integer":
        raise TypeMismatch(f"{name} takes an Integer")
    return got.col.cast("int")


def _slice(this, start, length):
    if this.kind == "empty":
        return EMPTY
    return Coll(this.kind, F.slice(to_many(this), start, length), True, this.dtype)


@function("tail")
def tail(c, this, args):
    return _slice(this, F.lit(2), F.greatest(size(this), F.lit(0)))


@function("skip", 1)
def skip(c, this, args):
    n = F.greatest(_number(c, args[0], this, "skip"), F.lit(0))
    return _slice(this, n + 1, size(this))


@function("take", 1)
def take(c, this, args):
    return _slice(this, F.lit(1), F.greatest(_number(c, args[0], this, "take"), F.lit(0)))


@function("single")
def single(c, this, args):
    if this.kind == "empty":
        return EMPTY
    if not this.many:
        if c.spec or not c.strict or this.col is None:
            return this
        return this.with_col(F.when(this.col.isNull(), F.raise_error(F.lit("single: no item"))).otherwise(this.col))
    wrong = (lambda x: F.size(x) > 1) if c.spec else (lambda x: F.size(x) != 1)
    return this.with_col(let(this.col, lambda x: c.fail(wrong(x), "single: one item expected", F.get(x, F.lit(0)))), False)


@function("ofType", 1)
def of_type(c, this, args):
    return c.as_type(this, type_name_of(args[0]))


@function("is", 1)
def is_(c, this, args):
    return c.is_type(c.one(this, "is"), type_name_of(args[0]))


@function("as", 1)
def as_(c, this, args):
    return c.as_type(c.one(this, "as"), type_name_of(args[0]))


@function("not")
def not_(c, this, args):
    return Coll("boolean", ~c.boolean(this))


@function("hasValue")
def has_value(c, this, args):
    if this.kind == "choice":
        out = F.lit(False)
        for _, v in this.variants:
            out = out | has_value(c, v, args).col
        return Coll("boolean", out)
    primitive = this.kind in TYPE_NAMES and this.kind != "quantity"
    return Coll("boolean", present(this) if primitive else F.lit(False))


@function("getValue")
def get_value(c, this, args):
    if this.kind == "choice":
        kept = tuple((s, v) for s, v in this.variants if v.kind in TYPE_NAMES and v.kind != "quantity")
        return EMPTY if not kept else kept[0][1] if len(kept) == 1 else replace(this, variants=kept)
    return this if this.kind in TYPE_NAMES and this.kind != "quantity" else EMPTY
