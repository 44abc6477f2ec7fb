"""Functions of numbers; they take the first item, and anything else gives nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpath.functions.registry import function
from lumenpath.plans.coll import EMPTY, NUMERIC, Coll, choice_item, first


def _operand(this):
    this = choice_item(this, "decimal")
    return first(this) if this.kind in NUMERIC else None


def _unary(name, apply, kind="decimal", same=False):
    @function(name)
    def build(c, this, args):
        x = _operand(this)
        if x is None:
            return EMPTY
        if same and x.kind == "integer":
            return Coll("integer", apply(x.col) if name == "abs" else x.col)
        return Coll(x.kind if same and kind is None else kind, apply(x.col))


_unary("abs", F.abs, "decimal", same=True)
_unary("ceiling", lambda x: F.ceil(x).cast("long"), "integer", same=True)
_unary("floor", lambda x: F.floor(x).cast("long"), "integer", same=True)
_unary("truncate", lambda x: x.cast("long"), "integer", same=True)
_unary("exp", lambda x: F.exp(x.cast("double")))
_unary("ln", lambda x: F.when(x > 0, F.ln(x.cast("double"))))
_unary("sqrt", lambda x: F.when(x >= 0, F.sqrt(x.cast("double"))))


@function("round", 0, 1)
def round_(c, this, args):
    x = _operand(this)
    if x is None or x.kind == "integer":
        return x or EMPTY
    places = first(c.argument(args[0], this)) if args else Coll("integer", F.lit(0), literal=0)
    if isinstance(places.literal, int):
        return Coll("decimal", F.round(x.col, places.literal))
    scale = F.pow(F.lit(10.0), places.col)
    return Coll("decimal", F.signum(x.col) * F.floor(F.abs(x.col) * scale + 0.5) / scale)


def _finite(x):
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


@function("log", 1)
def log(c, this, args):
    x, base = _operand(this), _operand(c.argument(args[0], this))
    if x is None or base is None:
        return EMPTY
    good = (x.col > 0) & (base.col > 0) & (base.col != 1)
    return Coll("decimal", F.when(good, F.ln(x.col.cast("double")) / F.ln(base.col.cast("double"))))


@function("power", 1)
def power(c, this, args):
    x, e = _operand(this), _operand(c.argument(args[0], this))
    return EMPTY if x is None or e is None else Coll("decimal", _finite(F.pow(x.col.cast("double"), e.col.cast("double"))))
