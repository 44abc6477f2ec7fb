"""Conversions of the first item, their tests, and iif."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpath.functions.registry import function
from lumenpath.functions.units import canonical, one_of
from lumenpath.plans import temporal
from lumenpath.plans.coll import EMPTY, NUMERIC, Coll, as_quantity, choice_item, first, is_quantity, present

#: Texts that are Booleans, ignoring case.
TRUE, FALSE = ("true", "t", "yes", "y", "1", "1.0"), ("false", "f", "no", "n", "0", "0.0")


@function("iif", 2, 3)
def iif(c, this, args):
    test = F.coalesce(c.boolean(c.argument(args[0], this)), F.lit(False))
    yes = c.argument(args[1], this)
    no = c.argument(args[2], this) if len(args) > 2 else EMPTY
    if yes.kind == no.kind == "empty":
        return EMPTY
    if yes.many or no.many or yes.kind != no.kind:
        if "empty" not in (yes.kind, no.kind) or yes.many or no.many:
            if not yes.many and not no.many and {yes.kind, no.kind} <= NUMERIC:
                return Coll("decimal", F.when(test, yes.col.cast("double")).otherwise(no.col.cast("double")))
            x, y = c.together(yes, no)
            merged = F.when(test, x.col).otherwise(y.col)
            return x.with_col(merged) if yes.many or no.many else x.with_col(F.get(merged, F.lit(0)), False)
    if no.kind == "empty":
        return yes.with_col(F.when(test, yes.col))
    if yes.kind == "empty":
        return no.with_col(F.when(~test, no.col))
    return yes.with_col(F.when(test, yes.col).otherwise(no.col))


def _item(this):
    """The first item; of a choice the variant that is there, as far as one type can hold it."""
    return first(choice_item(this, "string"))


def _boolean(x):
    if x.kind == "boolean":
        return x.col
    if x.kind in NUMERIC:
        return F.when(x.col == 1, True).when(x.col == 0, False)
    if x.kind == "string":
        low = F.lower(x.col)
        return F.when(one_of(low, TRUE), True).when(one_of(low, FALSE), False)
    return None


def _integer(x):
    if x.kind == "integer":
        return x.col
    if x.kind == "boolean" or x.kind == "decimal":
        return x.col.cast("long")
    if x.kind == "string":
        return F.when(x.col.rlike(r"^[+-]?\d+$"), x.col.try_cast("long"))
    return None


def _decimal(x):
    if x.kind in NUMERIC or x.kind == "boolean":
        return x.col.cast("double") if x.kind != "boolean" else x.col.cast("int").cast("double")
    if x.kind == "string":
        return F.when(x.col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.col.try_cast("double"))
    return None


def _conversion(name, kind, convert):
    @function(f"to{name}")
    def to(c, this, args):
        x = _item(this)
        got = None if x.kind == "empty" else convert(x)
        return EMPTY if got is None else Coll(kind, got)

    @function(f"convertsTo{name}")
    def converts(c, this, args):
        x = _item(this)
        if x.kind == "empty":
            return EMPTY
        got = convert(x)
        return Coll("boolean", F.when(present(x), F.lit(False) if got is None else got.isNotNull()))


_conversion("Boolean", "boolean", _boolean)
_conversion("Integer", "integer", _integer)
_conversion("Decimal", "decimal", _decimal)


@function("toString")
def to_string(c, this, args):
    x = _item(this)
    return EMPTY if x.kind == "empty" else Coll("string", c.text(x))


@function("convertsToString")
def converts_to_string(c, this, args):
    x = _item(this)
    return EMPTY if x.kind == "empty" else Coll("boolean", F.when(present(x), F.lit(x.kind in ("string", "boolean", *NUMERIC))))


@function("toDate")
def to_date(c, this, args):
    x = _item(this)
    if x.kind == "string":
        return Coll("date", temporal.parse_date(x.col))
    if x.kind == "date":
        return x
    if x.kind == "datetime":
        return Coll("date", F.when(x.col.isNotNull(), F.struct(*[x.col[n].alias(n) for n in ("y", "m", "d")])))
    return EMPTY


def _is_text(name):
    @function(name)
    def build(c, this, args):
        x = _item(this)
        return EMPTY if x.kind == "empty" else Coll("boolean", F.when(present(x), F.lit(x.kind == "string")))


def _temporal(name, kind, parse):
    @function(f"to{name}")
    def to(c, this, args):
        x = _item(this)
        if x.kind == "string":
            return Coll(kind, parse(x.col)) if c.spec else x  # observed behaviour: the text as it is
        return x if c.spec and x.kind == kind else EMPTY


_temporal("DateTime", "datetime", temporal.parse_datetime)
_temporal("Time", "time", temporal.parse_time)
for _name in ("convertsToDate", "convertsToDateTime", "convertsToTime"):
    _is_text(_name)


def _quantity(c, this, args):
    x, unit = _item(this), first(c.argument(args[0], this)) if args else None
    if is_quantity(x):
        return as_quantity(x).col
    if x.kind in NUMERIC:
        made = F.struct(x.col.cast("double").alias("value"), (unit.col if unit is not None and unit.kind == "string" else F.lit("")).alias("unit"))
        return F.when(x.col.isNotNull(), made)
    if x.kind == "string":
        at = lambda k: F.regexp_extract(x.col, r"^\s*([+-]?\d+\.?\d*)\s*(?:'([^']*)'|([A-Za-z]+))?\s*$", k)
        value = F.nullif(at(1), F.lit("")).try_cast("double")
        return F.when(value.isNotNull(), F.struct(value.alias("value"), F.concat(at(2), at(3)).alias("unit")))
    return None


@function("toQuantity", 0, 1)
def to_quantity(c, this, args):
    got = _quantity(c, this, args)
    return EMPTY if got is None else Coll("quantity", got)


@function("convertsToQuantity", 0, 1)
def converts_to_quantity(c, this, args):
    x = _item(this)
    if x.kind == "empty":
        return EMPTY
    got = _quantity(c, this, args)
    if got is None:
        return Coll("boolean", F.when(present(x), F.lit(False)))
    good = got.isNotNull()
    if args and x.kind not in NUMERIC:
        unit = first(c.argument(args[0], this))
        good = good & (canonical(got["unit"])[0] == canonical(unit.col, unit.literal)[0])
    return Coll("boolean", F.when(present(x), F.coalesce(good, F.lit(False))))


