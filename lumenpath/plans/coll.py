"""Collections at compile time.

A collection of at most one item is a nullable column (null: empty); one of many items is an array column, never null and without null elements.
Kinds of items and their columns:
    boolean, integer (long), decimal (double), string; date <y, m, d>; time <h, mi, s, ms>; datetime <y, m, d, h, mi, s, ms, off>;
    quantity <value double, unit string>; object (a struct); choice (several typed variants of one element); empty.
Decimals are doubles, rounded to 12 places after + - *, so that decimal fractions add up as written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = ("y", "m", "d")
TIME = ("h", "mi", "s", "ms")
DATETIME = (*DATE, *TIME, "off")
PARTS = {"date": DATE, "time": TIME, "datetime": DATETIME}
NUMERIC = {"integer", "decimal"}
TYPE_NAMES = {"boolean": "Boolean", "integer": "Integer", "decimal": "Decimal", "string": "String", "date": "Date", "datetime": "DateTime", "time": "Time", "quantity": "Quantity"}
SPARK_TYPES = {
    "boolean": "boolean",
    "integer": "bigint",
    "decimal": "double",
    "string": "string",
    "date": "struct<y:int,m:int,d:int>",
    "time": "struct<h:int,mi:int,s:int,ms:int>",
    "datetime": "struct<y:int,m:int,d:int,h:int,mi:int,s:int,ms:int,off:int>",
    "quantity": "struct<value:double,unit:string>",
}


@dataclass(frozen=True)
class Coll:
    kind: str
    col: Column | None = None
    many: bool = False
    dtype: T.StructType | None = None
    #: Name of a literal's unit or string, where it is known when the plan is made.
    literal: object = None
    #: (suffix, collection) of a choice.
    variants: tuple = ()
    #: Columns of a document that is no struct: {name: (column, type)}.
    fields: dict | None = field(default=None, compare=False)
    #: Holds for the rows whose document has the type that the path starts with.
    guard: Column | None = None

    def with_col(self, col: Column, many: bool | None = None) -> Coll:
        return replace(self, col=col, many=self.many if many is None else many, literal=None)


EMPTY = Coll("empty")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none(kind: str = "string") -> Column:
    return F.lit(None).cast(SPARK_TYPES.get(kind, "string"))


def to_many(c: Coll) -> Column:
    """The items as an array."""
    if c.kind == "empty":
        return F.array().cast("array<string>")
    if c.many:
        return c.col
    return F.array_compact(F.array(object_column(c)))


def object_column(c: Coll) -> Column:
    """The item as one column; a document's columns become a struct only where one is needed."""
    if c.col is None and c.fields is not None:
        made = F.struct(*[col.alias(n) for n, (col, _) in c.fields.items()])
        return made if c.guard is None else F.when(c.guard, made)
    return c.col


def first(c: Coll) -> Coll:
    return c.with_col(F.get(c.col, F.lit(0)), False) if c.many else c


def size(c: Coll) -> Column:
    if c.kind == "empty":
        return F.lit(0)
    if c.kind == "choice":
        return sum((size(v) for _, v in c.variants), F.lit(0))
    if c.many:
        return F.size(c.col)
    return F.when(present(c), 1).otherwise(0)


def present(c: Coll) -> Column:
    """Not empty; never null."""
    if c.kind == "empty":
        return F.lit(False)
    if c.kind == "choice":
        out = F.lit(False)
        for _, v in c.variants:
            out = out | present(v)
        return out
    if c.many:
        return F.size(c.col) > 0
    if c.col is None:
        return F.lit(True) if c.guard is None else F.coalesce(c.guard, F.lit(False))
    return c.col.isNotNull()


def of_type(column: Column, dtype: T.DataType) -> tuple[str, Column, T.StructType | None]:
    """(kind, column in that kind's form, struct type) of a document's column."""
    if isinstance(dtype, T.BooleanType):
        return "boolean", column, None
    if isinstance(dtype, T.IntegralType):
        return "integer", column if isinstance(dtype, T.LongType) else column.cast("long"), None
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "decimal", column if isinstance(dtype, T.DoubleType) else column.cast("double"), None
    if isinstance(dtype, T.DateType):
        return "date", F.when(column.isNotNull(), F.struct(F.year(column).alias("y"), F.month(column).alias("m"), F.dayofmonth(column).alias("d"))), None
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        ms = (F.extract(F.lit("SECOND"), column) * 1000 % 1000).cast("int")
        parts = [F.year(column), F.month(column), F.dayofmonth(column), F.hour(column), F.minute(column), F.second(column), ms, F.lit(0)]
        return "datetime", F.when(column.isNotNull(), F.struct(*[p.cast("int").alias(n) for p, n in zip(parts, DATETIME, strict=True)])), None
    if isinstance(dtype, T.StructType):
        return "object", column, dtype
    if isinstance(dtype, T.StringType):
        return "string", column, None
    return "string", column.cast("string"), None


def child(base: Coll, name: str) -> Coll | None:
    """Field `name` of the object(s), or None where the schema has none."""
    if base.fields is not None:
        if name not in base.fields:
            return None
        column, dtype = base.fields[name]
        pick = lambda: column
    else:
        if base.dtype is None or name not in base.dtype.names:
            return None
        dtype = base.dtype[name].dataType
        pick = lambda: base.col[name]
    if isinstance(dtype, T.NullType):
        return Coll("empty")
    repeated = isinstance(dtype, T.ArrayType)
    inner = dtype.elementType if repeated else dtype
    if isinstance(inner, T.ArrayType):  # an array in an array is dropped
        return Coll("empty")
    kind, _, struct = of_type(F.lit(None), inner)
    convert = lambda x: of_type(x, inner)[1]
    plain = isinstance(inner, (T.BooleanType, T.LongType, T.DoubleType, T.StringType, T.StructType))
    if base.many:
        if repeated:
            got = F.flatten(F.transform(base.col, lambda x: F.coalesce(x[name], F.array().cast(dtype))))
        else:
            got = F.transform(base.col, lambda x: x[name])
        got = F.array_compact(got)
        return Coll(kind, got if plain else F.transform(got, convert), True, struct)
    value = pick()
    if repeated:
        if base.guard is not None:
            value = F.when(base.guard, value)
        value = F.array_compact(F.coalesce(value, F.array().cast(dtype)))
        return Coll(kind, value if plain else F.transform(value, convert), True, struct)
    value = convert(value)
    return Coll(kind, value if base.guard is None else F.when(base.guard, value), False, struct)


def choice_item(c: Coll, kind: str) -> Coll:
    """The variant of a choice that fits an operand of `kind`, or its first one."""
    if c.kind != "choice":
        return c
    numeric = {"integer", "decimal"}
    fits = [v for _, v in c.variants if v.kind == kind or (v.kind in numeric and kind in numeric) or (kind == "quantity" and is_quantity(v))]
    return fits[0] if fits else c.variants[0][1]


def is_quantity(c: Coll) -> bool:
    """An object that has a quantity's fields."""
    return c.kind == "quantity" or (c.kind == "object" and c.dtype is not None and "value" in c.dtype.names and bool({"unit", "code", "system"} & set(c.dtype.names)))


def as_quantity(c: Coll) -> Coll:
    """A JSON quantity as a quantity: its unit, else its code."""
    if c.kind != "object" or not is_quantity(c):
        return c
    unit = F.lit(None).cast("string")
    for name in ("unit", "code"):
        if name in c.dtype.names:
            unit = F.coalesce(unit, c.col[name].cast("string"))
    value = c.col["value"].cast("double")
    return Coll("quantity", F.when(value.isNotNull(), F.struct(value.alias("value"), F.coalesce(unit, F.lit("")).alias("unit"))), c.many)
