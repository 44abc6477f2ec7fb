"""Expressions over frames of documents: each row is a document, its columns are the document's fields."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpath.lang.errors import TypeMismatch
from lumenpath.plans.coll import Coll, first, present, size, to_many
from lumenpath.plans.compiler import Compiler, document

#: The limit on items that where() and select() get, as in the option mode of evaluation.
MAX_ITEMS = 10_000


def compiler(df: DataFrame, resource_type: str | None = None, variables: dict | None = None, **modes) -> Compiler:
    return Compiler(document(df, resource_type), variables, **modes)


def result(c: Compiler, got: Coll, form: str = "items") -> Column:
    """A collection as a column.

    items: an array of its items, boolean/integer/decimal/string: its first item of that kind, text: its first item as text,
    texts: all items as text, exists, count, json: an array of native scalars and texts.
    """
    if form == "items":
        if got.kind == "choice":
            return c.texts(got).col
        return to_many(got)
    if form == "exists":
        return present(got)
    if form == "count":
        return size(got).cast("long")
    if form == "texts":
        return F.array().cast("array<string>") if got.kind == "empty" else c.texts(got).col
    if form == "text":
        return F.get(result(c, got, "texts"), F.lit(0)) if got.kind == "choice" or got.kind == "empty" else c.text(first(got))
    if form == "json":
        scalar = got.kind in ("boolean", "integer", "string")
        return F.to_json(to_many(got) if scalar else result(c, got, "texts"))
    if form == "boolean":
        return c.boolean(got)
    wanted = {"integer": ("integer",), "decimal": ("integer", "decimal"), "string": ("string",)}.get(form)
    if wanted is None:
        raise TypeMismatch(f"unknown form: {form}")
    from lumenpath.plans.coll import SPARK_TYPES, choice_item, none

    got = choice_item(got, form)
    return first(got).col.cast(SPARK_TYPES[form]) if got.kind in wanted else none(form)


def select(df: DataFrame, columns: dict[str, str | tuple[str, str]], keep: tuple = (), **options) -> DataFrame:
    """One column for each expression, or (expression, form), besides the columns to keep."""
    c = compiler(df, **options)
    made = []
    for k, what in enumerate(columns.values()):
        expression, form = (what, "items") if isinstance(what, str) else what
        made.append(result(c, c.compile(expression), form).alias(f"_made{k}"))
    found = df.select(*[F.col(f"`{k}`") for k in keep], *made)  # names of their own: an alias like a field's name would stand for the field in lambdas
    return found.select(*[F.col(f"`{k}`") for k in keep], *[F.col(f"_made{k}").alias(name) for k, name in enumerate(columns)])


def where(df: DataFrame, expression: str, **options) -> DataFrame:
    """The documents for which the expression is true."""
    c = compiler(df, **options)
    return df.where(F.coalesce(c.boolean(c.compile(expression)), F.lit(False)))


def explode(df: DataFrame, expression: str, keep: tuple = (), **options) -> DataFrame:
    """One row for each item: the columns to keep, pos, value."""
    c = compiler(df, **options)
    return df.select(*[F.col(f"`{k}`") for k in keep], F.posexplode(result(c, c.compile(expression))).alias("pos", "value"))


def as_json(df: DataFrame) -> Column:
    """Each row as a JSON document, so that any table's rows can be read as documents."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def lines(items: list) -> str:
    """A result as text for people: (empty), the item, or numbered items."""
    if not items:
        return "(empty)"
    shown = [i if isinstance(i, str) else json.dumps(i, default=str) for i in items]
    return shown[0] if len(shown) == 1 else "\n".join(f"[{k}] {s}" for k, s in enumerate(shown))


