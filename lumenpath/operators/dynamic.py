"""Expressions over JSON texts without a schema, in Arrow batches. Use operators.evaluate where the schema is known: it stays in the JVM."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenpath.interp.evaluator import evaluate
from lumenpath.interp.values import load, text
from lumenpath.lang.errors import PathError
from lumenpath.lang.parser import parse
from lumenpath.shipping import ship


def native(x):
    """An item as JSON knows it: Booleans, Integers and Strings as they are, others as text."""
    return x if isinstance(x, (bool, int, str)) else text(x)


def select(df: DataFrame, json_column: str, columns: dict[str, str], strict: bool = False, **options) -> DataFrame:
    """df with an array of texts for each expression. Without strict, an error gives an empty result for its row."""
    ship(df.sparkSession)
    for expression in columns.values():
        parse(expression)  # errors of syntax show before any row is read
    names = [f for f in df.schema.fieldNames() if f not in columns]
    schema = T.StructType([df.schema[n] for n in names] + [T.StructField(k, T.ArrayType(T.StringType())) for k in columns])

    def of(expression, document):
        try:
            return [text(x) for x in evaluate(expression, document, **options)]
        except (PathError, ArithmeticError, ValueError):
            if strict:
                raise
            return []

    def run(batches):
        for batch in batches:
            documents = batch.column(batch.schema.get_field_index(json_column)).to_pylist()
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            made = [pa.array([of(e, d) for d in documents], pa.list_(pa.string())) for e in columns.values()]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, *columns])

    return df.mapInArrow(run, schema)


class Document:
    """A document that is read once and asked often."""

    def __init__(self, text: str | bytes | dict, **options):
        self.value, self.options = load(text) if isinstance(text, (str, bytes)) else text, options

    def evaluate(self, expression: str) -> list:
        return evaluate(expression, self.value, **self.options)

    def json(self, expression: str) -> str:
        return json.dumps([native(x) for x in self.evaluate(expression)])


def evaluate_json(expression: str, document: str, **options) -> str:
    """The result over one document, as a JSON array."""
    return json.dumps([native(x) for x in evaluate(expression, document, **options)])


