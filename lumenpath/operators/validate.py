"""Validation of frames of documents.

Documents are validated one by one in Arrow batches: no shuffle, one pass, whatever rules are on. What concerns several
documents, such as references between them, is a join (operators.references). Definitions and value sets are bounded by the specification and sent with the plan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpath.rules.model import Options
from lumenpath.rules.validate import Validator
from lumenpath.shipping import ship
from lumenpath.sources.definitions import Registry
from lumenpath.sources.terminology import Terminology

_COLUMNS = ("severity", "code", "diagnostics", "expression")


def issues(df: DataFrame, json_column: str, registry: Registry, options: Options | None = None, terminology: Terminology | None = None, keep: tuple = ()) -> DataFrame:
    """One row for each issue: the columns to keep, severity, code, diagnostics, expression."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(c, T.StringType()) for c in _COLUMNS])
    own = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{json_column}`").alias("_json"))

    def run(batches):
        validator = Validator(registry, options, terminology)
        for batch in batches:
            rows, found = [], []
            for i, document in enumerate(batch.column(len(keep)).to_pylist()):
                for issue in validator.validate(document):
                    rows.append(i)
                    found.append((issue.severity, issue.code, issue.diagnostics, issue.expression))
            at = pa.array(rows, pa.int64())
            kept = [batch.column(k).take(at) for k in range(len(keep))]
            made = [pa.array([f[c] for f in found], pa.string()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, *_COLUMNS])

    return own.mapInArrow(run, schema)


def summary(found: DataFrame, *by: str) -> DataFrame:
    """Counts by document: errors, warnings, valid. Documents without issues have no row; join them where they are needed."""
    bad = F.col("severity").isin("fatal", "error")
    return found.groupBy(*by).agg(F.count_if(bad).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (F.count_if(bad) == 0).alias("valid"))
