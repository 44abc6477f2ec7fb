"""References between documents: their syntax, and joins that resolve them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpath.functions.navigation import reference_key, reference_text
from lumenpath.operators.evaluate import compiler
from lumenpath.plans.coll import Coll, to_many

#: Forms of references, in the order in which they are tried; a whole text has to match, a newline at its end included.
CONTAINED = r"#([A-Za-z0-9\-.]+)"
RELATIVE = r"([A-Za-z]+)/([A-Za-z0-9\-.]+)"
URN_UUID = r"urn:uuid:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
URN_OID = r"urn:oid:[012](\.\d+)+"
ABSOLUTE = r"https?://[^/]+/.*/([A-Za-z]+)/([A-Za-z0-9\-.]+)"


def matched(form: str, text: str) -> re.Match | None:
    return re.fullmatch(form, text, re.ASCII)


def _whole(form: str) -> str:
    return rf"\A{form}\z"


def parse_reference(text: Column) -> Column:
    """<form, resource_type, id, version> of a reference."""
    web = text.rlike(r"\Ahttps?://")
    fits = lambda p: text.rlike(_whole(p))
    form = (
        F.when(fits(CONTAINED), "contained").when(fits(RELATIVE), "relative").when(fits(URN_UUID), "uuid").when(fits(URN_OID), "oid")
        .when(fits(ABSOLUTE), "absolute").when(web, "canonical").otherwise("invalid")
    )
    part = lambda p, k: F.nullif(F.regexp_extract(text, _whole(p), k), F.lit(""))
    id_ = F.coalesce(part(CONTAINED, 1), part(RELATIVE, 2), part(ABSOLUTE, 2), F.when(fits(URN_UUID) | fits(URN_OID), F.substring_index(text, ":", -1)))
    version = F.when(form == "canonical", F.when(F.contains(text, F.lit("|")), F.substring_index(text, "|", -1)))
    return F.when(text.isNotNull(), F.struct(form.alias("form"), F.coalesce(part(RELATIVE, 1), part(ABSOLUTE, 1)).alias("resource_type"), id_.alias("id"), version.alias("version")))


def resolve(df: DataFrame, expression: str, documents: DataFrame, key: str, keep: tuple = (), **options) -> DataFrame:
    """The documents that the expression's references name: keep columns, pos, reference, document (null where there is none).

    documents has their Type/id in `key`. An equi-join on it: both sides are shuffled by key, or the smaller is broadcast by its size.
    """
    c = compiler(df, **options)
    found = reference_text(c.compile(expression))
    refs = df.select(*[F.col(f"`{k}`") for k in keep], F.posexplode(to_many(found)).alias("pos", "reference"))
    refs = refs.withColumn("_key", reference_key(F.col("reference")))
    target = documents.select(F.col(f"`{key}`").alias("_key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"))
    return refs.join(target, "_key", "left").drop("_key")


def with_resolved(df: DataFrame, expression: str, documents: DataFrame, key: str, row_id: str, **options) -> tuple[DataFrame, dict]:
    """df with the documents that its references name, and the variables with which resolve() finds them in expressions."""
    found = resolve(df, expression, documents, key, (row_id,), **options).where("document IS NOT NULL")
    maps = found.select(row_id, reference_key(F.col("reference")).alias("k"), "document").dropDuplicates([row_id, "k"])
    maps = maps.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("k", "document"))).alias("_resolved"))
    out = df.join(maps, row_id, "left")
    dtype = next(f.dataType for f in maps.schema.fields if f.name == "_resolved")
    assert isinstance(dtype, T.MapType)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(T.ArrayType(dtype.valueType)))
    return out, {"__resolved": Coll("object", F.coalesce(F.col("_resolved"), empty), False, dtype.valueType)}


def missing(df: DataFrame, expression: str, documents: DataFrame, key: str, keep: tuple = (), **options) -> DataFrame:
    """References that name no document: an anti-join."""
    c = compiler(df, **options)
    refs = df.select(*[F.col(f"`{k}`") for k in keep], F.explode(to_many(reference_text(c.compile(expression)))).alias("reference"))
    known = documents.select(F.col(f"`{key}`").alias("_key"))
    return refs.withColumn("_key", reference_key(F.col("reference"))).join(known, "_key", "left_anti").drop("_key")
