"""Sources of documents: files of JSON, tables' rows, and views of the relational test tables as documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpath.sources.definitions import Registry, schema_of


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """Documents of JSON files: one a line, or one (or an array of them) a file. A schema saves a pass over the files."""
    reader = spark.read.option("multiLine", str(not lines).lower()).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Documents as raw JSON texts in `json`, for schema-less evaluation."""
    return spark.read.option("wholetext", str(whole).lower()).text(path).select(F.col("value").alias("json"))


def parse(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """The fields of JSON texts as columns; texts that are no JSON give nulls."""
    return df.withColumn("_doc", F.from_json(column, schema, {"mode": "PERMISSIVE"})).select(*[c for c in df.columns if c != column], "_doc.*")


def inferred_schema(df: DataFrame, column: str) -> str:
    """The schema that all JSON texts of a column have together, found in one pass over them as variants; what differs in type is a text."""
    found = df.select(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"] or ""
    shape = re.sub(r"\b(VARIANT|VOID)\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", found))
    return shape if shape.startswith("STRUCT<") and shape != "STRUCT<>" else "STRUCT<resourceType: STRING>"


def inferred(df: DataFrame, column: str) -> DataFrame:
    """The fields of JSON texts without a known schema as columns, so that expressions over them compile."""
    shape = inferred_schema(df, column)
    return df.withColumn("_doc", F.from_json(column, shape, {"mode": "PERMISSIVE"})).select(*[F.col(f"`{c}`") for c in df.columns if c != column], "_doc.*")


def by_type(df: DataFrame, column: str, registry: Registry, types: list[str]) -> dict[str, DataFrame]:
    """Frames with the typed fields of each type's documents, out of JSON texts of many types. An unknown type is an error."""
    kind, out = F.get_json_object(column, "$.resourceType"), {}
    for name in types:
        if registry.of_type(name) is None:
            raise KeyError(f"unknown resource type: {name}")
        out[name] = parse(df.where(kind == name), column, schema_of(registry, name))
    return out


def summary(df: DataFrame, registry: Registry, type_name: str) -> DataFrame:
    """The columns that belong to the type's summary, with type and id; choices in all their types."""
    fields = registry.summary_fields(type_name)
    keep = [c for c in df.columns if c in ("resourceType", "id") or any(c == f or (c.startswith(f) and c[len(f) :][:1].isupper()) for f in fields)]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as Patient documents. Nations are 25 rows by definition, so Spark broadcasts them."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = _read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    no = F.lit(None)
    return c.select(
        F.lit("Patient").alias("resourceType"),
        F.col("c_custkey").cast("string").alias("id"),
        (F.col("c_acctbal") > 0).alias("active"),
        F.array(
            F.struct(F.lit("official").alias("use"), F.col("c_name").alias("family"), no.cast("array<string>").alias("given")),
            F.struct(F.lit("usual").alias("use"), no.cast("string").alias("family"), F.array("c_mktsegment").alias("given")),
        ).alias("name"),
        F.array(F.struct(F.col("n_name").alias("country"))).alias("address"),
        F.array(F.struct(F.lit("http://example.org/balance").alias("url"), F.col("c_acctbal").cast("double").alias("valueDecimal"))).alias("extension"),
        F.struct(text("Organization/", F.col("c_nationkey").cast("string")).alias("reference")).alias("managingOrganization"),
        F.col("c_custkey").cast("long").alias("number"),
        F.col("c_acctbal").cast("double").alias("balance"),
    )


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as Encounter documents."""
    o = _read(spark, sf_dir, "orders")
    return o.select(
        F.lit("Encounter").alias("resourceType"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "planned").when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "P", "in-progress").alias("status"),
        F.struct(F.concat(F.lit("Patient/"), F.col("o_custkey").cast("string")).alias("reference")).alias("subject"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("start")).alias("period"),
        F.struct(F.array(F.struct(F.col("o_orderpriority").alias("code"))).alias("coding")).alias("priority"),
        F.col("o_totalprice").cast("double").alias("total"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as Observation documents; their value is a quantity, or a text where the item was returned."""
    li = _read(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    measured = F.col("l_returnflag") != "R"
    quantity = F.struct(F.col("l_quantity").cast("double").alias("value"), F.lit("kg").alias("unit"), F.lit("kg").alias("code"))
    component = lambda code, column: F.struct(F.lit(code).alias("code"), F.col(column).cast("double").alias("value"))
    return li.select(
        F.lit("Observation").alias("resourceType"),
        key.alias("id"),
        F.when(measured, quantity).alias("valueQuantity"),
        F.when(~measured, F.col("l_returnflag")).alias("valueString"),
        F.struct(F.concat(F.lit("Encounter/"), F.col("l_orderkey").cast("string")).alias("reference")).alias("encounter"),
        F.array(component("price", "l_extendedprice"), component("discount", "l_discount"), component("tax", "l_tax")).alias("component"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("effectiveDateTime"),
        F.col("l_quantity").cast("long").alias("count"),
        F.col("l_extendedprice").cast("double").alias("price"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_orderkey").cast("long").alias("order"),
    )


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as Bundle documents."""
    o = observations(spark, sf_dir).select("order", F.struct(F.concat(F.lit("urn:x:"), "id").alias("fullUrl"), F.struct("resourceType", "id", "valueQuantity", "valueString", "component", "line").alias("resource")).alias("entry"))
    grouped = o.groupBy("order").agg(F.sort_array(F.collect_list("entry")).alias("entry"))
    return grouped.select(F.lit("Bundle").alias("resourceType"), F.col("order").cast("string").alias("id"), F.lit("collection").alias("type"), "entry")
