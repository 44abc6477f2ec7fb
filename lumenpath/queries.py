"""Registered queries over the test tables' documents, each with SQL for the same result.

A query names a view of documents, columns made by expressions (expression, form), and SQL written against the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenpath import rule_queries
from lumenpath.operators import evaluate, references
from lumenpath.sources import documents

VIEWS = {"Patient": documents.patients, "Encounter": documents.encounters, "Observation": documents.observations, "Bundle": documents.bundles}

_PATIENT = "FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
_ORDERS = "FROM orders"
_ITEMS = "FROM lineitem"
_KEY = {
    "Patient": ("CAST(c_custkey AS VARCHAR) AS id", _PATIENT),
    "Encounter": ("CAST(o_orderkey AS VARCHAR) AS id", _ORDERS),
    "Observation": ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id", _ITEMS),
}


@dataclass(frozen=True)
class Query:
    view: str
    columns: dict[str, tuple[str, str]]
    sql: dict[str, str] | str | None
    options: dict | None = None
    where: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = VIEWS[self.view](spark, sf_dir)
        if self.where:
            df = evaluate.where(df, self.where)
        return evaluate.select(df, self.columns, ("id",), **(self.options or {}))

    def oracle(self) -> str | None:
        if not isinstance(self.sql, dict):
            return self.sql
        key, source = _KEY[self.view]
        return f"SELECT {key}, {', '.join(f'{v} AS {k}' for k, v in self.sql.items())} {source}"


def _q(view: str, **columns: tuple[str, str, str]) -> Query:
    """columns: name = (expression, form, SQL)."""
    return Query(view, {k: v[:2] for k, v in columns.items()}, {k: v[2] for k, v in columns.items()})


_OVERFLOW = "(date_trunc('month', {d}) + INTERVAL {n} MONTH)::DATE + (day({d}) - 1)::INTEGER"
_SHIP, _ORDER = "l_shipdate::DATE", "o_orderdate::DATE"
_PARTS = "[l_extendedprice::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]"

QUERIES: dict[str, Query] = {
    "nav_family": _q("Patient", v=("Patient.name.family", "text", "c_name"), given=("name.given", "text", "c_mktsegment"), n=("Patient.name", "count", "2::BIGINT")),
    "nav_index": _q("Patient", v=("name[1].given[0]", "text", "c_mktsegment"), none=("name[7]", "exists", "false"), country=("address[0].country", "text", "n_name")),
    "nav_choice": _q("Observation", v=("value.unit", "text", "CASE WHEN l_returnflag <> 'R' THEN 'kg' END"), t=("value.ofType(string)", "text", "CASE WHEN l_returnflag = 'R' THEN 'R' END"), e=("Observation.value", "exists", "true")),
    "nav_other_type": _q("Patient", v=("Observation.id", "exists", "false"), w=("DomainResource.id", "text", "CAST(c_custkey AS VARCHAR)")),
    "nav_this_index": _q("Patient", v=("name.where($index = 1).given", "text", "c_mktsegment"), w=("name.select($this.use)", "count", "2::BIGINT"), x=("id.select($this & '!')", "text", "c_custkey || '!'")),
    "nav_extension": _q("Patient", v=("extension('http://example.org/balance').value", "decimal", "c_acctbal::DOUBLE"), h=("hasExtension('http://example.org/other')", "boolean", "false"), g=("getExtensionValue('http://example.org/balance')", "decimal", "c_acctbal::DOUBLE")),
    "filter_where": _q("Patient", v=("name.where(use = 'official').family", "text", "c_name"), n=("name.where(family.exists())", "count", "1::BIGINT"), no=("name.where(use = 'old')", "exists", "false")),
    "filter_exists_all": _q(
        "Observation",
        e=("component.where(value > 0.05).exists()", "boolean", f"len(list_filter({_PARTS}, lambda x: x > 0.05)) > 0"),
        a=("component.all(value < 0.08)", "boolean", f"len(list_filter({_PARTS}, lambda x: x < 0.08)) = 3"),
        x=("component.exists(code = 'tax' and value = 0)", "boolean", "l_tax = 0"),
        m=("component.value.empty()", "boolean", "false"),
    ),
    "filter_documents": Query("Encounter", {"status": ("status", "text")}, "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'finished' AS status FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000", where="status = 'finished' and total > 100000"),
    "filter_type": _q(
        "Observation",
        q=("value is Quantity", "boolean", "l_returnflag <> 'R'"),
        s=("value is string", "boolean", "l_returnflag = 'R'"),
        o=("value.ofType(Quantity).value", "decimal", "CASE WHEN l_returnflag <> 'R' THEN l_quantity::DOUBLE END"),
        r=("$this is DomainResource", "boolean", "true"),
        i=("(line as Integer) = line", "boolean", "true"),
        b=("line.is(Boolean)", "boolean", "false"),
    ),
    "filter_membership": _q("Encounter", i=("status in ('planned' | 'finished')", "boolean", "CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN true WHEN 'P' THEN false END"), c=("('finished' | 'x') contains status", "boolean", "CASE WHEN o_orderstatus IN ('O', 'F', 'P') THEN o_orderstatus = 'F' END")),
    "filter_iif": _q("Patient", v=("iif(active, name[0].family, 'none')", "text", "CASE WHEN c_acctbal > 0 THEN c_name ELSE 'none' END"), w=("iif(balance < 0, balance)", "decimal", "CASE WHEN c_acctbal < 0 THEN c_acctbal::DOUBLE END"), n=("active.not()", "boolean", "NOT (c_acctbal > 0)")),
    "filter_has_value": _q("Patient", v=("balance.hasValue()", "boolean", "true"), w=("name.hasValue()", "boolean", "false"), g=("number.getValue()", "integer", "c_custkey::BIGINT"), s=("address.country.single()", "text", "n_name")),
    "bool_three_valued": _q(
        "Patient",
        a=("active and balance > 5000", "boolean", "c_acctbal > 0 AND c_acctbal > 5000"),
        o=("active or {}", "boolean", "CASE WHEN c_acctbal > 0 THEN true END"),
        x=("active xor (number mod 2 = 0)", "boolean", "(c_acctbal > 0) <> (c_custkey % 2 = 0)"),
        i=("active implies balance > 100", "boolean", "NOT (c_acctbal > 0) OR c_acctbal > 100"),
        e=("{} and false", "boolean", "false"),
        n=("({} implies active)", "boolean", "CASE WHEN c_acctbal > 0 THEN true END"),
    ),
    "equality": _q(
        "Patient",
        e=("name[0].use = 'official'", "boolean", "true"),
        m=("name.use = 'official'", "boolean", "NULL::BOOLEAN"),
        n=("number != 5", "boolean", "c_custkey <> 5"),
        q=("'  Mixed   Case ' ~ 'mixed case'", "boolean", "true"),
        u=("name[0].family !~ 'x'", "boolean", "true"),
        z=("{} ~ {}", "boolean", "true"),
        d=("number = number * 1.0", "boolean", "true"),
        t=("number = 'a'", "boolean", "false"),
    ),
    "ordering": _q("Observation", a=("price > 50000", "boolean", "l_extendedprice > 50000"), b=("line <= 3", "boolean", "l_linenumber <= 3"), c=("id < '3'", "boolean", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) < '3'"), d=("effective >= '1995-01-01'", "boolean", f"{_SHIP} >= DATE '1995-01-01'"), e=("line > {}", "boolean", "NULL::BOOLEAN")),
    "arithmetic": _q(
        "Observation",
        p=("(price * count).round(4)", "decimal", "round(l_extendedprice::DOUBLE * l_quantity::BIGINT, 4)"),
        d=("line div 3", "integer", "(l_linenumber // 3)::BIGINT"),
        m=("-line mod 3", "integer", "(-l_linenumber % 3)::BIGINT"),
        q=("(line / 4).round(6)", "decimal", "round(l_linenumber::DOUBLE / 4, 6)"),
        z=("line / 0", "exists", "false"),
        s=("line + 1 - 2 * 3", "integer", "(l_linenumber - 5)::BIGINT"),
        u=("-line", "integer", "(-l_linenumber)::BIGINT"),
        t=("0.1 + 0.2 = 0.3", "boolean", "true"),
    ),
    "concatenation": _q("Patient", v=("name[0].family & '-' & {} & id", "text", "c_name || '-' || c_custkey"), p=("name[0].family + '/' + id", "text", "c_name || '/' || c_custkey"), n=("'a' & 1", "text", "'a'")),
    "sets": _q(
        "Observation",
        u=("(1 | 1 | 2 | line).count()", "integer", "(CASE WHEN l_linenumber IN (1, 2) THEN 2 ELSE 3 END)::BIGINT"),
        c=("(1 | 2).combine(%resource.line).count()", "integer", "3::BIGINT"),
        i=("(1 | 2 | 3).intersect(%resource.line)", "integer", "CASE WHEN l_linenumber IN (1, 2, 3) THEN l_linenumber::BIGINT END"),
        x=("(1 | 2 | 3).exclude(%resource.line).count()", "integer", "(CASE WHEN l_linenumber IN (1, 2, 3) THEN 2 ELSE 3 END)::BIGINT"),
        s=("line.subsetOf(1 | 2 | 3)", "boolean", "l_linenumber IN (1, 2, 3)"),
        p=("(1 | 2).supersetOf(%resource.line)", "boolean", "l_linenumber IN (1, 2)"),
        d=("line.combine(1).isDistinct()", "boolean", "l_linenumber <> 1"),
        e=("line.combine(1).distinct().count()", "integer", "(CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END)::BIGINT"),
        m=("(line | 1.5).count()", "integer", "2::BIGINT"),
    ),
    "subsetting": _q(
        "Observation",
        f=("component.value.first()", "decimal", "l_extendedprice::DOUBLE"),
        l=("component.value.last()", "decimal", "l_tax::DOUBLE"),
        t=("component.value.tail().first()", "decimal", "l_discount::DOUBLE"),
        s=("component.skip(2).code", "text", "'tax'"),
        k=("component.take(2).count()", "integer", "2::BIGINT"),
        z=("component.take(0)", "exists", "false"),
        n=("component.skip(-1).count()", "integer", "3::BIGINT"),
        o=("component.skip(9).exists()", "boolean", "false"),
    ),
    "aggregates": _q(
        "Observation",
        s=("component.value.sum().round(4)", "decimal", f"round(list_sum({_PARTS}), 4)"),
        a=("component.value.avg().round(4)", "decimal", f"round(list_sum({_PARTS}) / 3, 4)"),
        n=("component.value.min()", "decimal", f"list_min({_PARTS})"),
        x=("component.value.max()", "decimal", f"list_max({_PARTS})"),
        c=("component.count()", "integer", "3::BIGINT"),
        z=("component.where(code = 'none').value.sum()", "decimal", "0::DOUBLE"),
        g=("(1 | 2 | line).aggregate($this + $total, 10)", "integer", "(CASE WHEN l_linenumber IN (1, 2) THEN 13 ELSE 13 + l_linenumber END)::BIGINT"),
        b=("component.select(value > 0.05).allTrue()", "boolean", f"len(list_filter({_PARTS}, lambda x: x > 0.05)) = 3"),
        y=("component.select(value > 0.05).anyFalse()", "boolean", f"len(list_filter({_PARTS}, lambda x: x > 0.05)) < 3"),
        w=("component.select(value > 1000000).allFalse()", "boolean", "l_extendedprice <= 1000000"),
        v=("component.select(value > 50000).anyTrue()", "boolean", "l_extendedprice > 50000"),
    ),
    "strings": _q(
        "Patient",
        a=("name[0].family.lower()", "text", "lower(c_name)"),
        b=("name[0].family.upper().substring(0, 8)", "text", "substr(upper(c_name), 1, 8)"),
        c=("name[0].family.startsWith('Customer')", "boolean", "starts_with(c_name, 'Customer')"),
        d=("name[0].family.endsWith('7')", "boolean", "c_name LIKE '%7'"),
        e=("name[0].family.contains('00')", "boolean", "c_name LIKE '%00%'"),
        f=("name[0].family.replace('0', 'oh')", "text", "replace(c_name, '0', 'oh')"),
        g=("name[0].family.matches('#0+[1-3]')", "boolean", "regexp_matches(c_name, '#0+[1-3]')"),
        h=("name[0].family.replaceMatches('[0-9]+', 'N')", "text", "regexp_replace(c_name, '[0-9]+', 'N', 'g')"),
        i=("name[0].family.indexOf('#')", "integer", "(strpos(c_name, '#') - 1)::BIGINT"),
        j=("name[0].family.length()", "integer", "length(c_name)::BIGINT"),
        k=("name[1].given.first().split('I').count()", "integer", "len(string_split(c_mktsegment, 'I'))::BIGINT"),
        l=("name[1].given.first().toChars().join('.')", "text", "array_to_string(regexp_extract_all(c_mktsegment, '.'), '.')"),
        m=("(' ' & id & '  ').trim()", "text", "CAST(c_custkey AS VARCHAR)"),
        n=("name.where(use = 'old').family.join(',')", "text", "''"),
        o=("id.substring(50)", "exists", "false"),
    ),
    "mathematics": _q(
        "Observation",
        a=("(0 - price).abs()", "decimal", "l_extendedprice::DOUBLE"),
        b=("price.ceiling()", "integer", "ceil(l_extendedprice)::BIGINT"),
        c=("price.floor()", "integer", "floor(l_extendedprice)::BIGINT"),
        d=("price.truncate()", "integer", "trunc(l_extendedprice)::BIGINT"),
        e=("price.round(1)", "decimal", "round(l_extendedprice::DECIMAL(18, 6), 1)::DOUBLE"),
        f=("price.sqrt().round(6)", "decimal", "round(sqrt(l_extendedprice::DOUBLE), 6)"),
        g=("price.ln().round(6)", "decimal", "round(ln(l_extendedprice::DOUBLE), 6)"),
        h=("price.log(10).round(6)", "decimal", "round(ln(l_extendedprice::DOUBLE) / ln(10), 6)"),
        i=("line.power(3)", "decimal", "pow(l_linenumber::DOUBLE, 3)"),
        j=("line.exp().round(6)", "decimal", "round(exp(l_linenumber::DOUBLE), 6)"),
        k=("(0 - line).sqrt()", "exists", "false"),
        m=("line.round(1)", "integer", "l_linenumber::BIGINT"),
    ),
    "conversions": _q(
        "Patient",
        a=("id.toInteger()", "integer", "c_custkey::BIGINT"),
        b=("name[0].family.toInteger()", "exists", "false"),
        c=("id.toDecimal()", "decimal", "c_custkey::DOUBLE"),
        d=("number.toString()", "text", "CAST(c_custkey AS VARCHAR)"),
        e=("(number mod 2).toBoolean()", "boolean", "c_custkey % 2 = 1"),
        f=("'Yes'.toBoolean()", "boolean", "true"),
        g=("id.convertsToInteger()", "boolean", "true"),
        h=("name[0].family.convertsToDecimal()", "boolean", "false"),
        i=("active.toInteger()", "integer", "(c_acctbal > 0)::BIGINT"),
        j=("balance.toInteger()", "integer", "trunc(c_acctbal)::BIGINT"),
        k=("id.convertsToBoolean()", "boolean", "c_custkey IN (0, 1)"),
        l=("id.convertsToString()", "boolean", "true"),
        m=("id.convertsToDate()", "boolean", "true"),
        n=("number.convertsToTime()", "boolean", "false"),
        o=("id.toDateTime()", "text", "CAST(c_custkey AS VARCHAR)"),
    ),
    "temporal": _q(
        "Encounter",
        y=("period.start.toDate().`year`()", "integer", f"year({_ORDER})::BIGINT"),
        m=("period.start.toDate().month()", "integer", f"month({_ORDER})::BIGINT"),
        d=("period.start.toDate().day()", "integer", f"day({_ORDER})::BIGINT"),
        p=("(period.start.toDate() + 1 month).toString()", "text", f"strftime({_OVERFLOW.format(d=_ORDER, n=1)}, '%Y-%m-%d')"),
        w=("(period.start.toDate() - 2 weeks).toString()", "text", f"strftime({_ORDER} - 14, '%Y-%m-%d')"),
        x=("(period.start.toDate() + 10 days).toString()", "text", f"strftime({_ORDER} + 10, '%Y-%m-%d')"),
        g=("period.start.toDate() > @1995-06-01", "boolean", f"{_ORDER} > DATE '1995-06-01'"),
        a=("period.start.toDate() > @1995", "boolean", f"CASE WHEN year({_ORDER}) <> 1995 THEN year({_ORDER}) > 1995 END"),
        e=("period.start.toDate() = @1995-06-01", "boolean", f"{_ORDER} = DATE '1995-06-01'"),
        t=("@2024-03-01T23:30:00Z + 45 minutes = @2024-03-02T00:15:00Z", "boolean", "true"),
        z=("@2024-01-31 + 1 month = @2024-03-02", "boolean", "true"),
        c=("@T10:30 < @T10:31", "boolean", "true"),
    ),
    "quantities": _q(
        "Observation",
        g=("value.ofType(Quantity) > 20000 'g'", "boolean", "CASE WHEN l_returnflag <> 'R' THEN l_quantity > 20 END"),
        e=("valueQuantity = 17000 'g'", "boolean", "CASE WHEN l_returnflag <> 'R' THEN l_quantity = 17 END"),
        s=("(count.toQuantity('mg') + 3 'mg').toString()", "text", "(l_quantity::BIGINT + 3) || ' mg'"),
        q=("count.toQuantity('kg') ~ valueQuantity", "boolean", "l_returnflag <> 'R'"),
        c=("'5 mg'.convertsToQuantity('g')", "boolean", "true"),
        n=("'5 mg'.toQuantity() < 1 's'", "boolean", "NULL::BOOLEAN"),
        d=("3 days = 72 'h'", "boolean", "false"),
    ),
    "references": _q(
        "Encounter",
        k=("subject.getReferenceKey()", "text", "'Patient/' || o_custkey"),
        t=("subject.getReferenceKey('type')", "text", "'Patient'"),
        i=("subject.reference.getReferenceKey('id')", "text", "CAST(o_custkey AS VARCHAR)"),
    ),
    "tree": _q("Patient", c=("name.children()", "count", "4::BIGINT"), d=("address.descendants()", "text", "n_name"), r=("name[1].repeat(given)", "text", "c_mktsegment")),
    "variables": _q("Patient", a=("%limit < balance", "boolean", "c_acctbal > 1000"), b=("%resource.id = id", "boolean", "true"), c=("%`label` & id", "text", "'no ' || c_custkey"), t=("id.trace('seen')", "text", "CAST(c_custkey AS VARCHAR)")),
}
QUERIES["set_functions"] = _q(
    "Observation",
    u=("(1 | 2).union(%resource.line).count()", "integer", "(CASE WHEN l_linenumber IN (1, 2) THEN 2 ELSE 3 END)::BIGINT"),
    a=("line.as(Integer)", "integer", "l_linenumber::BIGINT"),
    q=("value.as(Quantity).value", "decimal", "CASE WHEN l_returnflag <> 'R' THEN l_quantity::DOUBLE END"),
    n=("line.as(string)", "exists", "false"),
    j=("component.code", "json", "'[\"price\",\"discount\",\"tax\"]'"),
)
QUERIES["clock"] = _q(
    "Encounter",
    n=("now() > @2020-01-01T00:00:00Z", "boolean", "true"),
    t=("today() >= @2020-01-01", "boolean", "true"),
    e=("today() = today() and now() = now()", "boolean", "true"),
    d=("timeOfDay() >= @T00:00:00.000", "boolean", "true"),
    y=("now().year() >= 2020", "boolean", "true"),
)
QUERIES["patterns"] = _q(
    "Patient",
    p=("name[0].family.matches('#0*' & %resource.id & '$')", "boolean", "true"),
    b=("name[0].family.matches('(' & %resource.id)", "boolean", "NULL::BOOLEAN"),
    m=("name[0].family.replaceMatches('([0-9])$', '<$1$2>')", "text", "regexp_replace(c_name, '([0-9])$', '<\\1>')"),
    d=("id.replaceMatches('[0-9]+', '5$')", "text", "'5$'"),
    x=("id.convertsToDateTime()", "boolean", "true"),
    i=("id.toTime()", "text", "CAST(c_custkey AS VARCHAR)"),
)
_TIMES = _q(
    "Observation",
    h=("('1' & line.toString() & ':20:30.250').toTime().hour()", "integer", "(10 + l_linenumber)::BIGINT"),
    m=("('10:0' & line.toString() & ':30.250').toTime().minute()", "integer", "l_linenumber::BIGINT"),
    s=("('10:20:0' & line.toString() & '.250').toTime().second()", "integer", "l_linenumber::BIGINT"),
    z=("('10:20:30.25' & line.toString()).toTime().millisecond()", "integer", "(250 + l_linenumber)::BIGINT"),
    d=("(effective & 'T10:20:30Z').toDateTime().hour()", "integer", "10::BIGINT"),
    c=("@2024-01-31 + 1 month = @2024-02-29", "boolean", "true"),
    u=("(1 | 1 | line).count()", "integer", "(CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END)::BIGINT"),
    e=("component.where(code = 'none').value.sum()", "exists", "false"),
)
QUERIES["spec_mode"] = Query("Observation", _TIMES.columns, _TIMES.sql, {"spec": True})
QUERIES["variables"] = Query("Patient", QUERIES["variables"].columns, QUERIES["variables"].sql, {"variables": {"limit": 1000, "label": "no "}})


def bundle_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents.bundles(spark, sf_dir)
    columns = {"n": ("entry.count()", "integer"), "measured": ("entry.resource.ofType(Observation).where(value is Quantity).count()", "integer"), "total": ("entry.resource.component.where(code = 'price').value.sum().round(2)", "decimal"), "patients": ("entry.resource.ofType(Patient).exists()", "boolean")}
    return evaluate.select(df, columns, ("id",))


def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    people = documents.patients(spark, sf_dir).withColumn("key", F.concat(F.lit("Patient/"), "id")).select("key", "resourceType", "name")
    found = references.resolve(documents.encounters(spark, sf_dir), "subject", people, "key", ("id",))
    return found.select("id", F.col("document.name")[0]["family"].alias("family"))


def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rich = evaluate.where(documents.patients(spark, sf_dir), "balance > 0").select(F.concat(F.lit("Patient/"), "id").alias("key"))
    return references.missing(documents.encounters(spark, sf_dir), "subject", rich, "key", ("id",))


def exploded_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.explode(documents.observations(spark, sf_dir), "component.where(value > 0.01).value", ("id",))


def issues_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of expressions are frames, so they group as any other."""
    df = evaluate.select(documents.encounters(spark, sf_dir), {"status": ("status", "text"), "code": ("priority.coding.code", "text")}, ("total",))
    from pyspark.sql import functions as F

    return df.groupBy("status", "code").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def faulty_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as Patient documents with faults that follow from their keys, in `number`."""
    from pyspark.sql import functions as F

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, null = F.col("c_custkey"), F.lit(None)
    fault = lambda k, bad, good: F.when(key % k == 0, bad).otherwise(good)
    name = F.struct(F.lit("official").alias("use"), fault(11, null.cast("string"), F.col("c_name")).alias("family"))
    fields = [
        fault(97, F.lit("Alien"), F.lit("Patient")).alias("resourceType"),
        fault(13, F.concat(F.lit("bad id "), key.cast("string")), key.cast("string")).alias("id"),
        fault(7, null, F.when(key % 5 == 0, F.array(name, name, name)).otherwise(F.array(name))).alias("name"),
        fault(17, F.lit("robot"), F.lit("female")).alias("gender"),
        fault(19, F.lit("1990-13-01"), F.lit("1990-12-01")).alias("birthDate"),
        F.when(key % 23 == 0, "green").alias("colour"),
        F.struct(fault(29, F.lit("Device/1"), fault(31, F.lit("no reference"), F.lit("Organization/1"))).alias("reference")).alias("managingOrganization"),
        F.array(F.struct(fault(37, null.cast("string"), F.lit("http://example.org/balance")).alias("url"), F.col("c_acctbal").cast("double").alias("valueDecimal"))).alias("extension"),
        F.when(key % 41 == 0, "").alias("multipleBirthBoolean"),
    ]
    return c.select(key.cast("long").alias("number"), *fields)


def patient_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON documents."""
    from pyspark.sql import functions as F

    df = faulty_patients(spark, sf_dir)
    return df.select("number", F.to_json(F.struct(*df.columns[1:])).alias("json"))


def validation_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of typed documents, by columns alone."""
    from lumenpath.operators import native
    from lumenpath.rules.model import Options
    from lumenpath.sources import examples

    return native.issues(faulty_patients(spark, sf_dir), examples.registry(), "Patient", Options(terminology=True, references=True), examples.terminology(), ("number",))


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.operators.validate import issues
    from lumenpath.rules.model import Options
    from lumenpath.sources import examples

    options = Options(terminology=True, references=True)
    return issues(patient_texts(spark, sf_dir), "json", examples.registry(), options, examples.terminology(), ("number",))


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.operators.validate import summary

    return summary(validation_issues(spark, sf_dir), "number")


_ISSUES = """
WITH p AS (SELECT c_custkey::BIGINT AS number, c_custkey AS k, c_acctbal AS b FROM customer), ok AS (SELECT * FROM p WHERE k % 97 <> 0)
SELECT number, 'fatal' AS severity, 'not-found' AS code, 'Unknown resource type: Alien' AS diagnostics, '' AS expression FROM p WHERE k % 97 = 0
UNION ALL SELECT number, 'error', 'value', 'Element ''Patient.id'' has invalid id format (alphanumeric, hyphens, dots, max 64 chars): bad id ' || k, 'Patient.id' FROM ok WHERE k % 13 = 0
UNION ALL SELECT number, 'error', 'required', 'Missing required element: Patient.name (min=1)', 'Patient.name' FROM ok WHERE k % 7 = 0
UNION ALL SELECT number, 'error', 'structure', 'Element ''Patient.name'' has 3 items but maximum is 2', 'Patient.name' FROM ok WHERE k % 7 <> 0 AND k % 5 = 0
UNION ALL SELECT number, 'error', 'invariant', 'Constraint pat-1 violated: A name has a family or a given name', 'Patient.name' FROM ok WHERE k % 7 <> 0 AND k % 11 = 0
UNION ALL SELECT number, 'error', 'code-invalid', 'Code ''robot'' is not in ValueSet http://example.org/ValueSet/genders|1.0 (binding: required)', 'Patient.gender' FROM ok WHERE k % 17 = 0
UNION ALL SELECT number, 'error', 'value', 'Element ''Patient.birthDate'' has invalid date format: 1990-13-01', 'Patient.birthDate' FROM ok WHERE k % 19 = 0
UNION ALL SELECT number, 'error', 'structure', 'Unknown element: Patient.colour', 'Patient.colour' FROM ok WHERE k % 23 = 0
UNION ALL SELECT number, 'error', 'value', 'Reference to ''Device'' not allowed; expected one of: Organization', 'Patient.managingOrganization.reference' FROM ok WHERE k % 29 = 0
UNION ALL SELECT number, 'error', 'value', 'Invalid reference format: ''no reference''', 'Patient.managingOrganization.reference' FROM ok WHERE k % 29 <> 0 AND k % 31 = 0
UNION ALL SELECT number, 'error', 'required', 'Extension must have a ''url'' field', 'Patient.extension[0]' FROM ok WHERE k % 37 = 0
UNION ALL SELECT number, 'warning', 'invariant', 'Constraint pat-2 violated: Balances are not negative', 'Patient' FROM ok WHERE k % 37 <> 0 AND b < 0
UNION ALL SELECT number, 'error', 'value', 'Element ''Patient.multipleBirthBoolean'' must be a boolean', 'Patient.multipleBirthBoolean' FROM ok WHERE k % 41 = 0
UNION ALL SELECT number, 'error', 'invariant', 'Constraint ele-1 violated: All FHIR elements must have a @value or children (empty string)', 'multipleBirthBoolean' FROM ok WHERE k % 41 = 0
"""


def dynamic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema-less evaluation of JSON texts."""
    from pyspark.sql import functions as F

    from lumenpath.operators import dynamic

    df = patient_texts(spark, sf_dir)
    got = dynamic.select(df, "json", {"family": "Patient.name.family.distinct()", "n": "name.count()", "old": "birthDate.toDate() < @1990-12-02"})
    return got.select("number", F.array_join("family", ",").alias("family"), F.array_join("n", ",").alias("n"), F.array_join("old", ",").alias("old"))


def missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes outside a value set, as an anti-join."""
    from pyspark.sql import functions as F

    from lumenpath.sources.terminology import Terminology, not_in_set

    known = Terminology()
    known.load({"resourceType": "ValueSet", "url": "urn:priorities", "compose": {"include": [{"system": "urn:p", "concept": [{"code": "1-URGENT"}, {"code": "2-HIGH"}]}]}})
    df = evaluate.select(documents.encounters(spark, sf_dir), {"code": ("priority.coding.code", "text")}, ("id",))
    return not_in_set(df, F.col("code"), known.frame(spark), "urn:priorities|2").select("id", "code")


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "bundle_entries": (
        bundle_entries,
        "SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*)::BIGINT AS n, count_if(l_returnflag <> 'R')::BIGINT AS measured, round(sum(l_extendedprice::DOUBLE), 2) AS total, false AS patients FROM lineitem GROUP BY l_orderkey",
    ),
    "resolved_names": (resolved_names, "SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name AS family FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "missing_references": (
        missing_references,
        "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Patient/' || o_custkey AS reference FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    ),
    "exploded_components": (
        exploded_components,
        f"WITH p AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, list_filter({_PARTS}, lambda x: x > 0.01) AS v FROM lineitem) SELECT id, (unnest(range(len(v))))::INTEGER AS pos, unnest(v) AS value FROM p",
    ),
    "validation_issues": (validation_issues, _ISSUES),
    "validation_typed": (validation_typed, _ISSUES),
    "validation_summary": (
        validation_summary,
        f"SELECT number, count_if(severity <> 'warning')::BIGINT AS errors, count_if(severity = 'warning')::BIGINT AS warnings, count_if(severity <> 'warning') = 0 AS valid FROM ({_ISSUES}) GROUP BY number",
    ),
    "dynamic_select": (
        dynamic_select,
        "SELECT c_custkey::BIGINT AS number, CASE WHEN c_custkey % 97 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN '' ELSE c_name END AS family, CASE WHEN c_custkey % 7 = 0 THEN '0' WHEN c_custkey % 5 = 0 THEN '3' ELSE '1' END AS n, CASE WHEN c_custkey % 19 = 0 THEN 'false' ELSE 'true' END AS old FROM customer",
    ),
    "missing_codes": (missing_codes, "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS code FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "grouped_results": (
        issues_grouped,
        "SELECT CASE o_orderstatus WHEN 'O' THEN 'planned' WHEN 'F' THEN 'finished' WHEN 'P' THEN 'in-progress' END AS status, o_orderpriority AS code, count(*)::BIGINT AS n, round(sum(o_totalprice::DOUBLE), 2) AS total FROM orders GROUP BY ALL",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in QUERIES.items()} | {k: f for k, (f, _) in (FRAMES | rule_queries.FRAMES).items()}


def oracle_sql() -> dict[str, str]:
    found = {k: q.oracle() for k, q in QUERIES.items()} | {k: s for k, (_, s) in (FRAMES | rule_queries.FRAMES).items()}
    return {k: s for k, s in found.items() if s}
