"""Registered queries of rules, sources and helpers, each with SQL for the same result.

Documents with faults are made from a table's keys: each case is a template, where {k} is the key, and the issues that it should give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpath.operators import evaluate, references
from lumenpath.rules.model import Options
from lumenpath.sources import documents, examples
from lumenpath.sources.definitions import CANONICAL

Case = tuple[str, list[tuple[str, str, str, str]]]

_GOOD = '{"resourceType":"Basic","id":"{k}","code":"c"}'
_SAID = '"identifier":{"system":"s","value":"v"},"timestamp":"2024-01-01T00:00:00Z",'


def _bundle(fields: str) -> str:
    return '{"resourceType":"Bundle","id":"{k}",' + fields + "}"


def _entry(kind: str, fields: str, more: str = "") -> str:
    return _bundle(f'{more}"type":"{kind}","entry":[{{{fields}}}]')


def _invariant(text: str, at: str) -> tuple[str, str, str, str]:
    return ("error", "invariant", f"Constraint {text}", at)


BUNDLES: list[Case] = [
    (_entry("collection", f'"fullUrl":"urn:x:{{k}}","resource":{_GOOD}'), []),
    (_entry("odd{k}", '"request":{"method":"EAT"}'), [("error", "code-invalid", "Invalid Bundle.type: 'odd{k}'", "Bundle.type")]),
    (_bundle('"type":"batch","total":1'), [_invariant("bdl-1 violated: Bundle.total is only allowed for searchset or history bundles, not 'batch'", "Bundle.total")]),
    (_bundle('"type":"document"'), [_invariant("bdl-9 violated: A document Bundle must have an identifier", "Bundle.identifier"), _invariant("bdl-10 violated: A document Bundle must have a timestamp", "Bundle.timestamp")]),
    (_bundle('"type":"document","identifier":{"system":"s"},"timestamp":"2024-01-01T00:00:00Z"'), [_invariant("bdl-9 violated: A document Bundle identifier must have a value", "Bundle.identifier.value")]),
    (_entry("collection", '"fullUrl":"u{k}"'), [_invariant("bdl-5 violated: Bundle entry must have a resource, request, or response", "Bundle.entry[0]")]),
    (_entry("collection", f'"fullUrl":"http://x/_history/{{k}}","resource":{_GOOD}'), [_invariant("bdl-8 violated: fullUrl cannot be a version specific reference (contains /_history/)", "Bundle.entry[0].fullUrl")]),
    (_entry("batch", '"request":{"method":"GET","url":"x"},"search":{"mode":"match"}'), [_invariant("bdl-2 violated: entry.search is only allowed in searchset bundles, not 'batch'", "Bundle.entry[0].search")]),
    (_entry("batch", f'"resource":{_GOOD}'), [_invariant("bdl-3 violated: entry.request is required for 'batch' bundles", "Bundle.entry[0].request")]),
    (_entry("collection", '"request":{"method":"GET","url":"x"}'), [_invariant("bdl-3 violated: entry.request is not allowed for 'collection' bundles", "Bundle.entry[0].request")]),
    (_entry("batch-response", f'"resource":{_GOOD}'), [_invariant("bdl-4 violated: entry.response is required for 'batch-response' bundles", "Bundle.entry[0].response")]),
    (_entry("collection", f'"fullUrl":"u","resource":{_GOOD}}},{{"fullUrl":"u","resource":{_GOOD}'), [_invariant("bdl-7 violated: duplicate fullUrl 'u' in bundle", "Bundle.entry[1].fullUrl")]),
    (_entry("message", '"request":{"method":"GET","url":"x"}'), [_invariant("bdl-3 violated: entry.request is not allowed for 'message' bundles", "Bundle.entry[0].request"), _invariant("bdl-12 violated: message Bundle first entry must have a resource", "Bundle.entry[0].resource")]),
    (_entry("document", f'"resource":{_GOOD}', _SAID), [_invariant("bdl-11 violated: document Bundle first entry must be a Composition, got 'Basic'", "Bundle.entry[0].resource")]),
    (_entry("batch", '"request":{"method":"EAT","url":"x"}'), [("error", "code-invalid", "Invalid request method: 'EAT'", "Bundle.entry[0].request.method")]),
    (_entry("batch", '"request":{"method":"GET"}'), [("error", "required", "Bundle.entry.request.url is required", "Bundle.entry[0].request.url")]),
    (_entry("batch-response", '"response":{"etag":"x"}'), [("error", "required", "Bundle.entry.response.status is required", "Bundle.entry[0].response.status")]),
    (_entry("searchset", f'"resource":{_GOOD},"search":{{"mode":"x","score":2}}'), [("error", "code-invalid", "Invalid search mode: 'x'", "Bundle.entry[0].search.mode"), ("error", "value", "search.score must be between 0 and 1", "Bundle.entry[0].search.score")]),
    (_entry("collection", '"resource":{"code":"x"}'), [("error", "required", "Contained resource at Bundle.entry.resource[0] must have a resourceType", "Bundle.entry.resource[0]"), ("error", "required", "Bundle entry resource must have a resourceType", "Bundle.entry[0].resource.resourceType")]),
    (_entry("history", '"fullUrl":"u","request":{"method":"GET","url":"x"},"response":{"status":"200"}},{"fullUrl":"u","request":{"method":"PUT","url":"x"},"response":{"status":"200"}'), []),
    (_entry("collection", f'"fullUrl":"u&1","resource":{_GOOD}}},{{"resource":{_GOOD}'), []),
]


def _patient(fields: str) -> str:
    return '{"resourceType":"Patient","id":"{k}","name":[{"family":"f"}],' + fields + "}"


def _extension(fields: str) -> str:
    return _patient(f'"extension":[{{{fields}}}]')


_AT = "Patient.extension[0]"
EXTENSIONS: list[Case] = [
    (_extension('"url":"http://x/y","valueString":"s{k}"'), []),
    (_extension('"valueString":"s"'), [("error", "required", "Extension must have a 'url' field", _AT)]),
    (_extension('"url":"a {k}","valueString":"s"'), [("error", "value", "Invalid extension URL format: 'a {k}'", f"{_AT}.url")]),
    (_extension('"url":"http://x/{k}"'), [("error", "required", "Extension must have either a value[x] or nested extensions", _AT)]),
    (_extension('"url":"http://x/y","valueString":"s","extension":[{"url":"y","valueString":"b"}]'), [("error", "structure", "Extension cannot have both a value and nested extensions", _AT)]),
    (_patient('"extension":["x"]'), [("error", "structure", "Extension must be an object", _AT)]),
    (_extension('"url":"http://x/y","extension":[{"url":"y","valueInteger":7},{"url":"b c","valueInteger":7}]'), [("error", "value", "Invalid extension URL format: 'b c'", f"{_AT}.extension[1].url")]),
    (_extension('"url":"http://x/y","valueBoolean":"yes"'), [("error", "value", "Element 'Patient.extension.valueBoolean' must be a boolean", "Patient.extension.valueBoolean"), ("error", "value", "Expected boolean for type 'Boolean', got string", f"{_AT}.valueBoolean")]),
    (_extension('"url":"http://x/y","valueInteger":1.5'), [("error", "value", "Element 'Patient.extension.valueInteger' must be an integer", "Patient.extension.valueInteger"), ("error", "value", "Expected integer for type 'Integer', got decimal", f"{_AT}.valueInteger")]),
    (_extension('"url":"http://x/y","valueDecimal":true'), [("error", "value", "Element 'Patient.extension.valueDecimal' must be a decimal number", "Patient.extension.valueDecimal"), ("error", "value", "Expected number for type 'Decimal', got bool", f"{_AT}.valueDecimal")]),
    (_extension(f'"url":"{CANONICAL}HumanName","valueString":"s"'), [("error", "extension", f"URL '{CANONICAL}HumanName' does not define an Extension (type: HumanName)", _AT)]),
    (_extension(f'"url":"{CANONICAL}Extension","valueCode":"c"'), [("error", "value", "Extension value type 'Code' not allowed; expected one of: string, boolean, integer, decimal", _AT)]),
    (_extension(f'"url":"{CANONICAL}Extension","valueString":"s"'), []),
    (_extension('"url":"http://x/y","valueHumanName":{"family":1}'), [("error", "value", "Element 'Patient.extension.valueHumanName.family' must be a string", "Patient.extension.valueHumanName.family"), ("error", "value", f"Expected string for '{_AT}.valueHumanName.family', got float64", f"{_AT}.valueHumanName.family")]),
    (_extension('"url":"http://x/y","valueHumanName":"text"'), [("error", "structure", "Expected object for type 'HumanName', got string", f"{_AT}.valueHumanName")]),
]


def _refers(text: str, more: str = "") -> str:
    return _patient(f'{more}"managingOrganization":{{"reference":"{text}"}}')


_HELD = '"contained":[{"resourceType":"Basic","id":"c{k}","code":"c"}],'
_REFERENCE = "Patient.managingOrganization.reference"
CONTAINED: list[Case] = [
    (_refers("#c{k}", _HELD), []),
    (_refers("#d{k}", _HELD), [("error", "not-found", "Contained resource not found: '#d{k}'", _REFERENCE)]),
    (_patient('"contained":[{"code":"c"}]'), [("error", "required", "Contained resource at Patient.contained[0] must have a resourceType", "Patient.contained[0]")]),
    (_patient('"contained":[{"resourceType":"Alien{k}"}]'), [("error", "not-found", "Unknown resource type in contained resource: Alien{k}", "Patient.contained[0]")]),
    (_patient('"contained":[{"resourceType":"Basic","code":"c","x":1}]'), [("error", "structure", "Unknown element: Basic.x", "Basic.x")]),
    (_patient('"contained":[{"resourceType":"Basic","code":" c"}]'), [("error", "value", "Element 'Basic.code' has invalid code format (no leading/trailing whitespace allowed):  c", "Basic.code")]),
    (_refers("Organization/{k}\\n"), [("error", "value", "Invalid reference format: 'Organization/{k}\n'", _REFERENCE)]),
    (_refers("http://h/fhir/Organization/{k}"), []),
    (_refers("http://h/fhir/Device/{k}"), [("error", "value", "Reference to 'Device' not allowed; expected one of: Organization", _REFERENCE)]),
    (_refers("urn:uuid:01234567-89ab-cdef-0123-456789abcdef"), []),
    (_refers("urn:oid:1.2\\u0663"), [("error", "value", "Invalid reference format: 'urn:oid:1.2٣'", _REFERENCE)]),
    (_refers("http://h/canonical|{k}"), []),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(cases: list[Case], table: str, key: str, **options) -> tuple[Callable, str]:
    """A query that validates each key's case, and the issues as SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from lumenpath.operators.validate import issues

        k = F.col(key).cast("long")
        text = F.get(F.array(*[F.lit(t) for t, _ in cases]), (k % len(cases)).cast("int"))
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(k.alias("number"), F.replace(text, F.lit("{k}"), k.cast("string")).alias("json"))
        return issues(df, "json", examples.registry(), Options(**options), examples.terminology(), ("number",))

    parts = []
    for at, (_, found) in enumerate(cases):
        for severity, code, text, place in found:
            said = f"replace({_quoted(text)}, '{{k}}', k::VARCHAR)"
            parts.append(f"SELECT k::BIGINT AS number, '{severity}' AS severity, '{code}' AS code, {said} AS diagnostics, {_quoted(place)} AS expression FROM o WHERE k % {len(cases)} = {at}")
    return run, f"WITH o AS (SELECT {key} AS k FROM {table}) " + "\nUNION ALL ".join(parts)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenpath.queries import patient_texts

    return patient_texts(spark, sf_dir)


def validation_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue of each document at most, of structure and simple values only."""
    from lumenpath.operators.validate import issues

    return issues(_people(spark, sf_dir), "json", examples.registry(), Options(constraints=False, extensions=False, max_errors=1), None, ("number",))


_FIRST = """
WITH p AS (SELECT c_custkey::BIGINT AS number, c_custkey AS k FROM customer), ok AS (SELECT * FROM p WHERE k % 97 <> 0), f AS (
SELECT number, 0 AS o, 'fatal' AS severity, 'not-found' AS code, 'Unknown resource type: Alien' AS diagnostics, '' AS expression FROM p WHERE k % 97 = 0
UNION ALL SELECT number, 1, 'error', 'structure', 'Element ''Patient.name'' has 3 items but maximum is 2', 'Patient.name' FROM ok WHERE k % 7 <> 0 AND k % 5 = 0
UNION ALL SELECT number, 2, 'error', 'structure', 'Unknown element: Patient.colour', 'Patient.colour' FROM ok WHERE k % 23 = 0
UNION ALL SELECT number, 3, 'error', 'required', 'Missing required element: Patient.name (min=1)', 'Patient.name' FROM ok WHERE k % 7 = 0
UNION ALL SELECT number, 4, 'error', 'value', 'Element ''Patient.id'' has invalid id format (alphanumeric, hyphens, dots, max 64 chars): bad id ' || k, 'Patient.id' FROM ok WHERE k % 13 = 0
UNION ALL SELECT number, 5, 'error', 'value', 'Element ''Patient.birthDate'' has invalid date format: 1990-13-01', 'Patient.birthDate' FROM ok WHERE k % 19 = 0
UNION ALL SELECT number, 6, 'error', 'value', 'Element ''Patient.multipleBirthBoolean'' must be a boolean', 'Patient.multipleBirthBoolean' FROM ok WHERE k % 41 = 0
) SELECT number, severity, code, diagnostics, expression FROM f QUALIFY row_number() OVER (PARTITION BY number ORDER BY o) = 1
"""


def typed_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts of several types, dispatched by type into frames with that type's schema."""
    found = documents.by_type(_people(spark, sf_dir), "json", examples.registry(), ["Patient", "Basic"])["Patient"]
    return found.select("number", F.col("name")[0]["family"].alias("family"), F.size("name").alias("names"), "gender", "birthDate")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of a type's summary."""
    registry = examples.registry()
    found = documents.by_type(_people(spark, sf_dir), "json", registry, ["Patient"])["Patient"]
    return documents.summary(found.drop("number"), registry, "Patient").withColumn("name", F.to_json("name"))


def rows_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows as JSON documents, read without a schema."""
    from lumenpath.operators import dynamic

    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    df = customer.select(F.col("c_custkey").cast("long").alias("number"), evaluate.as_json(customer).alias("json"))
    got = dynamic.select(df, "json", {"name": "c_name", "n": "c_custkey + 1", "bad": "c_name.matches('(' & c_mktsegment)", "none": "c_name.replaceMatches('[0-9]+', 'n$1')"})
    return got.select("number", *[F.array_join(c, ",").alias(c) for c in ("name", "n", "bad", "none")])


def inferred_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts without a known schema: inferred in one pass, then compiled."""
    df = documents.inferred(_people(spark, sf_dir), "json")
    columns = {"family": ("Patient.name.family.distinct()", "text"), "n": ("name.count()", "integer"), "old": ("birthDate.toDate() < @1990-12-02", "boolean"), "gone": ("colour.empty()", "boolean")}
    return evaluate.select(df, columns, ("number",), resource_type="Patient")


def resolved_in_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resolve() inside an expression, over a frame that was joined with what its references name."""
    people = documents.patients(spark, sf_dir).withColumn("key", F.concat(F.lit("Patient/"), "id")).select("key", "resourceType", "name", "active")
    visits = documents.encounters(spark, sf_dir)
    joined, variables = references.with_resolved(visits, "subject", people, "key", "id")
    columns = {"family": ("subject.resolve().name.where(use = 'official').family", "text"), "known": ("subject.resolve().exists()", "boolean")}
    return evaluate.select(joined, columns, ("id",), variables=variables)


def definition_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions as a frame."""
    found = examples.registry().frame(spark)
    return found.groupBy("type").agg(F.count_if(F.col("path") != F.col("type")).alias("elements"), F.count_if(F.col("min") > 0).alias("required"))


def value_set_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value set's expansion, from all codes of its code system."""
    return examples.terminology().frame(spark)


def unit_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical units of a column, and what is known of them."""
    from lumenpath.functions import units as U

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    unit = F.get(F.array(*[F.lit(u) for u in ("kg", "mg", "L", "ML", "zorks")]), (F.col("p_size") % 5).cast("int"))
    code, factor = U.canonical(unit)
    own = U.canonical(unit, system=F.lit("urn:other"))
    value = F.struct(F.col("p_size").cast("double").alias("value"), unit.alias("unit"))
    return part.select(
        F.col("p_partkey").cast("long").alias("part"), code.alias("code"), F.round(F.col("p_size") * factor, 6).alias("value"), U.known(unit).alias("known"), own[0].alias("other"), U.scaled(value, F.lit(2.5))["value"].alias("scaled")
    )


def registered_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one's own in expressions."""
    from lumenpath.functions import registry
    from lumenpath.plans.coll import Coll

    registry.register("plusItself", 0, 0, lambda this: Coll(this.kind, this.col * 2))
    return evaluate.select(documents.observations(spark, sf_dir), {"v": ("line.plusItself() + 1", "integer")}, ("id",), max_items=evaluate.MAX_ITEMS)


def made_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made with the constants and helpers of common observations, and expressions over them."""
    from lumenpath.sources import model as M

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    made = c.select(F.col("c_custkey").cast("string").alias("id"), M.quantity(F.col("c_acctbal"), "kg").alias("valueQuantity"), M.concept("29463-7").alias("code"), F.array(M.category("vital-signs")).alias("category"), M.reference("Patient", F.col("c_custkey")).alias("subject"))
    columns = {
        "grams": ("value > 5000000 'g'", "boolean"), "code": ("code.coding.where(system = 'http://loinc.org').code", "text"), "shown": ("category.coding.display", "text"),
        "unit": ("valueQuantity.code", "text"), "who": ("subject.getReferenceKey()", "text"), "all": ("(id | code.text).first()", "json"),
    }
    return evaluate.select(made, columns, ("id",))


def streamed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive as a stream: documents made of them, an expression as filter, and what is wrong with each, written batch by batch."""
    import tempfile
    import uuid

    from lumenpath.operators import native
    from lumenpath.streaming import documents as S

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="lumenpath-stream")
    folder = f"{shared}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/customer.parquet").schema
    rows = S.read(spark, f"{sf_dir}/custome[r].parquet", schema)
    key = F.col("c_custkey").cast("string")
    made = rows.select(F.lit("Basic").alias("resourceType"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("no id "), key)).otherwise(key).alias("id"), F.col("c_mktsegment").alias("code"), (F.col("c_acctbal") > 0).alias("rich"))
    some = evaluate.where(made, "rich").drop("rich")

    def write(batch: DataFrame, number: int) -> None:
        native.issues(batch, examples.registry(), "Basic").write.mode("append").parquet(f"{folder}/issues")

    S.each_batch(some, write, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("severity string, code string, diagnostics string, expression string").parquet(f"{folder}/issues")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows with a watermark; here over the rows that are there, on streams the same plan keeps bounded state."""
    from lumenpath.streaming import documents as S

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.windowed(events, "ts", "1 day", "1 hour", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def extension_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extensions' URLs tell."""
    from lumenpath.functions.navigation import extension_name, is_standard_extension

    url = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("http://hl7.org/fhir/x/"), F.col("s_name"))).otherwise(F.concat(F.lit("http://example.org/"), F.col("s_name")))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("number"), is_standard_extension(url).alias("standard"), extension_name(url).alias("name"))


def looked_up_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of coded values, with and without a system, by a join with the value set's codes."""
    codes = examples.terminology().frame(spark).select("system", F.col("code").alias("known"))
    gender = F.get(F.array(*[F.lit(g) for g in ("male", "female", "robot")]), (F.col("c_custkey") % 3).cast("int"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("number"), gender.alias("code"))
    return c.join(codes, c["code"] == codes["known"], "left").select("number", "code", F.col("known").isNotNull().alias("member"), "system")


_ELEMENTS = "SELECT * FROM (VALUES ('Patient', 9, 1), ('HumanName', 3, 0), ('Reference', 2, 0), ('Extension', 3, 1), ('Bundle', 11, 1), ('Basic', 2, 1)) t(type, elements, required)"
_CODES = "SELECT 'http://example.org/ValueSet/genders' AS value_set, 'http://example.org/gender' AS system, code, '' AS display, true AS active FROM (VALUES ('male'), ('female'), ('other'), ('unknown')) t(code)"
_PEOPLE = "FROM customer WHERE c_custkey % 97 <> 0"
_FAMILY = "CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN c_name END"
_NAME = """'{"use":"official"' || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ',"family":"' || c_name || '"' END || '}'"""

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "validation_bundles": _cases(BUNDLES, "orders", "o_orderkey"),
    "validation_extensions": _cases(EXTENSIONS, "customer", "c_custkey"),
    "validation_contained": _cases(CONTAINED, "customer", "c_custkey", references=True),
    "validation_first": (validation_first, _FIRST),
    "typed_patients": (
        typed_patients,
        f"SELECT c_custkey::BIGINT AS number, {_FAMILY} AS family, (CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 3 ELSE 1 END)::INTEGER AS names, CASE WHEN c_custkey % 17 = 0 THEN 'robot' ELSE 'female' END AS gender, CASE WHEN c_custkey % 19 = 0 THEN '1990-13-01' ELSE '1990-12-01' END AS \"birthDate\" {_PEOPLE}",
    ),
    "summaries": (
        summaries,
        f"SELECT 'Patient' AS \"resourceType\", CASE WHEN c_custkey % 13 = 0 THEN 'bad id ' ELSE '' END || c_custkey AS id, NULL::BOOLEAN AS active, CASE WHEN c_custkey % 7 <> 0 THEN '[' || CASE WHEN c_custkey % 5 = 0 THEN {_NAME} || ',' || {_NAME} || ',' || {_NAME} ELSE {_NAME} END || ']' END AS name {_PEOPLE}",
    ),
    "rows_as_documents": (rows_as_documents, "SELECT c_custkey::BIGINT AS number, c_name AS name, CAST(c_custkey + 1 AS VARCHAR) AS n, '' AS bad, regexp_replace(c_name, '[0-9]+', 'n') AS \"none\" FROM customer"),
    "inferred_documents": (
        inferred_documents,
        "SELECT c_custkey::BIGINT AS number, CASE WHEN c_custkey % 97 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN c_name END AS family, (CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN 3 ELSE 1 END)::BIGINT AS n, c_custkey % 19 <> 0 AS old, c_custkey % 23 <> 0 AS gone FROM customer",
    ),
    "resolved_in_expressions": (resolved_in_expressions, "SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name AS family, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "definition_elements": (definition_elements, _ELEMENTS),
    "value_set_codes": (value_set_codes, _CODES),
    "unit_forms": (
        unit_forms,
        "SELECT p_partkey::BIGINT AS part, ['g', 'g', 'L', 'L', 'zorks'][p_size % 5 + 1] AS code, round(p_size * [1000.0, 0.001, 1.0, 0.001, 1.0][p_size % 5 + 1]::DOUBLE, 6) AS value, p_size % 5 <> 4 AS known, ['kg', 'mg', 'L', 'ML', 'zorks'][p_size % 5 + 1] AS other, p_size * 2.5::DOUBLE AS scaled FROM part",
    ),
    "streamed_issues": (
        streamed_issues,
        "SELECT 'error' AS severity, 'value' AS code, 'Element ''Basic.id'' has invalid id format (alphanumeric, hyphens, dots, max 64 chars): no id ' || c_custkey AS diagnostics, 'Basic.id' AS expression FROM customer WHERE c_custkey % 10 = 0 AND c_acctbal > 0",
    ),
    "streamed_windows": (streamed_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "extension_names": (extension_names, "SELECT s_suppkey::BIGINT AS number, s_suppkey % 2 = 0 AS standard, s_name AS name FROM supplier"),
    "looked_up_codes": (
        looked_up_codes,
        "SELECT c_custkey::BIGINT AS number, ['male', 'female', 'robot'][c_custkey % 3 + 1] AS code, c_custkey % 3 <> 2 AS member, CASE WHEN c_custkey % 3 <> 2 THEN 'http://example.org/gender' END AS system FROM customer",
    ),
    "registered_function": (registered_function, "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, (2 * l_linenumber + 1)::BIGINT AS v FROM lineitem"),
    "made_documents": (
        made_documents,
        "SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal > 5000 AS grams, '29463-7' AS code, 'Vital Signs' AS shown, 'kg' AS unit, 'Patient/' || c_custkey AS who, '[\"' || c_custkey || '\"]' AS \"all\" FROM customer",
    ),
}
