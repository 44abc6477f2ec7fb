"""Each rule with a document that keeps it and one that breaks it."""

import json

import pytest

from lumenpath.rules.model import Options
from lumenpath.rules.validate import Validator, valid
from lumenpath.sources import examples
from lumenpath.sources.definitions import Registry, schema_of

GOOD = {"resourceType": "Patient", "id": "a-1", "active": True, "name": [{"family": "X"}], "gender": "female", "birthDate": "1990-01-31", "extension": [{"url": "http://example.org/balance", "valueDecimal": 1.5}], "managingOrganization": {"reference": "Organization/1"}}


def check(resource, **options):
    return Validator(examples.registry(), Options(**{"terminology": True, "references": True, **options}), examples.terminology()).validate(json.dumps(resource) if isinstance(resource, dict) else resource)


def test_good_document():
    assert check(GOOD) == [] and valid(check(GOOD))


PATIENTS = [
    ({"colour": "red"}, "Unknown element: Patient.colour"), ({"name": []}, "Element 'Patient.name' has 0 items but minimum is 1"), ({"name": [{"family": "a"}] * 3}, "Element 'Patient.name' has 3 items but maximum is 2"),
    ({"name": None}, "Element 'Patient.name' has 0 items but minimum is 1"), ({"active": "yes"}, "Element 'Patient.active' must be a boolean"), ({"id": "a b"}, "Element 'Patient.id' has invalid id format (alphanumeric, hyphens, dots, max 64 chars): a b"),
    ({"birthDate": "1990-02-32"}, "Element 'Patient.birthDate' has invalid date format: 1990-02-32"), ({"birthDate": 1990}, "Element 'Patient.birthDate' must be a string (date)"), ({"multipleBirthInteger": 1.5}, "Element 'Patient.multipleBirthInteger' must be an integer"),
    ({"name": [{"use": "a", "family": ""}]}, "Constraint ele-1 violated: All FHIR elements must have a @value or children (empty string)"), ({"name": [{"family": "a"}, {"id": "1"}]}, "Constraint ele-1 violated: All FHIR elements must have a @value or children"),
    ({"name": [{"use": "a"}]}, "Constraint pat-1 violated: A name has a family or a given name"), ({"gender": "robot"}, "Code 'robot' is not in ValueSet http://example.org/ValueSet/genders|1.0 (binding: required)"),
    ({"managingOrganization": {"reference": "Device/1"}}, "Reference to 'Device' not allowed; expected one of: Organization"), ({"managingOrganization": {"reference": "nowhere"}}, "Invalid reference format: 'nowhere'"), ({"managingOrganization": {"reference": "#x"}}, "Contained resource not found: '#x'"),
    ({"extension": [{"valueString": "a"}]}, "Extension must have a 'url' field"), ({"extension": [{"url": "a b", "valueString": "a"}]}, "Invalid extension URL format: 'a b'"), ({"extension": [{"url": "http://x"}]}, "Extension must have either a value[x] or nested extensions"),
    ({"extension": [{"url": "http://x", "valueString": "a", "extension": [{"url": "y", "valueString": "b"}]}]}, "Extension cannot have both a value and nested extensions"), ({"extension": ["x"]}, "Extension must be an object"),
    ({"contained": [{"id": "1"}]}, "Contained resource at Patient.contained[0] must have a resourceType"), ({"contained": [{"resourceType": "Alien"}]}, "Unknown resource type in contained resource: Alien"), ({"contained": [{"resourceType": "Basic", "code": "c", "x": 1}]}, "Unknown element: Basic.x"),
]


@pytest.mark.parametrize(("change", "said"), PATIENTS)
def test_rules(change, said):
    assert said in [i.diagnostics for i in check(GOOD | change)]


def test_missing_and_choice():
    without = {k: v for k, v in GOOD.items() if k != "name"}
    assert [i.diagnostics for i in check(without)] == ["Missing required element: Patient.name (min=1)"]
    assert check(GOOD | {"multipleBirthBoolean": True}) == []
    assert check(GOOD | {"contained": [{"resourceType": "Basic", "id": "x", "code": "c"}], "managingOrganization": {"reference": "#x"}}) == []


def test_gates_and_options():
    assert [(i.severity, i.code) for i in check("{")] == [("fatal", "structure")]
    assert [i.code for i in check({"id": "1"})] == ["required"] and [i.code for i in check({"resourceType": "Alien"})] == ["not-found"]
    assert [i.diagnostics for i in check(GOOD, profile="http://x")] == ["Profile not found: http://x"]
    bad = GOOD | {"a": 1, "b": 2, "gender": "robot"}
    assert len(check(bad, max_errors=2)) == 2 and len(check(bad, terminology=False)) == 2
    assert check(GOOD | {"name": [{"use": "x"}]}, constraints=False) == [] and check(GOOD | {"extension": [{}]}, extensions=False, constraints=False)[0].code == "invariant"
    assert any("not found" in i.diagnostics for i in check(GOOD, strict=True))
    warned = check(GOOD | {"extension": [{"url": "http://example.org/balance", "valueDecimal": -1}]})
    assert [i.severity for i in warned] == ["warning"] and valid(warned)


BUNDLES = [
    ({"type": "odd"}, "Invalid Bundle.type: 'odd'"), ({"type": "batch", "total": 1}, "bdl-1"), ({"type": "document", "timestamp": "x"}, "bdl-9 violated: A document Bundle must have an identifier"), ({"type": "document", "identifier": {"system": "a"}}, "bdl-9 violated: A document Bundle identifier must have a value"),
    ({"type": "document"}, "bdl-10"), ({"type": "collection", "entry": [{"fullUrl": "u"}]}, "bdl-5"), ({"type": "collection", "entry": [{"fullUrl": "u/_history/1", "resource": {"resourceType": "Basic", "code": "c"}}]}, "bdl-8"), ({"type": "batch", "entry": [{"request": {"method": "GET", "url": "x"}, "search": {}}]}, "bdl-2"),
    ({"type": "batch", "entry": [{"resource": {"resourceType": "Basic", "code": "c"}}]}, "bdl-3 violated: entry.request is required"), ({"type": "collection", "entry": [{"request": {"method": "GET", "url": "x"}}]}, "bdl-3 violated: entry.request is not allowed"), ({"type": "batch-response", "entry": [{"resource": {"resourceType": "Basic", "code": "c"}}]}, "bdl-4"),
    ({"type": "collection", "entry": [{"fullUrl": "u", "resource": {"resourceType": "Basic", "code": "c"}}] * 2}, "bdl-7"), ({"type": "document", "entry": [{"resource": {"resourceType": "Basic", "code": "c"}}]}, "bdl-11"), ({"type": "message", "entry": [{"fullUrl": "u"}]}, "bdl-12"), ({"type": "batch", "entry": [{"request": {"method": "EAT", "url": "x"}}]}, "Invalid request method: 'EAT'"),
    ({"type": "batch", "entry": [{"request": {}}]}, "Bundle.entry.request.url is required"), ({"type": "batch-response", "entry": [{"response": {}}]}, "Bundle.entry.response.status is required"), ({"type": "searchset", "entry": [{"resource": {"resourceType": "Basic", "code": "c"}, "search": {"mode": "x"}}]}, "Invalid search mode: 'x'"),
    ({"type": "searchset", "entry": [{"resource": {"resourceType": "Basic", "code": "c"}, "search": {"score": 2}}]}, "search.score must be between 0 and 1"), ({"type": "collection", "entry": [{"resource": {"id": "x"}}]}, "Bundle entry resource must have a resourceType"), ({"type": "collection", "entry": [{"resource": {"resourceType": "Alien"}}]}, "Unknown resource type in entry: Alien"),
    ({"type": "collection", "entry": [{"resource": {"resourceType": "Basic", "code": "c", "x": 1}}]}, "Unknown element: Basic.x"),
]


@pytest.mark.parametrize(("fields", "said"), BUNDLES)
def test_bundle_rules(fields, said):
    assert any(said in i.diagnostics for i in check({"resourceType": "Bundle", **fields}))


def test_good_bundle():
    entry = [{"fullUrl": f"urn:x:{i}", "resource": {"resourceType": "Basic", "id": str(i), "code": "c"}} for i in range(3)]
    assert check({"resourceType": "Bundle", "id": "b", "type": "collection", "entry": entry}) == []


def test_definitions_from_files(tmp_path, spark):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "all.json").write_text(json.dumps(examples.definitions()))
    (tmp_path / "broken.json").write_text("{")
    registry, other = Registry(), Registry()
    assert registry.load_folder(str(tmp_path)) == 6 == other.load_spark(spark, str(tmp_path))
    assert registry.of_type("Patient").url.endswith("/Patient") and registry.get("nope") is None and len(registry) == 6 == len(registry.urls())
    frame = registry.frame(spark)
    assert frame.where("path = 'Patient.name' AND min = 1 AND max = '2'").count() == 1
    schema = schema_of(registry, "Patient")
    assert schema["name"].dataType.typeName() == "array" and {"multipleBirthBoolean", "multipleBirthInteger", "_birthDate"} <= set(schema.names)
    profile = {"resourceType": "StructureDefinition", "url": "http://x/profile/p", "type": "Patient"}
    registry.load(profile)
    assert registry.of_type("Patient").url.endswith("/Patient")


def test_documents_by_type_and_summaries(spark):
    from lumenpath.functions.navigation import extension_name, is_standard_extension
    from lumenpath.sources.documents import by_type, summary
    from pyspark.sql import functions as F

    registry = examples.registry()
    df = spark.createDataFrame([(1, json.dumps(GOOD)), (2, '{"resourceType": "Basic", "code": "c"}'), (3, '{"resourceType": "Alien"}'), (4, "{")], "n long, json string")
    found = by_type(df, "json", registry, ["Patient", "Basic"])
    assert [r.n for r in found["Patient"].collect()] == [1] and found["Basic"].first().code == "c"
    assert found["Patient"].first().name[0].family == "X"
    with pytest.raises(KeyError):
        by_type(df, "json", registry, ["Alien"])
    assert summary(found["Patient"], registry, "Patient").columns == ["resourceType", "id", "active", "name"]
    row = spark.range(1).select(is_standard_extension(F.lit("http://hl7.org/fhir/StructureDefinition/x")).alias("a"), extension_name(F.lit("http://e/y")).alias("b")).first()
    assert row.a and row.b == "y"


def test_terminology():
    from lumenpath.sources.terminology import Terminology

    t = Terminology()
    t.load(
        {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "CodeSystem", "url": "s", "content": "complete", "concept": [{"code": "a", "concept": [{"code": "b", "display": "B"}]}, {"code": "c"}]}}, {"resource": {"resourceType": "CodeSystem", "url": "n", "content": "not-present"}}]},
        {"resourceType": "ValueSet", "url": "v", "compose": {"include": [{"system": "s", "filter": [{"property": "code", "op": "in", "value": "a, b"}]}], "exclude": [{"system": "s"}]}},
        {"resourceType": "ValueSet", "url": "w", "expansion": {"contains": [{"system": "x", "code": "1", "contains": [{"code": "2"}]}]}},
    )
    assert {c.code for c in t.expand("v|2")} == {"a", "b"} and [c.code for c in t.expand("w")] == ["1"] and t.has_set("v|1") and t.has_system("s") and not t.has_system("n")
    assert t.contains("v", "s", "a") and not t.contains("v", "x", "a") and t.contains("v", "", "b") and t.contains("none", "", "a") is None
    assert t.lookup("s", "b").display == "B" and t.lookup("s", "z") is None and t.stats() == {"value_sets": 2, "code_systems": 1, "codes": 3}


def test_units():
    from lumenpath.functions import units as U

    assert U.normalize(2, "kg") == (2000.0, "g") and U.normalize(1, "KG") == (1000.0, "g") and U.normalize(3, "zorks") == (3.0, "zorks")
    assert U.normalize_with_system(1, "kg", "urn:other") == (1, "kg") and U.is_known("mm[Hg]") and not U.is_known("zorks") and U.canonical_unit("mL") == "L" and len(U.CANONICAL) == 88


def test_frames_and_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from lumenpath.operators import evaluate, validate
    from lumenpath.streaming import documents as S

    df = spark.createDataFrame([(1, json.dumps(GOOD)), (2, "{"), (3, None)], "n long, json string")
    found = validate.issues(df, "json", examples.registry(), keep=("n",))
    assert {(r.n, r.severity) for r in found.collect()} == {(2, "fatal"), (3, "fatal")}
    assert {(r.n, r.errors, r.valid) for r in validate.summary(found, "n").collect()} == {(2, 1, False), (3, 1, False)}
    source = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 00:00:30"), ("b", "2024-01-01 00:10:00")], "id string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(source))
    seen = []
    stream = S.read(spark, str(source), "id string, at timestamp")
    S.each_batch(evaluate.where(stream, "id = 'a'"), lambda batch, n: seen.extend(r.id for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["a"]
    counted = S.windowed(stream, "at", "5 minutes", "1 minute").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    counted.processAllAvailable()
    counted.stop()
    assert spark.table("counted").count() == 2


def test_command_line(tmp_path, capsys):
    from lumenpath import cli

    file = tmp_path / "p.json"
    file.write_text(json.dumps(GOOD))
    (tmp_path / "defs").mkdir()
    (tmp_path / "defs" / "d.json").write_text(json.dumps(examples.definitions()))
    assert cli.main(["path", "Patient.name.family | 'b'", str(file)]) == 0 and capsys.readouterr().out == "[0] X\n[1] b\n"
    assert cli.main(["path", "active", str(file), "--json"]) == 0 and capsys.readouterr().out == "[true]\n"
    assert cli.main(["path", "nothing", str(file)]) == 0 and capsys.readouterr().out == "(empty)\n"
    assert cli.main(["path", "a b", str(file)]) == 1
    assert cli.main(["validate", "--definitions", str(tmp_path / "defs"), str(file)]) == 0
    file.write_text(json.dumps(GOOD | {"x": 1}))
    assert cli.main(["validate", "--definitions", str(tmp_path / "defs"), str(file)]) == 1


def test_document_helpers(spark):
    from pyspark.sql import functions as F

    from lumenpath.operators import evaluate as E
    from lumenpath.sources import model as M

    df = spark.range(4).select(F.col("id"), M.quantity(F.col("id") + 70, "kg").alias("valueQuantity"), M.concept("29463-7").alias("code"), M.reference("Patient", F.col("id") % 2).alias("subject"), (F.col("id") % 2).alias("who"))
    row = E.select(df, {"heavy": ("value > 72000 'g'", "boolean"), "code": ("code.coding.code", "text"), "who": ("subject.getReferenceKey('id')", "text")}, ("id",)).orderBy("id").collect()
    assert [r.heavy for r in row] == [False, False, False, True] and row[0].code == "29463-7" and row[3].who == "1"
    assert len(M.CONCEPTS) == 44 and len(M.UNIT_CODES) == 33
    made = df.select(M.quantity(F.lit(1), "mmHg").alias("q"), M.category("vital-signs").alias("c")).first()
    assert made.q.code == "mm[Hg]" and made.c.coding[0].display == "Vital Signs"
    bundles = M.bundle(df, "who", F.concat(F.lit("urn:x:"), F.col("id").cast("string")))
    assert [r.n for r in E.select(bundles, {"n": ("entry.resource.count()", "integer")}).collect()] == [2, 2]
