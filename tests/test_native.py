"""Validation in columns gives what validation of the same documents as JSON texts gives."""

import json

import pytest
from pyspark.sql import functions as F

from lumenpath import queries as Q
from lumenpath.operators import native, validate
from lumenpath.operators.evaluate import as_json
from lumenpath.rules.model import Options
from lumenpath.sources import examples

SCHEMA = """n long, resourceType string, id string, active boolean, gender string, birthDate string, multipleBirthInteger double, colour string,
 name array<struct<id: string, use: string, family: string, given: array<string>, extension: array<struct<url: string, valueString: string>>>>,
 managingOrganization struct<reference: string, display: string>,
 extension array<struct<url: string, valueString: string, valueInteger: double, valueCode: string, valueDecimal: string, extension: array<struct<url: string, valueBoolean: boolean>>>>"""
GOOD = {"resourceType": "Patient", "id": "a-1", "active": True, "gender": "female", "name": [{"family": "X"}], "managingOrganization": {"reference": "Organization/1"}}
CHANGES = [
    {}, {"id": "a b"}, {"gender": "robot"}, {"birthDate": "1990-13-01"}, {"birthDate": "1990-01\n"}, {"multipleBirthInteger": 1.5}, {"colour": "red"}, {"name": []}, {"name": None},
    {"name": [{"family": "a"}, {"family": "b"}, {"given": ["c", ""]}]}, {"name": [{"use": "a b "}, {"id": "1"}]}, {"name": [{"family": "", "extension": [{"valueString": "x"}, {"url": "http://x", "valueString": "s"}]}]},
    {"managingOrganization": {"reference": "Device/1"}}, {"managingOrganization": {"reference": "nowhere\n"}}, {"managingOrganization": {"reference": "#c"}}, {"managingOrganization": {"reference": ""}},
    {"managingOrganization": {"reference": "http://h/x/Organization/1"}}, {"managingOrganization": {"display": "only"}}, {"extension": [{"url": "a b", "valueString": "s"}, {"url": "http://x"}]},
    {"extension": [{"url": "http://x", "valueString": "s", "extension": [{"url": "y", "valueBoolean": True}, {"url": "y"}, {"valueBoolean": False}]}]}, {"extension": [{"url": "http://x", "valueDecimal": "1.5"}]},
    {"extension": [{"url": "http://hl7.org/fhir/StructureDefinition/Extension", "valueCode": "c"}, {"url": "http://hl7.org/fhir/StructureDefinition/HumanName", "valueString": "s"}]},
    {"extension": [{"url": "http://example.org/balance", "valueInteger": -1}]}, {"resourceType": "Alien"}, {"resourceType": None}, {"resourceType": ""},
]


@pytest.mark.parametrize("options", [Options(terminology=True, references=True), Options(strict=True), Options(constraints=False, extensions=False)])
def test_equals_validation_of_texts(spark, options):
    rows = [json.dumps({"n": n, **GOOD, **change}) for n, change in enumerate(CHANGES)]
    typed = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", SCHEMA.replace("\n", "")).alias("d")).select("d.*")
    texts = typed.select("n", as_json(typed.drop("n")).alias("json"))
    want = {tuple(r) for r in validate.issues(texts, "json", examples.registry(), options, examples.terminology(), ("n",)).collect()}
    got = [tuple(r) for r in native.issues(typed, examples.registry(), "Patient", options, examples.terminology(), ("n",)).collect()]
    assert set(got) == want and len(want) > 10


def test_no_python_in_the_plan(spark):
    plan = Q.queries()["validation_typed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(KeyError):
        native.issues(spark.range(1), examples.registry(), "Alien")
