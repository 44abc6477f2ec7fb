"""Small definitions and value sets of our own for the test tables' documents; real ones are loaded with Registry and Terminology."""

from __future__ import annotations

from lumenpath.sources.definitions import CANONICAL, Registry
from lumenpath.sources.terminology import Terminology

GENDERS = "http://example.org/ValueSet/genders"


def _definition(name: str, kind: str, *elements: dict) -> dict:
    return {"resourceType": "StructureDefinition", "url": CANONICAL + name, "name": name, "type": name, "kind": kind, "snapshot": {"element": [{"path": name, "min": 0, "max": "*"}, *elements]}}


def _e(path: str, types: str, low: int = 0, high: str = "1", **more) -> dict:
    return {"path": path, "min": low, "max": high, "type": [{"code": t} for t in types.split()], **more}


def definitions() -> dict:
    reference = [{"code": "Reference", "targetProfile": [CANONICAL + "Organization"]}]
    key = {"key": "pat-1", "severity": "error", "human": "A name has a family or a given name", "expression": "family.exists() or given.exists()"}
    soft = {"key": "pat-2", "severity": "warning", "human": "Balances are not negative", "expression": "extension('http://example.org/balance').value.all($this >= 0)"}
    patient = [
        _e("Patient.id", "id"), _e("Patient.contained", "Resource", 0, "*"), _e("Patient.extension", "Extension", 0, "*"), _e("Patient.active", "boolean", isSummary=True),
        _e("Patient.name", "HumanName", 1, "2", constraint=[key], isSummary=True), _e("Patient.gender", "code", binding={"strength": "required", "valueSet": GENDERS + "|1.0"}),
        _e("Patient.birthDate", "date"), _e("Patient.multipleBirth[x]", "boolean integer"), {"path": "Patient.managingOrganization", "min": 0, "max": "1", "type": reference},
    ]
    root = {"path": "Patient", "min": 0, "max": "*", "constraint": [soft]}
    made = [
        _definition("Patient", "resource", *patient),
        _definition("HumanName", "complex-type", _e("HumanName.use", "code"), _e("HumanName.family", "string"), _e("HumanName.given", "string", 0, "*")),
        _definition("Reference", "complex-type", _e("Reference.reference", "string"), _e("Reference.display", "string")),
        _definition("Extension", "complex-type", _e("Extension.url", "uri", 1), _e("Extension.value[x]", "string boolean integer decimal"), _e("Extension.extension", "Extension", 0, "*")),
        _definition("Bundle", "resource", _e("Bundle.id", "id"), _e("Bundle.type", "code", 1), _e("Bundle.total", "unsignedInt"), _e("Bundle.entry", "BackboneElement", 0, "*"), _e("Bundle.entry.fullUrl", "uri"), _e("Bundle.entry.resource", "Resource"), _e("Bundle.entry.request", "BackboneElement"), _e("Bundle.entry.response", "BackboneElement"), _e("Bundle.entry.search", "BackboneElement"), _e("Bundle.identifier", "Identifier"), _e("Bundle.timestamp", "instant")),
        _definition("Basic", "resource", _e("Basic.id", "id"), _e("Basic.code", "code", 1)),
    ]
    made[0]["snapshot"]["element"][0] = root
    return {"resourceType": "Bundle", "entry": [{"resource": d} for d in made]}


def registry() -> Registry:
    found = Registry()
    found.load(definitions())
    return found


def terminology() -> Terminology:
    system = "http://example.org/gender"
    codes = [{"code": c} for c in ("male", "female", "other", "unknown")]
    found = Terminology()
    found.load({"resourceType": "CodeSystem", "url": system, "content": "complete", "concept": codes}, {"resourceType": "ValueSet", "url": GENDERS, "compose": {"include": [{"system": system}]}})
    return found
