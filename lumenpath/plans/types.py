"""Type names of items, and what matches them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenpath.plans.coll import TYPE_NAMES, Coll

#: Types of the specification that are items of a simple type.
ALIASES = {
    "boolean": "Boolean", "string": "String", "integer": "Integer", "decimal": "Decimal", "date": "Date", "datetime": "DateTime", "time": "Time", "instant": "DateTime",
    "uri": "String", "url": "String", "canonical": "String", "base64binary": "String", "code": "String", "id": "String", "markdown": "String", "oid": "String", "uuid": "String",
    "positiveint": "Integer", "unsignedint": "Integer", "integer64": "Integer", "quantity": "Quantity", "simplequantity": "Quantity", "age": "Quantity", "count": "Quantity",
    "distance": "Quantity", "duration": "Quantity", "money": "Quantity",
}
#: Suffixes of elements that may have several types, in the order in which they are tried.
CHOICE_SUFFIXES = (
    "Boolean", "Integer", "Integer64", "Decimal", "String", "Code", "Id", "Uri", "Url", "Canonical",
    "Base64Binary", "Instant", "Date", "DateTime", "Time", "Oid", "Uuid", "Markdown", "PositiveInt", "UnsignedInt",
    "Quantity", "CodeableConcept", "Coding", "Range", "Period", "Ratio", "RatioRange",
    "Identifier", "Reference", "Attachment", "HumanName", "Address", "ContactPoint",
    "Timing", "Signature", "Annotation", "SampledData", "Age", "Distance", "Duration",
    "Count", "Money", "MoneyQuantity", "SimpleQuantity",
    "Meta", "Dosage", "ContactDetail", "Contributor", "DataRequirement", "Expression",
    "ParameterDefinition", "RelatedArtifact", "TriggerDefinition", "UsageContext",
)
#: Resources that are no DomainResource.
PLAIN_RESOURCES = {"Bundle", "Binary", "Parameters"}


def guess(names: set[str], arrays: set[str] = frozenset(), strings: set[str] = frozenset()) -> str:
    """The complex type of an object with these fields; the first that fits."""
    has = names.__contains__
    tests = (
        ("Quantity", has("value") and bool(names & {"unit", "code", "system"})),
        ("Coding", has("system") and has("code") and not has("value")),
        ("CodeableConcept", "coding" in arrays),
        ("Reference", has("reference")),
        ("Period", has("start") or has("end")),
        ("Identifier", has("system") and "value" in strings),
        ("Range", has("low") or has("high")),
        ("Ratio", has("numerator") or has("denominator")),
        ("Attachment", has("contentType")),
        ("HumanName", has("family") or "given" in arrays),
        ("Address", has("city") or has("postalCode")),
        ("ContactPoint", has("system") and has("use")),
        ("Annotation", has("text") and bool(names & {"time", "authorReference", "authorString"})),
    )
    return next((name for name, fits in tests if fits), "Object")


def static_type(c: Coll) -> str | None:
    """The type's name where the schema tells it; None where documents tell it themselves."""
    if c.kind in TYPE_NAMES:
        return TYPE_NAMES[c.kind]
    if c.kind != "object":
        return None
    fields = {n: d for n, (_, d) in c.fields.items()} if c.fields is not None else {f.name: f.dataType for f in c.dtype.fields}
    if "resourceType" in fields:
        return None
    kinds = {n: d.typeName() for n, d in fields.items()}
    return guess(set(kinds), {n for n, k in kinds.items() if k == "array"}, {n for n, k in kinds.items() if k == "string"})


def _subtype(actual: str, wanted: str) -> bool:
    capital = actual[:1].isupper() and actual not in TYPE_NAMES.values()
    return capital and (wanted == "Resource" or (wanted == "DomainResource" and actual not in PLAIN_RESOURCES))


def matches(actual: str, wanted: str) -> bool:
    """Whether an item of type `actual` is a `wanted`."""
    for prefix in ("System.", "FHIR."):
        if wanted.startswith(prefix):
            return matches(actual, wanted[len(prefix) :])
    if actual.lower() == wanted.lower() or _subtype(actual, wanted):
        return True
    return ALIASES.get(wanted.lower()) == actual or (ALIASES.get(actual.lower(), "").lower() == wanted.lower() and bool(wanted))


def column_matches(resource_type: Column, wanted: str) -> Column:
    """matches(), for types that a column holds."""
    wanted = wanted.removeprefix("FHIR.").removeprefix("System.")
    if wanted == "Resource":
        return resource_type.isNotNull()
    if wanted == "DomainResource":
        return resource_type.isNotNull() & ~resource_type.isin(*sorted(PLAIN_RESOURCES))
    return F.coalesce(F.lower(resource_type) == wanted.lower(), F.lit(False))
