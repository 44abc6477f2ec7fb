"""Extensions and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpath.functions.registry import function
from lumenpath.plans.coll import EMPTY, Coll, child, choice_item, first, let, to_many

#: Elements that hold an extension's value, in the order in which they are tried.
EXTENSION_VALUES = (
    "valueString", "valueBoolean", "valueInteger", "valueDecimal", "valueDate", "valueDateTime", "valueTime", "valueCode", "valueCoding", "valueCodeableConcept", "valueQuantity",
    "valueReference", "valueIdentifier", "valuePeriod", "valueRange", "valueRatio", "valueAttachment", "valueUri", "valueUrl", "valueCanonical",
)


def _extensions(c, this, node):
    found = child(this, "extension") if this.kind == "object" else None
    if found is None or found.kind != "object" or "url" not in found.dtype.names:
        return EMPTY
    url = first(c.argument(node, this))
    if url.kind != "string":
        return EMPTY
    items = to_many(found)
    return found.with_col(F.filter(items, lambda e: F.coalesce(e["url"] == url.col, F.lit(False))), True)


@function("extension", 1)
def extension(c, this, args):
    return _extensions(c, this, args[0])


@function("hasExtension", 1)
def has_extension(c, this, args):
    found = _extensions(c, this, args[0])
    return Coll("boolean", F.lit(False) if found.kind == "empty" else F.size(found.col) > 0)


@function("getExtensionValue", 1)
def get_extension_value(c, this, args):
    found = _extensions(c, this, args[0])
    if found.kind == "empty":
        return EMPTY
    variants = [(n, v) for n in EXTENSION_VALUES if n in found.dtype.names and (v := child(found, n)) is not None and v.kind != "empty"]
    if not variants:
        return EMPTY
    if len(variants) == 1:
        return variants[0][1]
    return Coll("choice", variants=tuple((n.removeprefix("value"), v) for n, v in variants))


def is_standard_extension(url):
    """Whether an extension's URL is one of the specification's."""
    return F.startswith(url, F.lit("http://hl7.org/fhir/"))


def extension_name(url):
    """The last part of an extension's URL."""
    return F.substring_index(url, "/", -1)


def reference_text(this: Coll) -> Coll:
    """Texts of references: the strings themselves, or objects' `reference`."""
    this = choice_item(this, "string")
    if this.kind == "string":
        return this
    return (child(this, "reference") or EMPTY) if this.kind == "object" else EMPTY


def reference_key(text):
    """Type/id of a reference or an absolute URL."""
    return F.when(F.contains(text, F.lit("/")), F.substring_index(text, "/", -2)).otherwise(text)


@function("getReferenceKey", 0, 1)
def get_reference_key(c, this, args):
    found = reference_text(this)
    if found.kind == "empty":
        return EMPTY
    part = c.argument(args[0], this).literal if args else None

    def of(text):
        key = reference_key(text)
        if part == "type":
            return F.when(F.contains(key, F.lit("/")), F.substring_index(key, "/", 1))
        return F.substring_index(key, "/", -1) if part == "id" else key

    if found.many:
        return found.with_col(F.array_compact(F.transform(found.col, of)))
    return found.with_col(of(found.col))


@function("resolve")
def resolve(c, this, args):
    """Documents that the input refers to, looked up in the resolver that the frame was joined with.

    operators.references.with_resolved() adds, as variable, a map from Type/id to documents of the row's references; there is none without it.
    """
    resolver = c.scope.variables.get("__resolved")
    found = reference_text(this)
    if resolver is None or found.kind == "empty":
        return EMPTY
    keys = F.transform(to_many(found), reference_key)
    got = let(resolver.col, lambda m: F.array_compact(F.transform(keys, lambda k: F.try_element_at(m, k))))
    return Coll("object", got, True, resolver.dtype)
