"""Structure definitions: schema metadata of documents, from files, folders or bundles of JSON.

Definitions are few (thousands at most, fixed by the specification), so they are held by the driver and sent to the executors with a plan; as a
frame they are one row for each element.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CANONICAL = "http://hl7.org/fhir/StructureDefinition/"


@dataclass(frozen=True)
class Constraint:
    key: str
    severity: str
    human: str
    expression: str
    source: str


@dataclass(frozen=True)
class Element:
    path: str
    min: int = 0
    max: str = ""
    types: tuple[str, ...] = ()
    target_profiles: tuple[tuple[str, ...], ...] = ()
    strength: str = ""
    value_set: str = ""
    constraints: tuple[Constraint, ...] = ()
    content_reference: str = ""
    summary: bool = False


@dataclass
class Definition:
    url: str
    name: str
    type: str
    kind: str
    abstract: bool
    base: str
    elements: list[Element] = field(default_factory=list)
    #: What a profile states beyond its base; rules use the snapshot.
    differential: list[Element] = field(default_factory=list)

    @property
    def index(self) -> dict[str, Element]:
        """By path; of elements with one path, such as slices, the last counts."""
        return {e.path: e for e in self.elements}


def _type_code(t: dict) -> str:
    code = t.get("code") or ""
    for e in t.get("extension") or []:
        if str(e.get("url", "")).endswith("structuredefinition-fhir-type"):
            code = e.get("valueUrl") or e.get("valueUri") or code
    return code.rsplit("/", 1)[-1].rsplit(".", 1)[-1] if code.startswith("http://hl7.org/fhirpath/") else code


def _element(e: dict) -> Element:
    binding, types = e.get("binding") or {}, e.get("type") or []
    constraints = tuple(Constraint(c.get("key", ""), c.get("severity", ""), c.get("human", ""), c.get("expression", ""), c.get("source", "")) for c in e.get("constraint") or [])
    targets = tuple(tuple(t.get("targetProfile") or ()) for t in types)
    return Element(e.get("path", ""), int(e.get("min") or 0), str(e.get("max") or ""), tuple(map(_type_code, types)), targets, binding.get("strength", ""), binding.get("valueSet", ""), constraints, e.get("contentReference", ""), bool(e.get("isSummary")))


def parse(d: dict) -> Definition:
    parts = [[_element(e) for e in (d.get(part) or {}).get("element") or [] if isinstance(e, dict)] for part in ("snapshot", "differential")]
    return Definition(d.get("url", ""), d.get("name", ""), d.get("type", ""), d.get("kind", ""), bool(d.get("abstract")), d.get("baseDefinition", ""), *parts)


class Registry:
    """Definitions by URL and by type. A profile never becomes the definition of its base type; a type's canonical URL wins."""

    def __init__(self, definitions=()):
        self.by_url: dict[str, Definition] = {}
        self.by_type: dict[str, Definition] = {}
        for d in definitions:
            self.register(d)

    def register(self, d: Definition) -> None:
        self.by_url[d.url] = d
        if "/profile/" in d.url:
            return
        if d.type not in self.by_type or d.url == CANONICAL + d.type:
            self.by_type[d.type] = d

    def get(self, url: str) -> Definition | None:
        return self.by_url.get(url)

    def of_type(self, name: str) -> Definition | None:
        return self.by_type.get(name)

    def urls(self) -> list[str]:
        return sorted(self.by_url)

    def __len__(self) -> int:
        return len(self.by_url)

    def load(self, value: dict) -> int:
        """A definition, or a bundle of some; how many were found."""
        kind = value.get("resourceType")
        if kind == "StructureDefinition":
            self.register(parse(value))
            return 1
        if kind == "Bundle":
            return sum(self.load(e["resource"]) for e in value.get("entry") or [] if isinstance(e.get("resource"), dict) and e["resource"].get("resourceType") == "StructureDefinition")
        return 0

    def load_file(self, path: str) -> int:
        return self.load(json.loads(Path(path).read_text()))

    def load_folder(self, path: str) -> int:
        """All *.json below path; files that can't be read are passed over."""
        n = 0
        for file in sorted(Path(path).rglob("*.json")):
            try:
                n += self.load_file(str(file))
            except (ValueError, OSError):
                continue
        return n

    def load_specification(self, folder: str) -> int:
        """The specification's three files of definitions, as far as they are there."""
        n = 0
        for name in ("profiles-resources.json", "profiles-types.json", "extension-definitions.json"):
            try:
                n += self.load_file(f"{folder}/{name}")
            except (ValueError, OSError):
                continue
        return n

    def load_spark(self, spark: SparkSession, path: str) -> int:
        """Definitions in a store that only Spark reads. Definitions are bounded by the specification, so they may come to the driver."""
        n = 0
        for r in spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path).toLocalIterator():
            try:
                n += self.load(json.loads(r["value"]))
            except ValueError:
                continue
        return n

    def summary_fields(self, type_name: str) -> list[str]:
        """Top-level elements that belong to a type's summary."""
        d = self.of_type(type_name)
        return [e.path.split(".")[1].removesuffix("[x]") for e in d.elements if e.summary and e.path.count(".") == 1] if d else []

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row for each element of each definition."""
        rows = [(d.url, d.type, e.path, e.min, e.max, list(e.types), e.strength, e.value_set) for d in self.by_url.values() for e in d.elements]
        return spark.createDataFrame(rows, "url string, type string, path string, min int, max string, types array<string>, strength string, value_set string")


#: Simple types of the specification and Spark's types for them.
SIMPLE = {
    "boolean": T.BooleanType(), "integer": T.IntegerType(), "unsignedInt": T.LongType(), "positiveInt": T.LongType(), "integer64": T.LongType(), "decimal": T.DecimalType(38, 16),
}
TEXT = {"string", "code", "id", "uri", "url", "canonical", "base64Binary", "markdown", "oid", "uuid", "xhtml", "date", "dateTime", "instant", "time", "String"}


def schema_of(registry: Registry, type_name: str, depth: int = 4) -> T.StructType:
    """The Spark schema of a type's documents: lists for repeated elements, one field for each type of a choice, a sibling _field for extensions
    of simple elements; recursion is cut at `depth`, below which values are JSON texts."""
    d = registry.of_type(type_name)
    fields = [T.StructField("resourceType", T.StringType())] if d is not None and d.kind == "resource" else []
    return T.StructType(fields + _children(registry, d, type_name, depth) if d else fields)


def _children(registry: Registry, d: Definition, prefix: str, depth: int) -> list[T.StructField]:
    out = []
    for e in d.elements:
        if not e.path.startswith(f"{prefix}.") or "." in e.path[len(prefix) + 1 :] or e.max == "0":
            continue
        name = e.path[len(prefix) + 1 :]
        if name.endswith("[x]"):
            options = [(name[:-3] + code[:1].upper() + code[1:], code) for code in e.types]
        else:
            options = [(name, e.types[0] if e.types else "")]
        for field_name, code in options:
            dtype, simple = _dtype(registry, d, e, code, depth)
            many = e.max not in ("", "1")
            out.append(T.StructField(field_name, T.ArrayType(dtype) if many else dtype))
            if simple and depth > 1 and registry.of_type("Extension"):
                extra = T.StructType([T.StructField("id", T.StringType()), T.StructField("extension", T.ArrayType(schema_of(registry, "Extension", 1)))])
                out.append(T.StructField(f"_{field_name}", T.ArrayType(extra) if many else extra))
    return out


def _dtype(registry: Registry, d: Definition, e: Element, code: str, depth: int) -> tuple[T.DataType, bool]:
    if code in SIMPLE:
        return SIMPLE[code], True
    if code in TEXT:
        return T.StringType(), True
    if depth <= 0 or code == "Resource":
        return T.StringType(), False
    nested = _children(registry, d, e.content_reference.removeprefix("#") or e.path, depth - 1)
    if not nested and (other := registry.of_type(code)) is not None:
        nested = _children(registry, other, code, depth - 1)
    return (T.StructType(nested), False) if nested else (T.StringType(), False)
