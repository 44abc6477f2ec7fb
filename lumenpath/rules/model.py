"""Issues of a document, and what rules share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from lumenpath.sources.definitions import Definition, Element, Registry
from lumenpath.sources.terminology import Terminology


@dataclass(frozen=True)
class Issue:
    severity: str  # fatal error warning information
    code: str
    diagnostics: str
    expression: str = ""


@dataclass(frozen=True)
class Options:
    constraints: bool = True
    extensions: bool = True
    terminology: bool = False
    references: bool = False
    strict: bool = False
    max_errors: int = 0
    profile: str = ""
    skip_contained: bool = False


#: Suffixes and complex types by which an element's definition is found.
SUFFIXES = (
    "Boolean", "Integer", "String", "Date", "DateTime", "Time", "Decimal", "Uri", "Url", "Canonical", "Code", "Oid", "Id", "Uuid",
    "Markdown", "Base64Binary", "Instant", "PositiveInt", "UnsignedInt", "CodeableConcept", "Coding", "Quantity", "Range", "Period",
    "Ratio", "SampledData", "Attachment", "Reference", "Identifier", "HumanName", "Address", "ContactPoint", "Timing", "Signature",
    "Annotation", "Money", "Age", "Distance", "Duration", "Count",
)
COMPLEX = {
    "Address", "Age", "Annotation", "Attachment", "CodeableConcept", "CodeableReference", "Coding", "ContactDetail", "ContactPoint", "Contributor", "Count",
    "DataRequirement", "Distance", "Dosage", "Duration", "Element", "ElementDefinition", "Expression", "Extension", "HumanName", "Identifier", "Meta", "Money",
    "Narrative", "ParameterDefinition", "Period", "Population", "ProdCharacteristic", "ProductShelfLife", "Quantity", "Range", "Ratio", "RatioRange", "Reference",
    "RelatedArtifact", "SampledData", "Signature", "Timing", "TriggerDefinition", "UsageContext", "BackboneElement",
}


class Schema:
    """Finds the definition of an element by its path, also inside complex types; what was found is kept."""

    def __init__(self, registry: Registry, definition: Definition):
        self.registry, self.definition = registry, definition
        self.index = definition.index
        self._known: dict[str, Element | None] = {}

    def find(self, path: str) -> Element | None:
        if path not in self._known:
            self._known[path] = self._direct(self.index, path) or self._inside(path)
        return self._known[path]

    @staticmethod
    def _direct(index: dict[str, Element], path: str) -> Element | None:
        if path in index:
            return index[path]
        for suffix in SUFFIXES:
            if path.endswith(suffix) and (e := index.get(path[: -len(suffix)] + "[x]")) is not None:
                code = suffix[:1].lower() + suffix[1:]
                fits = tuple(t for t in e.types if t in (suffix, code)) or (suffix if suffix in COMPLEX else code,)
                return Element(path, e.min, e.max, fits, e.target_profiles, e.strength, e.value_set, e.constraints)
        return None

    def _inside(self, path: str) -> Element | None:
        """The nearest ancestor that is of a complex type, and the rest of the path in that type's definition."""
        parts = path.split(".")
        for k in range(len(parts) - 1, 0, -1):
            ancestor = self._direct(self.index, ".".join(parts[:k]))
            if ancestor is None:
                continue
            if ancestor.content_reference:
                return self.find(ancestor.content_reference.split("#")[-1] + "." + ".".join(parts[k:]))
            for code in ancestor.types:
                if code in COMPLEX:
                    d = self.registry.of_type(code)
                    if d is None or not d.elements:
                        return Element(path, 0, "*")  # the type isn't known: anything may be in it
                    rest = ".".join(parts[k:])
                    return Schema(self.registry, d).find(f"{code}.{rest}") or (Element(path, 0, "*") if code == "BackboneElement" else None)
            return None
        return None


@dataclass(frozen=True)
class Subject:
    """A document under validation."""

    resource: dict
    type: str
    schema: Schema
    registry: Registry
    options: Options
    terminology: Terminology | None = None
    resolver: object = None


def nodes(value, path: str, shown: str) -> Iterator[tuple[str, str, object]]:
    """(path, path with indices, value) of every item below, objects before what they hold."""
    if isinstance(value, list):
        for i, x in enumerate(value):
            yield from nodes(x, path, f"{shown}[{i}]")
        return
    yield path, shown, value
    if isinstance(value, dict):
        for k, x in value.items():
            if k != "resourceType":
                yield from nodes(x, f"{path}.{k}" if path else k, f"{shown}.{k}" if shown else k)


def listed(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]
