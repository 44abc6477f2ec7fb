"""Validation of one document: the rules in their order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from itertools import islice

from lumenpath.interp.values import load
from lumenpath.rules.bundle import bundle, known_type
from lumenpath.rules.content import bindings, constraints, extensions, references
from lumenpath.rules.model import Issue, Options, Schema, Subject, listed
from lumenpath.rules.structure import has_content, simple_values, structure
from lumenpath.sources.definitions import Definition, Registry
from lumenpath.sources.terminology import Terminology


class Validator:
    """Holds the definitions and what was found in them; documents are validated one by one."""

    def __init__(self, registry: Registry, options: Options | None = None, terminology: Terminology | None = None, resolver=None):
        self.registry, self.options, self.terminology, self.resolver = registry, options or Options(), terminology, resolver
        self._schemas: dict[str, Schema] = {}

    def schema(self, d: Definition) -> Schema:
        if d.url not in self._schemas:
            self._schemas[d.url] = Schema(self.registry, d)
        return self._schemas[d.url]

    def validate(self, document) -> list[Issue]:
        found = self._issues(document)
        return list(islice(found, self.options.max_errors) if self.options.max_errors else found)

    def _issues(self, document) -> Iterator[Issue]:
        value = load(document) if isinstance(document, (str, bytes)) else document
        if not isinstance(value, dict):
            yield Issue("fatal", "structure", "Invalid JSON: an object is expected")
            return
        kind = value.get("resourceType")
        if not isinstance(kind, str) or not kind:
            yield Issue("fatal", "required", "Resource must have a resourceType")
            return
        d = self.registry.get(self.options.profile) if self.options.profile else self.registry.of_type(kind)
        if d is None:
            yield Issue("fatal", "not-found", f"Profile not found: {self.options.profile}" if self.options.profile else f"Unknown resource type: {kind}")
            return
        s = Subject(value, kind, self.schema(d), self.registry, self.options, self.terminology, self.resolver)
        yield from self._rules(s, True)

    def _rules(self, s: Subject, top: bool) -> Iterator[Issue]:
        o = s.options
        yield from structure(s, required=top)
        yield from simple_values(s)
        yield from has_content(s)
        if o.constraints:
            yield from constraints(s)
        if o.terminology:
            yield from bindings(s)
        if o.references and top:
            yield from references(s)
        if o.extensions:
            yield from extensions(s)
        if s.type == "Bundle":
            yield from bundle(s)
            for i, e in enumerate(listed(s.resource.get("entry")) if known_type(s.resource) else ()):
                yield from self._entry(s, e, f"Bundle.entry[{i}].resource")

    def _entry(self, s: Subject, e, at: str) -> Iterator[Issue]:
        resource = e.get("resource") if isinstance(e, dict) else None
        if not isinstance(resource, dict):
            return
        kind = resource.get("resourceType")
        if not isinstance(kind, str) or not kind:
            yield Issue("error", "required", "Bundle entry resource must have a resourceType", f"{at}.resourceType")
            return
        d = self.registry.of_type(kind)
        if d is None:
            yield Issue("error", "not-found", f"Unknown resource type in entry: {kind}", at)
            return
        for issue in self._rules(Subject(resource, kind, self.schema(d), s.registry, s.options, s.terminology, s.resolver), False):
            yield replace(issue, expression=f"{at}: {issue.expression}")


def valid(issues: list[Issue]) -> bool:
    return not any(i.severity in ("fatal", "error") for i in issues)
