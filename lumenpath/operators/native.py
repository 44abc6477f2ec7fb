"""Validation of typed documents in columns only.

Where a frame has a schema, the rules follow from schema and definitions when the plan is made: what a document adds is an expression over its columns,
an array of issues. So Catalyst sees all of it, and no Python runs for a row. Documents as JSON texts are for operators.validate, which gives the same issues.

A null field is an absent one. The frame's documents are of one type; what names no known type is fatal. Elements that a definition doesn't know are
reported, elements whose column has another type than the definition's are reported where they are present.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpath.operators.evaluate import compiler
from lumenpath.operators.references import parse_reference
from lumenpath.plans.coll import present
from lumenpath.rules.content import _MOMENTS, _STRINGS
from lumenpath.rules.model import Options, Schema
from lumenpath.rules.structure import _EMPTY, _SAID, _TEXTS, FORMS
from lumenpath.sources.definitions import Definition, Registry
from lumenpath.sources.terminology import Terminology

ISSUES = "array<struct<severity:string,code:string,diagnostics:string,expression:string>>"
#: visit(value, type, path, path with indices) gives the issues of a node, each null where it is none, and whether to go on below it.
Visit = Callable[[Column, T.DataType, str, Column], tuple[list[Column], bool]]


def _text(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _issue(when: Column, severity: str, code: str, diagnostics, expression) -> Column:
    made = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), _text(diagnostics).alias("diagnostics"), _text(expression).alias("expression"))
    return F.when(when, made)


def _member(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def _none() -> Column:
    return F.array().cast(ISSUES)


def _many(items: Column, issues: Callable[[Column, Column], Column]) -> Column:
    """The issues of all items of an array."""
    return F.coalesce(F.flatten(F.transform(items, lambda x, i: issues(x, i))), _none())


def _joined(parts: list[Column]) -> Column | None:
    return None if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)


def _walk(x: Column, dtype: T.DataType, path: str, shown: Column, visit: Visit, leave: tuple[str, ...] = ()) -> Column | None:
    """The issues of a value and all below it; None if there can be none."""
    if isinstance(dtype, T.ArrayType):
        if _walk(F.lit(None), dtype.elementType, path, shown, visit, leave) is None:
            return None
        below = lambda item, i: _walk(item, dtype.elementType, path, F.concat(shown, F.lit("["), i.cast("string"), F.lit("]")), visit, leave)
        return _many(x, below)
    found, on = visit(x, dtype, path, shown)
    parts = [F.array(*found)] if found else []
    if on and isinstance(dtype, T.StructType):
        parts += _fields(lambda name: x[name], dtype, path, shown, visit, leave)
    return _joined(parts)


def _fields(get: Callable[[str], Column], dtype: T.StructType, path: str, shown: Column | None, visit: Visit, leave: tuple[str, ...]) -> list[Column]:
    out = []
    for f in dtype.fields:
        if f.name == "resourceType" or f.name in leave:
            continue
        below = F.lit(f.name) if shown is None else F.concat(shown, F.lit(f".{f.name}"))
        found = _walk(get(f.name), f.dataType, f"{path}.{f.name}", below, visit, leave)
        if found is not None:
            out.append(found)
    return out


@dataclass
class _Typed:
    """The rules of one type's frames."""

    df: DataFrame
    registry: Registry
    definition: Definition
    options: Options
    terminology: Terminology | None

    def __post_init__(self):
        self.type, self.schema = self.definition.type, Schema(self.registry, self.definition)
        self.compiler = compiler(self.df, self.type)

    def get(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def issues(self) -> Column:
        o = self.options
        parts = [*self._structure(self.get, self.df.schema, self.type), *self._missing()]
        parts += _fields(self.get, self.df.schema, self.type, None, self._content, ())
        if o.constraints:
            parts += self._constraints()
        if o.terminology and self.terminology is not None:
            parts += self._bindings()
        if o.references:
            parts += _fields(self.get, self.df.schema, self.type, F.lit(self.type), self._reference, ("contained",))
        if o.extensions:
            parts += [p for p in [self._extensions(self.get, self.df.schema, F.lit(self.type))] if p is not None]
            parts += self._extended_below(self.get, self.df.schema, F.lit(self.type))
        return F.array_compact(_joined(parts) if parts else _none())

    # structure and simple values

    def _structure(self, get, dtype: T.StructType, path: str) -> list[Column]:
        out = []
        for f in dtype.fields:
            if f.name.startswith("_") or (f.name == "resourceType" and path == self.type):
                continue
            x, below = get(f.name), f"{path}.{f.name}"
            e = self.schema.find(below)
            if e is None:
                out.append(F.array(_issue(x.isNotNull(), "error", "structure", f"Unknown element: {below}", below)))
                continue
            many = isinstance(f.dataType, T.ArrayType)
            n, most = F.size(x) if many else F.lit(1), int(e.max) if e.max.isdigit() else 0
            said = lambda what, limit, n=n, below=below: F.concat(F.lit(f"Element '{below}' has "), n.cast("string"), F.lit(f" items but {what} is {limit}"))
            if many and e.min:
                out.append(F.array(_issue(x.isNotNull() & (n < e.min), "error", "required", said("minimum", e.min), below)))
            if many and most:
                out.append(F.array(_issue(x.isNotNull() & (n > most), "error", "structure", said("maximum", most), below)))
            if "Resource" in e.types:
                continue
            inner = f.dataType.elementType if many else f.dataType
            if isinstance(inner, T.StructType):
                if many:
                    if self._structure(lambda name: F.lit(None), inner, below):
                        out.append(_many(x, lambda item, i, inner=inner, below=below: F.concat(*self._structure(lambda name: item[name], inner, below))))
                else:
                    out += self._structure(lambda name, x=x: x[name], inner, below)
            elif e.types:
                of = lambda item, inner=inner, e=e, below=below: self._value(item, inner, e.types[0], below)
                if of(F.lit(None)) is not None:
                    out.append(_many(x, lambda item, i, of=of: F.array(of(item))) if many else F.array(of(x)))
        return out

    @staticmethod
    def _value(x: Column, dtype: T.DataType, kind: str, path: str) -> Column | None:
        numeric, is_text = isinstance(dtype, T.NumericType), isinstance(dtype, T.StringType)
        wrong = lambda when, what: _issue(when, "error", "value", f"Element '{path}' must be {what}", path)
        if kind == "boolean":
            return None if isinstance(dtype, T.BooleanType) else wrong(x.isNotNull(), "a boolean")
        if kind in ("integer", "positiveInt", "unsignedInt"):
            if not numeric:
                return wrong(x.isNotNull(), "an integer")
            sign = {"positiveInt": (x <= 0, "a positive integer"), "unsignedInt": (x < 0, "a non-negative integer")}.get(kind)
            whole = F.lit(False) if isinstance(dtype, T.IntegralType) else x != F.floor(x)
            return F.coalesce(wrong(whole, "an integer"), wrong(*sign)) if sign else None if isinstance(dtype, T.IntegralType) else wrong(whole, "an integer")
        if kind == "decimal":
            return None if numeric else wrong(x.isNotNull(), "a decimal number")
        if kind in _TEXTS:
            return None if is_text else wrong(x.isNotNull(), "a string")
        if kind in FORMS:
            if not is_text:
                return wrong(x.isNotNull(), f"a string ({kind})")
            return _issue(~x.rlike(rf"\A(?:{FORMS[kind]})\z"), "error", "value", F.concat(F.lit(f"Element '{path}' has invalid {_SAID[kind]}: "), x), path)
        return None

    def _exists(self, path: str) -> Column:
        return F.coalesce(present(self.compiler.compile(path)), F.lit(False)) if path else F.lit(True)

    def _missing(self) -> list[Column]:
        out = []
        for e in self.definition.elements:
            inside = e.path[len(self.type) + 1 :].removesuffix("[x]")
            if e.min == 0 or not inside:
                continue
            above = inside.rpartition(".")[0]
            gone = self._exists(above) & ~self._exists(inside)
            if "." not in inside and inside in self.df.columns:
                gone = self.get(inside).isNull()
            out.append(F.array(_issue(gone, "error", "required", f"Missing required element: {e.path} (min={e.min})", e.path)))
        return out

    # elements without content

    def _content(self, x: Column, dtype: T.DataType, path: str, shown: Column) -> tuple[list[Column], bool]:
        if isinstance(dtype, T.StringType) and path.rpartition(".")[2] != "id":
            return [_issue(x == "", "error", "invariant", f"{_EMPTY} (empty string)", shown)], False
        if isinstance(dtype, T.StructType):
            other = [x[f.name].isNull() for f in dtype.fields if f.name != "id"]
            empty = x.isNotNull()
            for gone in other:
                empty = empty & gone
            if "resourceType" not in dtype.names:
                return [_issue(empty, "error", "invariant", _EMPTY, shown)], True
        return [], True

    # constraints and codes

    def _constraints(self) -> list[Column]:
        out = []
        for e in self.definition.elements:
            below = e.path[len(self.type) + 1 :]
            for c in e.constraints:
                if not c.expression or (c.source and c.source != self.definition.url):
                    continue
                there = self._exists(".first().".join(below.split("."))) if below else F.lit(True)
                good = F.coalesce(self.compiler.boolean(self.compiler.compile(f"{below}.all({c.expression})" if below else c.expression)), F.lit(False))
                severity = "warning" if c.severity == "warning" else "error"
                out.append(F.array(_issue(there & ~good, severity, "invariant", f"Constraint {c.key} violated: {c.human}", e.path)))
        return out

    def _bindings(self) -> list[Column]:
        out = []
        for e in self.definition.elements:
            if e.strength not in ("required", "extensible") or not e.value_set:
                continue
            inside = e.path[len(self.type) + 1 :]
            known, codes = self.terminology.expand(e.value_set), self._codes(inside)
            if codes is None:
                continue
            severity = "error" if e.strength == "required" else "warning"
            if not self.terminology.has_set(e.value_set):
                said = lambda c, e=e: F.concat(F.lit("Could not validate code '"), c["code"], F.lit(f"' against ValueSet {e.value_set}: ValueSet not found"))
                out.append(_many(codes, lambda c, i, e=e, said=said: F.array(_issue(F.lit(True), "warning", "code-invalid", said(c), e.path))))
                continue
            plain = F.array(*[F.lit(c.code) for c in known]) if known else F.array().cast("array<string>")
            full = F.array(*[F.lit(f"{c.system}|{c.code}") for c in known]) if known else plain
            shown = lambda c: F.concat(F.when(c["system"] != "", F.concat(c["system"], F.lit("|"))).otherwise(""), c["code"])
            hit = lambda c, plain=plain, full=full, shown=shown: F.when(c["system"] != "", F.array_contains(full, shown(c))).otherwise(F.array_contains(plain, c["code"]))
            said = lambda c, e=e, shown=shown: F.concat(F.lit("Code '"), shown(c), F.lit(f"' is not in ValueSet {e.value_set} (binding: {e.strength})"))
            out.append(_many(codes, lambda c, i, e=e, hit=hit, said=said, severity=severity: F.array(_issue(~hit(c), severity, "code-invalid", said(c), e.path))))
        return out

    def _codes(self, path: str) -> Column | None:
        """(system, code) of texts, codings or concepts at a path."""
        parts, dtype, x = path.split("."), self.df.schema, None
        for name in parts:
            if not isinstance(dtype, T.StructType) or name not in dtype.names:
                return None
            field = dtype[name].dataType
            repeated = isinstance(field, T.ArrayType)
            if x is None:
                x = self.get(name)
            else:
                x = F.transform(x, _member(name))
                x = F.flatten(x) if repeated else x
            if name == parts[0] and not repeated:
                x = F.array(x)
            dtype = field.elementType if repeated else field
        x, none = F.array_compact(x), F.lit("")
        pair = lambda system, code: F.struct(F.coalesce(system, none).alias("system"), code.alias("code"))
        if isinstance(dtype, T.StringType):
            return F.transform(x, lambda v: pair(none, v))
        if isinstance(dtype, T.StructType) and "coding" in dtype.names:
            inner = dtype["coding"].dataType.elementType
            x, dtype = F.flatten(F.array_compact(F.transform(x, lambda v: v["coding"]))), inner
        if isinstance(dtype, T.StructType) and "code" in dtype.names and isinstance(dtype["code"].dataType, T.StringType):
            own = F.filter(x, lambda v: v["code"].isNotNull())
            return F.transform(own, lambda v: pair(v["system"] if "system" in dtype.names else none, v["code"]))
        return None

    # references

    def _reference(self, x: Column, dtype: T.DataType, path: str, shown: Column) -> tuple[list[Column], bool]:
        if not isinstance(dtype, T.StructType) or "reference" not in dtype.names or not isinstance(dtype["reference"].dataType, T.StringType):
            return [], True
        text, at = x["reference"], F.concat(shown, F.lit(".reference"))
        parsed = parse_reference(text)
        quoted = lambda what: F.concat(F.lit(f"{what}: '"), text, F.lit("'"))
        ids = F.array().cast("array<string>")
        if "contained" in self.df.columns and "id" in getattr(getattr(self.df.schema["contained"].dataType, "elementType", None), "names", []):
            ids = F.coalesce(F.transform(self.get("contained"), lambda c: c["id"]), ids)
        out = [
            _issue((parsed["form"] == "contained") & ~F.coalesce(F.array_contains(ids, parsed["id"]), F.lit(False)), "error", "not-found", quoted("Contained resource not found"), at),
            _issue(parsed["form"] == "invalid", "error", "value", quoted("Invalid reference format"), at),
        ]
        e = self.schema.find(path)
        for code, profiles in zip(e.types, e.target_profiles, strict=False) if e is not None else ():
            allowed = [p.split("|")[0].rsplit("/", 1)[-1] for p in profiles]
            if code == "Reference" and allowed and "Resource" not in allowed:
                said = F.concat(F.lit("Reference to '"), parsed["resource_type"], F.lit(f"' not allowed; expected one of: {', '.join(allowed)}"))
                out.append(_issue(~parsed["resource_type"].isin(allowed), "error", "value", said, at))
        return out, True

    # extensions

    def _extended_below(self, get, dtype: T.StructType, shown: Column) -> list[Column]:
        """Extensions of everything below, but of extensions, which look after their own."""
        out = []
        for f in dtype.fields:
            many = isinstance(f.dataType, T.ArrayType)
            inner = f.dataType.elementType if many else f.dataType
            if f.name in ("extension", "modifierExtension") or not isinstance(inner, T.StructType):
                continue

            def of(x, at, inner=inner):
                own = self._extensions(lambda name: x[name], inner, at)
                return _joined([p for p in [own, *self._extended_below(lambda name: x[name], inner, at)] if p is not None])

            at = F.concat(shown, F.lit(f".{f.name}"))
            if of(F.lit(None), at) is not None:
                index = lambda i, at=at: F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
                out.append(_many(get(f.name), lambda x, i, of=of, index=index: of(x, index(i))) if many else of(get(f.name), at))
        return out

    def _extensions(self, get, dtype: T.StructType, shown: Column) -> Column | None:
        parts = []
        for name in ("extension", "modifierExtension"):
            if name in dtype.names and isinstance(dtype[name].dataType, T.ArrayType) and isinstance(dtype[name].dataType.elementType, T.StructType):
                inner = dtype[name].dataType.elementType
                at = lambda i, name=name: F.concat(shown, F.lit(f".{name}["), i.cast("string"), F.lit("]"))
                parts.append(_many(get(name), lambda x, i, inner=inner, at=at: self._extension(x, inner, at(i))))
        return _joined(parts)

    def _extension(self, x: Column, dtype: T.StructType, at: Column) -> Column:
        url = x["url"] if "url" in dtype.names else F.lit(None).cast("string")
        given = F.coalesce(url != "", F.lit(False))
        values = [n for n in dtype.names if n.startswith("value") and n != "value"]
        valued = F.lit(False)
        for n in values:
            valued = valued | x[n].isNotNull()
        nested = "extension" in dtype.names and isinstance(dtype["extension"].dataType, T.ArrayType)
        nests = F.coalesce(F.size(x["extension"]) > 0, F.lit(False)) if nested else F.lit(False)
        fine = url.rlike("^(http://|https://|urn:)") | url.rlike(r"\A[A-Za-z0-9_-]+\z")
        out = [
            _issue(x.isNotNull() & ~given, "error", "required", "Extension must have a 'url' field", at),
            _issue(given & ~fine, "error", "value", F.concat(F.lit("Invalid extension URL format: '"), url, F.lit("'")), F.concat(at, F.lit(".url"))),
            _issue(given & valued & nests, "error", "structure", "Extension cannot have both a value and nested extensions", at),
            _issue(given & ~valued & ~nests, "error", "required", "Extension must have either a value[x] or nested extensions", at),
            *self._defined(x, dtype, values, url, given, at),
        ]
        own = F.array(*out)
        if not nested:
            return own
        inner = dtype["extension"].dataType.elementType
        below = lambda e, i: self._extension(e, inner, F.concat(at, F.lit(".extension["), i.cast("string"), F.lit("]")))
        return F.concat(own, _many(F.when(given, x["extension"]), below)) if isinstance(inner, T.StructType) else own

    def _defined(self, x: Column, dtype: T.StructType, values: list[str], url: Column, given: Column, at: Column) -> list[Column]:
        """Against the definitions, which are bounded by the specification and become maps in the plan."""
        kinds = {u: d.type for u, d in self.registry.by_url.items()}
        allowed = {u: next((e.types for e in d.elements if e.path.startswith("Extension.value")), None) for u, d in self.registry.by_url.items() if d.type == "Extension"}
        table = lambda pairs, kind: F.create_map(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for p in pairs.items() for v in p]) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))
        kind = F.try_element_at(table(kinds, "string"), url)
        said = F.concat(F.lit("URL '"), url, F.lit("' does not define an Extension (type: "), kind, F.lit(")"))
        out = [_issue(given & (kind != "Extension"), "error", "extension", said, at)]
        if self.options.strict:
            out.append(_issue(given & kind.isNull(), "warning", "extension", F.concat(F.lit("Extension definition not found: '"), url, F.lit("'")), at))
        typed = {u: [t.lower() for t in types] for u, types in allowed.items() if types}
        names = {u: ", ".join(types) for u, types in allowed.items() if types}
        for n in values:
            have = n.removeprefix("value")
            fits = F.array_contains(F.try_element_at(table(typed, "array<string>"), url), have.lower())
            text = F.concat(F.lit(f"Extension value type '{have}' not allowed; expected one of: "), F.try_element_at(table(names, "string"), url))
            out.append(_issue(given & x[n].isNotNull() & ~fits, "error", "value", text, at))
            wrong = self._mistyped(dtype[n].dataType, have)
            if wrong:
                out.append(_issue(given & x[n].isNotNull() & F.coalesce(fits, kind.isNull()), "error", "value", wrong, F.concat(at, F.lit(f".{n}"))))
        return out

    @staticmethod
    def _mistyped(dtype: T.DataType, kind: str) -> str | None:
        low = kind.lower()
        name = "string" if isinstance(dtype, T.StringType) else "bool" if isinstance(dtype, T.BooleanType) else "float64" if isinstance(dtype, T.NumericType) else "map[string]interface {}"
        wanted = "string" if low in _STRINGS or low in _MOMENTS else {"boolean": "boolean", "integer": "integer", "positiveint": "integer", "unsignedint": "integer", "decimal": "number"}.get(low)
        fits = {"string": "string", "boolean": "bool", "integer": "float64", "number": "float64"}
        return None if wanted is None or fits[wanted] == name else f"Expected {wanted} for type '{kind}', got {name}"


def issues(df: DataFrame, registry: Registry, type_name: str, options: Options | None = None, terminology: Terminology | None = None, keep: tuple = ()) -> DataFrame:
    """One row for each issue of documents of one type: the columns to keep (which are no elements), severity, code, diagnostics, expression."""
    definition = registry.of_type(type_name)
    if definition is None:
        raise KeyError(f"unknown resource type: {type_name}")
    own = df.drop(*keep)
    found = _Typed(own, registry, definition, options or Options(), terminology).issues()
    if "resourceType" in own.columns:
        kind = F.col("resourceType")
        unknown = F.array(_issue(F.lit(True), "fatal", "not-found", F.concat(F.lit("Unknown resource type: "), kind), ""))
        nothing = F.array(_issue(F.lit(True), "fatal", "required", "Resource must have a resourceType", ""))
        found = F.when(F.coalesce(kind, F.lit("")) == "", nothing).when(kind == type_name, found).when(~kind.isin(sorted(registry.by_type)), unknown)
    made = df.select(*[F.col(f"`{k}`") for k in keep], F.explode(found).alias("_issue"))
    return made.select(*[F.col(f"`{k}`") for k in keep], "_issue.*")
