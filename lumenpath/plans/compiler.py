"""Compiles a path expression to Spark columns.

The plan is declarative: navigation is field access, lambdas are higher-order functions, an empty singleton is null, and three-valued logic is SQL's.
Modes: `compat` follows observable behaviour of the reference, `spec` the text of the specification. With `strict`, what is an
error there (several items for one, division by zero, incomparable items) raises; otherwise the result is empty for that row only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpath.functions import registry
from lumenpath.lang import nodes as N
from lumenpath.lang.errors import FunctionNotFound, InvalidArguments, InvalidOperation, InvalidPath, SingletonExpected, TypeMismatch
from lumenpath.lang.parser import parse
from lumenpath.plans import temporal
from lumenpath.plans.coll import EMPTY, NUMERIC, SPARK_TYPES, Coll, as_quantity, child, choice_item, first, is_quantity, let, none, object_column, present, size, to_many
from lumenpath.plans.types import CHOICE_SUFFIXES, column_matches, matches, static_type


@dataclass(frozen=True)
class Scope:
    root: Coll
    this: Coll
    index: Column | None = None
    total: Coll | None = None
    variables: dict = field(default_factory=dict)


def document(df: DataFrame, resource_type: str | None = None) -> Coll:
    """The rows of df as documents; resource_type, where all rows have one type and df has no such column."""
    fields = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    if resource_type and "resourceType" not in fields:
        fields["resourceType"] = (F.lit(resource_type), T.StringType())
    return Coll("object", None, False, T.StructType([T.StructField(n, d) for n, (_, d) in fields.items()]), fields=fields)


def literal(kind: str, value) -> Coll:
    if kind == "empty":
        return EMPTY
    if kind in ("date", "time", "datetime"):
        return Coll(kind, temporal.of_parts(kind, value))
    if kind == "quantity":
        number, unit = value
        return Coll(kind, F.struct(F.lit(float(number)).alias("value"), F.lit(unit).alias("unit")), literal=unit)
    if kind == "decimal":
        return Coll(kind, F.lit(float(value)), literal=float(value))
    return Coll(kind, F.lit(value).cast(SPARK_TYPES[kind]), literal=value)


def constant(value) -> Coll:
    """A Python value, or a column of strings, as the value of a %variable."""
    if isinstance(value, Coll):
        return value
    if isinstance(value, Column):
        return Coll("string", value)
    for kind, types in (("boolean", bool), ("integer", int), ("decimal", float), ("string", str)):
        if isinstance(value, types):
            return literal(kind, value)
    return EMPTY


def bound(a: Coll, b: Coll, body) -> Column:
    """body(a, b), with both columns computed once; for operators that read parts of their operands."""
    return let(F.struct(a.col.alias("a"), b.col.alias("b")), lambda p: body(replace(a, col=p["a"]), replace(b, col=p["b"])))


class Compiler:
    def __init__(self, root: Coll, variables: dict | None = None, spec: bool = False, strict: bool = False, max_items: int | None = None):
        import lumenpath.functions.library  # noqa: F401  registers the functions

        known = {"resource": root, "context": root} | {k: constant(v) for k, v in (variables or {}).items()}
        self.scope = Scope(root, root, variables=known)
        self.spec, self.strict, self.max_items = spec, strict, max_items

    def compile(self, expression: str) -> Coll:
        return self.visit(parse(expression))

    # scopes

    def within(self, scope: Scope, node: N.Node) -> Coll:
        before, self.scope = self.scope, scope
        try:
            return self.visit(node)
        finally:
            self.scope = before

    def argument(self, node: N.Node, this: Coll) -> Coll:
        """An argument; $this is the whole input."""
        return self.within(replace(self.scope, this=this), node)

    def item(self, node: N.Node, of: Coll, column: Column, index: Column | None = None, total: Coll | None = None) -> Coll:
        """node for one item of a collection."""
        one = replace(of, col=column, many=False, fields=None if of.many else of.fields, literal=None)
        return self.within(replace(self.scope, this=one, index=index if index is not None else self.scope.index, total=total or self.scope.total), node)

    # errors

    def fail(self, condition: Column, message: str, value: Column) -> Column:
        """value, but where condition holds an error, or null where not strict."""
        if self.strict:
            return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)
        return F.when(~F.coalesce(condition, F.lit(False)), value)

    def one(self, c: Coll, what: str = "operand") -> Coll:
        """c as a singleton; several items are an error."""
        if c.kind == "choice":
            return replace(c, variants=tuple((s, self.one(v, what)) for s, v in c.variants))
        if not c.many:
            return c
        return c.with_col(let(c.col, lambda x: self.fail(F.size(x) > 1, f"{what}: one item expected", F.get(x, F.lit(0)))), False)

    def boolean(self, c: Coll) -> Column:
        """The first item if it is a Boolean, else null."""
        c = choice_item(c, "boolean")
        return first(c).col if c.kind == "boolean" else none("boolean")

    # nodes

    def visit(self, node: N.Node) -> Coll:
        return getattr(self, f"visit_{type(node).__name__.lower()}")(node)

    def visit_literal(self, node: N.Literal) -> Coll:
        return literal(node.kind, node.value)

    def visit_variable(self, node: N.Variable) -> Coll:
        if node.name not in self.scope.variables:
            raise InvalidPath(f"undefined variable: %{node.name}")
        return self.scope.variables[node.name]

    def visit_special(self, node: N.Special) -> Coll:
        if node.name == "this":
            return self.scope.this
        if node.name == "index":
            return Coll("integer", self.scope.index.cast("long")) if self.scope.index is not None else EMPTY
        return self.scope.total or EMPTY

    def visit_member(self, node: N.Member) -> Coll:
        return self.navigate(self.scope.this, node.name)

    def visit_dot(self, node: N.Dot) -> Coll:
        base = self.visit(node.base)
        return self.within(replace(self.scope, this=base), node.step)

    def navigate(self, base: Coll, name: str) -> Coll:
        if base.kind == "choice":
            found = [c for _, v in base.variants if (c := self.navigate(v, name)).kind != "empty"]
            return found[0] if len(found) == 1 else Coll("choice", variants=tuple((c.kind, c) for c in found)) if found else EMPTY
        if base.kind != "object":
            return EMPTY
        got = child(base, name)
        typed = name[:1].isupper() and got is None
        if typed:  # the path starts with the document's type
            kind = child(base, "resourceType")
            if kind is not None and kind.kind == "string":
                if base.many:
                    return base.with_col(F.filter(base.col, lambda x: column_matches(x["resourceType"], name)))
                if isinstance(kind.literal, str) or base.fields is not None:
                    known = base.fields["resourceType"][0] if base.fields is not None else kind.col
                    return replace(base, guard=column_matches(known, name))
                return base.with_col(F.when(column_matches(kind.col, name), base.col))
            actual = static_type(base)
            return base if actual and matches(actual, name) else EMPTY
        if got is not None:
            return got
        variants = [(s, c) for s in CHOICE_SUFFIXES if (c := child(base, name + s)) is not None and c.kind != "empty"]
        if len(variants) == 1:
            return variants[0][1]
        return Coll("choice", variants=tuple(variants)) if variants else EMPTY

    def visit_index(self, node: N.Index) -> Coll:
        base, at = self.visit(node.base), self.one(self.visit(node.at), "index")
        if base.kind == "empty" or at.kind == "empty":
            return EMPTY
        if at.kind != "integer":
            raise TypeMismatch("an index has to be an Integer")
        if base.kind == "choice":
            return replace(base, variants=tuple((s, self._at(v, at)) for s, v in base.variants))
        return self._at(base, at)

    def _at(self, base: Coll, at: Coll) -> Coll:
        return base.with_col(F.get(to_many(base), at.col.cast("int")), False)

    def visit_call(self, node: N.Call) -> Coll:
        known = registry.get(node.name)
        if known is None:
            raise FunctionNotFound(f"unknown function: {node.name}")
        if not known.least <= len(node.args) <= known.most:
            raise InvalidArguments(f"{node.name}: {known.least} to {known.most} arguments, not {len(node.args)}")
        return known.build(self, self.scope.this, node.args)

    def visit_sign(self, node: N.Sign) -> Coll:
        of = self.one(self.visit(node.of), "sign")
        if of.kind == "empty" or node.op == "+":
            return of
        of = choice_item(of, "decimal")
        if of.kind not in NUMERIC:
            raise TypeMismatch(f"- of {of.kind}")
        return Coll(of.kind, -of.col, literal=-of.literal if isinstance(of.literal, (int, float)) else None)

    def visit_typetest(self, node: N.TypeTest) -> Coll:
        of = self.one(self.visit(node.of), node.op)
        return self.is_type(of, node.type_name) if node.op == "is" else self.as_type(of, node.type_name)

    def is_type(self, c: Coll, name: str) -> Coll:
        if c.kind == "empty":
            return EMPTY
        if c.kind == "choice":
            hit = F.lit(False)
            for suffix, v in c.variants:
                if self._fits(v, suffix, name):
                    hit = hit | present(v)
            return Coll("boolean", F.when(present(c), hit))
        c = first(c)
        kind = static_type(c)
        if kind is None:
            column = child(c, "resourceType").col
            return Coll("boolean", F.when(present(c), column_matches(column, name)))
        return Coll("boolean", F.when(present(c), F.lit(matches(kind, name))))

    def _fits(self, v: Coll, suffix: str, name: str) -> bool:
        kind = static_type(v) or ""
        return matches(kind, name) or matches(suffix, name) or (is_quantity(v) and matches("Quantity", name))

    def as_type(self, c: Coll, name: str) -> Coll:
        """The items of that type."""
        if c.kind == "empty":
            return EMPTY
        if c.kind == "choice":
            fits = [v for s, v in c.variants if self._fits(v, s, name)]
            return fits[0] if fits else EMPTY
        kind = static_type(c)
        if kind is not None:
            return c if matches(kind, name) else EMPTY
        if c.many:
            return c.with_col(F.filter(c.col, lambda x: column_matches(x["resourceType"], name)))
        if c.fields is not None:
            return replace(c, guard=column_matches(c.fields["resourceType"][0], name))
        return c.with_col(F.when(column_matches(c.col["resourceType"], name), c.col))

    # operators

    def visit_binary(self, node: N.Binary) -> Coll:
        left, right = self.visit(node.left), self.visit(node.right)
        op = node.op
        if op in ("and", "or", "xor", "implies"):
            a, b = self.boolean(left), self.boolean(right)
            return Coll("boolean", {"and": lambda: a & b, "or": lambda: a | b, "xor": lambda: a != b, "implies": lambda: ~a | b}[op]())
        if op == "=":
            return self.equal(left, right)
        if op == "!=":
            got = self.equal(left, right)
            return got if got.kind == "empty" else Coll("boolean", ~got.col)
        if op in ("~", "!~"):
            same = self.equivalent(left, right)
            return Coll("boolean", same if op == "~" else ~same)
        if op in ("<", "<=", ">", ">="):
            return self.order(op, left, right)
        if op == "|":
            return self.union(left, right)
        if op == "in":
            return self.contained(left, right)
        if op == "contains":
            return self.contained(right, left)
        if op == "&":
            return Coll("string", F.concat(self._as_text(left), self._as_text(right)))
        return self.arithmetic(op, self.one(left, op), self.one(right, op))

    def _as_text(self, c: Coll) -> Column:
        c = choice_item(c, "string")
        if c.kind != "string":
            return F.lit("")
        return F.coalesce(first(c).col, F.lit(""))

    def pair(self, a: Coll, b: Coll) -> tuple[Coll, Coll]:
        """Operands of one kind where they can be: choices resolved, JSON quantities read."""
        a = choice_item(a, b.kind if b.kind != "choice" else b.variants[0][1].kind)
        b = choice_item(b, a.kind)
        if a.kind == "quantity" and is_quantity(b):
            b = as_quantity(b)
        if b.kind == "quantity" and is_quantity(a):
            a = as_quantity(a)
        return a, b

    def equal_items(self, a: Coll, b: Coll) -> Column:
        """Equality of two singletons; null if either is empty."""
        a, b = self.pair(a, b)
        if a.kind == "empty" or b.kind == "empty":
            return none("boolean")
        left, right = object_column(a), object_column(b)
        if a.kind in NUMERIC and b.kind in NUMERIC:
            return left == right
        if a.kind != b.kind:
            return F.when(left.isNotNull() & right.isNotNull(), F.lit(False))
        if a.kind in ("date", "time", "datetime"):
            return bound(a, b, lambda p, q: temporal.equal(a.kind, p.col, q.col))
        if a.kind == "quantity":

            def same(p, q):
                comparable, x, y = temporal.quantity_pair(p, q)
                return F.when(p.col.isNotNull() & q.col.isNotNull(), F.coalesce(comparable & (x == y), F.lit(False)))

            return bound(a, b, same)
        if a.kind == "object":
            return F.to_json(left) == F.to_json(right)
        return left == right

    def equal(self, a: Coll, b: Coll) -> Coll:
        if a.kind == "empty" or b.kind == "empty":
            return EMPTY
        if self.spec and (a.many or b.many):
            x, y = self.together(a, b)
            return Coll("boolean", F.when((F.size(x.col) > 0) & (F.size(y.col) > 0), x.col == y.col))
        return Coll("boolean", self.equal_items(self._lone(a), self._lone(b)))

    def _lone(self, c: Coll) -> Coll:
        """The item of a collection of one; empty if there are more."""
        if c.kind == "choice":
            return replace(c, variants=tuple((s, self._lone(v)) for s, v in c.variants))
        return c.with_col(let(c.col, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))), False) if c.many else c

    def equivalent(self, a: Coll, b: Coll) -> Column:
        """Never null."""
        n, m = size(a), size(b)
        if a.kind == "empty" or b.kind == "empty":
            return (n == 0) & (m == 0)
        x, y = self.pair(self._lone(a), self._lone(b))
        if x.kind == "string" and y.kind == "string":
            plain = lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s+", " "))
            same = plain(x.col) == plain(y.col)
        elif x.kind == "quantity" and y.kind == "quantity":
            comparable, p, q = temporal.quantity_pair(x, y)
            most = F.greatest(F.abs(p), F.abs(q))
            near = F.when(most == 0, F.lit(True)).otherwise(F.abs(p - q) / most <= 1e-10)
            folded = F.lower(x.col["unit"]) == F.lower(y.col["unit"])
            same = F.when(folded, x.col["value"] == y.col["value"]).otherwise(comparable & near)
        else:
            same = self.equal_items(x, y)
        return F.when((n == 0) & (m == 0), F.lit(True)).when((n != 1) | (m != 1), F.lit(False)).otherwise(F.coalesce(same, F.lit(False)))

    def order(self, op: str, a: Coll, b: Coll) -> Coll:
        a, b = self.pair(self.one(a, op), self.one(b, op))
        if a.kind == "empty" or b.kind == "empty":
            return EMPTY
        compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        if (a.kind in NUMERIC and b.kind in NUMERIC) or (a.kind == b.kind == "string"):
            return Coll("boolean", compare(a.col, b.col))
        both = object_column(a).isNotNull() & object_column(b).isNotNull()
        if a.kind == b.kind and a.kind in ("date", "time", "datetime"):
            sign = bound(a, b, lambda p, q: temporal.compare(a.kind, p.col, q.col))
            if not self.strict:
                return Coll("boolean", compare(sign, F.lit(0)))
            return Coll("boolean", self.fail(both & sign.isNull(), f"{op}: ambiguous precision", compare(sign, F.lit(0))))
        if a.kind == b.kind == "quantity":

            def ordered(p, q):
                comparable, x, y = temporal.quantity_pair(p, q)
                return self.fail(~comparable, f"{op}: incompatible units", compare(x, y))

            return Coll("boolean", bound(a, b, ordered))
        if self.strict:
            return Coll("boolean", self.fail(both, f"{op}: {a.kind} and {b.kind} can't be compared", none("boolean")))
        return Coll("boolean", none("boolean"))

    def arithmetic(self, op: str, a: Coll, b: Coll) -> Coll:
        if a.kind == "empty" or b.kind == "empty":
            return EMPTY
        a, b = self.pair(a, b)
        if op in "+-" and a.kind in ("date", "datetime") and b.kind == "quantity":
            return Coll(a.kind, bound(a, b, lambda p, q: temporal.add(a.kind, p.col, q.col, 1 if op == "+" else -1, self.spec, b.literal if isinstance(b.literal, str) else None)))
        if op in "+-" and a.kind == b.kind == "quantity":
            same = (a.col["unit"] == b.col["unit"]) | (a.col["unit"] == "") | (b.col["unit"] == "")
            value = F.round(a.col["value"] + b.col["value"] if op == "+" else a.col["value"] - b.col["value"], 12)
            unit = F.when(a.col["unit"] == "", b.col["unit"]).otherwise(a.col["unit"])
            made = F.when(a.col.isNotNull() & b.col.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))
            return Coll("quantity", self.fail(~same, f"{op}: different units", made))
        if op == "+" and a.kind == b.kind == "string":
            return Coll("string", F.concat(a.col, b.col))
        if a.kind not in NUMERIC or b.kind not in NUMERIC:
            raise InvalidOperation(f"{a.kind} {op} {b.kind}")
        whole = a.kind == b.kind == "integer"
        if op in ("div", "mod"):
            if not whole and not self.spec:
                raise InvalidOperation(f"{op} takes Integers")
            x, y = a.col, F.nullif(b.col, F.lit(0).cast(SPARK_TYPES[b.kind]))
            if op == "mod":
                got = F.try_mod(x, y)
            else:
                got = F.call_function("div", x, y) if whole else (x / y).cast("long").cast("double")
            return Coll("integer" if whole else "decimal", self.fail(b.col == 0, "division by zero", got))
        if op == "/":
            got = a.col.cast("double") / F.nullif(b.col.cast("double"), F.lit(0.0))
            return Coll("decimal", self.fail(b.col == 0, "division by zero", F.round(got, 16)))
        if whole:
            return Coll("integer", {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col))
        x, y = a.col.cast("double"), b.col.cast("double")
        return Coll("decimal", F.round({"+": x + y, "-": x - y, "*": x * y}[op], 12))

    # sets

    def together(self, *colls: Coll) -> list[Coll]:
        """The collections as arrays of one item type: numbers widened, JSON quantities read, other mixtures as text."""
        kinds = {c.kind for c in colls if c.kind != "empty"}
        if not kinds:
            return [Coll("string", to_many(c), True) for c in colls]
        if len(kinds) == 1 and kinds != {"choice"}:
            kind, model = next(iter(kinds)), next(c for c in colls if c.kind != "empty")
            empty = F.slice(to_many(model), F.lit(1), F.lit(0))
            return [Coll(kind, empty if c.kind == "empty" else to_many(c), True, model.dtype) for c in colls]
        if kinds <= NUMERIC:
            return [Coll("decimal", (F.array() if c.kind == "empty" else to_many(c)).cast("array<double>"), True) for c in colls]
        return [self.texts(c) for c in colls]

    def texts(self, c: Coll) -> Coll:
        if c.kind == "choice":
            return Coll("string", F.concat(*[self.texts(v).col for _, v in c.variants]), True)
        items = to_many(c)
        return Coll("string", items if c.kind in ("string", "empty") else F.transform(items, lambda x: self.text(replace(c, col=x, many=False, fields=None))), True)

    def text(self, c: Coll) -> Column:
        """An item as text."""
        if c.kind in ("date", "time", "datetime"):
            return let(c.col, lambda x: temporal.text(c.kind, x))
        if c.kind == "quantity":
            return let(c.col, temporal.quantity_text)
        if c.kind == "decimal":
            return temporal.number_text(c.col)
        if c.kind == "object":
            return F.to_json(object_column(c))
        if c.kind == "empty":
            return none()
        return c.col.cast("string")

    def is_in(self, items: Coll, x: Column) -> Column:
        """Whether x equals an item; false for none."""
        if items.kind in ("quantity", "datetime"):
            one = replace(items, many=False, literal=None)
            return F.exists(items.col, lambda y: F.coalesce(self.equal_items(replace(one, col=x), replace(one, col=y)), F.lit(False)))
        return F.coalesce(F.array_contains(items.col, x), F.lit(False))

    def distinct(self, c: Coll) -> Coll:
        return Coll(c.kind, F.array_distinct(to_many(c)), True, c.dtype) if c.kind not in ("choice", "empty") else self.texts(c)

    def union(self, a: Coll, b: Coll) -> Coll:
        x, y = self.together(a, b)
        if self.spec:
            return x.with_col(F.array_distinct(F.concat(x.col, y.col)))
        return x.with_col(let(x.col, lambda l: F.concat(l, F.filter(F.array_distinct(y.col), lambda v: ~self.is_in(x.with_col(l), v)))))  # noqa: E741

    def contained(self, item: Coll, items: Coll) -> Coll:
        if item.kind == "empty":
            return EMPTY
        lone, all_items = self.together(self._lone(item), items)
        return Coll("boolean", let(lone.col, lambda x: F.when(F.size(x) == 1, self.is_in(all_items, F.get(x, F.lit(0))))))


def single(c: Coll) -> Coll:
    if c.many:
        raise SingletonExpected("one item expected")
    return c
