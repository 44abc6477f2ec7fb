"""The compiler against the schema-less evaluator, on random documents and random expressions."""

import json
import random

from test_expressions import SCHEMA

from lumenpath.interp.evaluator import evaluate
from lumenpath.interp.values import text
from lumenpath.lang.errors import PathError
from lumenpath.operators import evaluate as E
from lumenpath.sources.documents import parse


def random_document(rng: random.Random) -> dict:
    maybe = lambda make: make() if rng.random() < 0.7 else None
    word = lambda: rng.choice(["a", "b", "Ab", " a ", "c1", "", "é", "10", "2.5", "true"])
    many = lambda make, most=4: [make() for _ in range(rng.randrange(most))]
    name = lambda: {k: v for k, v in (("use", maybe(word)), ("family", maybe(word)), ("given", maybe(lambda: many(word)))) if v is not None}
    full = {
        "resourceType": "Patient", "id": maybe(word), "active": maybe(lambda: rng.random() < 0.5), "age": maybe(lambda: rng.randrange(-5, 50)), "score": maybe(lambda: rng.randrange(-40, 40) / 8),
        "birthDate": maybe(lambda: rng.choice(["1990", "1990-02", "1990-02-28", "2024-02-29", "x"])), "name": maybe(lambda: many(name)),
        "telecom": maybe(lambda: many(lambda: {"system": word(), "rank": rng.randrange(4)})), "valueQuantity": maybe(lambda: {"value": rng.randrange(9) / 2, "unit": rng.choice(["kg", "g", "mg", "s"])}),
        "flags": maybe(lambda: many(lambda: rng.random() < 0.5)), "numbers": maybe(lambda: many(lambda: rng.randrange(5))), "words": maybe(lambda: many(word)),
    }
    return {k: v for k, v in full.items() if v is not None}


class Grower:
    """Random expressions that are typed, so that most of them have a value."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def pick(self, *ways):
        return self.rng.choice(ways)()

    def number(self, d=2):
        r = self.rng
        leaf = (lambda: "age", lambda: str(r.randrange(5)), lambda: "score", lambda: "numbers.first()", lambda: "name.count()", lambda: "numbers.sum()", lambda: "numbers.max()", lambda: "valueQuantity.value", lambda: "id.length()")
        if not d:
            return self.pick(*leaf)
        return self.pick(*leaf, lambda: f"({self.number(d - 1)} {r.choice('+-*')} {self.number(d - 1)})", lambda: f"-({self.number(d - 1)})", lambda: f"({self.number(d - 1)}).abs()", lambda: f"iif({self.truth(d - 1)}, age, 3)", lambda: "numbers.aggregate($this + $total, 1)")

    def text(self, d=2):
        leaf = (lambda: "id", lambda: "'a'", lambda: "words.first()", lambda: "name.family.first()", lambda: "words.join('-')", lambda: "words.last()")
        if not d:
            return self.pick(*leaf)
        return self.pick(*leaf, lambda: f"{self.text(d - 1)}.upper()", lambda: f"({self.text(d - 1)} & {self.text(d - 1)})", lambda: f"({self.text(d - 1)}).substring(0, 1)", lambda: f"({self.text(d - 1)}).trim()", lambda: f"iif({self.truth(d - 1)}, {self.text(d - 1)}, 'z')", lambda: f"{self.text(d - 1)}.replace('a', 'x')")

    def truth(self, d=2):
        r = self.rng
        leaf = (lambda: "active", lambda: "true", lambda: "words.exists()", lambda: "flags.allTrue()", lambda: "flags.first()", lambda: "{}", lambda: "name.given.empty()", lambda: "words.isDistinct()")
        if not d:
            return self.pick(*leaf)
        return self.pick(
            *leaf, lambda: f"({self.truth(d - 1)} {r.choice(['and', 'or', 'xor', 'implies'])} {self.truth(d - 1)})", lambda: f"({self.number(d - 1)} {r.choice(['<', '<=', '>', '>=', '=', '!='])} {self.number(d - 1)})",
            lambda: f"({self.text(d - 1)} {r.choice(['=', '~', '<', '!=', '!~'])} {self.text(d - 1)})", lambda: f"name.exists({r.choice(['use', 'family'])} = {self.text(0)})", lambda: f"name.all({r.choice(['given.exists()', 'use.exists()'])})",
            lambda: f"({self.truth(d - 1)}).not()", lambda: f"({self.text(0)} in words)", lambda: f"words contains {self.text(0)}", lambda: "valueQuantity > 1 'kg'", lambda: "birthDate.toDate() < @1990-02-28", lambda: f"({self.number(d - 1)}) is Integer",
        )

    def many(self, d=2):
        leaf = (lambda: "words", lambda: "name.given", lambda: "name.family", lambda: "telecom.system", lambda: "words.distinct()")
        if not d:
            return self.pick(*leaf)
        return self.pick(
            *leaf, lambda: f"({self.many(d - 1)} | {self.many(d - 1)})", lambda: f"{self.many(d - 1)}.where($this = {self.text(0)})", lambda: f"{self.many(d - 1)}.take({self.rng.randrange(3)})", lambda: f"{self.many(d - 1)}.skip({self.rng.randrange(3)})",
            lambda: f"{self.many(d - 1)}.select($this & '!')", lambda: "name.where(use.exists()).given", lambda: "name.select(given.first())", lambda: f"{self.many(d - 1)}.tail()", lambda: "telecom.where(rank > 1).system",
        )


def expected(expression: str, document: dict) -> list[str]:
    try:
        return [shown(text(x)) for x in evaluate(expression, json.dumps(document))]
    except (PathError, ArithmeticError):
        return []


def shown(x: str) -> str:
    try:
        return format(float(x), ".9g") if "." in x and x.strip() == x else x
    except ValueError:
        return x


def test_random(spark):
    rng = random.Random(20)
    documents = [random_document(rng) for _ in range(60)]
    df = parse(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "n long, json string").coalesce(1), "json", SCHEMA).cache()
    grow, wrong = Grower(rng), []
    for _ in range(6):
        made = [rng.choice([grow.number, grow.text, grow.truth, grow.many])() for _ in range(25)]
        rows = E.select(df, {f"e{i}": (e, "texts") for i, e in enumerate(made)}, ("n",)).collect()
        for r in rows:
            wrong += [(e, documents[r.n], got, want) for i, e in enumerate(made) if (got := [shown(x) for x in r[f"e{i}"]]) != (want := expected(e, documents[r.n]))]
    assert not wrong, (len(wrong), sorted({w[0] for w in wrong}, key=len)[:8], wrong[0])
